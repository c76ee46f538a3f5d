"""Registered queries against their SQL on the smallest data folder.

CHECK_ALL=1 compares every query; by default one area's quick queries are compared.
"""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ("d1_", "d7_", "e3_", "e14_", "f3_", "g2_", "h1_", "s3_", "s5_", "c1_", "c18_", "k3_", "k8_", "k19_", "l3_", "l9_", "b1_", "b8_", "i24_", "j4_")
NAMES = [n for n in entry.oracle_sql() if os.environ.get("CHECK_ALL") or n.startswith(QUICK)]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_every_checker_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["e14_signals_of_prospects", "j4_match_company", "i12_priority_score"])
def test_no_pairwise_joins(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rank_cut_before_shuffle(spark):
    assert "WindowGroupLimit" in _plan(entry.queries()["g2_recent_signals"](spark, SF))
