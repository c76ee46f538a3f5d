"""Queries against their SQL on values that the given tables do not hold."""

import datetime
import os

import duckdb
import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a8_archive_window", "c10_statistics_rows"])
def test_edges_of_windows_and_numbers(spark, tmp_path, name):
    start, end = datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20)
    tick = datetime.timedelta(microseconds=500_000)
    times = [start - tick, start, start + tick, end - tick, end, end + tick, end + 2 * tick]
    users = [7, 2024, 2099, 202401, 20240105, 2100, 20245]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{SF}/events.parquet') LIMIT 0")
    names = [d[0] for d in con.execute("SELECT * FROM events").description]
    for i, (ts, user) in enumerate(zip(times, users)):
        row = {"event_id": i * 6, "ts": ts, "user_id": user, "event_type": "click", "value": 5.0, "props": "{}"}
        con.execute(f"INSERT INTO events SELECT {', '.join('?' for _ in names)}", [row[n] for n in names])
    con.execute(f"COPY events TO '{tmp_path / 'events.parquet'}' (FORMAT parquet)")
    assert oracle.compare(entry.queries()[name](spark, os.fspath(tmp_path)), con, entry.oracle_sql()[name]) == ""


def test_market_facts_are_read_once(spark):
    from intelspark.operators import resolve

    facts = spark.range(20).selectExpr("id", "'szse_cninfo' as source", "cast(id % 3 as string) as company_id", "concat('Name ', id) as title", "'{}' as payload", "if(id % 2 = 0, 'a', 'b') as industry")
    out = resolve.market_companies(facts, ["id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {r.company_id: list(r.industries) for r in out.collect()} == {"0": ["a", "b"], "1": ["b", "a"], "2": ["a", "b"]}
