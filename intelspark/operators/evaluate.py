"""Evaluation of matching, parsing and extraction against labelled cases, and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark import rules


def check_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows were tested and passed per named check; one pass over the rows."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.col("n").alias("checked"), F.col(name).alias("passed")) for name in checks])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def contract_checks(prospects: DataFrame) -> DataFrame:
    """The scorecard's own promises: scores equal their parts, stay in range, nothing is missing."""
    p = rules.PRIORITY_POLICY
    parts = (
        F.floor(F.col("opportunity_score") * F.lit(p["opportunity_weight"])) + F.floor(F.col("evidence_confidence_score") * F.lit(p["evidence_confidence_weight"]))
        + F.floor(F.greatest(F.lit(0), F.lit(p["risk_headroom_cap"]) - F.col("risk_score")) * F.lit(p["risk_buffer_weight"])))
    groups = F.col("commercial_attractiveness_score") + F.col("immediacy_score") + F.col("product_fit_score")
    return check_counts(prospects, {
        "priority_matches_parts": F.col("priority_score") == F.least(parts, F.lit(100)),
        "opportunity_matches_groups": F.col("opportunity_score") == F.least(groups, F.lit(100)),
        "scores_in_range": F.col("priority_score").between(0, 100) & F.col("risk_score").between(0, 100),
        "required_parts_present": F.col("status").isNotNull() & F.col("priority_level").isNotNull(),
    })


def identity_accuracy(matched: DataFrame, cases: DataFrame) -> DataFrame:
    """Labelled texts against the company they were matched to; a case may expect no match."""
    joined = cases.join(matched.select("case_id", "company_id", "alias"), "case_id", "left")
    ok = F.when(
        F.col("should_match"), F.col("company_id").eqNullSafe(F.col("expected_company_id")) & F.col("alias").eqNullSafe(F.col("expected_alias"))
    ).otherwise(F.col("company_id").isNull())
    return joined.select("case_id", "company_id", "alias", ok.alias("passed"))


def expected_found(cases: DataFrame, expected: str, actual: str, out: str = "passed") -> DataFrame:
    """Is every expected value among the actual ones."""
    missing = F.array_except(F.coalesce(F.col(expected), F.array()), F.coalesce(F.col(actual), F.array()))
    return cases.withColumn("missing", missing).withColumn(out, F.size("missing") == 0)


def extraction_checks(cases: DataFrame, gated: DataFrame) -> DataFrame:
    """Nine named checks per extraction case, as a long table of booleans.

    ``cases``: case_id, content and arrays of expected values. ``gated``: one row per proposed
    fact with its verdict (case_id, fact_type, name, kind, quote, eligible, accepted, evidence_ok).
    A case has a handful of facts, so its collected arrays are short.
    """
    ok = F.col("accepted")
    per_case = gated.groupBy("case_id").agg(
        F.collect_set(F.when(ok, F.col("fact_type"))).alias("fact_types"),
        F.collect_set(F.when(ok & (F.col("fact_type") == "metric"), F.lower("name"))).alias("metric_names"),
        F.collect_set(F.when(ok & (F.col("fact_type") == "business_event"), F.col("kind"))).alias("event_types"),
        F.collect_set(F.when(ok & (F.col("fact_type") == "risk_factor"), F.col("kind"))).alias("risk_categories"),
        F.collect_set(F.when(ok & F.col("eligible"), F.col("fact_type"))).alias("eligible_types"),
        F.collect_set(F.when(ok & ~F.col("eligible"), F.col("fact_type"))).alias("context_types"),
        F.coalesce(F.bool_and(F.when(ok, F.col("evidence_ok"))), F.lit(True)).alias("evidence_valid"),
        F.coalesce(F.bool_and(F.when(ok & F.col("eligible"), F.col("fact_type").isin("metric", "risk_factor", "business_event"))), F.lit(True)).alias("gate_valid"),
    )
    joined = cases.join(per_case, "case_id", "left")
    none = F.array().cast("array<string>")
    inside = lambda want, have: F.size(F.array_except(F.coalesce(F.col(want), none), F.coalesce(F.col(have), none))) == 0
    checks = {
        "quotes_present": F.forall(F.coalesce("quote_substrings", none), lambda q: F.contains(F.col("content"), q)),
        "fact_types": inside("expected_fact_types", "fact_types"),
        "metric_names": inside("expected_metric_names", "metric_names"),
        "business_event_types": inside("expected_event_types", "event_types"),
        "risk_categories": inside("expected_risk_categories", "risk_categories"),
        "scoring_eligible_types": inside("expected_eligible_types", "eligible_types"),
        "context_only_types": inside("expected_context_types", "context_types"),
        "evidence_valid": F.coalesce("evidence_valid", F.lit(True)),
        "eligibility_gate": F.coalesce("gate_valid", F.lit(True)),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), test.alias("passed")) for name, test in checks.items()])
    return joined.select("case_id", F.explode(rows).alias("c")).select("case_id", "c.*")
