"""Scores that need signal counts only: the light scorecard, priority, level and display bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark import rules

P = rules.PRIORITY_POLICY


def _whole(value: Column) -> Column:
    """Truncation towards zero."""
    return value.cast("int")


def priority_parts(opportunity: Column, confidence: Column, risk: Column) -> tuple[Column, Column, Column]:
    """The three separately truncated terms of the priority score."""
    headroom = F.greatest(F.lit(0), F.lit(P["risk_headroom_cap"]) - risk)
    return (
        _whole(opportunity * F.lit(float(P["opportunity_weight"]))),
        _whole(confidence * F.lit(float(P["evidence_confidence_weight"]))),
        _whole(headroom * F.lit(float(P["risk_buffer_weight"]))),
    )


def priority_score(opportunity: Column, confidence: Column, risk: Column) -> Column:
    a, b, c = priority_parts(opportunity, confidence, risk)
    return F.least(a + b + c, F.lit(100))


def priority_level(score: Column, status: Column) -> Column:
    return (
        F.when((status == "actionable") & (score >= P["high_priority_threshold"]), "high")
        .when(score >= P["medium_priority_threshold"], "medium")
        .otherwise("monitor")
    )


def light_scorecard(rollup: DataFrame) -> DataFrame:
    """Scores from signal counts alone."""
    n, o, r = F.col("signal_count"), F.col("opportunity_signal_count"), F.col("risk_signal_count")
    out = rollup.withColumns(
        {
            "status": F.when((o >= 2) | (r >= 2), "actionable").when(n > 0, "active").otherwise("monitor"),
            "opportunity_score": F.least(F.lit(100), o * 22 + n * 5 + F.when(n > 0, 8).otherwise(0)).cast("int"),
            "risk_score": F.least(F.lit(100), r * 20).cast("int"),
            "evidence_confidence_score": F.least(F.lit(100), n * 15 + F.when(o > 0, 20).otherwise(0)).cast("int"),
        }
    )
    score = priority_score(F.col("opportunity_score"), F.col("evidence_confidence_score"), F.col("risk_score"))
    return out.withColumn("priority_score", score).withColumn(
        "priority_level", priority_level(F.col("priority_score"), F.col("status"))
    )


def product_themes(tags: Column) -> Column:
    """Product themes suggested by the leading signal types, four at most."""

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))

    def some(test: Column, *names: str) -> Column:
        return F.when(test, F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))

    themes = F.concat(
        some(any_of("cross_border", "trade"), "cross-border payments", "trade finance", "treasury"),
        some(any_of("financing", "growth", "expansion", "acquisition", "m&a"), "working capital", "term loan", "cash management"),
        some(F.array_contains(tags, "market"), "capital markets"),
        some(any_of("risk", "regulatory", "compliance", "warning", "litigation", "risk_review"), "risk review"),
    )
    themes = F.array_distinct(themes)
    return F.when(F.size(themes) == 0, F.array(F.lit("Corporate Banking"))).otherwise(F.slice(themes, 1, 4))


def ranked(scored: DataFrame) -> list[Column]:
    """Ranking order: priority, opportunity, activity and id, all descending."""
    return [F.desc("priority_score"), F.desc("opportunity_score"), F.desc_nulls_last("activity_at"), F.desc("company_id")]


def tier(level: Column) -> Column:
    return F.when(level == "high", "A").when(level == "medium", "B").otherwise("C")


def score_band(score: Column, kind: str) -> Column:
    if kind == "risk":
        return F.when(score <= 10, "Low friction").when(score <= 35, "Manageable risk").otherwise("Elevated risk")
    if kind == "priority":
        return F.when(score >= 50, "High").when(score >= 38, "Medium").otherwise("Low")
    return (
        F.when(score >= 70, "Strong").when(score >= 40, "Moderate").when(score > 0, "Early signal").otherwise("No clear signal")
    )


def confidence_text(score: Column) -> Column:
    level = F.when(score >= 85, "High").when(score >= 70, "Moderate").otherwise("Review")
    return F.coalesce(
        F.concat(F.lit("Evidence confidence: "), level, F.lit(" ("), score.cast("string"), F.lit("/100)")),
        F.lit("Evidence linked"),
    )
