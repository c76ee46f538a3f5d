"""Run ledgers: one summary row per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_status(scanned: Column, errors: Column) -> Column:
    return F.when(errors == 0, "success").when(errors < scanned, "partial_success").otherwise("failed")


def job_summary(outcomes: DataFrame) -> DataFrame:
    """Counters and status from one boolean ``failed`` column per work item."""
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(~F.col("failed")).alias("succeeded"),
        F.count_if(F.col("failed")).alias("errors"),
    )
    return counts.withColumn("status", run_status(F.col("scanned"), F.col("errors")))


def source_ledger(outcomes: DataFrame, run_id: str) -> DataFrame:
    """Per-source fetched and inserted counts of one ingestion run, with the run's status per source."""
    per_source = outcomes.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if("inserted").alias("inserted"),
        F.count_if("failed").alias("errors"),
    )
    return per_source.select(
        F.lit(run_id).alias("run_id"), "*", run_status(F.col("fetched"), F.col("errors")).alias("status")
    )
