"""Landed tables to serving tables: conform, upsert, incremental sync."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelspark.functions.times import loose_timestamp
from intelspark.operators.serving import latest_by
from intelspark.sinks.merge import new_rows, upsert


def conform(rows: DataFrame, json_fields=None, times=(), counts=()) -> DataFrame:
    """JSON texts to typed values, loose times to timestamps, missing counts to zero."""
    typed = {name: F.from_json(name, ddl) for name, ddl in (json_fields or {}).items()}
    stamped = {name: loose_timestamp(name) for name in times}
    filled = {name: F.coalesce(name, F.lit(0)) for name in counts}
    return rows.withColumns({**typed, **stamped, **filled})


def since(rows: DataFrame, run_id: str | None) -> DataFrame:
    """Rows of a run id at or after the given one; everything without one or without the column."""
    if run_id is None or "run_id" not in rows.columns:
        return rows
    return rows.filter(F.col("run_id") >= run_id)


@dataclass(frozen=True)
class TableSpec:
    """How one landed table goes to its serving table."""

    name: str
    keys: tuple[str, ...]
    update: bool = False
    json_fields: dict[str, str] = field(default_factory=dict)
    times: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()


# Natural keys and update policy of the synchronised tables.
TABLES = (
    TableSpec("ingestion_runs", ("run_id",), True, times=("started_at", "finished_at")),
    TableSpec("intelligence_records", ("source", "dataset", "record_key", "content_hash"), times=("event_time",)),
    TableSpec("trigger_signals", ("source", "dataset", "signal_key", "row_hash"), times=("event_time",)),
    TableSpec("client_one_view_timeline", ("source", "dedup_hash"), times=("event_time",)),
    TableSpec("generated_insights", ("dedup_hash",), times=("generated_at",)),
    TableSpec("companies", ("company_id", "row_hash"), times=("updated_at",)),
    TableSpec("company_mapping_audit", ("run_id", "target_table", "target_row_id", "new_company_id"), times=("mapped_at",)),
    TableSpec("parsing_runs", ("run_id",), True, times=("started_at", "finished_at")),
    TableSpec("parsed_documents", ("source_table", "source_id", "source_content_hash", "parse_version"), True, times=("parsed_at",),
              counts=("section_count", "table_count", "metric_count", "risk_factor_count", "business_event_count")),
    TableSpec("parsed_sections", ("document_id", "section_index"), True),
    TableSpec("parsed_tables", ("document_id", "table_index"), True),
    TableSpec("parsed_metrics", ("document_id", "metric_index"), True),
    TableSpec("parsed_risk_factors", ("document_id", "risk_index"), True),
    TableSpec("parsed_business_events", ("document_id", "event_index"), True),
)


ARRIVAL = "_arrival"  # column that tells which of several rows of a key came last


def landed_rows(spark: SparkSession, path: str) -> DataFrame:
    """A landed table with its rows' arrival: time and name of the file, then the place in it."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    return spark.read.parquet(path).select("*", place.alias(ARRIVAL))


def sync_table(spec: TableSpec, landed: DataFrame, target: DataFrame, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New state of a serving table and its one-row summary (scanned, inserted, skipped).

    Of several landed rows of a key the last arrived counts for a table that is updated, the first for one that is
    not; without an arrival column, content decides. Null keys are keys, in the state and in the counts.
    """
    present = lambda names: [n for n in names if n in landed.columns]
    rows = conform(since(landed, run_id), {k: v for k, v in spec.json_fields.items() if k in landed.columns}, present(spec.times), present(spec.counts))
    keys = list(spec.keys)
    once = rows
    if ARRIVAL in rows.columns:
        once = latest_by(rows, keys, F.desc(ARRIVAL) if spec.update else F.asc(ARRIVAL)).drop(ARRIVAL)
    merged = upsert(target, once, keys, update=spec.update)
    summary = rows.agg(F.count(F.lit(1)).alias("scanned")).select(
        F.lit(spec.name).alias("table"), "scanned", new_rows(target, once.select(*keys), keys).agg(F.count(F.lit(1))).scalar().alias("inserted"))
    return merged, summary.withColumn("skipped", F.col("scanned") - F.col("inserted"))


def sync(spark: SparkSession, landed: str, serving: str, version: str, previous: str | None = None, run_id: str | None = None, tables=TABLES) -> DataFrame:
    """Write every table's new state under ``serving/version``; returns the summaries.

    A new version folder is written and the old one stays as it is, so a job that dies half-way
    leaves the previous state readable and can simply be run again.
    """
    summaries = None
    for spec in tables:
        source = landed_rows(spark, f"{landed}/{spec.name}")
        empty = conform(source.drop(ARRIVAL), {k: v for k, v in spec.json_fields.items() if k in source.columns}, [t for t in spec.times if t in source.columns], [c for c in spec.counts if c in source.columns]).limit(0)
        target = spark.read.parquet(f"{serving}/{previous}/{spec.name}") if previous else empty
        merged, summary = sync_table(spec, source, target, run_id)
        merged.write.mode("overwrite").parquet(f"{serving}/{version}/{spec.name}")
        summaries = summary if summaries is None else summaries.unionByName(summary)
    return summaries
