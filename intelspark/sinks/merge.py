"""Idempotent appends, upserts and replace-children writes without a transactional table format.

Each function returns the rows to append or the new state; writers put them into a new folder.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark.functions.links import content_hash
from intelspark.operators.serving import latest_by

# The fields each table's row hash is made of.
SIGNAL_HASH_FIELDS = ("company_id", "entity", "indicator", "event_time", "value_num", "value_text", "extra")
TIMELINE_HASH_FIELDS = ("company_id", "entity", "event_time", "event_type", "headline", "source")


def with_hash(rows: DataFrame, fields, out: str) -> DataFrame:
    return rows.withColumn(out, content_hash([f for f in fields if f in rows.columns]))


def _first(batch: DataFrame, keys: list[str], order: tuple[Column, ...]) -> DataFrame:
    """One row per key: the first in ``order``, ties and no order settled by content, so that a rerun picks the same."""
    return latest_by(batch, keys, *order, F.asc(F.to_json(F.struct(*[F.col(c) for c in batch.columns if c not in keys] or [F.lit(1)]))))


def _same_keys(keys: list[str], target: str, batch: str) -> Column:
    """Null keys equal null keys."""
    return reduce(and_, [F.equal_null(F.col(f"{target}.{k}"), F.col(f"{batch}.{k}")) for k in keys])


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of the batch the target lacks, the first per key in ``order``: insert-or-ignore.

    The window keeps one row per key before its shuffle, so repeated deliveries of one key stay
    small. A null key is a key: it is new only while the target holds none.
    """
    return _first(batch, keys, order).alias("new").join(target.select(*keys).alias("old"), _same_keys(keys, "old", "new"), "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update: bool = True, columns: list[str] | None = None, *order: Column) -> DataFrame:
    """New state of the target: unseen keys added, seen keys updated (or left alone).

    Columns that only the batch has are added to the target.
    """
    if not update:
        return target.unionByName(new_rows(target, batch, keys, *order), allowMissingColumns=True)
    first = _first(batch, keys, order)
    extra = [F.lit(None).cast(first.schema[c].dataType).alias(c) for c in first.columns if c not in target.columns]
    old = target.select("*", *extra, F.lit(True).alias("had")).alias("old")
    joined = old.join(first.withColumn("given", F.lit(True)).alias("new"), _same_keys(keys, "old", "new"), "full")
    changed = columns or first.columns

    def value(c: str) -> Column:
        was, now = F.col(f"old.{c}"), F.col(f"new.{c}") if c in first.columns else F.lit(None)
        if c in keys:
            return F.coalesce(was, now)
        if c in changed and c in first.columns:
            return F.when(F.col("given"), now).otherwise(was)
        return F.when(F.col("had"), was).otherwise(now)

    rest = [c for c in old.columns if c not in keys and c != "had"]
    return joined.select(*[value(c).alias(c) for c in keys + rest])


def set_state(states: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Single-key workflow state upsert that stamps the time."""
    stamped = changes.withColumn("updated_at", now)
    return upsert(states, stamped, ["prospect_id"])


def replace_children(children: DataFrame, batch: DataFrame, index: str, *order: Column) -> DataFrame:
    """Child rows with the batch's documents replaced and densely numbered."""
    from pyspark.sql import Window as W

    numbered = batch.withColumn(index, F.row_number().over(W.partitionBy("document_id").orderBy(*order)) - 1)
    kept = children.join(batch.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(numbered.select(*children.columns))


def persist_batch(targets: dict[str, DataFrame], batch: dict[str, DataFrame], keys: dict[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows to append per table and one (table, inserted) count row each."""
    fresh = {name: new_rows(targets[name], rows, keys[name]) for name, rows in batch.items()}
    counts = None
    for name, rows in fresh.items():
        part = rows.agg(F.count(F.lit(1)).alias("inserted")).select(F.lit(name).alias("table"), "inserted")
        counts = part if counts is None else counts.unionByName(part)
    return fresh, counts


def append_new(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append a batch of new rows to a table folder."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def legacy_records(old: DataFrame) -> DataFrame:
    """Old-layout raw rows as facts with inferred type and defaults."""
    from intelspark.operators.classify import record_type

    return old.select(
        "source", "dataset", "record_key", "content_hash", record_type(F.col("source"), F.col("dataset")).alias("record_type"), "event_time",
        F.coalesce("title", "record_key").alias("title"), "payload")


def legacy_timeline(records: DataFrame) -> DataFrame:
    from intelspark.operators.classify import timeline_of

    filled = records.select("*", *[F.lit(None).cast("string").alias(c) for c in ("company_id", "entity", "summary") if c not in records.columns])
    return timeline_of(filled, F.col("record_type"))


def legacy_signals(old: DataFrame) -> DataFrame:
    """Old-layout metric rows as signals with inferred types."""
    from intelspark.operators.classify import signal_type

    return old.select(
        "source", "dataset", F.concat_ws("|", "dataset", "event_time", "indicator").alias("signal_key"),
        signal_type(F.col("indicator"), F.col("dataset")).alias("signal_type"), "event_time", "indicator", F.col("value").alias("value_num"))


def migrate_once(existing: DataFrame, migrated: DataFrame) -> DataFrame:
    """Migrated rows only while the new table is empty."""
    empty = existing.agg((F.count(F.lit(1)) == 0).alias("e")).scalar()
    return migrated.filter(empty)


# Column order of the news export.
CSV_COLUMNS = ("source", "date", "datetime", "title", "link", "description", "language", "signal_type", "matched")


def export_csv(rows: DataFrame, path: str) -> None:
    """News export with the fixed columns and a yes/no flag."""
    flag = F.when(F.col("matched"), "yes").otherwise("no")
    rows.withColumn("matched", flag).select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
