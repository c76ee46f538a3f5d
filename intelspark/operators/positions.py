"""Dense numbering that never puts one large group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intelspark.session import cut_lineage

_BITS = 33  # row number within a partition, in the ids Spark generates


def number_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1-based position of every row within its group, for groups of any size.

    The rows are range-sorted over all tasks, so a hot group spans many of them. Positions are the
    running row counts of the sorted partitions; only one number per partition is summed up.
    The sorted rows are materialised once because both passes must see the same partitions.
    """
    ordered = df.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered).withColumn("_part", F.shiftright("_id", _BITS))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition of the sort: as small as the task list itself.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = ordered.join(F.broadcast(offsets), "_part").withColumn("_pos", F.col("_offset") + F.col("_id").bitwiseAND((1 << _BITS) - 1))
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    numbered = placed.join(first, keys).withColumn(out, F.col("_pos") - F.col("_first") + 1)
    return numbered.drop("_id", "_part", "_offset", "_pos", "_first")
