"""Several tables committed together: versioned folders per batch, and one manifest that makes them count.

A batch writes its rows of every table below ``<root>/<table>/batch=<id>/day=<day>`` and then one row per table to
``<root>/manifest/batch=<id>``. Readers only see batches with a manifest, so a batch that died half-way is not
there at all; run again, it overwrites what it left. A batch whose manifest exists is not written again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from intelspark.operators.serving import latest_by
from intelspark.sinks.merge import new_rows


@dataclass(frozen=True)
class VersionedTable:
    """Schema, key and policy of one table: unseen keys are added, or with ``update`` the last version of a key counts."""

    name: str
    schema: StructType
    keys: tuple[str, ...]
    time: str | None = None  # its day prunes the search for keys: a key always comes with the same time
    update: bool = False
    order: str | None = None  # within a batch, the last row of a key in this order is kept by ``update``, the first otherwise


def _observed(rows: Observation) -> int:
    """The count a job observed; none came where Spark saw beforehand that there are no rows and left the step out."""
    try:
        return rows.get.get("n", 0)
    except Py4JJavaError:
        return 0


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str, *tables: VersionedTable):
        self.spark, self.root, self.tables = spark, root, {t.name: t for t in tables}

    def _exists(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def manifest(self) -> DataFrame:
        """(batch, table, scanned, inserted) of every committed batch."""
        ddl = "table string, scanned long, inserted long, batch string"
        if not self._exists(f"{self.root}/manifest"):
            return self.spark.createDataFrame([], ddl).select("batch", "table", "scanned", "inserted")
        return self.spark.read.schema(ddl).parquet(f"{self.root}/manifest").select("batch", "table", "scanned", "inserted")

    def versions(self, name: str, days: list[str] | None = None) -> DataFrame:
        """All committed rows of a table with batch and day; ``days`` reads those folders only."""
        table = self.tables[name]
        schema = StructType([*table.schema.fields]).add("batch", "string").add("day", "string")
        if not self._exists(f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        rows = rows if days is None else rows.filter(F.col("day").isin(days))
        return rows.join(self.manifest().filter(F.col("table") == name).select("batch"), "batch", "left_semi").select(*schema.names)

    def read(self, name: str) -> DataFrame:
        """The table as of now; of an updated key, the row of the last batch."""
        table, rows = self.tables[name], self.versions(name)
        if table.update:
            ids = self.manifest().filter(F.col("table") == name)
            order = [F.desc(F.regexp_extract("batch", r"(\d+)$", 1).cast("long")), F.desc("batch")]
            rows = latest_by(rows.join(ids.select("batch"), "batch", "left_semi"), list(table.keys), *order)
        return rows.select(*table.schema.names)

    def fresh(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a batch to write, with their day. Keys are looked for in the days of the batch only, whatever the table holds."""
        table = self.tables[name]
        day = F.lit("all") if table.time is None else F.coalesce(F.date_format(table.time, "yyyy-MM-dd"), F.lit("none"))
        rows = rows.select(*table.schema.names).withColumn("day", day)
        order = [] if table.order is None else [(F.desc_nulls_last if table.update else F.asc_nulls_last)(table.order)]
        if table.update:
            rest = F.asc(F.to_json(F.struct(*table.schema.names)))
            return latest_by(rows, list(table.keys), *order, rest)
        days = [r.day for r in rows.select("day").distinct().collect()]  # calendar days of one batch
        return new_rows(self.versions(name, days), rows, list(table.keys), *order)

    def commit(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Writes a batch of several tables; False if it is there already. Counts come from the writing jobs themselves."""
        if self._exists(f"{self.root}/manifest/batch={batch}"):
            return False
        counts = []
        for name, rows in tables.items():
            scanned, inserted = Observation(), Observation()
            seen = rows.observe(scanned, F.count(F.lit(1)).alias("n"))
            out = self.fresh(name, seen).observe(inserted, F.count(F.lit(1)).alias("n"))
            out.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/{name}/batch={batch}")
            counts.append((name, _observed(scanned), _observed(inserted)))
        found = self.spark.createDataFrame(counts, "table string, scanned long, inserted long")
        found.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
        return True

    def writer(self, stream: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: every micro-batch becomes one commit over all tables, known by the stream's name and number."""

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                self.commit(f"{stream}-{batch_id}", split(batch))
            finally:
                batch.unpersist()

        return write
