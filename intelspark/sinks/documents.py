"""Parsed documents on disk: a new parse replaces a document's rows in every child table, and what was derived from the old ones goes.

Each table lies below ``<root>/<table>/bucket=<n>``, a document's rows of all tables in the bucket of its id. Only
buckets of documents that really changed are written again, by dynamic partition overwrite, documents last: a job that died
before that finds the documents unchanged and does its work again, one that finished finds nothing to do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelspark.session import cut_lineage

BUCKETS = 256
DERIVED = {"chunks": "document_id", "embeddings": "chunk_id"}


class DocumentStore:
    """``documents`` (document_id, content_hash, parse_version, ...) with its children, chunks (document_id, chunk_id) and embeddings (chunk_id)."""

    def __init__(self, spark: SparkSession, root: str, children: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.root, self.children, self.buckets = spark, root, children, buckets

    def _place(self, below: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._place(f"{name}/bucket=*")
        return len(files.globStatus(path)) > 0

    def read(self, name: str) -> DataFrame | None:
        """The rows of a table, None while there are none."""
        return self.spark.read.parquet(f"{self.root}/{name}") if self._exists(name) else None

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def changed(self, documents: DataFrame) -> DataFrame:
        """Documents that the store lacks in this content and version."""
        old = self.read("documents")
        if old is None:
            return documents
        keys = ["document_id", "content_hash", "parse_version"]
        buckets = documents.select(self._bucket("document_id").alias("bucket")).distinct()
        return documents.join(old.join(buckets, "bucket", "left_semi").select(*keys), keys, "left_anti")

    def _rewrite(self, name: str, key: str, gone: DataFrame, rows: DataFrame | None) -> None:
        """Writes the buckets of ``gone`` (key) without its rows and with new ones; a bucket that is left without a row is emptied."""
        old = self.read(name)
        if old is None and rows is None:
            return
        parts = [] if rows is None else [rows.withColumn("bucket", self._bucket(key))]
        touched = gone.select(self._bucket(key).alias("bucket")).distinct()
        if old is not None:
            parts.insert(0, old.join(touched, "bucket", "left_semi").join(gone.select(key), key, "left_anti"))
        kept = cut_lineage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
        numbers = lambda df: {r.bucket for r in df.select("bucket").distinct().collect()}  # noqa: E731  as many as there are buckets at most
        emptied = set() if old is None else numbers(old.join(touched, "bucket", "left_semi")) - numbers(kept)
        kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")
        for bucket in emptied:
            path, files = self._place(f"{name}/bucket={bucket}")
            files.delete(path, True)

    def replace(self, tables: dict[str, DataFrame]) -> int:
        """Takes a batch of parsed documents with their children; returns how many documents were written.

        A document that is there in this content and version is left alone. Of a changed one, the rows of all
        children are replaced, also where the new parse has none, and its chunks and their embeddings are deleted, so
        that the jobs which build those find it without any.
        """
        new = cut_lineage(self.changed(tables["documents"]))
        count = new.count()
        if not count:
            return 0
        gone = new.select("document_id").distinct()
        chunks = self.read("chunks")
        if chunks is not None:
            dead = cut_lineage(chunks.join(gone, "document_id", "left_semi").select("chunk_id"))
            self._rewrite("embeddings", "chunk_id", dead, None)
            self._rewrite("chunks", "document_id", gone, None)
        for name in self.children:
            rows = tables.get(name)
            self._rewrite(name, "document_id", gone, None if rows is None else rows.join(gone, "document_id", "left_semi"))
        self._rewrite("documents", "document_id", gone, new)
        return count

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows derived from documents (chunks, embeddings) that the store lacks, into their buckets."""
        key = DERIVED[name]
        placed = rows.withColumn("bucket", self._bucket(key))
        old = self.read(name)
        if old is not None:
            placed = placed.join(old.join(placed.select("bucket").distinct(), "bucket", "left_semi").select("chunk_id"), "chunk_id", "left_anti")
        cut_lineage(placed).write.mode("append").partitionBy("bucket").parquet(f"{self.root}/{name}")
