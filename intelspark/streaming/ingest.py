"""Continuous ingestion with Structured Streaming.

A file stream delivers landed rows; repeats are dropped first by a watermarked state and then by a
comparison with the target table, so a batch replayed after a lost driver adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from intelspark.sinks.merge import append_new, new_rows

MIN_INTERVAL_SECONDS = 5  # fixed value: shortest pause between two ingestion rounds


def landed_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of a landing folder as a stream; the checkpoint remembers the ones already read."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def without_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str = "7 days") -> DataFrame:
    """Drop repeated deliveries; state older than the delay is forgotten, so it stays bounded."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def idempotent_append(path: str, keys: list[str], empty: DataFrame) -> Callable[[DataFrame, int], None]:
    """Batch writer that appends only rows the table lacks.

    The table is read again for every batch, so a batch that was written before its commit got
    lost finds its rows present and adds none.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        target = spark.read.schema(empty.schema).parquet(path) if exists else empty
        append_new(new_rows(target, batch, keys), path)

    return write


def start_ingestion(stream: DataFrame, writer, checkpoint: str, interval_seconds: int | None = None) -> StreamingQuery:
    """Run once over everything available, or repeatedly with a minimum pause."""
    out = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    if interval_seconds is None:
        return out.trigger(availableNow=True).start()
    return out.trigger(processingTime=f"{max(MIN_INTERVAL_SECONDS, interval_seconds)} seconds").start()

