"""User collectors as Spark data sources: a class says what it collects, Spark deals its parts to tasks and keeps its stream's offset.

    class Rates(Collector):
        source = "rates"
        tables = {"facts": "source string, record_key string, value double"}

        def parts(self, options): return ["2024-01", "2024-02"]
        def collect(self, options, part): yield "facts", {"source": "rates", "record_key": part, "value": 1.0}

    register(spark, Rates)
    store.commit("rates-1", batch_tables(spark.read.format("rates").load(), Rates))
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Collector(DataSource):
    """Base of user collectors: rows of several tables in one pass, each tagged with its table."""

    source = "collector"
    tables: dict[str, str] = {}

    def parts(self, options: dict) -> list:
        """What one task collects, per task; anything that pickles."""
        return [None]

    def collect(self, options: dict, part) -> Iterator[tuple[str, dict]]:
        """(table, row) of one part. A part whose task was lost is collected again, so it should always yield the same."""
        raise NotImplementedError

    def position(self, options: dict) -> int:
        """For streams: how many parts there are by now. Parts may be added at the end, never changed."""
        return len(self.parts(options))

    @classmethod
    def name(cls) -> str:
        return cls.source

    def schema(self) -> str:
        return "table string, row string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self, dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self, dict(self.options))


class _Part(InputPartition):
    def __init__(self, part):
        self.part = part


def _rows(collector: Collector, options: dict, partition: _Part) -> Iterator[tuple[str, str]]:
    for table, row in collector.collect(options, partition.part):
        if table not in collector.tables:
            raise ValueError(f"{collector.source} yields rows of {table}, which is none of its tables")
        yield table, json.dumps(row, default=str, ensure_ascii=False)


class _Reader(DataSourceReader):
    def __init__(self, collector: Collector, options: dict):
        self.collector, self.options = collector, options

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.collector.parts(self.options)]

    def read(self, partition: _Part) -> Iterator[tuple[str, str]]:
        return _rows(self.collector, self.options, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, collector: Collector, options: dict):
        self.collector, self.options = collector, options

    def initialOffset(self) -> dict:
        return {"parts": 0}

    def latestOffset(self) -> dict:
        return {"parts": self.collector.position(self.options)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(p) for p in self.collector.parts(self.options)[start["parts"] : end["parts"]]]

    def read(self, partition: _Part) -> Iterator[tuple[str, str]]:
        return _rows(self.collector, self.options, partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, collector: type[Collector]) -> None:
    spark.dataSource.register(collector)


def batch_tables(rows: DataFrame, collector: type[Collector]) -> dict[str, DataFrame]:
    """The tables of collected rows, typed; a value that does not fit its column is null."""
    return {name: rows.filter(F.col("table") == name).select(F.from_json("row", ddl).alias("r")).select("r.*") for name, ddl in collector.tables.items()}
