"""Calls of an outside model on candidate paragraphs: batched, with an error per row, so that nothing is lost and the rest can be asked again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intelspark.functions.rows import spread_array

# Fixed value: the fields of a proposed fact that the evidence gate reads.
FACT_FIELDS = ("fact_type", "kind", "name", "value", "summary", "confidence", "chunk_id", "quoted_text")
FACT_DDL = "struct<" + ", ".join(f"{f}: string" for f in FACT_FIELDS) + ">"


def call_model(candidates: DataFrame, call: Callable[[list[dict]], list[list[dict]]], key: str = "document_id", size: int = 8) -> DataFrame:
    """(key, chunk_id, facts, error): what the model says of every candidate (key, chunk_id, heading if any, text).

    ``call`` takes up to ``size`` candidates as dictionaries and returns a list of facts for each. If it fails on several, or
    returns another number of lists, each of them is asked alone; one that fails alone keeps its error and has
    no facts. Every candidate has exactly one row, null texts and repeats too. The call runs in tasks, on Arrow
    batches; a lost task asks again.
    """
    names = [c for c in (key, "chunk_id", "heading", "text") if c in candidates.columns]
    kind = candidates.schema[key].dataType.simpleString()
    fact_type = pa.list_(pa.struct([(f, pa.string()) for f in FACT_FIELDS]))

    def ask(rows: list[dict]) -> list[tuple]:
        try:
            answers = call(rows)
            if len(answers) != len(rows):
                raise ValueError(f"{len(answers)} answers for {len(rows)} candidates")
            told = [[{f: None if fact.get(f) is None else str(fact[f]) for f in FACT_FIELDS} for fact in facts] for facts in answers]
            return [(facts, None) for facts in told]
        except Exception as failure:  # whatever a user's callable raises belongs to its rows, not to the job
            if len(rows) == 1:
                return [([], f"{type(failure).__name__}: {failure}")]
        return [answer for row in rows for answer in ask([row])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            told = [answer for at in range(0, len(rows), size) for answer in ask(rows[at : at + size])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("chunk_id"), pa.array([t[0] for t in told], fact_type), pa.array([t[1] for t in told], pa.string())],
                names=[key, "chunk_id", "facts", "error"])

    return candidates.select(*names).mapInArrow(work, f"{key} {kind}, chunk_id {candidates.schema['chunk_id'].dataType.simpleString()}, facts array<{FACT_DDL}>, error string")


def proposed_facts(results: DataFrame, key: str = "document_id") -> DataFrame:
    """The facts as the evidence gate takes them, numbered within the document's answers by chunk, then place."""
    from pyspark.sql import Window as W

    rows = spread_array(results.withColumnRenamed("chunk_id", "_asked"), [key, "_asked"], "facts", "f", "_at")
    rows = rows.select(key, "_asked", "_at", *[F.col(f"f.{f}").alias(f) for f in FACT_FIELDS]).withColumn("chunk_id", F.coalesce("chunk_id", "_asked"))
    order = W.partitionBy(key).orderBy("_asked", "_at", *[f for f in FACT_FIELDS if f != "chunk_id"])
    return rows.withColumn("pos", F.row_number().over(order)).drop("_asked", "_at")


def to_ask_again(candidates: DataFrame, results: DataFrame, key: str = "document_id") -> DataFrame:
    """Candidates whose call failed: the retry table, again in the form of candidates."""
    failed = results.filter(F.col("error").isNotNull()).select(key, "chunk_id").distinct()
    return candidates.join(failed, [key, "chunk_id"], "left_semi")
