"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, packing; one Parquet table per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. The stages' outputs are written below the shared folder of the session and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelspark.llm import decontaminate, language, minhash, packing, secrets
from intelspark.llm.common import held_out, table
from intelspark.session import shared_folder


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects, also those without a letter; it is fitted on this stage's labelled documents.

    Columns named like those that the model adds keep their values: they bear other names while it runs.
    """
    model = language.fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    aside = {c: f"kept_{c}" for c in docs.columns if c not in ("doc_id", "text", "lang")}
    known = language.identify(docs.withColumnsRenamed(aside), model).filter(~F.col("lang_rejected"))
    return known.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class: five-word shingles, similarity of 0.8 or more.

    Rows of one id are one document, of which all rows stay or go.
    """
    found = minhash.near_duplicates(docs, words=5, num=80, den=100)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item, also an edited one; rows of one id go together."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; all documents stay, also those without text or id."""
    return secrets.redact(docs, secrets.fit(docs.select("doc_id", "text")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed in windows; a null text is an empty document."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]
ORACLE_SQL = None  # the stages' models and alignments are beyond SQL; tests/llm/test_pipeline.py compares them with plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir`` and returns the last one's rows."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
