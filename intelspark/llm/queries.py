"""Registered queries of the corpus operators: the contracts' columns, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelspark.llm import alignment, decontaminate, fertility, language, licenses, minhash, packing, personal, secrets, suffixes, toolcalls, toxicity, trie
from intelspark.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the model sees only labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.col("lang_rejected").alias("rejected"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: three-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document: base rules and bands of the vocabulary's measures per language."""
    return fertility.quality(table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the fixed patterns' spans and those that the Markov models add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs)).drop("text")


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the network learns from labels outside the held-out fold only."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"))
    model = toxicity.fit(docs.filter(~held), labels.filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, with the item and the alignment's score."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score")


REPLY = {"reply": [("turn", "BIGINT", True), ("text", "STRING", True)]}
ORACLES["op6_tool_calls"] = """
SELECT u.conv_id, u.turn * 1000000 AS position, 't' || u.turn AS call_id, 'reply' AS tool, a.turn IS NOT NULL AS linked, u.text IS NOT NULL AS valid, TRUE AS ordered,
  '{"arguments":{' || CASE WHEN u.text IS NULL THEN '' ELSE '"text":' || to_json(u.text) || ',' END || '"turn":' || u.turn || '},"id":"t' || u.turn || '","name":"reply","result":'
    || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS payload
FROM conversations u LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL) a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user'
"""


@query
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of the conversations as a call of ``reply``, linked to the assistant's answer."""
    return toolcalls.link(*toolcalls.turns_as_calls(table(spark, sf_dir, "conversations")), REPLY)


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations, with totals of their subtrees."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token alignment of every document between a byte-level and a piece vocabulary."""
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the fixed patterns' spans and those that the span classifier adds."""
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return personal.scan(table(spark, sf_dir, "documents")).withColumn("spans", spans).drop("found")
