"""Document assembly, chunking, embedding and evidence retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from intelspark import rules
from intelspark.functions.rows import spread_array
from intelspark.functions.text import CJK_CLASS, blank_to_null, col, truncate
from intelspark.operators.serving import top_n

# One CJK character, a run of other letters, digits and underscores, or any other visible mark.
TOKEN_PATTERN = rf"[{CJK_CLASS}]|[[\p{{L}}\p{{N}}_]&&[^{CJK_CLASS}]]+|[^\s\p{{Z}}]"
TERM_PATTERN = rf"[{CJK_CLASS}]|[A-Za-z0-9]{{2,}}"


def source_rows(facts: DataFrame, signals: DataFrame, timeline: DataFrame) -> DataFrame:
    """Facts, signals that have text, and timeline events as one document source."""
    text = lambda name: F.lit(None).cast("string").alias(name)
    a = facts.select(
        F.lit("intelligence_records").alias("source_table"), F.col("id").alias("source_id"), "source", "dataset", "record_key",
        text("signal_key"), "entity", "company_id", "event_time", text("signal_type"), "title", "summary", "payload", text("signal_text"))
    b = signals.filter(F.col("signal_text") != "").select(
        F.lit("trigger_signals").alias("source_table"), F.col("id").alias("source_id"), "source", "dataset", text("record_key"),
        "signal_key", "entity", "company_id", "event_time", "signal_type", F.col("indicator").alias("title"), text("summary"),
        F.col("extra").alias("payload"), "signal_text")
    c = timeline.select(
        F.lit("client_one_view_timeline").alias("source_table"), F.col("id").alias("source_id"), "source",
        F.col("event_type").alias("dataset"), text("record_key"), text("signal_key"), text("entity"), "company_id", "event_time",
        text("signal_type"), F.col("headline").alias("title"), F.col("detail").alias("summary"), text("payload"), text("signal_text"))
    return a.unionByName(b).unionByName(c)


METADATA = ("source_table", "source_id", "source", "dataset", "record_key", "signal_key", "entity", "company_id", "event_time", "signal_type")


def build_documents(rows: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Searchable content, metadata and content hash per source row.

    ``parsed`` holds the latest parse per source row (source_table, source_id, search_text);
    rows without one fall back to their payload.
    """
    if parsed is not None:
        rows = rows.join(parsed.select("source_table", "source_id", "search_text"), ["source_table", "source_id"], "left")
    else:
        rows = rows.withColumn("search_text", F.lit(None).cast("string"))
    title = F.coalesce(*[blank_to_null(F.col(c)) for c in ("title", "dataset", "source_table")])
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    when = F.coalesce(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("None"))
    body = F.coalesce(blank_to_null(F.col("search_text")), part("Payload:\n", "payload"))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), title), F.concat(F.lit("Source: "), shown("source")), F.concat(F.lit("Dataset: "), shown("dataset")),
        F.concat(F.lit("Entity: "), shown("entity")), F.concat(F.lit("Event time: "), when),
        part("Summary: ", "summary"), part("Signal: ", "signal_text"), body,
    )
    metadata = F.to_json(F.struct(*METADATA), {"ignoreNullFields": "false"})
    return rows.select(
        *METADATA, title.alias("title"), content.alias("content"), metadata.alias("metadata"),
        F.sha2(F.concat_ws("\n", content, metadata), 256).alias("content_hash"),
    )


def supersede(existing: DataFrame, built: DataFrame) -> DataFrame:
    """What happens to each version of a source row: inserted, superseded or kept.

    Both sides are one row per source row and hash, so the outer join never multiplies.
    """
    keys = ["source_table", "source_id", "content_hash"]
    old = existing.select(*keys).distinct().withColumn("old", F.lit(True))
    new = built.select(*keys).distinct().withColumn("new", F.lit(True))
    touched = built.select("source_table", "source_id").distinct().withColumn("rebuilt", F.lit(True))
    both = old.join(new, keys, "full").join(touched, ["source_table", "source_id"], "left")
    action = (
        F.when(F.col("old") & F.col("new"), "kept").when(F.col("new"), "inserted").when(F.col("rebuilt"), "superseded").otherwise("kept")
    )
    return both.select(*keys, action.alias("action"))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.size(tokens(text)))


def join_tokens(parts: Column) -> Column:
    """Tokens joined by blanks, without one between two CJK characters."""
    return F.regexp_replace(F.array_join(parts, " "), rf"(?<=[{CJK_CLASS}]) (?=[{CJK_CLASS}])", "")


def chunk(df: DataFrame, key: list[str], text: str, size: int = rules.CHUNK_TOKENS, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping token windows of each text, numbered, hashed and counted.

    A text is cut within its own row by array functions; only the windows are exploded.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    n = F.size("_tokens")
    # The last window is the first one that reaches the end of the text.
    windows = F.when(n > 0, F.ceil(F.greatest(n - overlap, F.lit(1)) / F.lit(step)).cast("int")).otherwise(0)
    starts = F.when(windows > 0, F.sequence(F.lit(0), windows - 1)).otherwise(F.array().cast("array<int>"))
    out = df.select(*key, tokens(text).alias("_tokens")).withColumn(
        "_chunks",
        F.transform(starts, lambda i: F.struct(i.alias("chunk_index"), F.slice("_tokens", i * step + 1, F.lit(size)).alias("t"))),
    )
    out = spread_array(out, key, "_chunks", "c").select(
        *key, F.col("c.chunk_index").alias("chunk_index"), join_tokens(F.col("c.t")).alias("chunk_text"),
        F.size("c.t").alias("token_count"))
    return out.withColumn("chunk_hash", F.sha2("chunk_text", 256))


def documents_without_chunks(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    return documents.join(chunks.select(key).distinct(), key, "left_anti")


def chunks_without_embedding(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    mine = embeddings.filter(F.col("embedding_model") == model).select("chunk_id")
    return chunks.join(mine, "chunk_id", "left_anti")


def hash_embedding(dimensions: int):
    """Deterministic stand-in embedding: unit vectors drawn from a generator seeded by the text, of which Python sees only the hash."""

    @F.pandas_udf(ArrayType(FloatType()))
    def drawn(seeds: pd.Series) -> pd.Series:
        def one(seed):
            values = np.random.default_rng(int(seed, 16)).uniform(-1.0, 1.0, dimensions)
            return (values / (np.linalg.norm(values) or 1.0)).astype("float32")

        return seeds.map(one)

    def embed(text: Column | str) -> Column:
        return drawn(F.left(F.sha2(F.coalesce(col(text), F.lit("")), 256), F.lit(16)))

    return embed


def embed_missing(chunks: DataFrame, embeddings: DataFrame, model: str, dimensions: int = 64, embed=None) -> DataFrame:
    """Vectors of the chunks this model has none for; Arrow batches are the embedding batches."""
    embed = embed or hash_embedding(dimensions)
    missing = chunks_without_embedding(chunks, embeddings, model)
    return missing.select("chunk_id", F.lit(model).alias("embedding_model"), embed("chunk_text").alias("embedding"))


def query_terms(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(TERM_PATTERN), F.lit(0)))


def lexical_search(chunks: DataFrame, question: str, text: str, key: str, top_k: int = rules.RETRIEVAL_TOP_K, filters=None,
                   start=None, end=None) -> DataFrame:
    """Top chunks by the share of query terms they contain, for one question."""
    for name, value in (filters or {}).items():
        if value:
            chunks = chunks.filter(F.col(name) == value)
    if start is not None:
        chunks = chunks.filter(F.col("event_time") >= start)
    if end is not None:
        chunks = chunks.filter(F.col("event_time") <= end)
    scored = chunks.withColumn("score", lexical_score(F.lower(text), query_terms(F.lit(question))))
    return scored.filter(F.col("score") > 0).orderBy(F.desc("score"), F.desc(key)).limit(top_k)


def lexical_score(lowered: Column, terms: Column) -> Column:
    hits = F.size(F.filter(terms, lambda t: F.contains(lowered, t)))
    return F.when(F.size(terms) > 0, hits.cast("double") / F.size(terms)).otherwise(F.lit(0.0))


def lexical_search_many(chunks: DataFrame, questions: list[tuple[str, str]], text: str, key: str, top_k: int = rules.RETRIEVAL_TOP_K) -> DataFrame:
    """Top chunks of each of a few questions, in one scan.

    A term counts when it occurs anywhere in the chunk, so every chunk is tested against every
    question's terms; only positive scores leave the row, and each question keeps its best chunks
    before the shuffle.
    """
    table = F.array(*[F.struct(F.lit(i).alias("question_id"), query_terms(F.lit(q)).alias("terms")) for i, q in questions])
    scored = chunks.select(key, F.lower(text).alias("_low")).select(
        key, F.explode(F.filter(
            F.transform(table, lambda q: F.struct(q["question_id"].alias("question_id"), lexical_score(F.col("_low"), q["terms"]).alias("score"))),
            lambda s: s["score"] > 0)).alias("s")).select(key, "s.*")
    return top_n(scored, "question_id", top_k, F.desc("score"), F.desc(key))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_search(vectors: DataFrame, query: Column, key: str, top_k: int = rules.RETRIEVAL_TOP_K,
                  min_score: float = rules.RETRIEVAL_MIN_SCORE) -> DataFrame:
    """Nearest vectors by cosine; the score floor applies after the cut to ``top_k``."""
    # The query is a column of its own first: it may be a one-row subquery.
    scored = vectors.withColumn("_query", query).withColumn("score", cosine(F.col("embedding"), F.col("_query"))).drop("_query")
    top = scored.orderBy(F.desc_nulls_last("score"), F.asc(key)).limit(top_k)
    return top.filter(F.col("score") >= min_score)


def validate_citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited chunks that were really retrieved, with the retrieved columns; junk ids drop out."""
    ids = cited.withColumn("chunk_id", F.col("chunk_id").try_cast("bigint")).filter(F.col("chunk_id").isNotNull())
    shared = [c for c in ids.columns if c in retrieved.columns]
    return ids.join(retrieved, shared, "inner")


def compact_evidence(evidence: DataFrame, question: str = "question_id") -> DataFrame:
    """Five leading evidence rows per question with short text."""
    kept = top_n(evidence, question, rules.EVIDENCE_ITEMS_FOR_ANSWER, F.desc("score"), F.desc("chunk_id"))
    return kept.withColumn("text", truncate("chunk_text", rules.EVIDENCE_CHARS_FOR_ANSWER))


def answers(questions: DataFrame, evidence: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Answer status and text per question from its evidence and optional model output.

    ``evidence`` has question_id and chunk_id; ``outputs`` has question_id, status, summary and
    an array of cited chunk ids. Without outputs the deterministic answer cites all evidence.
    """
    counts = evidence.groupBy("question_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    base = questions.join(counts, "question_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    if outputs is None:
        base = base.withColumns({
            "model_status": F.lit("ok"),
            "summary": F.concat(F.lit("Retrieved "), F.col("evidence_count").cast("string"), F.lit(" evidence item(s) relevant to: "), F.col("question")),
            "citation_count": F.col("evidence_count"),
        })
    else:
        cites = outputs.select("question_id", F.explode("citations").alias("chunk_id"))
        valid = validate_citations(cites, evidence.select("question_id", "chunk_id")).groupBy("question_id").agg(
            F.count(F.lit(1)).alias("citation_count"))
        base = base.join(outputs.select("question_id", F.col("status").alias("model_status"), "summary"), "question_id", "left").join(
            valid, "question_id", "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))
    status = (
        F.when(F.col("evidence_count") == 0, "insufficient_evidence")
        .when(F.col("model_status").isin("llm_error_fallback", "insufficient_evidence"), F.col("model_status"))
        .when(F.col("citation_count") > 0, "ok").otherwise("insufficient_evidence")
    )
    answer = (
        F.when(F.col("evidence_count") == 0, "Insufficient evidence was retrieved for this question.")
        .when(F.col("answer_status") == "llm_error_fallback", "The LLM call failed; returning deterministic evidence-grounded fallback for review.")
        .when(F.col("answer_status") != "ok", "The generated output did not cite retrieved evidence.")
        .otherwise(F.coalesce("summary", F.lit("")))
    )
    return base.withColumn("answer_status", status).select(
        "question_id", "answer_status", "evidence_count",
        F.when(F.col("answer_status").isin("ok", "llm_error_fallback"), F.col("citation_count")).otherwise(F.lit(0).cast("bigint")).alias("citation_count"),
        answer.alias("answer"),
    )


def retrieval_ledger(evidence: DataFrame, question: str = "question_id") -> DataFrame:
    """One row per retrieval with its (at most top-k) results as JSON, text left out."""
    item = F.struct((-F.col("score")).alias("neg"), (-F.col("chunk_id")).alias("neg_id"), F.col("chunk_id").alias("chunk_id"), F.col("score").alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score")))
    return evidence.groupBy(question).agg(F.to_json(ordered).alias("results"), F.count(F.lit(1)).alias("result_count"))


def insights_to_store(answered: DataFrame, citations: DataFrame) -> DataFrame:
    """Insight rows of questions answered with citations, keyed by a content hash.

    Citations per question are bounded by the retrieval size, so the ordered list is small.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "record_key")))
    keys = citations.groupBy("question_id").agg(
        F.filter(F.transform(ordered, lambda x: x["record_key"]), lambda x: x.isNotNull() & (x != "")).alias("record_keys"))
    ok = answered.filter((F.col("answer_status") == "ok") & (F.col("citation_count") > 0)).join(keys, "question_id")
    return ok.select("question_id", F.col("answer").alias("summary"), "record_keys",
                     F.sha2(F.concat_ws("\n", "answer", F.array_join("record_keys", ",")), 256).alias("dedup_hash"))
