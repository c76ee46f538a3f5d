"""Quality by tokeniser fertility: how a public vocabulary cuts a text, judged within its language or script."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark.llm.common import gather, map_partition, parts, split_words
from intelspark.session import cut_lineage

VOCABULARY = "piece_bpe_32k.model"
CACHE = 600_000  # words a worker remembers
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.array([32, 9, 10, 11, 12, 13])
MIN_WORDS, MAX_REPEAT = 50, 50  # base rule: words at least, repeated words in per cent at most
REACH = 1.5  # width of a band on each side, in interquartile ranges (Tukey's fence)
LEAST_ROWS = 40  # different texts that a class needs for a band of its own
# Narrowest interquartile range taken for each measure: characters per token, share of byte pieces, entropy in bits.
LEAST_SPREAD = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.2}
ONE_SIDED = "byte_share"  # has no lower limit
# Lead bytes of UTF-8 by script, fixed by the encoding.
LEADS = {
    "latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "hebrew": [0xD6, 0xD7], "arabic": [0xD8, 0xD9, 0xDA, 0xDB], "indic": [0xE0], "kana": [0xE3], "han": [*range(0xE4, 0xEA)], "hangul": [*range(0xEA, 0xEE)],
}


class Pieces:
    """Ids of words, each cut on its own; a bounded memory of words keeps repeats cheap."""

    def __init__(self, vocabulary: str):
        import sentencepiece
        from public_tokenizers import path

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else path(vocabulary))
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.known: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, words
        self.known.update(zip(new, [np.array(i, np.int32).tobytes() for i in self.model.encode(new, num_threads=1)]))
        return [self.known[w] for w in words]


def repeated_words(words: np.ndarray) -> int:
    """Words (as codes) that lie in a three-word window found at least twice in the text."""
    if len(words) < 4:
        return 0
    _, dense = np.unique(words, return_inverse=True)
    if dense.max() < 1 << 21:
        h = (dense[:-2] << 42) | (dense[1:-1] << 21) | dense[2:]
    else:
        _, h = np.unique(np.stack([dense[:-2], dense[1:-1], dense[2:]]), axis=1, return_inverse=True)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def _measure(text: str, words: np.ndarray, ids: np.ndarray, is_byte: np.ndarray) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    chars = int(n.sum() - n[128:192].sum() - n[SPACES].sum())
    share = np.unique(ids, return_counts=True)[1] / max(len(ids), 1)
    script = max(LEADS, key=lambda s: n[LEADS[s]].sum())
    return (
        len(words), chars, int(n[SYMBOLS].sum()), dup, repeated_words(words), len(ids),
        chars / len(ids) if len(ids) else 0.0, float(is_byte[ids].mean()) if len(ids) else 0.0, float(-(share * np.log2(share)).sum()) + 0.0,
        script if n[LEADS[script]].sum() else "none")


def measures(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row (doc_id, text, grp): counts of the base rules, the vocabulary's measures and the script; grp null becomes the script."""
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
              "chars_per_token double, byte_share double, entropy double, script string, grp string")
    names = [c.split()[0] for c in schema.split(", ")][1:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = Pieces(vocabulary)
        for part in parts(batches):
            words, codes, offsets = split_words(part.column("text"))
            ids, begins = gather(pieces.ids(words), codes)
            rows = list(zip(*[
                _measure(t or "", codes[offsets[i] : offsets[i + 1]], ids[begins[offsets[i]] : begins[offsets[i + 1]]], pieces.is_byte)
                for i, t in enumerate(part.column("text").to_pylist())]))
            rows.append([g or s for g, s in zip(part.column("grp").to_pylist(), rows[-1])])
            yield {"doc_id": part.column("doc_id"), **dict(zip(names, rows))}

    return map_partition(docs, work, schema)


def _bands(rows: DataFrame) -> DataFrame:
    """(grp, script, size_class, q): quartiles of each measure for every class there is, from the first level with enough texts."""
    cls = ["grp", "script", "size_class"]
    once = rows.select(*cls, "n_words", "word_chars", "n_tokens", *LEAST_SPREAD).distinct()  # copies have the same measures
    none = F.lit(None)
    levels = [("grp", none, "size_class"), (none, "script", "size_class"), (none, "script", none), (none, none, none)]

    def keys() -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("level"), *[(F.col(k) if isinstance(k, str) else k.cast(t)).alias(n) for n, k, t in zip(
            cls, level, ("string", "string", "int"))]) for i, level in enumerate(levels)])).alias("key")

    quartiles = F.struct(*[F.percentile_approx(m, [0.25, 0.75], 2000).alias(m) for m in LEAST_SPREAD]).alias("q")
    bands = once.select(keys(), *LEAST_SPREAD).groupBy("key").agg(F.count("*").alias("n"), quartiles).filter((F.col("n") >= LEAST_ROWS) | (F.col("key.level") == len(levels) - 1))
    classes = rows.select(*cls).distinct().select(*cls, keys())
    return classes.join(bands, "key").groupBy(*cls).agg(F.min_by("q", "key.level").alias("q"))


def quality(docs: DataFrame, vocabulary: str = VOCABULARY, reach: float = REACH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): counts, measures, base_failed and kept.

    A text is kept if it passes the base rules (at least 50 words, at most half of them in repeated
    three-word windows) and its characters per token, byte-fallback share (upper limit only) and token
    entropy lie in its band. A band reaches ``reach`` interquartile ranges beyond the quartiles of the
    texts that pass the base rules, copies counted once, in its language (its script where lang is null or
    not there) and size class; with fewer than ``LEAST_ROWS`` of these, in its script and size class, in
    its script, or in all rows. Size classes are powers of two of the token count. Null and empty texts have zero counts and fail. Repeated rows are judged
    alike; other columns are ignored.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = cut_lineage(measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("grp")), vocabulary)
                       .withColumn("size_class", F.floor(F.log2(F.col("n_tokens") + 1)).cast("int")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    inside = F.lit(True)
    for m, least in LEAST_SPREAD.items():
        low, high = F.col(f"q.{m}")[0], F.col(f"q.{m}")[1]
        width = F.greatest(high - low, F.lit(least)) * reach
        inside = inside & (F.col(m) <= high + width) & (F.lit(m == ONE_SIDED) | (F.col(m) >= low - width))
    return rows.join(_bands(rows.filter(~failed & (F.col("n_tokens") > 0))), ["grp", "script", "size_class"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "chars_per_token", "byte_share", "entropy", F.col("grp").alias("band"))
