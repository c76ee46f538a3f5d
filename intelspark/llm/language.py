"""Language identification by nearest centroid over TF-IDF vectors of hashed byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from intelspark.llm.common import map_batches, map_partition, release, texts_of

DIMS = 4096
FIT_ROWS = 300  # labelled documents per language that the centroids are fitted on
CENTROIDS = 4  # clusters per language
SLACK = 0.25  # a text is rejected below this share of the lowest cosine seen among the fitted documents
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # no digit, fraction or circled number is a letter
# Letters of ASCII and all bytes of other characters stay, the rest counts as a space.
_KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (number, DIMS), of unit length
    owner: np.ndarray  # index of each centroid's language
    floor: np.ndarray  # lowest accepted cosine per language


def counts(text: str) -> np.ndarray:
    """Trigram counts of the whole lower-cased text, hashed into ``DIMS`` buckets."""
    b = _KEPT[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    return np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIMS - 1), minlength=DIMS)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the points farthest from those chosen so far."""
    mean = x.mean(0)
    picked = [int(np.argmax(x @ mean))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    c = x[picked]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, k: int = CENTROIDS) -> Model:
    """Model from labelled rows (doc_id, text, lang).

    Document frequencies cover every labelled row; centroids are fitted on ``fit_rows`` documents per
    language, those of the smallest id hashes. Rows without a language are left out.
    """
    spark = docs.sparkSession
    known = docs.filter("lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in texts_of(batch):
                total += counts(text) > 0
                n += 1
        if n:
            yield {"slot": np.arange(DIMS + 1), "n": np.append(total, n)}

    df = np.zeros(DIMS + 1)
    for slot, n in map_partition(known.select("text"), frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        df[slot] = n
    idf = (np.log((df[DIMS] + 1) / (df[:DIMS] + 1)) + 0.05).astype(np.float32)

    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fit_rows).select("doc_id", "lang").collect()
    ids = spark.createDataFrame(picked, known.select("doc_id", "lang").schema)
    # At most fit_rows ids per language.
    sample = known.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("lang", "text")

    def sparse(batch: pa.RecordBatch) -> dict:
        rows = [counts(t) for t in texts_of(batch)]
        return {"lang": batch.column("lang"), "slots": [np.flatnonzero(r) for r in rows], "values": [r[r > 0] for r in rows]}

    by_lang: dict[str, list] = {}
    for lang, slots, values in map_batches(sample, sparse, "lang string, slots array<int>, values array<bigint>").collect():
        row = np.zeros(DIMS, np.float32)
        row[slots] = values
        by_lang.setdefault(lang, []).append(row)
    languages = sorted(by_lang)
    centroids, owner, floor = [], [], []
    for i, lang in enumerate(languages):
        rows = np.stack(by_lang[lang])
        x = vectors(rows[np.lexsort(rows.T[:8])], idf)
        c = _cluster(x, k)
        centroids.append(c)
        owner += [i] * len(c)
        seen = (x @ c.T).max(1)
        floor.append(SLACK * float(seen[seen > 0].min(initial=1.0)))
    return Model(languages, idf, np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32), np.array(owner, int), np.array(floor))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, lang_rejected.

    lang_pred is the language of the centroid with the highest cosine and score that cosine; ties go to
    the first language in order. A null text or one without a letter gives ``und``, score 0, rejected.
    lang_rejected also marks texts whose cosine lies below the language's floor. Without a model
    language every text is ``und``. Columns of these names in ``docs`` are replaced.
    """
    added = [("lang_pred", pa.string()), ("score", pa.float64()), ("lang_rejected", pa.bool_())]
    left = docs.drop(*[n for n, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            pred, score, rejected = [], [], []
            for at in range(0, len(texts), 256):
                part = [t or "" for t in texts[at : at + 256]]
                if len(model.languages):
                    cos = vectors(np.stack([counts(t) for t in part]), model.idf) @ model.centroids.T
                    best = cos.argmax(1)
                    lang, value = model.owner[best], np.clip(cos[np.arange(len(part)), best], 0, 1)
                for i, t in enumerate(part):
                    if not len(model.languages) or not _LETTER.search(t):
                        pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    else:
                        pred.append(model.languages[lang[i]]), score.append(float(value[i]))
                        rejected.append(bool(value[i] < model.floor[lang[i]]))
            new = [pa.array(v, t) for v, (_, t) in zip((pred, score, rejected), added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _ in added)])

    schema = StructType([*left.schema.fields, *StructType.fromDDL("lang_pred string, score double, lang_rejected boolean").fields])
    return left.mapInArrow(run, schema)
