"""Benchmark decontamination: rare word-pair seeds find candidates, Smith-Waterman alignment scores them.

Test items are cut into passages. A pair key is two words at a distance of one or two, so it outlives one
changed, lost or added word between them. An alignment of score s has M matches and at most 2M - s edits,
hence at least s/2 - 1 places of the passage whose key the text holds too: of any choice of places that
leaves out fewer, some must be met. The rarest places, by the number of documents, are taken as seeds; no
alignment of the threshold or more is missed. The document scan tests keys against a bitmap of fixed size,
so what is sent to the tasks does not grow with the benchmark; the hits then meet the seeds in an equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intelspark.llm.common import U64, map_batches, map_partition, mix, range_hashes
from intelspark.session import cut_lineage

REACH = 2  # distance of the words of a seed, at most
PASSAGE, STEP = 128, 64  # words of a passage and from one to the next
FILTER_BITS = 22  # the bitmap has 2^22 bits
SHIFTS = (0, 21, 42)  # a key's bits in the bitmap are those numbered from here
SPARE = 6  # of so many places that an alignment must share, one more is a seed, and so many seeds must be met
MATCH, OFF = 2, -1  # alignment scores: equal words, anything else (also a gap)
THRESHOLD = 0.5  # share of a passage's best score
LEAST_WORDS = 5  # items with fewer words are too short to tell
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (letters, digits, characters beyond ASCII) in ASCII lower case."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _INSIDE[data]
    edge = np.diff(inside)
    return range_hashes(data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def pairs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the word pairs at a distance of up to ``REACH``, and the place of each one's first word."""
    keys = [mix(hashes[:-d] * U64(0x9FB21C651E98DF25) + hashes[d:]) for d in range(1, REACH + 1)]
    return np.concatenate(keys), np.concatenate([np.arange(len(k)) for k in keys])


def sharing(n_words: int, threshold: float) -> tuple[int, int]:
    """How many of a passage's places are seeds, and how many of these an alignment of the threshold meets at least."""
    least = max(1, math.ceil(math.ceil(2 * threshold * n_words - 1e-9) / 2) - 1)
    meet = max(1, least // SPARE)
    return n_words - 1 - least + meet, meet


def passages(items: DataFrame) -> DataFrame:
    """(item_id, passage, words): every stretch of ``PASSAGE`` words of an item, equal ones of an item once."""

    def work(batch: pa.RecordBatch) -> dict:
        out = {"item_id": [], "passage": [], "words": []}
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            w = words(text)
            if len(w) < LEAST_WORDS:
                continue
            for at in range(0, max(1, len(w) - PASSAGE + STEP), STEP):
                part = w[at : at + PASSAGE].view(np.int64)
                out["item_id"].append(item)
                out["passage"].append(at)
                out["words"].append(part)
        return out

    return map_batches(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), work, "item_id long, passage int, words array<bigint>").distinct()


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of three times ``FILTER_BITS`` bits of ``key``; at most 2^FILTER_BITS numbers come to the driver."""
    mask = (1 << FILTER_BITS) - 1
    places = F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(mask) for s in SHIFTS])
    slots = [r[0] for r in keys.select(F.explode(places).alias("slot")).distinct().collect()]
    out = np.zeros(1 << FILTER_BITS, bool)
    out[slots] = True
    return np.packbits(out)


def _test(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indices of the values that the bitmap may hold."""
    at = np.arange(len(values))
    for s in SHIFTS:
        at = at[bits[((values[at] >> U64(s)) & U64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
    return at


def _frequencies(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(key, n): documents that hold each pair that passes the bitmap, summed within a task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits = np.unpackbits(bitmap).astype(bool)
        for batch in batches:
            held = []
            for text in batch.column("text").to_pylist():
                k, _ = pairs(words(text))
                held.append(np.unique(k[_test(bits, k)]))
            if held:
                key, n = np.unique(np.concatenate(held), return_counts=True)
                yield {"key": key.view(np.int64), "n": n}

    return map_partition(docs.select("text"), work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _window(row: int, blocks: np.ndarray) -> np.ndarray:
    return mix(np.full(len(blocks), row, np.int64).view(U64) * U64(0x9FB21C651E98DF25) + blocks.astype(U64))


def _hits(docs: DataFrame, bitmap: np.ndarray, block: int) -> DataFrame:
    """(window, key): seeds of each window. Windows are two blocks long and begin at every block of ``block`` words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits = np.unpackbits(bitmap).astype(bool)
        for batch in batches:
            out = {"window": [], "key": []}
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                k, place = pairs(words(text))
                hit = _test(bits, k)
                if len(hit):
                    at = place[hit] // block
                    both = np.unique(np.stack([np.append(at, np.maximum(at - 1, 0)).astype(U64), np.tile(k[hit], 2)]), axis=1)
                    out["window"].append(_window(row, both[0]).view(np.int64))
                    out["key"].append(both[1].view(np.int64))
            if out["key"]:
                yield {name: np.concatenate(x) for name, x in out.items()}

    return map_partition(docs.select("row", "text"), work, "window long, key long")


def _windows(docs: DataFrame, bitmap: np.ndarray, block: int) -> DataFrame:
    """(window, doc_id, words) of the windows that the bitmap may hold; other texts are not cut into words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits = np.unpackbits(bitmap).astype(bool)
        for batch in batches:
            out = {"window": [], "doc_id": [], "words": []}
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                names = _window(row, np.arange(len(text or "") // 2 // block + 1))  # words and gaps have a character at least
                hit = _test(bits, names)
                w = words(text) if len(hit) else None
                for b in hit.tolist():
                    out["window"].append(names[b].astype(np.int64))
                    out["doc_id"].append(doc)
                    out["words"].append(w[b * block : (b + 2) * block].view(np.int64))
            if out["window"]:
                yield out

    return map_partition(docs.select("row", "doc_id", "text"), work, "window long, doc_id long, words array<bigint>").distinct()


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs, all at once; 1 where the whole item stands in the text word by word."""
    m, width = max(map(len, items)), max(map(len, texts))
    item, text = np.full((len(items), m), -1, np.int64), np.full((len(items), width), -2, np.int64)
    for i, (a, b) in enumerate(zip(items, texts)):
        item[i, : len(a)], text[i, : len(b)] = a, b
    column = np.arange(width + 1, dtype=np.int32)
    row, best = np.zeros((len(items), width + 1), np.int32), np.zeros(len(items), np.int32)
    for i in range(m):
        step = np.zeros_like(row)
        step[:, 1:] = np.maximum(row[:, :-1] + np.where(item[:, i, None] == text, MATCH, OFF), row[:, 1:] + OFF)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + column, axis=1) - column  # gaps along the text cost one a word
        best = np.maximum(best, row.max(1))
    return best / (MATCH * np.array([len(a) for a in items]))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score) of each document that holds a copy of a test item, also an edited one.

    score is the best alignment of a passage of the item with a stretch of the document, as a share of the
    passage's full score; rows have ``threshold`` or more. Rows of one id count as one document. Null and
    empty texts and items of fewer than five words match nothing, rows without an id are left out, other
    columns are ignored; an empty table on either side gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    parts = cut_lineage(passages(items.filter("item_id is not null")).withColumn("part", F.xxhash64("item_id", "passage", "words")))
    block = max(PASSAGE, math.ceil((3 - 2 * threshold) * PASSAGE))  # no alignment of the threshold is longer

    def cut(batch: pa.RecordBatch) -> dict:
        out = {"part": [], "place": [], "key": [], "seeds": [], "meet": []}
        for part, w in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist()):
            k, place = pairs(np.array(w, np.int64).view(U64))
            seeds, meet = sharing(len(w), threshold)
            for name, x in (("part", [part] * len(k)), ("place", place.tolist()), ("key", k.view(np.int64).tolist()), ("seeds", [seeds] * len(k)), ("meet", [meet] * len(k))):
                out[name] += x
        return out

    keys = cut_lineage(map_batches(parts.select("part", "words"), cut, "part long, place int, key long, seeds int, meet int"))
    counts = _frequencies(docs, _bitmap(keys))
    at = Window.partitionBy("part", "place")
    order = Window.partitionBy("part").orderBy("n", "place")  # at most REACH * PASSAGE rows
    seeds = cut_lineage(
        keys.join(counts, "key", "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(at))
        .withColumn("rank", F.dense_rank().over(order)).filter("rank <= seeds").select("key", "part", "place", "meet"))
    found = cut_lineage(
        _hits(docs, _bitmap(seeds), block).join(seeds, "key").groupBy("window", "part", "meet")
        .agg(F.count_distinct("place").alias("met")).filter("met >= meet").select("window", "part"))
    held = _windows(docs, _bitmap(found.select(F.col("window").alias("key"))), block)

    def score(batch: pa.RecordBatch) -> dict:
        out = []
        items_, texts = batch.column("item").to_pylist(), batch.column("words").to_pylist()
        for at in range(0, len(items_), 64):
            out.append(align([np.array(x, np.int64) for x in items_[at : at + 64]], [np.array(x, np.int64) for x in texts[at : at + 64]]))
        return {"doc_id": batch.column("doc_id"), "item_id": batch.column("item_id"), "score": np.concatenate(out)}

    joined = (found.join(held, "window").join(parts.select("part", "item_id", F.col("words").alias("item")), "part")
              .select("doc_id", "item_id", "item", "words"))
    scored = map_batches(joined, score, "doc_id long, item_id long, score double")
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
