"""Packing of documents into fixed windows by lexical retrieval: a sharded BM25 index picks what fills a window."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intelspark.llm.common import U64, gather, keep, map_partition, mix, slices, split_words
from intelspark.session import cut_lineage

VOCABULARY = "word_bpe_49k.json"
END = 1  # id that follows each document
WINDOW = 2048
PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")  # letters, then ASCII marks
LETTERS = re.compile("[a-zß-öø-ÿ]+(?: [a-zß-öø-ÿ]+)*")  # what PLAIN's letters are in lower case
WORD_END = "</w>"  # mark of the vocabulary's tokens that end a word
SHARD_TOKENS = 1 << 21  # tokens of a shard of the index, on average
PART_BYTES = 4 << 20  # text that is cut into words at a time
QUERY_TERMS = 24  # terms of a seed that are looked up
NEIGHBOURS = 48  # candidates taken from the index at a time
K1, B = 1.2, 0.75
CACHE = 800_000  # words a worker remembers


class WordIds:
    """Ids of words, each cut on its own: the vocabulary never joins across white space, so words can be remembered.

    A word of plain letters and closing marks is cut there into what the vocabulary's own first step
    gives, in lower case, so that fewer different strings have to be coded.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import path
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else path(vocabulary))
        self.bare = self._unnormalised()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _code(self, words: list[str]) -> list[bytes]:
        new = list({w for w in words if w not in self.cores})
        if len(self.cores) + len(new) > CACHE:
            self.cores, new = {}, list(set(words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.cores.update(zip(part, self._joined(part) or [np.array(e.ids, np.int32).tobytes() for e in self._encode(part)]))
        return [self.cores[w] for w in words]

    def _unnormalised(self):
        """The vocabulary without its normaliser, for joined words, if that leaves their letters and blanks as they are."""
        from tokenizers import Tokenizer, normalizers

        letters = " ".join(c for c in map(chr, range(256)) if LETTERS.fullmatch(c))
        if self.tokenizer.normalizer is None or self.tokenizer.normalizer.normalize_str(letters) != letters:
            return self.tokenizer
        bare = Tokenizer.from_str(self.tokenizer.to_str())
        bare.normalizer = normalizers.Sequence([])
        return bare

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _joined(self, words: list[str]) -> list[bytes] | None:
        """Ids of words coded as one text and cut after each id that ends a word; null unless all are plain letters.

        One word of letters is one step of the vocabulary, so it has one such id, its last.
        """
        if not LETTERS.fullmatch(text := " ".join(words)):
            return None
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
        if len(ends) != len(words):
            return None
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def ids(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, words
        plain = [m for w in new if (m := PLAIN.fullmatch(w))]
        tails = {m: self._code([m])[0] if m else b"" for m in {m[2] for m in plain}}
        heads = self._code([m[1].lower() for m in plain])
        self.known.update(zip([m[0] for m in plain], [h + tails[m[2]] for h, m in zip(heads, plain)]))
        other = [w for w in new if w not in self.known]
        self.known.update(zip(other, self._code(other)))
        return [self.known[w] for w in words]


@lru_cache(2)
def word_ids(vocabulary: str) -> WordIds:
    """A worker's own coder; what it has coded serves all tasks that the worker runs."""
    return WordIds(vocabulary)


def _ids(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // length}")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of pieces: full windows of long documents (with their checksum) and what remains (with its ids).

    ``place`` is a hash that near copies mostly share: the smallest hash of two consecutive ids.
    """
    schema = "doc_id long, doc_tokens long, start long, length long, crc long, ids binary, place long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = word_ids(vocabulary)
        keep("packing", word_ids.cache_clear)
        for part in (p for batch in batches for p in slices(batch, limit=PART_BYTES)):
            rows = []
            distinct, codes, offsets = split_words(part.column("text"))
            every, begins = gather(words.ids(distinct), codes)
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                ids = np.append(every[begins[offsets[i]] : begins[offsets[i + 1]]], END)
                rest = len(ids) - len(ids) % WINDOW
                for at in range(0, rest, WINDOW):
                    rows.append((doc, len(ids), at, WINDOW, _crc(ids[at : at + WINDOW]), None, None))
                if rest < len(ids):
                    left = ids[rest:].astype(U64)
                    pairs = mix(left[:-1] * U64(1 << 20) + left[1:])
                    rows.append((doc, len(ids), rest, len(left), None, left.astype(words.kind).tobytes(), int(pairs.min() >> U64(1)) if len(pairs) else 0))
            if rows:
                yield dict(zip(("doc_id", "doc_tokens", "start", "length", "crc", "ids", "place"), zip(*rows)))

    return map_partition(docs, work, schema, owner="packing")


def _document_frequencies(rest: DataFrame) -> tuple[dict[int, int], int, float]:
    """Per token the number of pieces that hold it, over all pieces; at most as many rows as the vocabulary has ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist()):
                one = np.unique(_ids(raw, n))
                if len(one) and one[-1] >= len(df):
                    df = np.append(df, np.zeros(int(one[-1]) + 1 - len(df), np.int64))
                df[one] += 1
        held = np.flatnonzero(df)
        yield {"token": held, "n": df[held]}

    df = {r["token"]: r["n"] for r in map_partition(rest.select("ids", "length"), work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    n, mean = rest.agg(F.count("*"), F.avg("length")).first()
    return df, n, float(mean or 1)


class Shard:
    """BM25 index of a shard's pieces and the greedy filling of windows from it."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.ids, n = ids, len(ids)
        size = np.array([len(x) for x in ids])
        key = np.repeat(np.arange(n, dtype=np.int64), size) * (1 << 32) + np.concatenate(ids)
        pair, tf = np.unique(key, return_counts=True)
        doc, term = pair >> 32, pair & 0xFFFFFFFF
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))).astype(np.float32)
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        self.term, self.rank = term, idf[term] * tf
        order = np.argsort(term, kind="stable")
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.used = np.zeros(n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused pieces by falling score, at most ``NEIGHBOURS``."""
        own = slice(self.of_doc[seed], self.of_doc[seed + 1])
        best = self.term[own][np.argsort(-self.rank[own], kind="stable")[:QUERY_TERMS]]
        at = np.searchsorted(self.terms, best)
        spans = [slice(self.first[i], self.first[i + 1]) for i in at]
        score = np.bincount(np.concatenate([self.post_doc[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans]), len(self.used))
        score[self.used] = 0
        top = np.argpartition(-score, min(NEIGHBOURS, len(score) - 1))[:NEIGHBOURS]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (piece, from, to) that fill a window each; only the last may be short."""
        begin = np.zeros(len(self.ids), np.int64)
        length = np.array([len(x) for x in self.ids])
        order, at = np.argsort(-length, kind="stable"), 0
        while at < len(order):
            seed = int(order[at])
            if self.used[seed]:
                at += 1
                continue
            window, room = [], WINDOW

            def take(i: int, room: int) -> int:
                n = min(room, int(length[i] - begin[i]))
                window.append((i, int(begin[i]), int(begin[i]) + n))
                begin[i] += n
                self.used[i] = begin[i] == length[i]
                return room - n

            room = take(seed, room)
            while room:
                found = self.neighbours(seed)
                left = length[found] - begin[found]
                whole = False
                for i, n in zip(found.tolist(), left.tolist()):
                    if n <= room:
                        room, whole = take(i, room), True
                        if not room:
                            break
                if room and not whole:
                    if len(found):
                        room = take(int(found[0]), room)
                    else:  # nothing in common: the next unused piece in order
                        while at < len(order) and self.used[order[at]]:
                            at += 1
                        if at == len(order):
                            break
                        room = take(int(order[at]), room)
            yield window


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``END``; whole windows of it are sequences of their own, and what remains is
    packed with lexical neighbours until a window is full, cutting the last one. A shard's last window, if
    short, is cut into sequences of powers of two, which need no padding. A null text counts as empty and
    is the single id ``END``; repeated rows are packed each; a null doc_id is carried; other columns are
    ignored; an empty table gives no rows.
    """
    cut = cut_lineage(_tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary))
    full = cut.filter("ids is null").select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter("ids is not null").drop("crc")
    df, n, mean = _document_frequencies(rest)
    size = max(df, default=0) + 1
    idf = np.zeros(size, np.float32)
    for token, held in df.items():
        idf[token] = np.log(1 + (n - held + 0.5) / (held + 0.5))
    shards = max(1, round(n * mean / shard_tokens))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        data = pa.Table.from_batches(parts)
        data = data.take(pa.array(np.lexsort((data["start"].to_numpy(), data["doc_id"].fill_null(-1).to_numpy()))))
        ids = [_ids(x, n) for x, n in zip(data["ids"].to_pylist(), data["length"].to_pylist())]
        docs, tokens, starts = data["doc_id"].to_pylist(), data["doc_tokens"].to_pylist(), data["start"].to_pylist()
        number, rows = TaskContext.get().partitionId() << 32, []
        for window in Shard(ids, idf, mean).windows():
            filled = sum(b - a for _, a, b in window)
            while window:
                room, offset = 1 << filled.bit_length() - 1, 0
                filled -= room
                while room:
                    i, a, b = window[0]
                    n = min(room, b - a)
                    rows.append((docs[i], starts[i] + a, n, _crc(ids[i][a : a + n]), tokens[i], number * 2, offset))
                    offset, room = offset + n, room - n
                    window[0] = (i, a + n, b)
                    if a + n == b:
                        window.pop(0)
                number += 1
        yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), zip(*rows)))

    packed = map_partition(
        rest.repartitionByRange(shards, "place", "doc_id", "start"), work,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(packed)
