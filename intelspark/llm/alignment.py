"""Cross-tokenizer alignment: token ends of two vocabularies merged by merge-path pieces, links counted over the corpus."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intelspark.llm.common import gather, keep, map_partition, parts
from intelspark.session import cut_lineage

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
PIECE = 1 << 15  # steps of a merge that one piece does
CHUNK = 4096  # segments tokenised as one text
CACHE = 200_000  # segments a worker remembers
TOP = 1 << 18  # id pairs whose counts are sent to every task; all rarer ones are joined
FLUSH = 1 << 20  # id pairs a task adds up before it sends counts
BITS_B = 15  # an id pair is a 32-bit code: A's id, then this many bits of B's id
KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_LATIN = re.compile("[\\x00-\u024f]*")
_SPACE = "▁"  # stands for a space in pieces


def split_diagonals(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d merged elements come from ``a``, for each diagonal d; equal ones of ``a`` come first.

    All diagonals are searched at once, by bisection, so the pieces between them are known before any is merged.
    """
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        more = (low < high) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonals - mid - 1, 0, len(b) - 1)])
        low, high = np.where(more, mid + 1, low), np.where(more | (low >= high), high, mid)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece of the merge of ends ``a`` and ``b``: the overlapping tokens (index in a, index in b), and which links close a group.

    Of other pieces it only needs the end before its first and the one after its last.
    """
    x, y = a[i0:i1], b[j0:j1]
    at_a = np.arange(len(x)) + np.searchsorted(y, x, "left")
    at_b = np.arange(len(y)) + np.searchsorted(x, y, "right")
    ends, is_a = np.empty(len(x) + len(y), np.int64), np.zeros(len(x) + len(y), bool)
    ends[at_a], ends[at_b], is_a[at_a] = x, y, True
    i = i0 + np.cumsum(is_a) - is_a
    j = j0 + np.cumsum(~is_a) - ~is_a
    before = max(a[i0 - 1] if i0 else 0, b[j0 - 1] if j0 else 0)
    real = np.diff(ends, prepend=before) > 0  # the second of two equal ends covers nothing
    closes = is_a & (b[np.minimum(j, len(b) - 1)] == ends)
    return i[real], j[real], closes[real]


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (index in a, index in b) of two ascending lists of token ends that end alike, and the group of each link.

    Equal-work pieces are merged independently; their links are then stitched into groups across the seams.
    """
    diagonals = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = split_diagonals(a, b, diagonals)
    j = diagonals - i
    found = [overlaps(a, b, i[k], i[k + 1], j[k], j[k + 1]) for k in range(len(i) - 1)]
    link_a, link_b, closes = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    return link_a, link_b, np.cumsum(closes) - closes


_PAIRS: dict[tuple, Pair] = {}  # of this worker


def pair_of(*vocabularies: str) -> Pair:
    """The worker's own pair, kept over tasks: loading takes most of a second."""
    if vocabularies not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[vocabularies] = Pair(*vocabularies)
    return _PAIRS[vocabularies]


def forget_pairs() -> None:
    _PAIRS.clear()


class Pair:
    """The two vocabularies, and what they make of segments; a bounded memory of segments keeps repeats cheap."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from public_tokenizers import path
        from tokenizers import Tokenizer

        a, b = (v if "/" in v else path(v) for v in (vocabulary_a, vocabulary_b))
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        # Byte-level alphabet: printable characters stand for themselves, the other bytes for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(c): c for c in plain} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in plain)}
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda v: v[1])
        self.bytes_a = [bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode() for t, _ in names]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces) or len(pieces) > 1 << BITS_B or len(names) > 1 << 31 - BITS_B:
            raise ValueError("a piece spans words, or the vocabularies are too large for 32-bit pairs")
        self.size_a, self.size_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.lone_space = self.b.piece_to_id(_SPACE)
        self.fast = self._fast([t for t, _ in names])
        self.known: dict[str, tuple] = {}

    def _fast(self, names: list[str]):
        """The same vocabulary for the faster of the two byte-level libraries, if its merges are in the order of its ids, else None.

        Then the lowest rank of a joined token and the first applicable merge are the same choice at every step.
        """
        import tiktoken
        from public_tokenizers import PATTERN

        told = json.loads(self.a.to_str())
        ids = {name: at for at, name in enumerate(names)}
        merges = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        special = {t["id"] for t in told["added_tokens"]}
        plain = told["normalizer"] is None and told["pre_tokenizer"]["type"] == "ByteLevel" and told["pre_tokenizer"]["use_regex"] and not told["pre_tokenizer"]["add_prefix_space"]
        if not plain or merges != list(range(256, 256 + len(merges))):
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: at for at, t in enumerate(self.bytes_a) if at not in special}, special_tokens={})

    def segments(self, segments: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, pair codes, groups as text) of each segment, None where the bytes differ from the segment's."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, segments
        # Segments that end in a word can stand one after the other: their tokens are the same as alone. Letters of other
        # scripts may be classed differently by the two libraries, and the space mark never comes back as itself.
        together = [s for s in new if self.fast and not s[-1].isspace() and _LATIN.fullmatch(s)]
        rest = set(new).difference(together) if len(together) < len(new) else ()
        for at in range(0, len(together), CHUNK):
            part = together[at : at + CHUNK]
            text = "".join(part)
            found = self._align(part, np.array(self.fast.encode_ordinary(text), np.int64), np.array(self.b.encode(text[1:]), np.int64))
            rest = [*rest, *part] if found is None else rest
            self.known.update(zip(part, found or ()))
        for text in rest:
            b = [self.lone_space] if text == " " else self.b.encode(text[1:])
            found = self._align([text], np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), np.array(b, np.int64))
            self.known[text] = found[0] if found else None
        return [self.known[s] for s in segments]

    def _align(self, segments: list[str], a: np.ndarray, b: np.ndarray) -> list[tuple] | None:
        """Alignment of segments from the tokens of their texts joined; None if the tokens' bytes are not theirs."""
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        if b"".join([self.bytes_a[t] for t in a.tolist()]) != (joined := b"".join(raw)) or b"".join([self.bytes_b[t] for t in b.tolist()]) != joined:
            return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.append(0, np.cumsum([len(r) for r in raw]))
        first_a, first_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
        if (ends_a[first_a[1:] - 1] != cuts[1:]).any() or (ends_b[first_b[1:] - 1] != cuts[1:]).any():
            return None
        link_a, link_b, group = merge(ends_a, ends_b)
        codes = ((a[link_a] << BITS_B) + b[link_b]).astype(np.int32).tobytes()
        first = (4 * np.searchsorted(link_a, first_a)).tolist()
        opens = np.append(True, group[1:] != group[:-1])  # first link of each group
        open_a, open_b = np.append(link_a[opens], len(a)).tolist(), np.append(link_b[opens], len(b)).tolist()
        groups = np.searchsorted(link_a[opens], first_a).tolist()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        told = [
            f"{text_a[i]}|{text_b[j]}" if k - i == 1 == m - j else ",".join(text_a[i:k]) + "|" + ",".join(text_b[j:m])
            for i, k, j, m in zip(open_a[:-1], open_a[1:], open_b[:-1], open_b[1:])]
        sizes = zip(np.diff(first_a).tolist(), np.diff(first_b).tolist())
        return [(x, y, g1 - g0, codes[l0:l1], told[g0] if g1 - g0 == 1 else ";".join(told[g0:g1]))
                for (x, y), g0, g1, l0, l1 in zip(sizes, groups[:-1], groups[1:], first[:-1], first[1:])]


def cut_segments(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Segments of space + text: the distinct ones, a code per segment, and each text's first segment (one more entry for the end).

    A segment begins before a space that follows a character other than white space. No token of either
    vocabulary spans such a place, and neither looks across it, so segments are tokenised on their own.
    The distinct ones are few beside the words of a corpus.
    """
    words = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = words.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    offsets = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py() if len(words) else np.zeros(1, np.int64)
    goes_on = np.array([not w or w[-1].isspace() for w in names], bool)[codes] if names else np.zeros(0, bool)
    starts = np.append(True, ~goes_on[:-1]) if len(codes) else np.zeros(0, bool)
    starts[offsets[:-1]] = True
    segments, place = [" " + w for w in names], {}
    at = np.flatnonzero(starts)
    size = np.diff(np.append(at, len(codes)))
    out = codes[at].copy()
    for k in np.flatnonzero(size > 1).tolist():
        text = " " + " ".join([names[c] for c in codes[at[k] : at[k] + size[k]]])
        if text not in place:
            place[text] = len(segments)
            segments.append(text)
        out[k] = place[text]
    used, out = np.unique(out, return_inverse=True)
    return [segments[k] for k in used.tolist()], out, np.append(0, np.cumsum(starts))[offsets]


def aligned(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the counts, the hash of the groups, and its links as packed (pair code, times) lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pair = pair_of(vocabulary_a, vocabulary_b)
        keep("alignment", forget_pairs)
        for batch in parts(batches):
            segments, codes, first = cut_segments(batch.column("text"))
            found = pair.segments(segments)
            fits = np.array([f is not None for f in found], bool)
            found = [f or (0, 0, 0, b"", "") for f in found]
            counts = np.array([f[:3] for f in found], np.int64).reshape(-1, 3)
            names = [f[4] for f in found]
            links, begins = gather([f[3] for f in found], codes)
            out = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "n_pairs")}
            for k, text in enumerate(pc.binary_length(pc.fill_null(batch.column("text"), "")).to_pylist()):
                mine = codes[first[k] : first[k + 1]]
                row = (0, 0, 0, 0, "", None, 0)
                if text and fits[mine].all():
                    seen, times = np.unique(own := links[begins[first[k]] : begins[first[k + 1]]], return_counts=True)
                    packed = np.concatenate([np.diff(seen, prepend=np.int32(0)), times.astype(np.int32)])
                    digest = sha256(";".join([names[c] for c in mine.tolist()]).encode()).hexdigest()
                    row = (*counts[mine].sum(0).tolist(), len(own), digest, pa.compress(packed.tobytes(), "zstd", asbytes=True), len(seen))
                for name, value in zip(out, row):
                    out[name].append(value)
            yield {"doc_id": batch.column("doc_id"), **out}

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, n_pairs long"
    return map_partition(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, schema, owner="alignment")


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the batch, pair code, times) of all links of a batch."""
    rows, codes, times = [], [], []
    for k, (packed, n) in enumerate(zip(batch.column("links").to_pylist(), batch.column("n_pairs").to_pylist())):
        if n:
            flat = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.int32)
            codes.append(np.cumsum(flat[:n], dtype=np.int64))
            times.append(flat[n:].astype(np.int64))
            rows.append(np.full(n, k))
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(v or none) for v in (rows, codes, times))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, n): in how many links of all rows each id pair stands; every task adds up its own rows first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0

        def flush() -> dict:
            codes, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, np.concatenate([h[1] for h in held]))
            return {"code": codes, "n": n}

        for batch in batches:
            _, codes, times = _links(batch)
            held.append((codes, times))
            size += len(codes)
            if size > FLUSH:
                merged = flush()
                held, size = [(merged["code"], merged["n"])], len(merged["code"])
                if size > FLUSH // 2:
                    yield merged
                    held, size = [], 0
        if size:
            yield flush()

    return map_partition(rows.select("links", "n_pairs"), work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, top: int = TOP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): token, group and link counts, the hash of its groups, and how common its links are.

    Null and empty texts, and texts whose tokens' bytes are not those of space + text, have no tokens: zeros
    and an empty hash. Rows are judged on their own, also repeated ones and those without doc_id; other columns are
    ignored. Counts of the ``top`` most common id pairs at most go to every task; links of rarer pairs
    are joined with their counts, none of which can be large, and the best count of each B id goes along
    (one number per vocabulary entry).
    """
    rows = cut_lineage(aligned(docs, vocabulary_a, vocabulary_b).withColumn("row", F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(rows))
    # Pairs by powers of two of their count: as few numbers as a count has bits.
    power = F.floor(F.log2("n")).cast("int")
    least, room = 63, top
    for r in counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():
        if (room := room - r["count"]) < 0:
            break
        least = r.power
    common = counts.filter(power >= least).orderBy("code").toArrow()  # at most ``top``
    codes, times = (common.column(c).to_numpy() for c in ("code", "n"))
    b_id = F.col("code").bitwiseAND((1 << BITS_B) - 1).alias("b")
    highest = cut_lineage(counts.groupBy(b_id).agg(F.max("n").alias("highest")))  # one row per entry of B's vocabulary at most
    best = np.zeros(1 << BITS_B, np.int64)
    for r in highest.collect():
        best[r.b] = r.highest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at, code, m = _links(batch)
            place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[place] == code if len(codes) else np.zeros(len(code), bool)
            n = np.zeros(len(code), np.int64)
            n[known] = times[place[known]]
            n_best, count_sum = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(count_sum, at, n * m)
            np.add.at(n_best, at, np.where(known & (n == best[code & ((1 << BITS_B) - 1)]), m, 0))
            cut = np.searchsorted(at[~known], np.arange(batch.num_rows + 1))
            rest = [[v[~known][a:b] for a, b in zip(cut[:-1], cut[1:])] for v in (code, m)]
            yield {**{c: batch.column(c) for c in KEPT}, "n_best": n_best, "count_sum": count_sum, "codes": rest[0], "times": rest[1]}

    done = cut_lineage(map_partition(rows, work, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in (*KEPT, "n_best", "count_sum"))
                                     + ", codes array<long>, times array<long>"))
    pairs = done.filter(F.size("codes") > 0).select("row", F.explode(F.arrays_zip("codes", "times")).alias("v")).select("row", "v.codes", "v.times")
    rare = counts.filter(power < least).select(F.col("code").alias("codes"), "n", b_id).join(F.broadcast(highest), "b")
    more = pairs.join(rare, "codes").groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    total = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return done.join(more, "row", "left").select(*KEPT[1:-1], *total, "groups_sha256")
