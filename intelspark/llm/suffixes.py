"""Repeated substrings by suffix grouping: bytes of every 50-byte string that also starts in an earlier document.

A map over the documents finds, for each 50-byte string, its anchor: the 26-byte string of smallest hash
inside. Equal strings have equal anchors at equal places, so strings can be compared anchor by anchor:
the stretch of text around an anchor (its context) holds the 50-byte strings that the anchor stands for.
Contexts, without the bytes of the anchor that its hash stands for, travel in packed blocks to the bucket of their anchor, equal ones of a block once. There,
anchors of one document have nothing to share, anchors with a single context share all of it, and the
contexts of all others are suffix-sorted in linear time to find which of their strings are equal.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intelspark.llm.common import U64, map_partition, mix, powers, range_hashes, slices
from intelspark.session import cut_lineage

LENGTH, ANCHOR = 50, 26
REACH = LENGTH - ANCHOR + 1  # anchors that a string could have
AROUND = LENGTH - 1 - ANCHOR  # bytes of a context besides its anchor, less its strings
BUCKET_BYTES = 2 << 20  # text whose contexts share a bucket, on average
SHARE_BYTES = 16 << 20  # text of the documents that are cut together at the end, on average
PART_BYTES = 4 << 20  # text whose contexts are packed together
SORT_SYMBOLS = 1 << 16  # symbols sorted at a time


def suffix_order(text: list[int]) -> list[int]:
    """Suffix array of a list of numbers, by grouping suffixes with their Lyndon prefixes.

    Groups are held as ranges of ``order``. From the highest range down, each member finds the suffix
    before it that is smaller; those parents grow by the group's prefix and move to the top of their own
    range, higher the more members they have. Then the final order is read off: a suffix in its place
    tells the places of those whose Lyndon prefix ends before it.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start = [0] * n, [0] * n  # of each suffix: its index in order, the first index of its range
    end: dict[int, int] = {}  # of each range
    first = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            end[first] = i
            first = i
        place[s], start[s] = i, first
    end[first] = n
    before, done = [-1] * n, [False] * n
    top = n
    while top:
        low = start[order[top - 1]]
        members = order[low:top]
        members.sort()
        count: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i], done[i] = j, True
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, k in count.items():
            if k in levels:
                levels[k].append(p)
            else:
                levels[k] = [p]
        for k in sorted(levels, reverse=True):
            cut: dict[int, int] = {}
            for p in levels[k]:
                own = start[p]
                to = cut.get(own, end[own]) - 1
                cut[own] = to
                other, at = order[to], place[p]
                order[at], order[to], place[other], place[p] = other, p, at, to
            for own, to in cut.items():
                if to > own:
                    end[to], end[own] = end[own], to
                    for x in order[to : end[to]]:
                        start[x] = to
        top = low
    out, placed, front = [-1] * n, [False] * n, {}
    i = -1
    while i < n:
        j = (out[i] if i >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            own = start[j]
            at = front.get(own, own)
            out[at], front[own], placed[j] = j, at + 1, True
            j = before[j]
        i += 1
    return out


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every stretch of ``size`` numbers."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(data) - size + 1])


def owners(h: np.ndarray) -> np.ndarray:
    """For each 50-byte string the place of its anchor: the first of the smallest hashes."""
    value, place, step = h, np.arange(len(h), dtype=np.int32), 1
    while step < REACH:
        width = min(step, REACH - step)
        right = value[width:] < value[:-width]
        place, value = np.where(right, place[width:], place[:-width]), np.where(right, value[width:], value[:-width])
        step += width
    return place


def _pack(*columns: np.ndarray | bytes) -> bytes:
    import zstandard

    raw = [c if isinstance(c, bytes) else c.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw)) + b"".join(raw))


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    sizes, at, out = struct.unpack_from(f"<{n}q", raw, 8), 8 * (n + 1), []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: high bytes that are alike pack to little."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _whole(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _contexts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block): packed distinct contexts of some documents, and where each stands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in (s for batch in batches for s in slices(batch, limit=PART_BYTES)):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            raws, found, base = [], [], 0
            for doc, text in zip(ids, texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH or doc is None:
                    continue
                data = np.frombuffer(raw, np.uint8)
                h = hashes(data, ANCHOR)
                anchor = owners(h)
                first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                n = np.diff(np.append(first, len(anchor)))
                up, down = powers(len(data) + 1)
                sums = np.append(U64(0), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)]))
                whole = mix((sums[first + n + LENGTH - 1] - sums[first]) * down[first] + n.astype(U64))
                at = anchor[first]
                found.append((h[at], mix(whole + h[at]), np.full(len(first), doc, np.int64), first.astype(np.uint32), n.astype(np.uint8), (at - first).astype(np.uint8), first + base))
                raws.append(raw)
                base += len(raw)
            if not found:
                continue
            anchor, context, doc, first, n, rel, at = (np.concatenate(c) for c in zip(*found))
            everything = b"".join(raws)
            found = raws = None
            anchor = mix(anchor)  # the smallest of many hashes are small; mixed, they fill all buckets alike
            bucket = ((anchor >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            order = np.lexsort((doc, context, anchor))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = {"bucket": [], "block": []}
            for b in np.flatnonzero(np.diff(edges)).tolist():
                some = order[edges[b] : edges[b + 1]]
                c = context[some]
                head = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (anchor[some[1:]] != anchor[some[:-1]])))
                k = some[head]
                stretch = b"".join([x for a, m, e in zip(at[k].tolist(), (at[k] + rel[k]).tolist(), (at[k] + n[k] + LENGTH - 1).tolist())
                                    for x in (everything[a:m], everything[m + ANCHOR : e])])
                low = int(doc[some].min())
                span = doc[some] - low
                span = span.astype(np.uint32) if span.max() < 1 << 32 else span
                out["bucket"].append(b)
                out["block"].append(_pack(
                    _planes(np.diff(anchor[k], prepend=U64(0))), rel[k], n[k], _planes(np.diff(np.append(head, len(some))).astype(np.uint32)),
                    np.array([low, span.itemsize]), _planes(span), _planes(first[some]), stretch))
            yield out

    return map_partition(docs, work, "bucket long, block binary")


class _Bucket:
    """Contexts of a bucket, put together from blocks."""

    def __init__(self, blocks: list[bytes]):
        columns: list[list] = [[] for _ in range(7)]
        for block in blocks:
            anchor, rel, n, count, base, span, first, stretch = _unpack(block)
            low, width = np.frombuffer(base, np.int64)
            doc = _whole(span, np.uint32 if width == 4 else np.int64).astype(np.int64) + low
            values = (np.cumsum(_whole(anchor, U64), dtype=U64), np.frombuffer(rel, np.uint8), np.frombuffer(n, np.uint8), _whole(count, np.uint32),
                      doc, _whole(first, np.uint32), np.frombuffer(stretch, np.uint8))
            for column, v in zip(columns, values):
                column.append(v)
        self.anchor, rel, n, count, self.doc, self.first, self.data = (np.concatenate(c) for c in columns)
        self.rel, self.n, self.count = rel.astype(np.int64), n.astype(np.int64), count.astype(np.int64)
        self.at = np.cumsum(self.n + AROUND) - (self.n + AROUND)
        self.begin = np.cumsum(self.count) - self.count
        self.smallest, self.largest = np.minimum.reduceat(self.doc, self.begin), np.maximum.reduceat(self.doc, self.begin)
        self.window = np.cumsum(self.n) - self.n

    def smallest_documents(self) -> np.ndarray:
        """For each 50-byte string of each context the smallest document that holds it."""
        size = self.n + AROUND
        whole = mix(U64(1) + self.rel.astype(U64) + np.concatenate([
            range_hashes(self.data[self.at[a] : self.at[a : a + 8192][-1] + size[a : a + 8192][-1]], self.at[a : a + 8192] - self.at[a], self.at[a : a + 8192] - self.at[a] + size[a : a + 8192])
            for a in range(0, len(size), 8192)]))
        order = np.lexsort((whole, self.anchor))
        a, w = self.anchor[order], whole[order]
        group = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        same = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])))
        # Equal contexts first: they share the smallest document.
        least = np.empty(len(a), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(self.smallest[order], same), np.diff(np.append(same, len(a))))
        shared = np.minimum.reduceat(self.smallest[order], group) < np.maximum.reduceat(self.largest[order], group)
        distinct = np.add.reduceat(np.isin(np.arange(len(a)), same).astype(int), group)
        out = np.repeat(least, self.n)
        mixed = np.repeat(shared & (distinct > 1), np.diff(np.append(group, len(a))))
        unclear = order[same[mixed[same]]]  # a context of each kind, anchors kept together
        if len(unclear):
            size = self.rel[unclear] + 1 + self.n[unclear] + LENGTH - 1 - self.rel[unclear] - ANCHOR + 1
            total, a = np.cumsum(size), self.anchor[unclear]
            value, key = [], []
            begin = 0
            while begin < len(unclear):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SORT_SYMBOLS, "right")))
                while end < len(unclear) and end - 1 > begin and a[end] == a[end - 1] and a[begin] != a[end]:
                    end -= 1  # an anchor that fits is not cut
                v, k = self._sorted(unclear[begin:end], least)
                value.append(v)
                key.append(k)
                begin = end
            value, key = np.concatenate(value), np.concatenate(key)
            # An anchor with more contexts than are sorted at a time meets its other parts here.
            by = np.argsort(key, kind="stable")
            runs = np.flatnonzero(np.append(True, key[by[1:]] != key[by[:-1]]))
            value[by] = np.repeat(np.minimum.reduceat(value[by], runs), np.diff(np.append(runs, len(by))))
            # Back to all contexts: those equal to a sorted one take over its strings.
            source = np.full(len(self.anchor), -1)
            source[unclear] = np.cumsum(self.n[unclear]) - self.n[unclear]
            source[order] = np.repeat(source[order[same]], np.diff(np.append(same, len(order))))
            for c in np.flatnonzero(source >= 0).tolist():
                out[self.window[c] : self.window[c] + self.n[c]] = value[source[c] : source[c] + self.n[c]]
        return out

    def _sorted(self, some: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest document of each string of the contexts ``some``, and a key of the string."""
        symbols, starts, docs = [], [], []
        names = {a: 257 + i for i, a in enumerate(dict.fromkeys(self.anchor[some].tolist()))}
        for c in some.tolist():
            at, rel, n = int(self.at[c]), int(self.rel[c]), int(self.n[c])
            starts.append(np.arange(len(symbols), len(symbols) + n))
            docs.append(np.full(n, least[c]))
            symbols += (self.data[at : at + rel].astype(int) + 1).tolist()
            symbols.append(names[int(self.anchor[c])])
            symbols += (self.data[at + rel : at + n + AROUND].astype(int) + 1).tolist()
            symbols.append(0)
        starts, docs = np.concatenate(starts), np.concatenate(docs)
        slot = np.full(len(symbols), -1)
        slot[starts] = np.arange(len(starts))
        ranked = slot[np.array(suffix_order(symbols))]
        ranked = ranked[ranked >= 0]
        named = np.array(symbols, U64)
        anchors = np.fromiter(names, U64, len(names))
        big = named > 256
        named[big] = anchors[(named[big] - U64(257)).astype(np.int64)]
        key = hashes(named, REACH)[starts]  # equal strings of REACH symbols stand side by side in suffix order
        k = key[ranked]
        runs = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        value = np.empty(len(starts), np.int64)
        value[ranked] = np.repeat(np.minimum.reduceat(docs[ranked], runs), np.diff(np.append(runs, len(ranked))))
        return value, key

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of stretches all of whose strings stand in a smaller document."""
        least = self.smallest_documents()
        low, high = np.minimum.reduceat(least, self.window), np.maximum.reduceat(least, self.window)
        context = np.repeat(np.arange(len(self.n)), self.count)
        whole = high[context] < self.doc
        docs, a, b = [self.doc[whole]], [self.first[whole].astype(np.int64)], [self.first[whole] + self.n[context[whole]] + LENGTH - 1]
        some = np.flatnonzero(~whole & (low[context] < self.doc))
        n = self.n[context[some]]
        if len(some):
            row = np.repeat(np.arange(len(some)), n)
            w = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = least[self.window[context[some]][row] + w] < self.doc[some][row]
            row, w = row[hit], w[hit]
            head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (w[1:] != w[:-1] + 1)))
            tail = np.append(head[1:], len(row)) - 1
            docs.append(self.doc[some][row[head]])
            a.append(self.first[some][row[head]] + w[head])
            b.append(self.first[some][row[head]] + w[tail] + LENGTH)
        return np.concatenate(docs), np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)


def _share(doc: np.ndarray, shares: int) -> np.ndarray:
    return ((mix(doc.view(U64)) >> U64(32)) * U64(shares) >> U64(32)).astype(np.int64)


def _stretches(contexts: DataFrame, buckets: int, shares: int) -> DataFrame:
    """(share, block): packed (document, start, end) of removed stretches, by the share that the document is cut in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def solved(blocks: list[bytes]) -> dict:
            doc, a, b = _Bucket(blocks).removed()
            share = _share(doc, shares)
            order = np.lexsort((a, doc, share))
            edges = np.searchsorted(share[order], np.arange(shares + 1))
            held = np.flatnonzero(np.diff(edges)).tolist()
            cut = [order[edges[s] : edges[s + 1]] for s in held]
            return {"share": held, "block": [_pack(doc[o], a[o], (b - a)[o]) for o in cut]}

        current, blocks = None, []
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
                if bucket != current and blocks:
                    yield solved(blocks)
                    blocks = []
                current = bucket
                blocks.append(block.as_py())
        if blocks:
            yield solved(blocks)

    return map_partition(contexts.repartition(buckets, "bucket").sortWithinPartitions("bucket"), work, "share long, block binary")


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    removed = count = done = 0
    digest = sha256()
    end = None
    for a, b in sorted(spans):
        if end is None or a > end:
            count += 1
            digest.update(raw[done:a])
            removed, end, done = removed + b - a, b, b
        elif b > end:
            removed, end, done = removed + b - end, b, b
    digest.update(raw[done:])
    return removed, count, digest.hexdigest()


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when a 50-byte string that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input. n_spans counts maximal removed runs, kept_sha256 is the digest
    of what is left. Null and empty texts have no bytes. Rows of one id are one document to each other:
    neither takes bytes from the other, but what either row loses, both lose at its place, so ids should be unique.
    A row without an id takes part in nothing and loses nothing. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shares = 1 + size // BUCKET_BYTES, 1 + size // SHARE_BYTES
    blocks = cut_lineage(_stretches(_contexts(source, buckets), buckets, shares))  # the contexts go before the texts move

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in (s for batch in batches for s in slices(batch, limit=PART_BYTES)):
            ids = part.column("doc_id").fill_null(0).to_numpy()
            yield {"share": _share(ids, shares), "block": pa.nulls(len(ids), pa.binary()), "doc_id": part.column("doc_id"), "text": part.column("text")}

    texts = map_partition(source, numbered, "share long, block binary, doc_id long, text string")
    both = texts.unionByName(blocks, allowMissingColumns=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, spans = None, {}
        for part in (s for batch in batches for s in slices(batch, limit=PART_BYTES)):
            rows = []
            for share, block, doc, text in zip(*(part.column(c).to_pylist() for c in ("share", "block", "doc_id", "text"))):
                if share != current:
                    current, spans = share, {}
                if block is not None:
                    for d, a, n in zip(*(np.frombuffer(c, np.int64).tolist() for c in _unpack(block))):
                        spans.setdefault(d, []).append((a, a + n))
                else:
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    rows.append((doc, len(raw), *_kept(raw, [(a, min(b, len(raw))) for a, b in spans.get(doc, []) if a < len(raw)])))
            if rows:
                yield dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), zip(*rows)))

    dealt = both.repartition(shares, "share").sortWithinPartitions("share", F.col("block").isNull())
    return map_partition(dealt, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
