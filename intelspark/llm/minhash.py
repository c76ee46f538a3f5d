"""Near-duplicate documents by min-max hashing: every permutation gives its minimum and its maximum.

Documents with equal shingle sets are one class. Class representatives are banded (a band takes the
minima and maxima of three permutations). Pairs come from two passes, and both are confirmed on full sets:

1. in each bucket, sorted by the values that follow the band, neighbours and the head of each run are
   paired, beyond a bucket's first rows in every fourth bucket only: a number of pairs linear in the rows, enough
   to join most of a large group of copies. Which pairs these are settles only how much is left to the second
   pass, which takes all rows of all buckets;
2. in buckets that still hold several components, the rows outside the bucket's largest component are
   compared, block by block, with all its rows by signature; rows of different components whose
   estimate lies within five deviations of the threshold fall into one group. Inside a group, the rows
   outside its largest component meet all others with their full sets, again block by block; how many of a
   document's shingles any other of these groups' documents has bounds its similarity first.

Full sets are made and moved only for documents that the sketches leave in a pair of the first pass or in a
group of the second.

So a large group of copies is joined by a linear number of pairs, while no bucket-mates of different
components are left untested. Pairs of the second pass exist only inside a block's task, which returns
no more links than it has rows. Buckets and groups are cut into blocks, so none has to fit into one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intelspark.llm.common import U64, map_batches, map_partition, mix, shingles, texts_of
from intelspark.llm.components import components
from intelspark.session import cut_lineage

PERMS_PER_BAND = 3
MISS = 1e-6  # chance that a pair at the threshold shares no band
FEW, FIRST = 8, 4  # the first pass pairs the first FEW rows of a bucket, and all rows of one bucket in FIRST, chosen by the band's hash
RUN = 256  # rows of a bucket that share a head in the first pass
BLOCK = 512  # rows of a bucket or group in a block of the second pass
BITS = 1 << 23  # of the bitmap of documents whose full sets are made: 1 MB
BLOCK_BYTES = 2 << 20  # full sets in a block of the second pass, on average


def band_count(threshold: float) -> int:
    """Bands needed so that a pair at the threshold shares one but for a chance of ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold ** (2 * PERMS_PER_BAND)))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 2**32, n, dtype=np.uint64) | U64(1)).astype(np.uint32), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def signature(values: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(2, n) minima and maxima of the shingle hashes under each permutation; one evaluation serves both."""
    times, plus = perms[0][:, None], perms[1][:, None]
    low, high = np.full(len(times), 2**32 - 1, np.uint32), np.zeros(len(times), np.uint32)
    short = (values >> U64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        h = times * short[None, at : at + 2048] + plus
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.stack([low, high])


def bands(sig: np.ndarray, count: int) -> np.ndarray:
    """One 64-bit key per band from the minima and maxima of its permutations."""
    cut = sig.reshape(2, count, PERMS_PER_BAND).astype(U64)
    key = np.arange(count, dtype=U64)
    for side in cut:
        for j in range(PERMS_PER_BAND):
            key = mix(key * U64(0x9FB21C651E98DF25) + side[:, j])
    return key.view(np.int64)


def _signed(docs: DataFrame, words: int, count: int) -> DataFrame:
    perms_of = PERMS_PER_BAND * count

    def work(batch: pa.RecordBatch) -> dict:
        perms, known = permutations(perms_of), {}
        out = {"doc_id": batch.column(0), "n": [], "class": [], "sketch": [], "bands": []}
        for text in texts_of(batch):
            if text not in known:
                values = shingles(text, words)
                sig = signature(values, perms) if len(values) else None
                known[text] = (len(values), blake2b(values.tobytes(), digest_size=16).digest(),
                               None if sig is None else sig.astype(np.uint8).tobytes(), None if sig is None else bands(sig, count))
            n, cls, sketch, keys = known[text]
            out["n"].append(n)
            out["class"].append(cls)
            out["sketch"].append(sketch)
            out["bands"].append(keys)
        return out

    return map_batches(docs, work, "doc_id long, n long, class binary, sketch binary, bands array<bigint>")


def _near_pairs(rows: DataFrame) -> DataFrame:
    """First pass: pairs (a, b) from rows (band, next, doc_id): neighbours in order and the heads of runs."""
    ordered = rows.repartitionByRange("band", "next", "doc_id").sortWithinPartitions("band", "next", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tail_band, tail_id, head, since = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            band, ids = batch.column("band").to_numpy(), batch.column("doc_id").to_numpy()
            a, b = [], []
            for k, d in zip(band.tolist(), ids.tolist()):
                if k != tail_band:
                    head, since = d, 0
                elif d != tail_id:
                    since += 1
                    if since < FEW or k % FIRST == 0:
                        a.append(min(tail_id, d))
                        b.append(max(tail_id, d))
                        if head != tail_id and head != d:
                            a.append(min(head, d))
                            b.append(max(head, d))
                    if since % RUN == 0:
                        head = d
                tail_band, tail_id = k, d
            if a:
                pairs = np.unique(np.array([a, b]), axis=1)
                yield {"a": pairs[0], "b": pairs[1]}

    return map_partition(ordered, work, "a long, b long").filter("a <> b").distinct()


def _estimated(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """Pairs whose sketches agree in a share of ``floor`` or more."""
    one = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))

    def work(batch: pa.RecordBatch) -> dict:
        same = np.array([
            (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() >= floor
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())], bool)
        keep = pa.array(same)
        return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return map_batches(pairs.join(one, "a").join(two, "b"), work, "a long, b long")


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, items): packed full shingle sets of the documents of ``ids``."""

    def sets(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "items": [shingles(t, words).tobytes() for t in texts_of(batch)]}

    # Most texts are dropped where they are read, by a bitmap of fixed size; the join then drops those that share a bit with an id.
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    marked = ids.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("marks"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("marks", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = (docs.withColumn("part", F.bitmap_bucket_number(bit)).join(F.broadcast(marked), "part")
              .filter(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1).select(*docs.columns))
    return cut_lineage(map_batches(likely.join(ids, "doc_id", "left_semi"), sets, "doc_id long, items binary").dropDuplicates(["doc_id"]))


def _common(full: DataFrame) -> DataFrame:
    """(doc_id, n, common): set size, and how many of the shingles another document of ``full`` has too."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("items").to_pylist()):
                items = np.frombuffer(raw, np.int64)
                yield {"doc_id": np.full(len(items), doc), "item": items}

    lone = (map_partition(full, single, "doc_id long, item long").groupBy("item").agg(F.count("*").alias("held"), F.min("doc_id").alias("doc_id"))
            .filter("held = 1").groupBy("doc_id").agg(F.count("*").alias("own")))
    size = F.octet_length("items") / 8
    return full.select("doc_id", size.cast("long").alias("n")).join(lone, "doc_id", "left").select("doc_id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def _confirmed(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with den * intersection >= num * union on full shingle sets."""
    one, two = full.select(F.col("doc_id").alias("a"), F.col("items").alias("ia")), full.select(F.col("doc_id").alias("b"), F.col("items").alias("ib"))

    def work(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist()):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            common = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(len(x) > 0 and den * common >= num * (len(x) + len(y) - common))
        keep = pa.array(keep, pa.bool_())
        return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return map_batches(pairs.join(one, "a").join(two, "b"), work, "a long, b long")


def _stars(a: np.ndarray, b: np.ndarray) -> dict:
    """As many links as hold the same nodes together: each node with the smallest one it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[x], root[y])
        for end in (x, y, before[x], before[y]):
            np.minimum.at(root, end, low)
        root = root[root]
    led = root != np.arange(len(nodes))
    return {"a": nodes[root[led]], "b": nodes[led]}


def _stars_of_all(found: list[dict]) -> dict:
    """One set of stars from those of many blocks, each of which has no more links than rows."""
    none = np.zeros(0, np.int64)
    return _stars(*(np.concatenate([none, *[f[c] for f in found]]) for c in "ab"))


def _near(odd: tuple, every: tuple, floor: float, num: int, den: int) -> np.ndarray:
    """Which rows of ``odd`` and ``every`` are of different components and could be linked, by sketches and sizes."""
    (_, ri, ni, si, *ci), (_, rj, nj, sj, *cj) = odd, every
    same = np.zeros((len(ri), len(rj)), np.int32)
    for at in range(0, si.shape[1], 16):
        same += (si[:, None, at : at + 16] == sj[None, :, at : at + 16]).sum(2, dtype=np.int32)
    most = np.minimum((ci or [ni])[0][:, None], (cj or [nj])[0][None, :])  # of shingles in common
    return (same >= floor * si.shape[1]) & (den * most >= num * (ni[:, None] + nj[None, :] - most)) & (ri[:, None] != rj[None, :])


def _outlier_groups(members: DataFrame, labels: DataFrame, sketches: DataFrame, floor: float, num: int, den: int) -> DataFrame:
    """Second pass: links (a, b) that hold together all documents of different components whose sketches agree in a bucket."""
    named = members.join(labels, "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    rows = cut_lineage(named.join(mixed, "band"))
    top = (rows.groupBy("band", "root").agg(F.count("*").alias("n"))
           .groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("rows")))
    dealt = (rows.join(top, "band").join(sketches, "doc_id")
             .withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
             .withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id"), "blocks")).otherwise(0).cast("int")))
    whole = dealt.groupBy("band", "block").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "root", "n", "sketch"))).alias("all"), F.first("main").alias("main"))
    out = whole.withColumn("odd", F.filter("all", lambda r: r["root"] != F.col("main"))).filter(F.size("odd") > 0).select("band", "odd")

    def work(batch: pa.RecordBatch) -> dict:
        found = []
        for odd, every in zip(batch.column("odd"), batch.column("all")):
            odd, every = _columns(odd), _columns(every)
            x, y = np.nonzero(_near(odd, every, floor, num, den))
            found.append(_stars(odd[0][x], every[0][y]))
        return _stars_of_all(found)

    return map_batches(out.join(whole.select("band", "all"), "band"), work, "a long, b long").distinct()


def _outlier_links(groups: DataFrame, labels: DataFrame, sketches: DataFrame, full: DataFrame, floor: float, num: int, den: int) -> DataFrame:
    """Confirmed links between different components inside each group of ``groups`` (doc_id, near).

    The rows outside a group's largest component meet all its rows block by block, with their full sets;
    a block returns as many links as hold its linked rows together.
    """
    named = (groups.join(labels, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
             .join(sketches, "doc_id").join(full, "doc_id"))
    rows = cut_lineage(named)
    top = (rows.groupBy("near", "root").agg(F.count("*").alias("rows"), F.sum(F.octet_length("items")).alias("bytes"))
           .groupBy("near").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")))
    dealt = (rows.join(top, "near")
             .withColumn("blocks", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("bytes") / BLOCK_BYTES)))
             .withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks")))
    held = F.collect_list(F.struct("doc_id", "root", "n", "common", "sketch", "items"))
    odd = dealt.filter("root <> main").groupBy("near", "block").agg(held.alias("odd")).drop("block")
    every = dealt.groupBy("near", "block").agg(held.alias("all"), F.first("main").alias("main")).drop("block")

    def work(batch: pa.RecordBatch) -> dict:
        found = []
        for odd, rows, main in zip(batch.column("odd"), batch.column("all"), batch.column("main").to_pylist()):
            left, right = _columns(odd, "common"), _columns(rows, "common")
            # Two rows outside the largest component meet twice; the first time is enough.
            near = _near(left, right, floor, num, den) & ((right[1] == main)[None, :] | (left[0][:, None] < right[0][None, :]))
            some, others = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(some):
                continue
            mine, theirs = _items(odd, some), _items(rows, others)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            known, code = np.unique(np.concatenate(theirs), return_inverse=True)
            ends = np.cumsum([len(t) for t in theirs])
            for i, items in zip(some.tolist(), mine):
                at = np.minimum(np.searchsorted(known, items), len(known) - 1)
                mark = np.zeros(len(known), np.int64)
                mark[at[known[at] == items]] = 1
                common = np.diff(np.cumsum(mark[code])[ends - 1], prepend=0)
                linked = near[i, others] & (den * common >= num * (left[2][i] + right[2][others] - common))
                b.append(right[0][others[linked]])
                a.append(np.full(len(b[-1]), left[0][i]))
            found.append(_stars(np.concatenate(a), np.concatenate(b)))
        return _stars_of_all(found)

    return map_batches(odd.join(every, "near"), work, "a long, b long").distinct()


def _items(rows: pa.ListScalar, some: np.ndarray) -> list[np.ndarray]:
    values = rows.values.field("items")
    return [np.frombuffer(values[i].as_py(), U64) for i in some.tolist()]


def _columns(rows: pa.ListScalar, *more: str) -> tuple[np.ndarray, ...]:
    values = rows.values
    sketch = np.frombuffer(b"".join(values.field("sketch").to_pylist()), np.uint8).reshape(len(values), -1)
    return *(values.field(c).to_numpy() for c in ("doc_id", "root", "n")), sketch, *(values.field(c).to_numpy() for c in more)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when den * intersection >= num * union of their sets of ``words``-word shingles
    (ASCII lower case, words split at space and tab..carriage return; fewer words: the whole sequence).
    component_id is the smallest doc_id reachable over links, kept tells whether it is the row's own id.
    A null or wordless text has an empty set and stands alone. Rows of one id count as one document in
    the graph. A row with a null id takes part in nothing: component_id null, kept true. Other columns
    are ignored; an empty table gives no rows.
    """
    count = band_count(num / den)
    values = 2 * PERMS_PER_BAND * count
    floor = num / den - 5 * math.sqrt(num / den * (1 - num / den) / values)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = cut_lineage(_signed(source, words, count))
    classes = cut_lineage(base.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")))
    heads = cut_lineage(base.join(classes, "class").filter("doc_id = rep").dropDuplicates(["class"]).select("doc_id", "n", "sketch", "bands"))
    following = F.transform("bands", lambda _, i: F.element_at("bands", (i + 1) % count + 1))
    rows = (heads.select("doc_id", F.explode(F.arrays_zip("bands", following.alias("following"))).alias("x"))
            .select("doc_id", F.col("x.bands").alias("band"), F.col("x.following").alias("next")))
    placed = rows.repartition("band")  # read by both sides of the join, moved once
    shared = placed.groupBy("band").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("band")
    members = cut_lineage(placed.join(shared, "band"))
    sketches = heads.select("doc_id", "n", "sketch")

    pairs = cut_lineage(_estimated(_near_pairs(members), sketches, floor))
    both = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    first = cut_lineage(_confirmed(pairs, _full_sets(source, both, words), num, den))
    labels = components(first).select(F.col("node").alias("doc_id"), "root")
    near = components(_outlier_groups(members.select("band", "doc_id"), labels, sketches, floor, num, den))
    groups = near.select(F.col("node").alias("doc_id"), F.col("root").alias("near"))
    full = _full_sets(source, groups.select("doc_id"), words)
    counted = _common(full).filter(den * F.col("common") >= num * F.col("n")).select("doc_id", "common")
    second = _outlier_links(groups, labels, sketches.join(counted, "doc_id"), full, floor, num, den)
    final = components(first.unionByName(second)).select(F.col("node").alias("rep"), "root")
    return (base.join(classes, "class", "left").join(final, "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("root", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))))
