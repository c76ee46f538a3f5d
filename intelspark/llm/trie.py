"""Prefix trie of conversations: nodes by hashes of prefixes, totals below each node by centroid decomposition."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intelspark.llm.common import U64, map_partition, mix
from intelspark.session import cut_lineage

GROUP = 20  # conversations of one group share the head of their first one
HEADS = 4  # a head has fewer turns than this
LOCAL = 4096  # nodes of a component that one task splits to the end
BLOCK = 8192  # conversation ids joined in one piece of text
KEY = ["depth", "p", "q"]  # a node: how many turns, and two hashes of them in order
SPACES = r"[^\x20\x09-\x0D]+"


def _turns(conversations: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    crc = F.crc32(F.col("conv_id").cast("long").cast("string").cast("binary"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *text, (crc % HEADS).cast("int").alias("h"))


def _sorted_turns(rows: DataFrame) -> DataFrame:
    """Head turns (side 0) and own turns (side 1) in order of conversation and place, as hashes, with their partition.

    The range partitioning also cuts a conversation of any length; its keys are short and in line with the
    order, so equal keys only meet where turn, role and the beginning of the text are equal.
    """
    order = W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    heads = rows.filter(F.col("conv") % GROUP == 0).withColumn("at", F.row_number().over(order)).filter(F.col("at") < HEADS)
    heads = heads.select(F.col("conv").alias("base"), F.col("at").cast("long").alias("turn"), "role", "text")
    convs = rows.select("conv", "h").distinct().withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    taken = convs.join(heads, "base").filter(F.col("turn") <= F.col("h")).select("conv", "turn", "role", "text", "h", F.lit(0).alias("side"))
    every = taken.unionByName(rows.withColumn("side", F.lit(1)))
    short = F.length("role") <= 32
    keys = ["conv", "side", F.asc_nulls_first("turn")]
    placed = every.repartitionByRange(*keys, F.substring("role", 1, 32), ~short, F.when(short, F.substring("text", 1, 32)).otherwise(""))
    placed = placed.sortWithinPartitions(*keys, "role", "text")
    return cut_lineage(placed.select(
        F.spark_partition_id().alias("part"), "conv", "side", "h", F.xxhash64(F.lit(1), "role", "text").alias("x"),
        F.xxhash64(F.lit(2), "text", "role").alias("y"), F.regexp_count("text", F.lit(SPACES)).cast("long").alias("words")))


def _walk(turns: DataFrame, counted: dict, summed: dict, lengths: dict) -> DataFrame:
    """One row per rebuilt turn with its depth, the hashes of the prefix it ends and of its parent's.

    A prefix hash is a sum of turn hashes mixed with their depth, so a conversation that spans partitions
    only needs what lies before each of them: ``counted[part]`` (conv, own turns, head turns),
    ``summed[part]`` (the two sums) and ``lengths[conv]``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        part, conv, side, h, x, y, words = (table.column(i).to_numpy() for i in range(7))
        first = np.append(True, conv[1:] != conv[:-1])
        starts, run = np.flatnonzero(first), np.cumsum(first) - 1
        known = counted.get(int(part[0]), (None, 0, 0))
        own_before, head_before = known[1:] if known[0] == conv[0] else (0, 0)

        def within(a: np.ndarray, before) -> np.ndarray:
            total = np.cumsum(a)
            base = (total - a)[starts]
            base[:1] -= np.array([before], a.dtype)
            return total - base[run]

        own = (side == 1).astype(np.int64)
        keep = (own == 0) | (within(own, own_before) > h)
        kept_before = head_before + max(0, own_before - int(h[0]))
        depth = within(keep.astype(np.int64), kept_before)
        size = depth[np.append(starts[1:], len(conv)) - 1]
        for at in {0, len(starts) - 1}:
            size[at] = lengths.get(int(conv[starts[at]]), size[at])
        size = size[run]
        out = {"part": part[keep], "conv": conv[keep], "depth": depth[keep], "words": words[keep], "left": (size - depth + 1)[keep], "ends": (size == depth)[keep]}
        for i, (name, value) in enumerate((("p", x), ("q", y))):
            tag = np.where(keep, mix(value.astype(U64) + depth.astype(U64) * U64(0x9E3779B97F4A7C15)), U64(0))
            before = summed.get(int(part[0]), (0, 0))[i] if known[0] == conv[0] else 0
            prefix = within(tag, before)
            out[name], out["up_" + name] = prefix[keep].view(np.int64), (prefix - tag)[keep].view(np.int64)
        yield out

    schema = "part int, conv long, depth long, p long, q long, up_p long, up_q long, words long, left long, ends boolean"
    return map_partition(turns, work, schema)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ends): a row per rebuilt turn as ``_walk`` gives it, and where each conversation ends (conv, depth, p, q)."""
    rows = _turns(conversations)
    turns = _sorted_turns(rows)
    runs = turns.groupBy("part", "conv").agg(F.sum("side").alias("own"), F.sum(1 - F.col("side")).alias("head"), F.max("h").alias("h"))
    # Conversations that span partitions of the sort: one row per partition and its first or last conversation.
    spanning = runs.join(runs.groupBy("conv").count().filter("count > 1").select("conv"), "conv").orderBy("conv", "part").collect()
    counted, lengths, sums, last = {}, {}, {}, None
    for r in spanning:
        if last != r.conv:
            last, own, head = r.conv, 0, 0
        else:
            counted[r.part] = (r.conv, own, head)  # goes on from an earlier partition
        own, head = own + r.own, head + r.head
        lengths[r.conv] = head + max(0, own - r.h)
    if spanning:
        pieces = _walk(turns.filter(F.col("conv").isin(list(lengths))), counted, {}, lengths).groupBy("conv", "part").agg(F.max_by(F.struct("p", "q"), "depth").alias("s"))
        got, last = {(r.conv, r.part): r.s for r in pieces.collect()}, None
        for r in spanning:
            if last != r.conv:
                last, p, q = r.conv, 0, 0
            else:
                sums[r.part] = (p, q)
            if (r.conv, r.part) in got:
                p, q = ((v + w) % (1 << 64) for v, w in zip((p, q), got[r.conv, r.part]))
    walked = cut_lineage(_walk(turns, counted, sums, lengths))
    ends = walked.filter("ends").select("conv", *KEY)
    none = rows.select("conv").distinct().join(ends.select("conv"), "conv", "left_anti")
    return walked, ends.unionByName(none.select("conv", *[F.lit(0).cast("long").alias(k) for k in KEY]))


def _hash_of_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ending conversations, ascending and comma-joined.

    Ids are first joined into blocks by a range sort that cuts large nodes; the hash of one node, which
    SHA-256 makes sequential, then streams over its blocks in constant memory.
    """
    schema = "depth long, p long, q long, first long, ids string"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            conv, depth, p, q = (batch.column(n).to_numpy() for n in ("conv", *KEY))
            new = np.append(True, (depth[1:] != depth[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) if len(conv) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(starts, np.append(starts[1:], len(conv)))]) if len(conv) else starts
            text = [str(c) for c in conv.tolist()]
            ids = [",".join(text[a:b]) for a, b in zip(starts, np.append(starts[1:], len(conv)))]
            yield {"depth": depth[starts], "p": p[starts], "q": q[starts], "first": conv[starts], "ids": ids}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, digest, done = None, None, []
        for batch in batches:
            for *at, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids"))):
                if at == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = at, sha256(ids.encode())
            if done:
                yield dict(zip((*KEY, "ends_sha256"), zip(*done)))
                done = []
        if key is not None:
            yield dict(zip((*KEY, "ends_sha256"), zip((*key, digest.hexdigest()))))

    placed = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    found = map_partition(placed, blocks, schema).repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return map_partition(found, join, "depth long, p long, q long, ends_sha256 string")


def split_to_the_end(parent: np.ndarray, weight: np.ndarray, values: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Totals of ``values`` (rows by node) below and at every node of a forest, plus the node's ``extra``.

    ``weight`` is the total of a positive weight below and at each node. Every component is split at its
    centroid, the lowest node with more than half of the component's weight; the total below it goes to the
    nodes between it and the component's top, which are just those that also have more than half. All
    components of a level are treated at once, so there are at most log2(largest weight) levels.
    """
    parent, weight, extra, total = parent.copy(), weight.copy(), extra.copy(), np.zeros_like(values)
    live, top = np.arange(len(parent)), np.empty(len(parent), np.int64)

    def find_tops() -> None:
        top[live] = np.where(parent[live] < 0, live, parent[live])
        while True:
            further = top[top[live]]
            if (further == top[live]).all():
                return
            top[live] = further

    find_tops()
    while len(live):
        heavy = live[2 * weight[live] > weight[top[live]]]
        lowest = np.ones(len(parent), bool)
        lowest[parent[heavy][parent[heavy] >= 0]] = False
        centre = heavy[lowest[heavy]]
        at = np.empty(len(parent), np.int64)
        at[top[centre]] = centre
        mine = at[top]  # the centroid of each live node's component
        old = top.copy()
        is_centre = np.zeros(len(parent), bool)
        is_centre[centre] = True
        parent[live[(parent[live] >= 0) & is_centre[parent[live]]]] = -1
        live = live[~is_centre[live]]
        cut = live[parent[live] < 0]
        new = cut[old[cut] != cut]  # tops that hung at a centroid
        find_tops()
        below = np.zeros(len(parent), bool)
        below[new] = True
        part = values[centre].copy()
        place = np.empty(len(parent), np.int64)
        place[centre] = np.arange(len(centre))
        inside = live[below[top[live]]]
        np.add.at(part, place[mine[inside]], values[inside])
        total[centre] = part + extra[centre]
        above = heavy[~is_centre[heavy]]
        extra[above] += part[place[mine[above]]]
        weight[above] -= weight[mine[above]]
    return total


COMP = ["c_depth", "c_p", "c_q"]  # a component is named by its top
STATE = [*KEY, "conv", "up_p", "up_q", "weight", "leaves", "saved", "more_leaves", "more_saved", *COMP]


def _finish_small(small: DataFrame) -> DataFrame:
    """Components of bounded size, whole ones side by side in a task, each split to the end there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            comp = [table.column(c).to_numpy() for c in COMP]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in comp], axis=0))
            cut = int(np.flatnonzero(new)[-1])  # the last component may go on in the next batch
            if cut >= LOCAL:
                yield solve(table.slice(0, cut), np.cumsum(new[:cut]) - 1)
                table = table.slice(cut)
            rest = table
        if rest is not None and rest.num_rows:
            comp = [rest.column(c).to_numpy() for c in COMP]
            yield solve(rest, np.cumsum(np.append(True, np.any([c[1:] != c[:-1] for c in comp], axis=0))) - 1)

    def solve(table: pa.Table, comp: np.ndarray) -> dict:
        col = {c: table.column(c).to_numpy() for c in STATE}
        kind = np.dtype([("c", np.int64), ("d", np.int64), ("p", np.int64), ("q", np.int64)])
        key, up = np.empty(len(comp), kind), np.empty(len(comp), kind)
        for a, cols, less in ((key, ("p", "q"), 0), (up, ("up_p", "up_q"), 1)):
            a["c"], a["d"], a["p"], a["q"] = comp, col["depth"] - less, col[cols[0]], col[cols[1]]
        order = np.argsort(key, order=("c", "d", "p", "q"))
        at = np.minimum(np.searchsorted(key[order], up), len(key) - 1)
        parent = np.where(key[order[at]] == up, order[at], -1)
        values = np.stack([col["leaves"], col["saved"]], 1)
        total = split_to_the_end(parent, col["weight"], values, np.stack([col["more_leaves"], col["more_saved"]], 1))
        return {**{k: col[k] for k in KEY}, "n_leaves": total[:, 0], "saved_tokens": total[:, 1]}

    placed = small.select(*STATE).repartition(*COMP).sortWithinPartitions(*COMP)
    return map_partition(placed, work, "depth long, p long, q long, n_leaves long, saved_tokens long")


def totals_below(forest: DataFrame, turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """(key, n_leaves, saved_tokens): sums of ``leaves`` and ``saved`` over the subtree of every node, by centroid decomposition.

    ``forest`` has KEY, conv (a member), up_p, up_q, weight (its members' turns from here on, so the weight below
    a node needs no recursion), leaves and saved; ``turns`` tells which node a member passes at any depth. While a
    component has more than ``local`` nodes, a round over all such components finds each one's centroid, sums up
    what lies below it, adds that to the nodes above it and splits the component; smaller ones are finished in
    tasks. A round halves the weight of every component, whatever the depth or fan-out of the trie.
    """
    zero = F.lit(0).cast("long")
    state = forest.select(*STATE[:9], zero.alias("more_leaves"), zero.alias("more_saved"), *[zero.alias(c) for c in COMP])
    passed = turns.select("conv", F.col("depth").alias("z_next"), F.col("p").alias("n_p"), F.col("q").alias("n_q"), F.col("up_p").alias("n_up_p"), F.col("up_q").alias("n_up_q"))
    small, done = [], []
    while True:
        sizes = state.groupBy(*COMP).agg(F.max("weight").alias("whole"), F.count(F.lit(1)).alias("n"))
        state = cut_lineage(state.join(sizes, COMP))
        small.append(state.filter(F.col("n") <= local).select(*STATE))
        large = state.filter(F.col("n") > local)
        if large.isEmpty():
            break
        heavy = 2 * F.col("weight") > F.col("whole")
        centre = large.filter(heavy).groupBy(*COMP).agg(F.max_by(F.struct(*KEY, "weight"), "depth").alias("z"))
        z = {k: F.col(f"z.{k}") for k in (*KEY, "weight")}
        marked = large.join(centre, COMP).withColumn("heavy", heavy).withColumn("z_next", F.when(F.col("depth") > z["depth"], z["depth"] + 1))
        below = F.coalesce((F.col("n_up_p") == z["p"]) & (F.col("n_up_q") == z["q"]), F.lit(False))
        is_centre = (F.col("depth") == z["depth"]) & (F.col("p") == z["p"]) & (F.col("q") == z["q"])
        marked = cut_lineage(marked.join(passed, ["conv", "z_next"], "left").withColumn("below", below).withColumn("is_centre", is_centre))
        parts = marked.filter("below or is_centre").groupBy(*COMP).agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
        marked = marked.join(parts, COMP)
        done.append(marked.filter("is_centre").select(
            *KEY, (F.col("t_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("t_saved") + F.col("more_saved")).alias("saved_tokens")))
        named = dict(zip(COMP, ("z_next", "n_p", "n_q")))
        state = marked.filter(~F.col("is_centre")).select(
            *STATE[:6], F.when(F.col("heavy"), F.col("weight") - z["weight"]).otherwise(F.col("weight")).alias("weight"), "leaves", "saved",
            *[F.when(F.col("heavy"), F.col(f"more_{v}") + F.col(f"t_{v}")).otherwise(F.col(f"more_{v}")).alias(f"more_{v}") for v in ("leaves", "saved")],
            *[F.when(F.col("below"), F.col(n)).otherwise(F.col(c)).alias(c) for c, n in named.items()])
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    out = _finish_small(out)
    for more in done:
        out = out.unionByName(more)
    return out


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """Per node of the trie of rebuilt conversations: the columns of the contract.

    Conversation c takes the first h = crc32(c) % 4 turns of conversation c - c % 20, then its own turns after
    its first h. Turns are ordered by turn (null first), then role, then text; a null role or text counts as empty.
    Rows without conv_id belong to no conversation and are left out, repeated rows are turns of their own, other
    columns are ignored, and without conversations there is no node. Two different prefixes are told apart by 128
    bits of hashes. Nodes of a single conversation have one leaf and save nothing: only nodes of two or more
    members (and the root) take part in the decomposition, each with its single-member children as leaves.
    """
    turns, ends = rebuilt_turns(conversations)
    ends = cut_lineage(ends)
    nodes = turns.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("up_p").alias("up_p"), F.min("up_q").alias("up_q"), F.sum("left").alias("weight"))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("depth") + 1).alias("weight")).filter("n_convs > 0")
    root = root.select(*[zero.alias(k) for k in KEY], "conv", "n_convs", zero.alias("words"), zero.alias("up_p"), zero.alias("up_q"), "weight")
    nodes = cut_lineage(nodes.unionByName(root))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("tails"))
    nodes = cut_lineage(nodes.join(children, KEY, "left").na.fill(0, ["n_children", "tails"]))
    leaves = F.col("tails") + (F.col("n_children") == 0).cast("long")
    core = nodes.filter("n_convs > 1").select(*STATE[:7], leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = totals_below(core, turns, local)
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv").alias("parent_conv_id"))
    own_hash = F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest()))
    return nodes.join(parents, ["depth", "up_p", "up_q"], "left").join(totals, KEY, "left").join(_hash_of_ends(ends), KEY, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), own_hash.alias("ends_sha256"))
