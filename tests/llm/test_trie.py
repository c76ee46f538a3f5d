"""Prefix trie against a plain dictionary of prefixes, and the decomposition against plain sums."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from intelspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, p long, n_convs string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort()
    built = {}
    for c in list(convs):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = [t[2:] for t in convs.get(base, [])[:h]] + [t[2:] for t in convs[c][h:]]
    nodes, children, total, out = defaultdict(list), defaultdict(list), {}, []
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        below = [total[k] for k in children[key]]
        total[key] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    for key, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(key))))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children[key]), *total[key], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, **kw):
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5), **kw)
    assert got.columns == COLUMNS
    return sorted([tuple(r) for r in got.collect()], key=lambda r: r[:2])


@pytest.fixture()
def rows():
    rng = random.Random(1)
    out = [(c, t if rng.random() < 0.9 else None, rng.choice(["u", "a", None]), rng.choice(["hi", "yo there", "", None, "x" * 5000 + rng.choice("ab")]))
           for c in range(-30, 120) for t in range(rng.randint(1, 6))]  # ties: several null turns
    out += [(c, i, "u", "same words") for c in (200, 201) for i in range(300)]  # long copies
    out += [(220 + c, i, "u", "same words") for c in range(20) for i in range(c * 5)]  # nested prefixes
    return out + [(None, 1, "u", "x")] + out[:3]  # no conversation; repeated rows


def test_trie_whole_and_in_rounds(spark, rows):
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, local=30) == want  # rounds over all components first


def test_conversations_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(c, i, "u", rng.choice("ab")) for c in (0, 20, 21, 22, 23, 40, 41) for i in range(rng.randint(30, 200))]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(spark, rows, local=200) == brute(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_small_tables(spark):
    assert found(spark, []) == []
    for rows in ([(5, None, None, None)], [(1, 0, "u", "a")], [(0, 0, "u", "a"), (1, 0, "u", "b"), (2, 0, "u", "b")]):
        assert found(spark, rows) == brute(rows)


def test_many_ends_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, i, "u", "a") for c in range(0, 1000, 20) for i in range(3)]
    assert found(spark, rows) == brute(rows)


def test_decomposition_equals_plain_sums():
    rng = np.random.default_rng(3)
    for shape in ("random", "chain", "star"):
        n = 500
        parent = np.array([-1 if i % 100 == 0 else {"random": rng.integers(i - i % 100, i), "chain": i - 1, "star": i - i % 100}[shape] for i in range(n)])
        own, values, extra = rng.integers(1, 50, n), rng.integers(0, 9, (n, 2)), np.zeros((n, 2), np.int64)
        weight, want = own.copy(), values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                want[parent[i]] += want[i]
        assert (trie.split_to_the_end(parent, weight, values, extra) == want).all()
