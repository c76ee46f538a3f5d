"""Alignment of two vocabularies against whole-text tokenisation and all pairs of byte ranges."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from intelspark.llm import alignment

SCHEMA = "doc_id long, text string, n_a string, row long, code string"


def brute(rows):
    """The contract's columns from whole texts: no segments, no pieces, no packing."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(c): c for c in letters} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in letters)}

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        if text:
            raw = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(shown[c] for c in a.id_to_token(t)) for t in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids_b]
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                ends_a, ends_b = ends(bytes_a), ends(bytes_b)
                i = j = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    group = ([], [])
                    while i < len(ends_a) and ends_a[i] <= cut:
                        group[0].append(i)
                        i += 1
                    while j < len(ends_b) and ends_b[j] <= cut:
                        group[1].append(j)
                        j += 1
                    groups.append("|".join(",".join(str(ids[t]) for t in side) for ids, side in zip((ids_a, ids_b), group)))
                    links += [(ids_a[s], ids_b[t]) for s in group[0] for t in group[1]
                              if max(ends_a[s] - len(bytes_a[s]), ends_b[t] - len(bytes_b[t])) < min(ends_a[s], ends_b[t])]
        counts.update(links)
        docs.append((doc_id, links, groups, (len(ids_a), len(ids_b)) if groups else (0, 0)))
    best = {}
    for (_, t), n in counts.items():
        best[t] = max(best.get(t, 0), n)
    return sorted(((d, *n, len(groups), len(links), sum(counts[v] == best[v[1]] for v in links), sum(counts[v] for v in links),
                    sha256(";".join(groups).encode()).hexdigest() if groups else "") for d, links, groups, n in docs), key=str)


def found(spark, rows, **kw):
    got = alignment.align(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3), **kw)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def awkward():
    rng = random.Random(5)
    texts = [None, "", " ", "  ", "a", "a ", "a  ", " a", "\n a", "a\n \n  b", "a\t b", "x\x1c y", "a  b 　 c", "▁q", "plain ▁ words", "<s> </s> <unk> <0x41>", "<|endoftext|> x<|endoftext|>",
             "日本語 の文章です。", "é é ﬁ 👩‍👩‍👧 \U0001f600", "can't  we'll\r\n\r\n   they're", "12,345.67 8% #$*", "word " * 300, "ab" * 5000, "一" * 3000, "\x00 zero \x7f", "don't 's 's"]
    pieces = [" ", "  ", "\n", "\t", "a", "the", "é", "日", "'s", "1", ".", " ", "▁", "<s>", "Ünï"]
    texts += ["".join(rng.choices(pieces[: rng.choice([4, 8, len(pieces)])], k=rng.randint(1, 40))) for _ in range(120)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "an id twice"), (3, "an id twice")]


def test_awkward_texts(spark):
    rows = awkward()
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, top=0) == found(spark, rows, top=20) == want  # counts joined, not sent


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert found(spark, rows) == brute(rows)


def test_small_memory(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FLUSH", 8)
    monkeypatch.setattr(alignment, "PIECE", 3)
    monkeypatch.setattr(alignment, "CACHE", 5)
    monkeypatch.setattr(alignment, "CHUNK", 2)
    rows = awkward()
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_merge_in_pieces_of_any_size():
    rng = np.random.default_rng(6)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, total)), total)) for _ in range(2))
        cuts = np.union1d(a, b)
        want = [(int(np.searchsorted(a, c)), int(np.searchsorted(b, c))) for c in cuts]
        group = np.append(0, np.cumsum(np.isin(cuts, np.intersect1d(a, b)))[:-1])
        for piece in (1, 2, 7, 1000):
            i, j, g = alignment.merge(a, b, piece)
            assert list(zip(i.tolist(), j.tolist())) == want and (g == group).all()
    steps = alignment.split_diagonals(np.arange(1000), np.arange(1000), np.arange(0, 2001, 100))
    assert (np.abs(2 * steps - np.arange(0, 2001, 100)) <= 1).all()  # equal work
