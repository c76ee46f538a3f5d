"""Personal data: base spans against the plain patterns, added spans on planted cases, and the label model on made votes."""

import random
import re
import time
from hashlib import sha256

import numpy as np
import pytest

from intelspark.llm import personal, queries
from intelspark.llm.personal import BASE, KINDS

SCHEMA = "doc_id long, text string, found string, kinds int, n_ip string"
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    tests = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
             lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if tests[k](m[0]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    pieces = ["@", ".", "a", "B9", "-", "_", "%", "+", "1", "25", "256", "0", "é", " ", "(", ")", "\n", "4111 1111 1111 1111", "10.0.0.1", "x@y.zz", "+1 (415) 555-0134", "..", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces[: rng.choice([5, 9, 13, len(pieces)])], k=rng.randint(0, 25)))
        assert personal.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000 + "a", "+1" * 200_000, "a@" * 200_000, "@a" * 200_000, "A" * 400_000, "(1" * 200_000, "Dr " * 100_000, "a@b.c " * 20_000, "AB12 " * 80_000):
        personal.candidates(text, personal.base_spans(text))
    assert time.time() - start < 20


CLEAN = "the red house stands on hill number {} and nobody knows why it was built there in the year {} or by whom"
PLANTED = {
    "number": ["please call my phone (415) 555-{:04d} tonight", "tel 415-555-{:04d}", "my ssn 123-45-{:04d} ok"],
    "name": ["signed Dr. Maria Keller{}", "contact name Mr John Walker{}"],
    "hidden_email": ["mail me at jane{} (at) example (dot) com", "contact bob{} [at] mail.example.org today"],
    "account": ["iban DE89 3704 0044 0532 0130 00 transfer {}"],
    "birth_date": ["born 12/03/1980, {}", "dob 1975-11-02 {}"],
}


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(60):
        for kind, forms in PLANTED.items():
            out.append((kind, forms[i % len(forms)].format(i if kind != "number" else 1000 + i)))
        out.append((None, CLEAN.format(i, 1900 + i)))
        out.append((None, f"invoice no 4785 3805 9239 {1000 + i} total and version 2024.11.{i}.5.6 part 100-200-3{i:03d} sku 9780-3064-0615-{i}"))
        out.append(("base", f"write to user{i}@mail.example.com or +1 (415) 555-{1000 + i} from 10.2.3.{i} card 4111 1111 1111 1111"))
    return out


def test_planted_spans_are_found_and_clean_texts_left_alone(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, (_, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in personal.scan(docs).collect()}
    caught = {k: [0, 0] for k in PLANTED}
    for i, (kind, text) in enumerate(rows):
        base = [(KINDS[k], a, b) for a, k, b in plain(text)]
        assert [s for s in got[i] if s[0] in KINDS[:BASE]] == base
        if kind is None:
            assert got[i] == base, text
        elif kind in caught:
            caught[kind][0] += any(s[0] == kind for s in got[i])
            caught[kind][1] += 1
    assert all(hit >= 0.9 * n for hit, n in caught.values()), caught


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "a@b.co"), (4, "no data"), (5, "x " * 50_000 + "a@b.co"), (6, "😀 1.2.3.4 é+1 4155550134 4111111111111111")]
    got = personal.scan(spark.createDataFrame([(*r, "f", 2, "n") for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"]
    want = []
    for i, text in rows:
        spans = plain(text or "")
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), sha256(text.encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got.collect()], key=str) == sorted(want, key=str)
    assert personal.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert personal.scan(spark.createDataFrame([(1, "nothing here", "", 1, "")], SCHEMA).drop("n_ip")).first().found == []


def test_query_over_given_documents(spark):
    got = queries.QUERIES["op11_personal_data"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for r in got:
        base = [f"{KINDS[k]}:{a}:{b}" for a, k, b in plain(texts[r.doc_id])]
        assert r.base_sha256 == sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))


def test_label_model_finds_the_reliable_voters():
    rng = np.random.default_rng(8)
    n = 20_000
    truth = rng.random(n) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55])
    votes = np.where(rng.random((n, 9)) < 0.3, 0, np.where((rng.random((n, 9)) < right) == truth[:, None], 2, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    kinds = np.zeros(len(patterns), np.int64)
    probability, hit = personal.aggregate(kinds, patterns, counts.astype(float))
    assert (np.abs(hit - right) < 0.08).all() and (np.diff(hit) < 0.02).all()
    known = {tuple(p): q for p, q in zip(patterns.tolist(), probability)}
    assert np.mean([(known[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.93


def test_scans_begin_with_a_character_and_find_what_the_plain_patterns_do():
    """A pattern that begins with a look back is tried at every place of a text; these are not, and find the same."""
    names = "|".join(personal.TITLES + personal.FIRST_NAMES)
    forms = {
        "ADDRESS": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        "ACCOUNT": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "NAME": rf"(?<!\w)(?:{names})\.?\x20[A-ZÀ-Þ][a-zß-ÿ]{{1,30}}(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{{1,30}})?(?!\w)",
        "BIRTH": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])",
    }
    rng = random.Random(9)
    pieces = ["1", "19", "20", "2", "12", "/", "-", ".", " ", "1975-11-02", "12/03/1980", "DE89", "3704", "A", "Dr", "Dr.", "Don", "Dona", "Anna", " Keller", " Ábc", "é", "_", "x", "٣"]
    texts = ["".join(rng.choices(pieces[: rng.choice([9, 13, len(pieces)])], k=rng.randint(0, 25))) for _ in range(20_000)]
    for name, form in forms.items():
        scan = getattr(personal, name)
        assert not scan.pattern.startswith("(?")
        assert all([m.span() for m in scan.finditer(t)] == [m.span() for m in re.finditer(form, t)] for t in texts), name


def test_a_number_takes_the_bracket_before_it():
    for text, start in (("(415) 555-0134", 0), ("a (415) 555-0134", 2), ("((415) 555-0134", 1), ("415 555 0134", 0)):
        assert [s[:2] for s in personal.candidates(text, [])] == [(start, KINDS.index("number"))]
