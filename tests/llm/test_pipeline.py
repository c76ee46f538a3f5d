"""The corpus pipeline's stages on awkward rows, each against plain code, and the whole run."""

import random

import pytest

import corpus_pipeline
from intelspark.llm import packing, secrets, toolcalls
from intelspark.llm.common import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, lang_pred string, lang_rejected boolean, root long, spans string"
WORDS = {
    "en": "the house stands near river with many people who like music while children play outside every evening after school and talk about their friends".split(),
    "de": "das haus steht nahe fluss mit vielen leuten die musik lieben während kinder draußen spielen jeden abend nach schule und über ihre freunde reden".split(),
}


def text_of(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def rows(spark):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    out = [(i, text_of("en" if i % 2 else "de", 120, i), "en" if i % 2 else "de") for i in range(1, 41)]
    out += [(50, out[0][1], "en"), (51, out[1][1] + " end", "de"), (52, out[2][1], None), (None, out[3][1], "de"), (5, out[4][1], "en"), (5, "another text of the same id", "en")]
    out += [(60, None, "en"), (61, "", "de"), (62, "12345 !!!", None), (63, benchmark, "en"), (64, text_of("en", 60, 900) + " " + benchmark + " tail", "en")]
    out += [(70, text_of("en", 60, 901) + " password = 'abcdef123456' end", "en"), (71, "word " * 20_000, "en")]
    return [(i, t, lang, "s", len(t or ""), 7.0, "mine", True, 5, "x") for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept(out):
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return out.collect()


def test_language_keeps_readable_rows_as_they_are(spark, docs, rows):
    got = kept(stage("language")(spark, docs, SF))
    assert {tuple(r) for r in got} <= set(rows)  # clashing columns are untouched
    ids = {r.doc_id for r in got}
    assert set(range(1, 41)) <= ids and not {60, 61, 62} & ids


def test_near_duplicates_equal_brute_force(spark, docs, rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None and i != 5:
            sets[i] = set(shingles(t or "", 5).tolist())
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = kept(stage("near_duplicates")(spark, docs, SF))
    ids = [r.doc_id for r in got]
    assert {i for i in ids if i not in (5, None)} == {i for i in sets if root[i] == i}
    assert None in ids and ids.count(5) == 3 and not {50, 51, 52} & set(ids) and {tuple(r) for r in got} <= set(rows)


def test_benchmark_copies_go_and_clean_rows_stay(spark, docs, rows):
    got = kept(stage("decontamination")(spark, docs, SF))
    assert sorted((str(tuple(r)) for r in got)) == sorted(str(r) for r in rows if r[0] not in (63, 64))


def test_secrets_are_blanked_and_nothing_else(spark, docs, rows):
    got = kept(stage("secrets")(spark, docs, SF))
    assert len(got) == len(rows)
    changed = {r.doc_id: r.text for r in got if r.text not in {t for _, t, *_ in rows}}
    assert set(changed) == {70} and "abcdef123456" not in changed[70] and changed[70].endswith(" end")
    ratios = secrets.fit(docs.select("doc_id", "text"))
    assert all(not secrets.spans(r.text or "", ratios) or r.text in changed.values() for r in got)


def test_packing_holds_every_token_once(spark, docs, rows):
    got = stage("packing")(spark, docs, SF).collect()
    length, used = {}, {}
    for r in got:
        length.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in {(r.doc_id, r.ids_crc32, r.start): r for r in got if r.start == 0}.values()) or len(rows) != len({r[0] for r in rows})
    for (doc, total), pieces in length.items():
        if doc not in (5, None):
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
            assert at == total
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, docs, name):
    assert stage(name)(spark, docs.limit(0), SF).count() == 0


def test_whole_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    every = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids <= every and len(ids) >= 0.7 * len(every)


def test_a_long_chain_of_references(spark):
    n = 4300
    calls = [("c", i, 0, f"k{i}", "f", "{}" if i == n - 1 else f'{{"x":"$result:k{i + 1}"}}') for i in range(n)] + [("c", n, 0, "free", "f", "{}"), ("d", 2**31 - 1, 999_999, "k0", "f", "{}")]
    results = spark.createDataFrame([("c", 1, "k0", "r")], "conv_id string, turn long, call_id string, content string")
    got = toolcalls.link(spark.createDataFrame(calls, "conv_id string, turn long, place int, call_id string, tool string, arguments string"), results, {})
    order = [r.call_id for r in got.filter("conv_id = 'c'").orderBy("position").collect()]
    assert order == [f"k{n - 1}", "free", *[f"k{i}" for i in range(n - 2, -1, -1)]]
