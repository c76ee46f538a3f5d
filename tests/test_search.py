"""Retrieval for tables of questions against a plain scan."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from intelspark import plans
from intelspark.operators import search

PARTS = ["alpha", "beta", "al", "ph", "x1", "a", "日", "本語", "É", "eta", "Beta-al", "K", " ", ". "]


def test_lexical_table_equals_a_scan(spark, tmp_path):
    rng = random.Random(3)
    chunks = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 12))), rng.choice(["s1", "s2", None]), f"2024-01-{1 + i % 28:02d}") for i in range(150)] + [(200, None, "s1", None)]
    asked = [(j, "".join(rng.choices(PARTS, k=rng.randint(0, 6))), rng.choice(["s1", None, ""]), rng.choice(["2024-01-05", None]), rng.choice(["2024-01-20", None])) for j in range(40)]
    want = set()
    for j, text, source, low, high in asked:
        terms = list(dict.fromkeys(re.findall(r"[一-鿿]|[A-Za-z0-9]{2,}", text.lower())))
        scored = [(sum(t in (c or "").lower() for t in terms) / len(terms), i) for i, c, s, at in chunks
                  if terms and (not source or s == source) and (low is None or (at and at >= low)) and (high is None or (at and at <= high))]
        for rank, (score, i) in enumerate(sorted((x for x in scored if x[0] > 0), reverse=True)[:6], 1):
            want.add((j, i, score, rank))
    docs = spark.createDataFrame(chunks, "id int, text string, source string, at string").withColumn("event_time", F.to_timestamp("at"))
    questions = spark.createDataFrame(asked, "q int, question string, source string, low string, high string").withColumns({"date_from": F.to_timestamp("low"), "date_to": F.to_timestamp("high")})
    search.save_index(search.word_postings(docs, "id", "text"), str(tmp_path / "index"), buckets=4)
    postings, words = search.load_index(spark, str(tmp_path / "index"))
    got = search.lexical_search_table(questions, postings.drop("bucket"), docs, "id", question_key="q", words=words)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {tuple(r) for r in got.select("q", "id", "score", "rank").collect()} == want
    assert search.lexical_search_table(questions.limit(0), postings.drop("bucket"), docs, "id", question_key="q").count() == 0


@pytest.mark.parametrize("sent", [search.SENT_ROWS, 0])
def test_search_of_texts_equals_a_scan(spark, monkeypatch, sent):
    monkeypatch.setattr(search, "SENT_ROWS", sent)  # also where the terms are too many to be sent to every task
    monkeypatch.setattr(search, "TASK_CHUNKS", 10)
    monkeypatch.setattr(search, "KNOWN_WORDS", 3)
    rng = random.Random(5)
    chunks = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 12))), rng.choice(["s1", "s2", None]), i) for i in range(120)] + [(200, None, "s1", 5), (201, "", "s2", 5)]
    asked = [(j, "".join(rng.choices(PARTS, k=rng.randint(0, 6))), rng.choice(["s1", None, ""]), rng.choice([50, None])) for j in range(30)]
    want = set()
    for j, text, source, high in asked:
        terms = set(re.findall(r"[一-鿿]|[A-Za-z0-9]{2,}", text.lower()))
        scored = [(sum(t in (c or "").lower() for t in terms) / len(terms), i) for i, c, s, at in chunks if terms and (not source or s == source) and (high is None or at <= high)]
        want |= {(j, i, score, rank) for rank, (score, i) in enumerate(sorted((x for x in scored if x[0] > 0), reverse=True)[:6], 1)}
    docs = spark.createDataFrame(chunks, "id int, text string, source string, at int").withColumn("event_time", F.timestamp_seconds("at"))
    questions = spark.createDataFrame(asked, "q int, question string, source string, high int").withColumn("date_to", F.timestamp_seconds("high"))
    got = search.lexical_search_texts(questions, docs, "id", "text", question_key="q")
    assert {tuple(r) for r in got.select("q", "id", "score", "rank").collect()} == want
    assert search.lexical_search_texts(questions.limit(0), docs, "id", "text", question_key="q").count() == 0


def test_question_table_deals_the_texts_hits_once(spark):
    plans.load()
    plan = plans.QUERIES["l9_question_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # The texts are spread, their terms are dealt by key, and the best of each task by question: no hit or count is moved besides.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3 and "SortMergeJoin" not in plan


def test_vector_table_is_exact_or_says_its_recall(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 16 * 20)  # blocks of twenty vectors
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    points = centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    points[5], points[6] = 0, points[7]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(990, None), (991, [])], "id int, e array<double>").repartition(4)
    asked = vectors.filter("id % 30 = 7 or id = 990").withColumnRenamed("id", "q")
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    want = {}
    for q in range(7, 900, 30):
        score = (unit @ unit[q]).round(12)
        want[q] = [(i, round(float(score[i]), 9)) for i in sorted(range(900), key=lambda i: (-score[i], i))[:6] if score[i] >= 0.15]

    def found(**kw):
        out = {}
        for r in search.vector_search_table(asked, vectors, "id", "e", "q", **kw).orderBy("q", "rank").collect():
            out.setdefault(r.q, []).append((r.id, round(r.score, 9)))
        return out

    assert found() == want
    cells = search.learn_cells(vectors, "id", "e", cells=12)
    near = found(probes=3, centres=cells)
    hits = sum(len({i for i, _ in near.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert search.vector_search_table(asked, vectors.limit(0), "id", "e", "q").count() == 0
