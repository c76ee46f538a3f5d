"""Replacing parsed documents on disk with everything that hangs on them."""

import os

import pytest

from intelspark.operators.parsing import CHILDREN
from intelspark.sinks.documents import DocumentStore


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def batch(spark, version, docs, metrics):
    out = {"documents": spark.createDataFrame([(d, h, version) for d, h in docs], "document_id int, content_hash string, parse_version string")}
    for name, index in CHILDREN.items():
        rows = [(d, i, f"{name}-{v}") for d, values in metrics.items() for i, v in enumerate(values)]
        out[name] = spark.createDataFrame(rows, f"document_id int, {index} int, value string")
    return out


@pytest.fixture()
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"), tuple(CHILDREN), buckets=4)


def test_replace_is_whole_and_a_second_run_does_nothing(spark, store, tmp_path):
    first = batch(spark, "v1", [(i, f"h{i}") for i in range(10)], {i: ["a", "b"] for i in range(10)})
    assert store.replace(first) == 10
    store.add("chunks", spark.createDataFrame([(i, f"c{i}-{k}") for i in range(10) for k in range(2)], "document_id int, chunk_id string"))
    store.add("embeddings", spark.createDataFrame([(f"c{i}-{k}", [1.0]) for i in range(10) for k in range(2)], "chunk_id string, embedding array<double>"))
    before = files(tmp_path / "store")
    assert store.replace(first) == 0 and files(tmp_path / "store") == before

    second = batch(spark, "v1", [(3, "new"), (4, "h4"), (11, "h11")], {3: ["z"], 4: ["never used"], 11: []})
    assert store.replace(second) == 2
    for name in CHILDREN:
        got = sorted((r.document_id, r.value) for r in store.read(name).collect())
        assert got == sorted([(i, f"{name}-{v}") for i in range(10) if i != 3 for v in "ab"] + [(3, f"{name}-z")])
    assert {(r.document_id, r.content_hash) for r in store.read("documents").collect()} == {(i, f"h{i}") for i in (*range(10), 11) if i != 3} | {(3, "new")}
    assert store.read("chunks").count() == 18 and store.read("chunks").filter("document_id = 3").count() == 0
    assert store.read("embeddings").count() == 18 and store.read("embeddings").filter("chunk_id like 'c3-%'").count() == 0
    assert store.replace(second) == 0

    third = batch(spark, "v2", [(i, f"h{i}") for i in range(10)], {0: ["only"]})
    assert store.replace(third) == 10 and store.read("metrics").count() == 1 and store.read("chunks") is None


def test_a_job_that_died_before_the_documents_is_done_again(spark, store, monkeypatch):
    store.replace(batch(spark, "v1", [(1, "a"), (2, "b")], {1: ["x"], 2: ["y"]}))
    new = batch(spark, "v1", [(1, "c")], {1: ["n1", "n2"]})
    whole = store._rewrite

    def dies(name, *rest):
        if name == "documents":
            raise RuntimeError("lost driver")
        whole(name, *rest)

    monkeypatch.setattr(store, "_rewrite", dies)
    with pytest.raises(RuntimeError):
        store.replace(new)
    monkeypatch.setattr(store, "_rewrite", whole)
    assert store.replace(new) == 1
    assert sorted(r.value for r in store.read("metrics").collect()) == ["metrics-n1", "metrics-n2", "metrics-y"] and store.read("documents").count() == 2
