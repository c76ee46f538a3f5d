"""What users plug in: collectors and model callables."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from intelspark.operators.model import call_model, proposed_facts, to_ask_again
from intelspark.operators.parsing import gate
from intelspark.sinks.versions import VersionedTable, VersionedTables
from intelspark.sources.collector import Collector, batch_tables, register
from intelspark.streaming import ingest


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


class Rates(Collector):
    source = "rates_of_a_test"
    tables = {
        "facts": "source string, record_key string, value double", "signals": "signal_key string, value double", "timeline": "headline string",
        "insights": "text string", "companies": "company_id string", "runs": "run_id string, status string",
    }

    def parts(self, options):
        return [f"2024-{m:02d}" for m in range(1, 1 + int(options.get("months", 3)))]

    def collect(self, options, part):
        yield "facts", {"source": self.source, "record_key": part, "value": 1.5}
        yield "facts", {"source": self.source, "record_key": f"{part}-b", "value": "no number"}
        if part.endswith("2"):
            yield "signals", {"signal_key": part, "value": 2}
        yield "timeline", {"headline": f"Rates of {part} – é"}
        yield "companies", {"company_id": "c1"}
        yield "runs", {"run_id": "r", "status": part}


def store_of(spark, path):
    keys = {"facts": ("record_key",), "signals": ("signal_key",), "timeline": ("headline",), "insights": ("text",), "companies": ("company_id",)}
    typed = {n: spark.createDataFrame([], ddl).schema for n, ddl in Rates.tables.items()}
    return VersionedTables(spark, str(path), *[VersionedTable(n, typed[n], k) for n, k in keys.items()], VersionedTable("runs", typed["runs"], ("run_id",), update=True, order="status"))


def test_a_collector_fills_the_tables_of_a_batch(spark, tmp_path):
    register(spark, Rates)
    rows = spark.read.format("rates_of_a_test").option("months", "3").load()
    assert rows.rdd.getNumPartitions() == 3
    store = store_of(spark, tmp_path / "store")
    assert store.commit("b-0", batch_tables(rows, Rates)) and store.commit("b-1", batch_tables(rows, Rates))
    assert {n: store.read(n).count() for n in Rates.tables} == {"facts": 6, "signals": 1, "timeline": 3, "insights": 0, "companies": 1, "runs": 1}
    assert store.read("facts").filter("value is null").count() == 3 and store.read("runs").first().status == "2024-03"


def test_a_collector_streams_what_is_new(spark, tmp_path):
    register(spark, Rates)
    store = store_of(spark, tmp_path / "store")
    for months, facts in ((2, 4), (3, 6)):
        stream = spark.readStream.format("rates_of_a_test").option("months", str(months)).load()
        ingest.start_ingestion(stream, store.writer("rates", lambda df: batch_tables(df, Rates)), str(tmp_path / "checkpoint")).awaitTermination()
        assert store.read("facts").count() == facts
    assert [r.scanned for r in store.manifest().filter("table = 'facts'").orderBy("batch").collect()] == [4, 2]


def stub(rows):
    """A model that fails on a whole batch with a bad text in it, answers nothing for short texts and quotes the others."""
    if any("bad" in (r["text"] or "") for r in rows):
        raise RuntimeError("model is down")
    return [[] if len(r["text"] or "") < 10 else [{"fact_type": "risk_factor", "kind": "Credit", "confidence": 0.9, "quoted_text": r["text"][:30], "chunk_id": r["chunk_id"]}] for r in rows]


def test_a_failing_model_loses_nothing(spark):
    texts = ["Credit risk may rise in a downturn.", "bad one, fails", None, "short", "Liquidity pressure is building up now.", "bad again"] * 5
    shown = spark.createDataFrame([(i // 2, f"s0:p{i % 2}", t) for i, t in enumerate(texts)], "document_id int, chunk_id string, text string").repartition(3)
    results = call_model(shown, stub, size=4).cache()
    assert results.count() == 30 and results.filter("error is not null").count() == 10
    assert {r.error for r in results.filter("error is not null").collect()} == {"RuntimeError: model is down"}
    verdict = gate(proposed_facts(results), shown)
    assert verdict.filter("eligible").count() == 10 and verdict.count() == 10
    again = to_ask_again(shown, results)
    assert again.count() == 10
    mended = call_model(again.withColumn("text", F.replace("text", F.lit("bad"), F.lit("good"))), stub)
    assert mended.filter("error is not null").count() == 0 and mended.count() == 10
    assert call_model(shown.limit(0), stub).count() == 0
    assert call_model(shown, lambda rows: [], size=4).filter("error like 'ValueError%'").count() == 30
