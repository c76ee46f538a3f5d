"""Alias matching without a broadcast of aliases or texts."""

from pyspark.sql import functions as F

from intelspark.operators import resolve as r

ALIASES = [("acme trading co ltd", "a"), ("acme trading", "b"), ("12345", "c"), ("中环银行", "d"), ("b&b-99 foods", "e"), ("4-4 12", "f")]
TEXTS = [(1, "Acme  Trading, Co ltd filed"), (2, "ACME TRADING CO LTD"), (3, "x12345y 12345"), (4, "在中环银行开户"), (5, "the B&B-99 foods"), (6, "at 4-4 12 now"), (7, ""), (8, None), (9, "acmetrading")]


def _frames(spark):
    index = spark.createDataFrame(ALIASES, "alias string, company_id string").withColumn("alias_length", F.length("alias"))
    return spark.createDataFrame(TEXTS, "row_id int, text string"), index


def test_matches_and_their_joins(spark):
    texts, index = _frames(spark)
    found = r.matches(texts, index)
    assert sorted((x.row_id, x.company_id, x.is_exact) for x in found.collect()) == [
        (1, "b", False), (2, "a", True), (2, "b", False), (3, "c", False), (4, "d", False), (5, "e", False), (6, "f", False)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_backfill_broadcasts_no_texts(spark):
    texts, index = _frames(spark)
    rows = texts.select(F.col("row_id").alias("id"), "text", F.lit(None).cast("string").alias("company_id"))
    filled, audit = r.backfill(rows, index, F.col("text"), "run", "records")
    assert {x.id: x.company_id for x in filled.collect() if x.company_id} == {1: "b", 3: "c", 4: "d", 5: "e", 6: "f"}
    for df in (filled, audit):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
