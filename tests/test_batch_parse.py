"""The batch parser's work is spread over all cores, and sections are judged only where the choice of the discussion is open."""

from pyspark.sql import functions as F

from intelspark import plans
from intelspark.operators import parsing as p


def test_every_source_of_the_batch_is_spread(spark):
    plans.load()
    rows = plans.QUERIES["k21_parse_all_sources"](spark, "/root/testdata/sf0.001")
    for kind in ("document", "page", "report"):
        assert rows.filter(F.col("kind") == kind).select("id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_table_metrics_of_labels_and_headers(spark):
    headers, rows = F.array(*[F.lit(x) for x in ("Item", "FY2024", "Net profit")]), F.array(*[
        F.array(*[F.lit(x) for x in r]) for r in (("Total revenue", "HK$5 million", "7"), ("Headcount", "", "n/a"))])
    found = spark.range(1).select(p.table_metrics(headers, rows).alias("m")).first()["m"]
    assert [(m["name"], m["value"], m["period"], m["confidence"]) for m in found] == [("revenue", "HK$5 million", "FY2024", 0.7), ("net profit", "7", "Net profit", 0.6)]


def test_says_is_the_pattern_of_all_words(spark):
    texts = spark.createDataFrame([("a.b c",), ("axb",), ("",), (None,)], "t string")
    for words in ((), ("a.b",), ("zz", "xb")):
        got = texts.select(p.says(F.col("t"), words).alias("s"), F.col("t").rlike(p.any_of(words)).alias("r")).collect()
        assert all(g["s"] == g["r"] for g in got)


def test_the_discussion_is_worked_out_once(spark):
    plans.load()
    rows = plans.QUERIES["k10_management_discussion"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert not any("aggregate" in line or "filter(" in line or "regexp" in line for line in filters)
