"""Golden cases for the default dictionaries, edge values and file feeds."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from intelspark.functions import numbers, text, times
from intelspark.operators import parsing as p
from intelspark.operators import resolve as r
from intelspark.operators import retrieval
from intelspark.operators import scorecard as sc
from intelspark.operators.evaluate import identity_accuracy
from intelspark.operators.positions import number_within
from intelspark.sinks.merge import new_rows, upsert
from intelspark.sources import feeds


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw,want", [
    ("(1,234.5)", -1234.5), ("12.8亿", 12.8e8), ("3万", 3e4), ("HK$1,000", 1000.0), ("5%", 5.0), ("--", None), ("2024-01", None), ("200000", None), ("x", None), (None, None)])
def test_number(spark, raw, want):
    assert one(spark, raw, numbers.to_number) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("raw,want", [
    ("20260401", "2026-04-01"), ("202604", "2026-04"), ("2026年4月1日", "2026-04-01"), ("2026/4", "2026-04"), ("FY2025", None), ("2026-13-01", "2026"), ("", None), ("in 2025.", "2025")])
def test_period(spark, raw, want):
    assert one(spark, raw, times.period_of) == want


def test_titles_and_sentences(spark):
    assert one(spark, "m&a", text.title_case) == "M&A"
    assert one(spark, "a; b。c", text.first_sentence) == "a"


def _model_chunks(words, size, overlap):
    start, out = 0, []
    while start < len(words):
        end = min(len(words), start + size)
        out.append(" ".join(words[start:end]))
        if end >= len(words):
            break
        start = end - overlap
    return out


def test_chunks_follow_the_window_model(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(n))) for i, n in enumerate((0, 1, 9, 10, 11, 17, 18, 40, 83))]
    got = retrieval.chunk(spark.createDataFrame(rows, "id int, t string"), ["id"], "t", 10, 3).collect()
    for i, t in rows:
        have = [x["chunk_text"] for x in sorted((g for g in got if g["id"] == i), key=lambda g: g["chunk_index"])]
        assert have == _model_chunks(t.split(), 10, 3)
    with pytest.raises(ValueError):
        retrieval.chunk(spark.createDataFrame(rows, "id int, t string"), ["id"], "t", 10, 10)


def test_cjk_tokens_join_without_blanks(spark):
    assert one(spark, "净利润 up 5%", lambda v: retrieval.join_tokens(retrieval.tokens(v))) == "净利润 up 5 %"


REPORT = ("Annual report 2024. Revenue rose to HK$12.5 million in FY2024, up 8%. The company acquired Harbour Foods on 2024-03-05. "
          "Material liquidity risk remains because of refinancing pressure. 净利润 为 3.2亿元。 NPL ratio was 1.2%. All rights reserved 2024.")


def test_default_extraction(spark):
    df = spark.createDataFrame([(1, REPORT, "Harbour annual report")], "id int, t string, title string")
    row = p.parse_text(df, "t", "title").first()
    metrics = {(m["name"], m["value"]) for m in row["metrics"]}
    assert ("revenue", "HK$12.5 million") in metrics and ("npl ratio", "1.2%") in metrics
    assert ("liquidity", "high") in {(x["category"], x["severity"]) for x in row["risk_factors"]}
    assert ("acquisition", "2024-03-05") in {(e["event_type"], e["event_date"]) for e in row["business_events"]}


def test_management_discussion_heading(spark):
    df = spark.createDataFrame([("", [("Management discussion", "Demand growth was strong. We opened two sites.")], "x")],
                               "title string, sections array<struct<heading: string, text: string>>, text string")
    out = p.with_discussion(df, "title", "sections", "text").first()["management_discussion"]
    assert out["summary"] == "Demand growth was strong." and out["source_sections"] == ["Management discussion"]


def test_html_sections_and_tables(spark):
    html = ("<html><title>T &amp; U</title><body><nav><p>menu</p></nav><h2>Over-view</h2><p>One <b>two</b></p><li>three</li>"
            "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>")
    row = p.with_html(spark.createDataFrame([(html,)], "h string"), "h").first()
    assert row["title"] == "T & U" and row["sections"][0]["heading"] == "Over view" and row["sections"][0]["text"].startswith("One two\n\nthree")
    assert row["tables"][0]["headers"] == ["A", "B"] and row["tables"][0]["rows"] == [["1", "2"]]


def test_identity_cases(spark):
    names = [("1", "Tencent Holdings", "腾讯"), ("2", "Bank of East Asia", "東亞銀行"), ("3", "ABC Group Ltd", "ABC Group Ltd"), ("00700", "Alpha Works", "Alpha Works"), ("5", "ABC Group Ltd", None)]
    companies = spark.createDataFrame(names, "company_id string, canonical_name string, display_name string")
    index = r.alias_index(r.alias_candidates(companies))
    cases = spark.createDataFrame([
        ("plain", "News about Tencent Holdings today", "1", "tencent holdings", True), ("cjk", "今天腾讯发布", "1", "腾讯", True), ("wide", "Ｔｅｎｃｅｎｔ Holdings", "1", "tencent holdings", True),
        ("glued", "xTencent Holdingsx", None, None, False), ("two", "Tencent Holdings and Bank of East Asia", None, None, False), ("ambiguous", "ABC Group Ltd", None, None, False),
        ("code", "stock 00700 rose", "00700", "00700", True), ("longer", "stock 1007001 rose", None, None, False)],
        "case_id string, text string, expected_company_id string, expected_alias string, should_match boolean")
    out = identity_accuracy(r.match_companies(cases, index, row="case_id"), cases).collect()
    assert {x["case_id"]: x["passed"] for x in out} == {c["case_id"]: True for c in cases.collect()}


def test_linkage_branches(spark):
    rows = [("1", "1", "growth", "e", None, "direct_company_link"), ("2", "1", "policy", "e", None, "macro_context_link"), ("2", "1", "trade", "e", None, "cross_border_exposure_link"),
            ("2", "1", "growth", "e", "Hong Kong", "region_link"), ("2", "1", "growth", None, "Hong Kong", "industry_link")]
    df = spark.createDataFrame(rows, "s string, c string, k string, e string, r string, want string")
    out = df.withColumn("got", sc.linkage_type(F.col("s"), F.col("c"), F.col("k"), F.col("e"), F.col("r"))).collect()
    assert all(x["got"] == x["want"] for x in out)


def test_page_lines_at_the_threshold(spark):
    pages = [(1, n, ("Running header\n" if n < 4 else "") + ("Rare footer\n" if n < 1 else "") + f"Body line number {n} here.") for n in range(10)]
    out = p.clean_pages(spark.createDataFrame(pages, "d int, p int, t string"), "d", "p", "t").collect()
    texts = " ".join(x["text"] for x in out)
    assert "Running header" not in texts and "Rare footer" in texts


def test_positions_cross_partitions(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50))
    got = number_within(df, ["g"], [F.asc("id")], "n").groupBy("g").agg(F.max("n").alias("m"), F.count_distinct("n").alias("d"), F.count("*").alias("c")).collect()
    assert all(x["m"] == x["d"] == x["c"] for x in got)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert [tuple(x) for x in new_rows(old, new, ["k"], F.asc("v")).collect()] == [(3, "y")]
    assert sorted(tuple(x) for x in upsert(old, new, ["k"], True, None, F.asc("v")).collect()) == [(1, "a"), (2, "x"), (3, "y")]


def test_feed_files(spark, tmp_path):
    (tmp_path / "news").mkdir()
    (tmp_path / "news" / "a.txt").write_text('{"results": [{"title": "A", "url": "u", "date": "d"}]} {"data": {"results": [{"title": "A", "url": "u", "date": "d"}, {"title": "B"}]}} oops', "utf-8")
    assert sorted(x["title"] for x in feeds.concatenated_news(spark, str(tmp_path / "news")).collect()) == ["A", "B"]
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss" / "a.xml").write_text("<rss><channel><item><title>T</title><link>l</link><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>")
    item = feeds.rss_items(spark, str(tmp_path / "rss")).first()
    assert item["title"] == "T" and item["published_at"].year == 2024
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "a.json").write_text(json.dumps({"announcements": [{"announcementId": str(i), "announcementTime": i} for i in range(5)]}))
    assert feeds.announcements(spark, str(tmp_path / "ann"), 2).count() == 2
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "b.txt").write_bytes("风险提示".encode("gb18030"))
    assert feeds.text_files(spark, str(tmp_path / "txt")).first()["text"] == "风险提示"
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "港股通.csv").write_text("﻿序号,代码,名称,日期,今日持股-市值\n1,700.0,Ten,20240305,1.5亿\n", "utf-8")
    row = feeds.holdings_rows(feeds.holdings_csv(spark, str(tmp_path / "csv")), ["holding_value"], []).first()
    assert (row["market"], row["company_id"], row["holding_value"], row["event_time"]) == ("southbound", "700", 1.5e8, "2024-03-05")


def test_no_numbers_lost_in_plain_model(spark):
    rng = random.Random(3)
    raw = [f"{rng.choice(['', '-', '$'])}{rng.randint(0, 1999)}{rng.choice(['', '.5', '%', '千'])}" for _ in range(200)]
    got = [x["o"] for x in spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").select("i", numbers.to_number("v").alias("o")).orderBy("i").collect()]
    for v, o in zip(raw, got):
        want = float(re.search(r"-?\d+(?:\.\d+)?", v.replace("$", "")).group()) * (1000 if v.endswith("千") else 1)
        assert o == pytest.approx(want)


@pytest.mark.parametrize("alias,text_", [
    ("TCL科技", "昨日TCL科技发布年报"), ("BYD比亚迪", "约BYD比亚迪股份"), ("阿里Alibaba", "看阿里alibaba集团"), ("Société Générale", "la SOCIÉTÉ GÉNÉRALE a"),
    ("ＡＢＣＤ Holdings", "the abcd holdings group"), ("腾讯控股", "x腾讯控股x"), ("Bank of East Asia Group", "at Bank of East Asia Group, then"), ("600-519.88", "no 600-519.88 here")])
def test_aliases_of_any_script(spark, alias, text_):
    index = r.alias_index(spark.createDataFrame([("c1", alias), ("c2", "Some Other Name")], "company_id string, raw string"))
    found = r.match_companies(spark.createDataFrame([(1, text_), (2, "nothing of it")], "row_id int, text string"), index).collect()
    assert [(x["row_id"], x["company_id"]) for x in found] == [(1, "c1")]


def test_null_keys_and_ties_of_merges(spark):
    target = spark.createDataFrame([(None, "old"), (1, "one")], "k int, v string")
    batch = spark.createDataFrame([(None, "z"), (2, "b"), (2, "a"), (1, "x")], "k int, v string")
    assert [tuple(x) for x in new_rows(target, batch, ["k"]).collect()] == [(2, "a")]
    got = upsert(target, batch.withColumn("w", F.lit(1)), ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "z", 1), (1, "x", 1), (2, "a", 1)], key=str)


def test_tables_keep_all_rows(spark):
    page = "<table><tr><th>a</th><th>b</th></tr>" + "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(60)) + "</table>"
    assert p.html_table_rows(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"]).count() == 60
    many = json.dumps({"rows": [{"a": i} for i in range(60)]})
    assert len(p.json_parts(spark.createDataFrame([(1, many)], "id int, t string"), "id", "t").first()["tables"][0]["rows"]) == 60


def test_nothing_is_cut_by_default(spark):
    row = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("Risk factor: market risk may hurt unit "), i.cast("string"))).alias("s"),
        F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("The company announced an acquisition of unit "), i.cast("string"))).alias("e"),
        F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.array(F.lit("Revenue"), (i * 10).cast("string"))).alias("r"), F.array(F.lit("Item"), F.lit("2023")).alias("h"))
    specs = [("revenue", "revenue", False)]
    out = row.select(
        F.size(p.risks("s", [("market", ["market"])], ["risk"], ["severe"])), F.size(p.events("e", [("deal", ["acquisition"])], ["zzz"])), F.size(p.table_metrics(F.col("h"), F.col("r"), specs)),
        F.size(p.dedupe_metrics(p.table_metrics(F.col("h"), F.col("r"), specs))), F.size(p.clean_table(F.concat(F.array("h"), "r"))["rows"]),
        F.size(p.risks("s", [("market", ["market"])], ["risk"], ["severe"], 12)), F.size(p.clean_table(F.concat(F.array("h"), "r"), 20)["rows"])).first()
    assert tuple(out) == (40, 40, 40, 40, 40, 12, 20)
    page = "".join("<table><tr><th>a</th></tr>" + "".join(f"<tr><td>{t}x{i}</td></tr>" for i in range(250)) + "</table>" for t in range(12))
    pages = spark.createDataFrame([(1, page)], "id int, html string")
    assert p.html_table_rows(pages, "html", ["id"]).count() == 3000 and p.html_table_rows(pages, "html", ["id"], 2, 100).count() == 200
