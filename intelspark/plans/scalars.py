"""Queries of the scalar functions and of the feed classification and projection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from intelspark import rules
from intelspark.bindings import with_views
from intelspark.functions import links, numbers, text, times
from intelspark.operators import classify as c
from intelspark.plans.registry import query

# Line items as messy number texts; the shape depends on the line number.
MESSY = """CASE l_linenumber WHEN 1 THEN '(' || q || ')' WHEN 2 THEN q || '亿' WHEN 3 THEN 'HK$ ' || q || '万' WHEN 4 THEN q || '%'
 WHEN 5 THEN '20' || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 2, '0') || '-07' WHEN 6 THEN '-' || q || ' 千' ELSE '--' END"""
_MESSY_SPARK = """CASE l_linenumber WHEN 1 THEN '(' || q || ')' WHEN 2 THEN q || '亿' WHEN 3 THEN 'HK$ ' || q || '万' WHEN 4 THEN q || '%'
 WHEN 5 THEN '20' || lpad(cast(cast(l_quantity as int) as string), 2, '0') || '-07' WHEN 6 THEN '-' || q || ' 千' ELSE '--' END"""
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINES = f"lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {MESSY} AS raw FROM (SELECT *, CAST(l_quantity AS VARCHAR) AS q FROM lineitem))"


def _lines(v):
    df = v.texts("lineitem", "l_orderkey").withColumn("q", F.col("l_quantity").cast("string"))
    return df.select(*LINE_KEY, F.expr(_MESSY_SPARK).alias("raw"))


# Events as date texts of six shapes.
DATED = """CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y%m%d') WHEN 1 THEN strftime(ts, '%Y%m') WHEN 2 THEN year(ts) || '年' || month(ts) || '月' || day(ts) || '日'
 WHEN 3 THEN 'as of ' || year(ts) || '/' || month(ts) WHEN 4 THEN 'fiscal ' || year(ts) ELSE strftime(ts, '%Y') || '-13-01' END"""
DATES = f"dates AS (SELECT event_id, ts, {DATED} AS raw FROM events)"


def _dates(v):
    e = F.col("event_id") % 6
    raw = (
        F.when(e == 0, F.date_format("ts", "yyyyMMdd")).when(e == 1, F.date_format("ts", "yyyyMM"))
        .when(e == 2, F.expr("concat(year(ts), '年', month(ts), '月', day(ts), '日')")).when(e == 3, F.expr("concat('as of ', year(ts), '/', month(ts))"))
        .when(e == 4, F.expr("concat('fiscal ', year(ts))")).otherwise(F.expr("concat(year(ts), '-13-01')")))
    return v.raw("events").select("event_id", "ts", raw.alias("raw"))


PERIOD = r"""CASE WHEN regexp_matches(raw, '^20\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$') THEN raw[1:4] || '-' || raw[5:6] || '-' || raw[7:8]
 WHEN regexp_matches(raw, '^20\d{2}(0[1-9]|1[0-2])$') THEN raw[1:4] || '-' || raw[5:6]
 WHEN regexp_matches(raw, '20\d{2}[年/.-]\d{1,2}[月/.-]\d{1,2}') AND CAST(regexp_extract(raw, '20\d{2}[年/.-](\d{1,2})[月/.-](\d{1,2})', 1) AS INT) BETWEEN 1 AND 12
  THEN regexp_extract(raw, '(20\d{2})[年/.-]', 1) || '-' || lpad(regexp_extract(raw, '20\d{2}[年/.-](\d{1,2})[月/.-](\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(raw, '20\d{2}[年/.-](\d{1,2})[月/.-](\d{1,2})', 2), 2, '0')
 WHEN regexp_matches(raw, '20\d{2}[年/.-]\d{1,2}') AND CAST(regexp_extract(raw, '20\d{2}[年/.-](\d{1,2})', 1) AS INT) BETWEEN 1 AND 12
  THEN regexp_extract(raw, '(20\d{2})[年/.-]', 1) || '-' || lpad(regexp_extract(raw, '20\d{2}[年/.-](\d{1,2})', 1), 2, '0')
 WHEN regexp_matches(raw, '\b20\d{2}\b') THEN regexp_extract(raw, '\b(20\d{2})\b', 1) END"""


@query("s1_strip", r"SELECT p_partkey, regexp_replace('  ' || p_name || chr(12288) || ' ', '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM part")
def s1(v):
    return v.raw("part").select("p_partkey", text.strip(F.concat(F.lit("  "), "p_name", F.lit("　 "))).alias("text"))


@query("s2_clean", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 replace(replace(replace(replace(replace(replace(replace(text || chr(13) || chr(10) || ' &nbsp;&lt;end&gt;  ', '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'),
 chr(160), ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM documents""")
def s2(v):
    return v.raw("documents").select("doc_id", text.clean(F.concat("text", F.lit("\r\n &nbsp;&lt;end&gt;  ")), every_entity=True).alias("text"))


@query("s3_coerce_number", f"""WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 CASE l_linenumber WHEN 1 THEN -n WHEN 2 THEN n * 1e8::DOUBLE WHEN 3 THEN n * 1e4::DOUBLE WHEN 4 THEN n WHEN 6 THEN n * 1e3::DOUBLE END AS value FROM (
  SELECT *, CAST(nullif(regexp_extract(raw, '-?\\d+\\.?\\d*'), '') AS DOUBLE) AS n FROM lines WHERE l_linenumber NOT IN (5) AND raw <> '--'
  UNION ALL SELECT *, NULL FROM lines WHERE l_linenumber = 5 OR raw = '--')""")
def s3(v):
    return _lines(v).select(*LINE_KEY, numbers.to_number("raw").alias("value"))


@query("s4_date_like", f"WITH {DATES} SELECT event_id, event_id % 6 <> 4 AS date_like FROM dates")
def s4(v):
    return _dates(v).select("event_id", numbers.is_date_like("raw").alias("date_like"))


@query("s5_period", f"WITH {DATES} SELECT event_id, {PERIOD} AS period FROM dates")
def s5(v):
    return _dates(v).select("event_id", times.period_of("raw").alias("period"))


@query("s6_record_time", f"WITH {DATES} SELECT event_id, coalesce({PERIOD}, strftime(ts, '%Y-%m')) AS event_time FROM dates")
def s6(v):
    record = F.create_map(F.lit("note"), F.date_format("ts", "yyyy-MM"), F.lit("publish_date"), F.col("raw"))
    return _dates(v).select("event_id", times.record_time(record).alias("event_time"))


@query("s7_infer_unit", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'percent' WHEN contains(lower(p_name), 'ring') AND p_size % 3 = 1 THEN 'percent' WHEN p_size % 3 = 1 THEN 'currency' END AS unit FROM part""")
def s7(v):
    size = F.col("p_size") % 3
    indicator = F.when(F.col("p_name").contains("ring") & (size == 1), "hibor_fixing").when(size == 1, "fob_usd").otherwise("count")
    return v.raw("part").select("p_partkey", numbers.infer_unit(indicator, F.when(size == 0, "5%").otherwise("5")).alias("unit"))


@query("s8_natural_key", with_views("facts", "SELECT id, dataset || '|' || left(concat_ws('|', CAST(id AS VARCHAR), title, 'idx-' || id), 400) AS record_key FROM facts"))
def s8(v):
    fields = {"id": F.col("id").cast("string"), "title": F.col("title"), "subject": F.lit("")}
    key = links.natural_key(F.col("dataset"), fields, F.concat(F.lit("idx-"), F.col("id").cast("string")))
    return v.facts().select("id", key.alias("record_key"))


@query("s9_content_hash", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS content_hash FROM orders""")
def s9(v):
    return v.raw("orders").select("o_orderkey", links.content_hash(["o_orderstatus", "o_custkey", "o_orderpriority"]).alias("content_hash"))


STAMPS = """CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y/%m/%d') WHEN 2 THEN strftime(ts, '%Y-%m') WHEN 3 THEN strftime(ts, '%Y') ELSE 'soon ' || event_id END"""


@query("s10_loose_timestamp", """SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('month', ts)
 WHEN 3 THEN date_trunc('year', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def s10(v):
    e = F.col("event_id") % 5
    raw = (F.when(e == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e == 1, F.date_format("ts", "yyyy/MM/dd"))
           .when(e == 2, F.date_format("ts", "yyyy-MM")).when(e == 3, F.date_format("ts", "yyyy")).otherwise(F.concat(F.lit("soon "), F.col("event_id").cast("string"))))
    return v.raw("events").select("event_id", F.date_format(times.loose_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("s11_row_conform", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CASE WHEN value > 50 THEN event_id END, 0) AS count, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS event_time FROM events""")
def s11(v):
    from intelspark.sinks.sync import conform

    landed = v.raw("events").select(
        "event_id", F.col("props").alias("payload"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), F.when(F.col("value") > 50, F.col("event_id")).alias("count"))
    out = conform(landed, json_fields={"payload": "struct<k: bigint>"}, times=["event_time"], counts=["count"])
    return out.select("event_id", F.col("payload.k").alias("k"), "count", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("s12_epoch_ms", """SELECT event_id, strftime(TIMESTAMP '1970-01-01' + to_milliseconds(1700000000000 + event_id * 86399) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time,
 strftime(TIMESTAMP '1970-01-01' + to_milliseconds(1700000000000 + event_id * 86399) + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_date FROM events""")
def s12(v):
    ms = (F.lit(1700000000000) + F.col("event_id") * 86399).cast("string")
    return v.raw("events").select("event_id", times.epoch_ms_text(ms).alias("local_time"), times.epoch_ms_date(ms).alias("local_date"))


@query("s13_publication_time", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS published FROM events")
def s13(v):
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return v.raw("events").select("event_id", F.date_format(times.publication_time(raw), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("s14_split_iso", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime FROM events")
def s14(v):
    return v.raw("events").select("event_id", times.split_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("s")).select("event_id", "s.date", "s.datetime")


@query("s15_year_month", "SELECT o_orderkey, year(o_orderdate) = 1997 AND month(o_orderdate) = 5 AS hit FROM orders")
def s15(v):
    return v.raw("orders").select("o_orderkey", times.matches_year_month(F.date_format("o_orderdate", "yyyy-MM-dd"), "1997", "05").alias("hit"))


@query("s16_slug", "SELECT c_custkey, 'hkg-' || trim(regexp_replace(lower(c_name || ' (HK) Ltd.'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def s16(v):
    return v.raw("customer").select("c_custkey", links.slug(F.concat("c_name", F.lit(" (HK) Ltd."))).alias("slug"))


@query("s17_urls", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url ELSE 'https://' || regexp_replace(url, '^https?://', '') END AS url,
 CASE WHEN page_id % 3 = 2 THEN 'Page ' || page_id || ' é' END AS title FROM pages""".replace("ELSE 'https://' || regexp_replace(url, '^https?://', '') END", "WHEN 1 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE 'https://en.wikipedia.org/wiki/Page_' || page_id || '_%C3%A9' END"))
def s17(v):
    p = F.col("page_id") % 3
    raw = (F.when(p == 0, F.col("url")).when(p == 1, F.regexp_replace("url", "^https?://", ""))
           .otherwise(F.concat(F.lit("en.wikipedia.org/wiki/Page_"), F.col("page_id").cast("string"), F.lit("_%C3%A9"))))
    return v.raw("pages").select("page_id", links.public_url(raw).alias("url"), links.wikipedia_title(raw).alias("title"))


@query("s18_article_id", r"""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '/*([?#].*)?$', ''), '([^/]*)$', 1), '\.html$', '') AS article,
 'https://static.example/root/doc/' || page_id || '.pdf' AS pdf FROM pages""")
def s18(v):
    pdf = links.absolute_url(F.concat(F.lit("/doc/"), F.col("page_id").cast("string"), F.lit(".pdf")), "https://static.example/root/")
    return v.raw("pages").select("page_id", links.article_id("url").alias("article"), pdf.alias("pdf"))


@query("s19_codes", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS code, CAST(p_size AS DOUBLE) / 4 AS percent FROM part")
def s19(v):
    code = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("double").cast("string")).otherwise(F.concat(F.lit("HK:"), F.col("p_partkey").cast("string")))
    return v.raw("part").select("p_partkey", numbers.code_text(code).alias("code"), numbers.to_percent(F.concat((F.col("p_size").cast("double") / 4).cast("string"), F.lit(" %"))).alias("percent"))


@query("s20_list", "SELECT p_partkey, lower(p_brand) || '|' || p_name || '|' || p_type AS items FROM part")
def s20(v):
    return v.raw("part").select("p_partkey", F.array_join(text.list_of(F.concat_ws(",", F.lower("p_brand"), F.concat(F.lit(" "), "p_name"), F.lit(" "), "p_type")), "|").alias("items"))


@query("s21_alias_key", "SELECT c_custkey, lower(c_name) || ' co' AS alias FROM customer")
def s21(v):
    # The appended letters are full-width, so they only come out right after compatibility folding.
    return v.raw("customer").select("c_custkey", text.alias_key(F.concat("c_name", F.lit("  ＣＯ "))).alias("alias"))


@query("s22_first_sentence", r"""SELECT doc_id, CASE WHEN contains(t, '. ') THEN trim(split_part(t, '. ', 1)) WHEN contains(t, '; ') THEN trim(split_part(t, '; ', 1)) WHEN contains(t, '。') THEN trim(split_part(t, '。', 1)) ELSE nullif(t, '') END AS sentence
 FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents)""")
def s22(v):
    return v.raw("documents").select("doc_id", text.first_sentence("text").alias("sentence"))


@query("s23_pretty_label", "SELECT event_id, upper(event_type[1]) || event_type[2:] || ' Type' AS label FROM events")
def s23(v):
    return v.raw("events").select("event_id", text.title_case(F.concat("event_type", F.lit("_type"))).alias("label"))


@query("s24_truncate", r"SELECT doc_id, CASE WHEN length(t) > 220 THEN rtrim(t[1:220]) || '...' ELSE t END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents)")
def s24(v):
    return v.raw("documents").select("doc_id", text.truncate("text", 220).alias("text"))


@query("s25_find_text", "SELECT event_id, event_type AS path FROM events")
def s25(v):
    payload = F.to_json(F.struct(F.struct(F.lit(" ").alias("file_path"), F.struct(F.col("event_type").alias("local_path")).alias("deep")).alias("body"), "event_id"))
    return links.find_text_deep(v.raw("events").select("event_id", payload.alias("payload")), "payload", ("file_path", "local_path", "path"), "path").select("event_id", "path")


@query("s26_json_lines", "SELECT event_id, CAST(0 AS INT) AS pos, 'k: ' || json_extract_string(props, '$.k') AS line FROM events")
def s26(v):
    return links.json_lines(v.raw("events"), "event_id", "props")


@query("s27_html_and_media", """SELECT page_id, true AS is_html, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/x-own' END AS media FROM pages""")
def s27(v):
    p = F.col("page_id") % 4
    name = F.when(p == 0, "a/Report.PDF").when(p == 1, "index.htm").when(p == 2, "x.json").otherwise("x.bin")
    return v.raw("pages").select("page_id", text.looks_like_html("html", rules.HTML_TAG_PATTERN).alias("is_html"), text.media_type(F.when(p == 2, "Text/X-Own"), name).alias("media"))


@query("s28_indicator_text", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'US dollar FX reference updated' WHEN event_id % 3 = 1 THEN upper(event_type[1]) || event_type[2:] || ' Rate updated' ELSE 'note ' || event_id END AS title,
 CASE WHEN event_id % 3 = 0 THEN 'US dollar FX reference: ' || CAST(value AS VARCHAR) WHEN event_id % 3 = 1 THEN upper(event_type[1]) || event_type[2:] || ' Rate: ' || CAST(value AS VARCHAR) ELSE 'note ' || event_id END AS summary FROM events""")
def s28(v):
    e = F.col("event_id") % 3
    raw = (F.when(e == 0, F.concat(F.lit("USD: "), F.col("value").cast("string"))).when(e == 1, F.concat("event_type", F.lit("_rate: "), F.col("value").cast("string")))
           .otherwise(F.concat(F.lit("note "), F.col("event_id").cast("string"))))
    title, summary = c.indicator_display(F.col("raw"))
    return v.raw("events").select("event_id", raw.alias("raw")).select("event_id", title.alias("title"), summary.alias("summary"))


@query("s29_date_candidates", "SELECT event_id, strftime(ts, '%Y-%m-%d') || '|' || strftime(ts, '%-d %B %Y') AS dates FROM events")
def s29(v):
    note = F.concat(F.lit("On "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" and "), F.date_format("ts", "d MMMM yyyy"), F.lit(", again "), F.date_format("ts", "yyyy-MM-dd"), F.lit("."))
    return v.raw("events").select("event_id", F.array_join(text.date_candidates(note, rules.DATE_IN_TEXT_PATTERN), "|").alias("dates"))


# ------------------------------------------------------------------ classification

WORDS = ("usd fixing", "loan growth", "gdp output", "liquidity fund", "port calls", "IPO 上市", "风险 warning", "mainland visit", "expansion launch", "technology park shenzhen company")
TOPIC = "(['" + "','".join(WORDS) + "'])[1 + event_id % 10]"


def _topics(v):
    words = F.array(*[F.lit(w) for w in WORDS])
    return v.raw("events").select("event_id", "event_type", F.get(words, (F.col("event_id") % 10).cast("int")).alias("topic"))


def _case(groups, otherwise="market", column="t"):
    parts = [f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in groups]
    return "CASE " + " ".join(parts) + f" ELSE '{otherwise}' END"


@query("c1_signal_type", f"SELECT event_id, {_case(rules.SIGNAL_TYPE_GROUPS)} AS signal_type FROM (SELECT event_id, lower('feed_' || event_type || ' ' || {TOPIC}) AS t FROM events)")
def c1(v):
    return _topics(v).select("event_id", c.signal_type(F.col("topic"), F.concat(F.lit("feed_"), "event_type")).alias("signal_type"))


@query("c2_news_type", f"SELECT event_id, {_case(rules.NEWS_TYPE_GROUPS)} AS signal_type FROM (SELECT event_id, lower(event_type || ' ' || {TOPIC}) AS t FROM events)")
def c2(v):
    return _topics(v).select("event_id", c.news_type(F.col("event_type"), F.col("topic")).alias("signal_type"))


@query("c3_announcement_type", f"SELECT event_id, {_case(rules.ANNOUNCEMENT_TYPE_GROUPS)} AS signal_type FROM (SELECT event_id, lower(event_type || ' ' || {TOPIC}) AS t FROM events)")
def c3(v):
    return _topics(v).select("event_id", c.announcement_type(F.col("event_type"), F.col("topic")).alias("signal_type"))


@query("c4_policy_type", f"""SELECT event_id, CASE WHEN event_type = 'view' AND contains(t, 'shenzhen') THEN 'cross_border' ELSE {_case(rules.POLICY_TYPE_GROUPS)} END AS signal_type
 FROM (SELECT event_id, event_type, lower(event_type || ' ' || {TOPIC}) AS t FROM events)""")
def c4(v):
    return _topics(v).select("event_id", c.policy_type(F.col("event_type"), F.col("topic"), F.col("event_type") == "view").alias("signal_type"))


@query("c5_record_type", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'event' WHEN 2 THEN 'document' ELSE 'metric' END AS record_type FROM events""")
def c5(v):
    e = F.col("event_id") % 4
    dataset = F.when(e == 0, "holdings_CSV").when(e == 1, "press_releases_2024").otherwise("daily_figures")
    return v.raw("events").select("event_id", c.record_type(F.when(e == 2, "kpmg").otherwise("hkma"), dataset).alias("record_type"))


@query("c6_timeline_of_facts", with_views("facts", """SELECT source, company_id, event_time, 'metric' AS event_type, CASE WHEN id % 2 = 0 THEN title ELSE source || ' ' || dataset END AS headline,
 '{"source":"' || source || '","dataset":"' || dataset || '","record_key":"' || record_key || '"}' AS payload FROM facts"""))
def c6(v):
    facts = v.facts().withColumn("title", F.when(F.col("id") % 2 == 0, F.col("title")))
    return c.timeline_of(facts, F.lit("metric")).select("source", "company_id", "event_time", "event_type", "headline", "payload")


UNPIVOT = """SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_linenumber, 'exports' AS dataset, strftime(l_shipdate, '%Y-%m-%d') AS event_time, indicator, value_num,
 'exports|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || indicator || '|' || CAST(value_num AS VARCHAR) AS signal_key, 'cross_border' AS signal_type, CASE WHEN indicator = 'tax_rate' THEN 'percent' END AS unit
FROM (SELECT *, unnest(['quantity', 'tax_rate', 'discount']) AS indicator, unnest([l_quantity, l_tax, l_discount]) AS value_num FROM lineitem)"""


def _wide(v):
    line = v.texts("lineitem", "l_orderkey").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    fields = F.create_map(*[x for name, column in (("quantity", "l_quantity"), ("tax_rate", "l_tax"), ("discount", "l_discount"), ("flag", "l_returnflag"), ("date", "day")) for x in (F.lit(name), F.col(column).cast("string"))])
    return line.withColumn("fields", fields)


@query("c7_unpivot_signals", UNPIVOT)
def c7(v):
    out = c.metric_signals(_wide(v), F.lit("exports"), F.col("day"), F.col("fields"), LINE_KEY)
    return out.drop("value_text", "signal_text")


@query("c8_macro_facts", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'press_releases_daily' ELSE 'rates_' || event_type END AS dataset, CASE WHEN event_type = 'view' THEN 'event' ELSE 'metric' END AS record_type,
 strftime(ts, '%Y-%m-%d') AS event_time, 'Title ' || event_id AS title, 'Title ' || event_id AS summary,
 CASE WHEN event_type = 'view' THEN 'press_releases_daily' ELSE 'rates_' || event_type END || '|' || strftime(ts, '%Y-%m-%d') || '|Title ' || event_id || '|idx-' || user_id AS record_key FROM events""")
def c8(v):
    fields = F.create_map(F.lit("end_of_day"), F.date_format("ts", "yyyy-MM-dd"), F.lit("title"), F.concat(F.lit("Title "), F.col("event_id").cast("string")), F.lit("level"), F.col("value").cast("string"))
    dataset = F.when(F.col("event_type") == "view", "press_releases_daily").otherwise(F.concat(F.lit("rates_"), "event_type"))
    return c.macro_facts(v.raw("events"), dataset, F.col("user_id"), fields, ["event_id"]).select("event_id", "dataset", "record_type", "event_time", "title", "summary", "record_key")


@query("c9_series", """SELECT event_type AS series, count(*) AS observation_count, count(value) AS numeric_count, min(strftime(ts, '%Y-%m-%d')) AS first_period, max(strftime(ts, '%Y-%m-%d')) AS last_period FROM events GROUP BY 1""")
def c9(v):
    obs = v.raw("events").select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("time_period"), F.col("value").alias("value_num"))
    return c.series_facts(obs, ["series"])


@query("c9_series_signals", """SELECT event_type AS series, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, value AS value_num, event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS signal_key, 'growth' AS signal_type FROM events""")
def c9b(v):
    obs = v.raw("events").select(F.col("event_type").alias("series"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_period"), F.col("value").alias("value_num"))
    return c.series_signals(obs, ["series"], F.lit("kidb_gdp")).select("series", "event_time", "value_num", "signal_key", "signal_type")


# A special value that reads as a date (user 2024 or 202401) is no number; the checker's SQL says the same.
@query("c10_statistics_rows", rf"WITH {DATES} SELECT event_id, {PERIOD} AS event_time, coalesce(CASE WHEN value > 20 THEN value END, CASE WHEN NOT regexp_matches(CAST(user_id AS VARCHAR), '^20\d{{2}}(\d{{2}}){{0,2}}$') THEN CAST(user_id AS DOUBLE) END) AS value_num FROM dates JOIN events USING (event_id) WHERE {PERIOD} IS NOT NULL")
def c10(v):
    from intelspark.sources.feeds import statistics_signals

    rows = _dates(v).join(v.raw("events").select("event_id", "value", "user_id"), "event_id").select(
        "event_id", F.col("raw").alias("period"), F.when(F.col("value") > 20, F.col("value")).alias("figure"), F.col("user_id").cast("string").alias("sd_value"))
    return statistics_signals(rows, ["event_id"])


# A number such as 122012.35 holds the text of a month ("2012.35"), so the date guard drops it; the
# checker does the same.
@query("c11_table_cells", r"SELECT o_orderkey, 'total' AS indicator, o_totalprice AS value_num FROM orders WHERE NOT regexp_matches(CAST(o_totalprice AS VARCHAR), '20\d{2}[.]\d') UNION ALL SELECT o_orderkey, 'priority', CAST(o_orderpriority[1] AS DOUBLE) FROM orders")
def c11(v):
    fields = F.create_map(F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.left("o_orderpriority", F.lit(1)))
    return c.metric_signals(v.raw("orders"), F.lit("table"), F.lit("2024"), fields, ["o_orderkey"]).select("o_orderkey", "indicator", "value_num")


@query("c12_news_rows", f"SELECT event_id, {TOPIC} AS title, {TOPIC} AS summary, {TOPIC} AS headline, {_case(rules.NEWS_TYPE_GROUPS)} AS signal_type FROM (SELECT event_id, lower(event_type || ' ' || {TOPIC}) AS t FROM events)")
def c12(v):
    return c.news_rows(_topics(v), F.col("event_type"), F.col("topic"), F.lit(" "), ["event_id"])


@query("c13_policy_news", f"""SELECT event_id, contains(t, 'shenzhen') AS matched, CASE WHEN contains(t, 'shenzhen') THEN 'cross_border' ELSE {_case(rules.POLICY_TYPE_GROUPS)} END AS signal_type
 FROM (SELECT event_id, lower({TOPIC} || ' ' || event_type) AS t FROM events)""")
def c13(v):
    rows = _topics(v)
    chosen = c.keyword_filter(rows, "topic", "event_type")
    flagged = c.membership_flag(rows, chosen, "event_id", "matched")
    return flagged.select("event_id", "matched", c.policy_type(F.col("topic"), F.col("event_type"), F.col("matched")).alias("signal_type"))


@query("c15_listing_filter", "SELECT o_orderkey, 'market' AS signal_type FROM orders WHERE year(o_orderdate) = 1997 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def c15(v):
    from intelspark.sources.feeds import listing_facts

    rows = v.raw("orders").withColumn("event_time", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return listing_facts(rows, year="1997", limit=50, order=[F.desc("event_time"), F.asc("o_orderkey")]).select("o_orderkey", "signal_type")


@query("c16_seed_companies", with_views("companies", "SELECT company_id, canonical_name FROM companies WHERE list_has_any(segments, ['building','machinery'])"))
def c16(v):
    return c.seed_companies(v.companies(), ["Building", "MACHINERY"]).select("company_id", "canonical_name")


@query("c17_holdings_rows", with_views("holdings", r"SELECT company_id, rank, CASE WHEN NOT regexp_matches(CAST(CAST(holding_value AS DECIMAL(20,2)) AS VARCHAR), '20\d{2}[.]\d') THEN holding_value END AS holding_value, CAST(CAST(holding_float_ratio_pct AS DECIMAL(18,4)) AS DOUBLE) AS holding_float_ratio_pct, '2024-03-05' AS event_time FROM holdings WHERE shares IS NOT NULL"))
def c17(v):
    from intelspark.sources.feeds import holdings_rows

    h = v.holdings().filter(F.col("shares").isNotNull())
    raw = h.select(
        F.col("rank").cast("string").alias("rank"), F.concat(F.col("company_id"), F.lit(".0")).alias("code"), F.col("company_name").alias("name"), F.lit("20240305").alias("date"),
        F.concat(F.lit("HK$"), F.col("holding_value").cast("decimal(20,2)").cast("string")).alias("holding_value"), F.concat(F.col("holding_float_ratio_pct").cast("decimal(18,4)").cast("string"), F.lit("%")).alias("holding_float_ratio_pct"))
    return holdings_rows(raw, numbers_in=["holding_value"], percents_in=["holding_float_ratio_pct"]).select("company_id", "rank", "holding_value", "holding_float_ratio_pct", "event_time")


@query("c18_holding_signals", with_views("holdings", """
SELECT company_id, 'market_attention' AS signal_type, 'ranking' AS indicator, rank::DOUBLE AS value_num, company_name || ' ranks ' || rank || ' in southbound holdings.' AS signal_text FROM holdings WHERE rank > 0 AND rank <= 20
UNION ALL SELECT company_id, 'growth', 'estimated_increase_value', increase_value, NULL FROM holdings WHERE increase_value > 0
UNION ALL SELECT company_id, 'market', 'holding_float_ratio_pct', holding_float_ratio_pct, NULL FROM holdings WHERE holding_float_ratio_pct > 5
UNION ALL SELECT company_id, 'growth', 'price_and_flow_resonance', price_change_pct, NULL FROM holdings WHERE price_change_pct > 0 AND increase_value > 0
UNION ALL SELECT company_id, 'market_attention', 'increase_float_ratio_pct', increase_float_ratio_pct, NULL FROM holdings WHERE increase_float_ratio_pct > 0
UNION ALL SELECT company_id, 'market', 'sector_capital_presence', holding_value, company_name || ' shows material connect capital presence in sector ' || sector || '.' FROM holdings WHERE holding_value > 0 AND sector <> ''"""))
def c18(v):
    out = c.holding_signals(v.holdings())
    shown = F.when(F.col("indicator").isin("ranking", "sector_capital_presence"), F.col("signal_text"))
    return out.select("company_id", "signal_type", "indicator", "value_num", shown.alias("signal_text"))


@query("c19_first_seen_company", "SELECT l_partkey AS code, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1")
def c19(v):
    from intelspark.operators.serving import latest_by

    order = [F.asc(x) for x in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return latest_by(v.raw("lineitem"), "l_partkey", *order).select(F.col("l_partkey").alias("code"), "l_orderkey")


@query("c21_keyword_filter", f"SELECT event_id FROM events WHERE contains({TOPIC}, 'shenzhen') AND contains({TOPIC}, 'company')")
def c21(v):
    return c.keyword_filter(_topics(v), "topic", "event_type").select("event_id")


@query("c22_ui_groups", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'funding' WHEN 1 THEN 'policy' WHEN 2 THEN 'crossborder' ELSE 'expansion' END AS ui,
 CASE event_id % 4 WHEN 0 THEN 'Financing' WHEN 1 THEN 'Policy/Macro' WHEN 2 THEN 'Cross-border' ELSE 'New Launch' END AS label,
 CASE event_id % 4 WHEN 0 THEN 'financing' WHEN 1 THEN 'policy' WHEN 2 THEN 'cross_border' ELSE 'signal' END AS class FROM events""")
def c22(v):
    e = F.col("event_id") % 4
    kind = F.when(e == 0, "Financing").when(e == 1, "macro").when(e == 2, "Cross_Border").otherwise("new_launch")
    return v.raw("events").select("event_id", c.ui_group(kind).alias("ui"), c.type_label(kind).alias("label"), c.type_class(kind).alias("class"))


@query("c23_operational_only", "SELECT p_partkey FROM part WHERE NOT contains(p_name || CASE WHEN p_size % 5 = 0 THEN ' Sector view' ELSE '' END, 'Sector')")
def c23(v):
    named = v.raw("part").withColumn("n", F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " Sector view").otherwise("")))
    return c.operational_only(named, "n").select("p_partkey")


@query("a9_news_window", """SELECT event_id, CAST((CAST(ts AS DATE) - INTERVAL 3 MONTH) AS DATE) AS start_day,
 array_to_string(list_transform(generate_series(date_trunc('month', CAST(ts AS DATE) - INTERVAL 3 MONTH), date_trunc('month', CAST(ts AS DATE)), INTERVAL 1 MONTH), lambda d: strftime(d, '%Y%m')), ',') AS months FROM events""")
def a9(v):
    start = times.news_window(F.col("ts").cast("date"), months=3)
    return v.raw("events").select("event_id", start.alias("start_day"), F.array_join(times.month_keys(start, F.col("ts").cast("date")), ",").alias("months"))
