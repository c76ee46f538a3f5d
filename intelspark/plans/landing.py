"""Queries of idempotent writes, merges, synchronisation, feed shapes and streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from intelspark.bindings import with_views
from intelspark.operators.serving import latest_by
from intelspark.plans.registry import query
from intelspark.sinks import merge, sync
from intelspark.sinks.ledger import source_ledger
from intelspark.sources import feeds

KEY = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def _split_orders(v):
    """Orders before 1997 are stored already, the whole table is delivered again."""
    orders = v.raw("orders")
    return orders.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")), orders


def _append_query(name, keys, keep):
    columns, joined = ", ".join(dict.fromkeys(["o_orderkey", *keys])), " AND ".join(f"s.{k} = o.{k}" for k in keys)
    sql = f"""SELECT {columns} FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderdate < TIMESTAMP '1997-01-01' AND {joined})
QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY o_orderkey) = 1"""

    @query(name, sql)
    def build(v):
        stored, batch = _split_orders(v)
        return merge.new_rows(stored, batch, keys, F.asc("o_orderkey")).select(*dict.fromkeys(["o_orderkey", *keys]))

    return keep


_append_query("b1_append_records", KEY, None)
_append_query("b4_append_scores", ["o_custkey", "o_orderstatus"], None)
_append_query("b5_append_insights", ["o_orderkey"], None)


@query("b2_append_signals", with_views("signals", """SELECT company_id, signal_type, min(id) AS id FROM signals GROUP BY company_id, signal_type HAVING min(event_time) >= TIMESTAMP '2024-01-10'"""))
def b2(v):
    rows = v.signals().withColumn("value_text", F.col("value_num").cast("string"))
    # The hash covers fields that are equal within a company and type here, so it is the same key.
    hashed = merge.with_hash(rows.withColumns({c: F.lit("x") for c in ("entity", "indicator", "value_text", "extra")} | {"value_num": F.lit(1.0), "t": F.col("event_time"), "event_time": F.lit("all")}),
                             [*merge.SIGNAL_HASH_FIELDS, "signal_type"], "row_hash")
    stored = hashed.filter(F.col("t") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return merge.new_rows(stored, hashed, ["row_hash"], F.asc("id")).select("company_id", "signal_type", "id")


@query("b3_append_timeline", with_views("timeline", """SELECT id, company_id FROM timeline WHERE event_time >= TIMESTAMP '1997-01-01'"""))
def b3(v):
    hashed = merge.with_hash(v.timeline(), merge.TIMELINE_HASH_FIELDS, "dedup_hash")
    twice = hashed.unionByName(hashed)
    stored = hashed.filter(F.col("event_time") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return merge.new_rows(stored, twice, ["dedup_hash"], F.asc("id")).select("id", "company_id")


@query("b6_append_company_versions", with_views("companies", "SELECT company_id, canonical_name FROM companies WHERE region <> 'ASIA'"))
def b6(v):
    rows = merge.with_hash(v.companies(), ["company_id", "canonical_name", "region", "segments", "industries"], "row_hash")
    return merge.new_rows(rows.filter(F.col("region") == "ASIA"), rows, ["company_id", "row_hash"], F.asc("id")).select("company_id", "canonical_name")


@query("b7_persist_batch", """SELECT 'orders' AS "table", count(*) AS inserted FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL SELECT 'customers', count(*) FROM customer""")
def b7(v):
    stored, batch = _split_orders(v)
    customers = v.raw("customer")
    targets = {"orders": stored, "customers": customers.limit(0)}
    return merge.persist_batch(targets, {"orders": batch, "customers": customers}, {"orders": ["o_orderkey"], "customers": ["c_custkey"]})[1]


@query("b8_upsert", """SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(c_name, s_name) AS name, coalesce(s_nationkey, c_nationkey) AS nation FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""")
def b8(v):
    target = v.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    batch = v.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return merge.upsert(target, batch, ["id"], True, ["name"])


@query("b8_insert_ignore", """SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def b8b(v):
    target = v.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return merge.upsert(target, v.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ["id"], False)


@query("b9_sync_summary", """SELECT 'trigger_signals' AS "table", count(*) AS scanned, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS inserted, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS skipped FROM orders""")
def b9(v):
    stored, batch = _split_orders(v)
    return sync.sync_table(sync.TableSpec("trigger_signals", ("o_orderkey",)), batch, stored)[1]


@query("b10_workflow_upsert", """SELECT 'prospect:' || coalesce(s_suppkey, c_custkey) AS prospect_id, CASE WHEN c_custkey IS NOT NULL THEN 'won' WHEN s_acctbal < 0 THEN 'on_hold' ELSE 'contacted' END AS stage, c_custkey IS NOT NULL AS stamped
FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON s_suppkey = c_custkey""")
def b10(v):
    states = v.workflow_states().select("prospect_id", "company_id", "stage", F.lit(None).cast("timestamp").alias("updated_at"))
    changes = v.raw("customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.concat(F.lit("prospect:"), F.col("c_custkey").cast("string")).alias("prospect_id"), F.col("c_custkey").cast("string").alias("company_id"), F.lit("won").alias("stage"))
    return merge.set_state(states, changes, F.current_timestamp()).select("prospect_id", "stage", F.col("updated_at").isNotNull().alias("stamped"))


@query("b11_replace_children", """SELECT l_orderkey AS document_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS child_index, l_extendedprice AS value FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), l_extendedprice FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def b11(v):
    # Returned lines are the new parse of their order; the other lines are its previous children.
    cols = [F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("bigint").alias("child_index"), F.col("l_extendedprice").alias("value")]
    lines = v.raw("lineitem")
    old = lines.filter(F.col("l_returnflag") != "A").select(*cols)
    new = lines.filter(F.col("l_returnflag") == "A").select(*cols, "l_partkey", "l_suppkey")
    return merge.replace_children(old, new, "child_index", F.asc("child_index"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("value"))


@query("b14_source_ledger", with_views("facts", """SELECT 'run-1' AS run_id, source, count(*) AS fetched, count(*) FILTER (WHERE id % 3 > 0) AS inserted, count(*) FILTER (WHERE source = 'src1') AS errors, CASE WHEN source = 'src1' THEN 'failed' ELSE 'success' END AS status FROM facts GROUP BY source"""))
def b14(v):
    outcomes = v.facts().select("source", (F.col("id") % 3 > 0).alias("inserted"), (F.col("source") == "src1").alias("failed"))
    return source_ledger(outcomes, "run-1")


@query("b15_legacy_records", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'event' ELSE 'metric' END AS record_type, event_type || '|' || event_id AS title FROM events""")
def b15(v):
    old = v.raw("events").select(
        "event_id", F.lit("hkma").alias("source"), F.when(F.col("event_type") == "view", "press_releases").otherwise("rates").alias("dataset"), F.concat_ws("|", "event_type", F.col("event_id").cast("string")).alias("record_key"),
        F.lit("h").alias("content_hash"), F.col("ts").alias("event_time"), F.lit(None).cast("string").alias("title"), F.col("props").alias("payload"))
    migrated = merge.legacy_records(old)
    kept = merge.migrate_once(migrated.limit(0), migrated)
    return kept.select(F.split_part("record_key", F.lit("|"), F.lit(2)).cast("bigint").alias("event_id"), "record_type", "title")


@query("b15_legacy_signals", """SELECT 'rates|' || event_type || '_usd' AS signal_key, 'cross_border' AS signal_type, count(*) AS n FROM events GROUP BY event_type""")
def b15b(v):
    old = v.raw("events").select(F.lit("hkma").alias("source"), F.lit("rates").alias("dataset"), F.lit(None).cast("string").alias("event_time"), F.concat("event_type", F.lit("_usd")).alias("indicator"), "value")
    return merge.legacy_signals(old).groupBy("signal_key", "signal_type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ feed shapes


@query("a1_paged_records", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price FROM orders")
def a1(v):
    page = F.to_json(F.struct(F.struct(F.array(F.struct("o_orderkey", F.col("o_totalprice").cast("string").alias("price"))).alias("records")).alias("result")))
    pages = v.raw("orders").select(page.alias("page"))
    return feeds.records_of(pages, "page", "struct<o_orderkey: bigint, price: string>")


@query("a3_time_series", """SELECT o_orderkey, '2024-' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') AS time_period, CAST(i AS INT) AS observation_index, (o_orderkey + i)::DOUBLE AS value_num, 'Units' AS unit, 3 AS unit_multiplier_pow10
FROM (SELECT o_orderkey, unnest(range(0, 12)) AS i FROM orders)""")
def a3(v):
    order = [10, 2, 0, 11, 5, 1, 3, 4, 9, 8, 7, 6]
    observations = F.concat_ws(",", *[F.concat(F.lit(f'"{i}":["'), (F.col("o_orderkey") + i).cast("string"), F.lit('"]')) for i in order])
    periods = ",".join(f'{{"value":"2024-{i + 1:02d}"}}' for i in range(12))
    tail = ('}}}}],"structures":[{"dimensions":{"observation":[{"id":"TIME_PERIOD","values":[' + periods + ']}]},"attributes":{"observation":[{"id":"UNIT","values":[{"name":"Units"}]},'
            '{"id":"UNIT_MULT","values":[{"id":"3"}]}]}}]}}')
    payload = F.concat(F.lit('{"data":{"datasets":[{"structure":0,"series":{"0.10":{"observations":{"0":["-1"]}},"0.2":{"observations":{'), observations, F.lit(tail))
    return feeds.time_series(v.raw("orders").select("o_orderkey", payload.alias("p")), "p", ["o_orderkey"]).drop("value")


@query("a8_archive_window", """SELECT user_id AS link, strftime(max(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS published_at FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_type <> 'error' GROUP BY 1""")
def a8(v):
    items = v.raw("events").select(F.col("user_id").alias("link"), F.col("event_type").alias("title"), F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("pubDate"))
    start, end = (F.to_timestamp(F.lit(x)) for x in ("2024-01-05 00:00:00", "2024-01-20 00:00:00"))
    return feeds.archive_window(items, start, end).select("link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


_NEWS = "SELECT user_id AS link, date_trunc('second', ts) AS seen FROM events WHERE event_type <> 'error'"
_NEWS_MODES = (
    ("range", "seen BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:59:59'", ""), ("months", "seen BETWEEN TIMESTAMP '2023-12-31 12:00:00' AND TIMESTAMP '2024-01-31 12:00:00'", ""),
    ("days", "seen BETWEEN TIMESTAMP '2024-01-24 12:00:00' AND TIMESTAMP '2024-01-31 12:00:00'", ""), ("latest", "true", ""), ("cut", "true", "LIMIT 5"), ("none", "true", "LIMIT 0"))


@query("a9_news_modes", " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, link, strftime(seen, '%Y-%m-%d %H:%M:%S') AS published_at FROM (SELECT link, max(seen) AS seen FROM ({_NEWS}) WHERE {window} GROUP BY 1 ORDER BY seen DESC, link {limit})" for mode, window, limit in _NEWS_MODES))
def a9_modes(v):
    items = v.raw("events").filter(F.col("event_type") != "error").select(F.col("user_id").alias("link"), F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("pubDate"))
    as_of = datetime(2024, 1, 31, 12)
    modes = {"range": {"start_date": "2024-01-05", "end_date": "2024-01-20", "max_items": -1}, "months": {"months": 1, "max_items": -1}, "days": {"days": 7, "max_items": -1},
             "latest": {"months": 0, "max_items": -1}, "cut": {"max_items": 5}, "none": {"max_items": 0}}
    out = None
    for mode, how in modes.items():
        part = feeds.news_articles(items, items, as_of, **how).select(F.lit(mode).alias("mode"), "link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a11_conform_statistics", with_views("holdings", """SELECT company_id AS code, strftime(DATE '2024-03-01' + CAST(rank % 3 AS INT), '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY rank % 3 ORDER BY CAST(company_id AS BIGINT)) AS rank, 'southbound' AS market FROM holdings"""))
def a11(v):
    rows = v.holdings().select(
        F.col("company_id").cast("bigint").alias("code"), F.col("company_name").alias("name"), F.expr("date_add(date'2024-03-01', cast(rank % 3 as int))").alias("date"), F.lit(1.0).alias("close"), F.col("price_change_pct").alias("change"),
        "shares", F.col("holding_value").alias("value"), F.col("holding_float_ratio_pct").alias("issued_pct"), F.col("increase_value").alias("value_change_1d"))
    return feeds.conform_statistics(rows, [F.asc("code")]).select("code", "date", "rank", "market")


@query("a16_incremental_scan", "SELECT o_orderkey, strftime(o_orderdate, 'run-%Y%m%d') AS run_id FROM orders WHERE strftime(o_orderdate, 'run-%Y%m%d') >= 'run-19970601'")
def a16(v):
    rows = v.raw("orders").withColumn("run_id", F.date_format("o_orderdate", "'run-'yyyyMMdd"))
    return sync.since(rows, "run-19970601").select("o_orderkey", "run_id")


@query("a12_seed_rows", "SELECT c_custkey, c_name AS name, lower(c_mktsegment) AS segment FROM customer")
def a12(v):
    seeds = v.raw("customer").select("c_custkey", F.to_json(F.array(F.struct(F.col("c_name").alias("name"), F.array(F.lower("c_mktsegment")).alias("segments")))).alias("j"))
    parsed = seeds.select("c_custkey", F.inline(F.from_json("j", "array<struct<name: string, segments: array<string>>>")))
    return parsed.select("c_custkey", "name", F.get("segments", 0).alias("segment"))


@query("a15_announcements", """SELECT event_id AS announcement_id, strftime(TIMESTAMP '1970-01-01' + to_milliseconds(1700000000000 + event_id * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS published FROM events ORDER BY event_id DESC LIMIT 100""")
def a15(v):
    from intelspark.functions.times import epoch_ms_text

    rows = v.raw("events").select("event_id", (F.lit(1700000000000) + F.col("event_id") * 1000).alias("announcementTime"))
    top = rows.orderBy(F.desc("announcementTime"), F.desc("event_id")).limit(100)
    return top.select(F.col("event_id").alias("announcement_id"), epoch_ms_text("announcementTime").alias("published"))


@query("c14_announcement_rows", """SELECT event_id, CAST(user_id AS VARCHAR) AS company_id, 'risk' AS signal_type, 'Test notice ' || event_id AS headline FROM events""")
def c14(v):
    from intelspark.operators.classify import announcement_type

    title = F.concat(F.lit("Test notice "), F.col("event_id").cast("string"))
    return v.raw("events").select("event_id", F.col("user_id").cast("string").alias("company_id"), announcement_type(F.lit(None).cast("string"), title).alias("signal_type"), F.left(title, F.lit(240)).alias("headline"))


@query("c20_document_facts", "SELECT doc_id, sha256(text) AS record_key FROM documents")
def c20(v):
    return v.raw("documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("record_key"))


@query("a13_html_table_rows", """SELECT page_id, CAST(1 AS INT) AS row_index, 'Name=Page|col_1=' || page_id AS cells FROM pages""")
def a13(v):
    from intelspark.operators.parsing import html_table_rows

    table = F.concat(F.lit("<table><tr><th>Name</th><th></th></tr><tr><td> </td><td></td></tr><tr><td>Page</td><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table>"))
    out = html_table_rows(v.raw("pages").withColumn("html", F.concat("html", table)), "html", ["page_id"])
    return out.select("page_id", "row_index", F.array_join(F.transform("cells", lambda c: F.concat(c["name"], F.lit("="), c["value"])), "|").alias("cells"))


# ------------------------------------------------------------------ streaming


@query("n2_stream_without_repeats", "SELECT event_id, event_type FROM events")
def n2(v):
    """Events as a file stream into a table, delivered twice; the second run adds nothing."""
    import uuid

    from intelspark.session import shared_folder
    from intelspark.streaming import ingest

    spark = v.spark
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    empty = v.raw("events").select("event_id", "event_type").limit(0)
    for delivery in ("first", "second"):
        rows = ingest.landed_stream(spark, f"{v.sf_dir}/events*.parquet", v.raw("events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
        once = ingest.without_repeats(rows, ["event_id"], "ts", "3650 days").select("event_id", "event_type")
        writer = ingest.idempotent_append(f"{place}/table", ["event_id"], empty)
        ingest.start_ingestion(once, writer, f"{place}/checkpoint-{delivery}").awaitTermination()
    return latest_by(spark.read.parquet(f"{place}/table"), "event_id", F.asc("event_type"))


@query("n1_scheduled_batches", """WITH f AS (SELECT 'facts' AS "table", CAST(ts AS DATE) AS d, event_id, user_id, value FROM events)
SELECT "table", strftime(d, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY 1, 2
UNION ALL SELECT 'signals', strftime(d, '%Y-%m-%d'), count(*), CAST(sum(event_id) AS BIGINT) FROM f WHERE value IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'users', 'all', count(*), CAST(sum(e) AS BIGINT) FROM (SELECT user_id, max(event_id) AS e FROM events GROUP BY 1)""")
def n1(v):
    """Landed events as a stream into three tables of one commit per batch, delivered twice; the second delivery adds nothing."""
    import uuid

    from intelspark.session import shared_folder
    from intelspark.sinks.versions import VersionedTable, VersionedTables
    from intelspark.streaming import ingest

    spark, events = v.spark, v.raw("events")
    place = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    fields = events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value").schema
    store = VersionedTables(
        spark, place, VersionedTable("facts", fields, ("event_id", "event_type"), "ts"), VersionedTable("signals", fields, ("event_id",), "ts"),
        VersionedTable("users", events.select("user_id", "event_id").schema, ("user_id",), update=True, order="event_id"))

    def split(batch):
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        return {"facts": rows, "signals": rows.filter(F.col("value").isNotNull()), "users": rows}

    for delivery in ("first", "second"):
        rows = ingest.landed_stream(spark, f"{v.sf_dir}/events*.parquet", events.schema)
        ingest.start_ingestion(rows, store.writer(delivery, split), f"{place}/checkpoint-{delivery}").awaitTermination()
    days = F.date_format("ts", "yyyy-MM-dd")
    out = None
    for name in ("facts", "signals", "users"):
        part = store.read(name).groupBy(F.lit(name).alias("table"), (F.lit("all") if name == "users" else days).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ landed files, read by the feed readers


def _landed(v, lines, each: bool = False) -> str:
    """A new folder of text files with the given lines; ``each`` makes every line a file of its own."""
    import uuid

    from intelspark.session import shared_folder

    path = f"{shared_folder(v.spark)}/landed-{uuid.uuid4().hex}"
    (lines.write.option("maxRecordsPerFile", 1) if each else lines.write).text(path)
    return path


@query("a2_concatenated_news", "SELECT event_type || ' ' || event_id AS title, 'https://x.example/' || event_id AS url, '2024-01-01' AS published, event_type AS kind FROM events")
def a2(v):
    item = F.struct(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"), F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string")).alias("url"),
                    F.lit("2024-01-01").alias("publishDate"), F.col("event_type").alias("newsContentType"))
    # Three shapes, one value after another; every third item comes twice.
    k = F.col("event_id") % 3
    listed = F.when(k == 0, F.to_json(F.struct(F.array(item, item).alias("results")))).when(k == 1, F.to_json(F.struct(F.struct(F.array(item).alias("results")).alias("data")))).otherwise(F.to_json(item))
    path = _landed(v, v.raw("events").select(listed.alias("value")).repartition(4))
    return feeds.concatenated_news(v.spark, path).select("title", "url", "published", "kind")


@query("a4_statistics_table", "SELECT n_name AS table_title, s_suppkey AS key, s_acctbal AS figure FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def a4(v):
    rows = v.raw("supplier").join(v.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    tables = rows.groupBy("n_name").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("figure"))).alias("dataSet"))
    path = _landed(v, tables.select(F.to_json(F.struct(F.struct(F.col("n_name").alias("title")).alias("header"), "dataSet")).alias("value")), each=True)
    return feeds.statistics_table(v.spark, path, "struct<key: bigint, figure: double>")


@query("a7_rss_items", "SELECT 'Item ' || event_id || ' & more' AS title, 'https://x.example/' || event_id AS link, event_type AS description, true AS dated FROM events")
def a7(v):
    n = F.col("event_id").cast("string")
    item = F.concat(F.lit("<item><title> Item "), n, F.lit(" &amp; more</title><link>https://x.example/"), n, F.lit("</link><pubDate>"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"),
                    F.lit(" +0800</pubDate><description><![CDATA["), F.col("event_type"), F.lit("]]></description></item>"))
    # Five hundred items a file.
    files = v.raw("events").groupBy(F.floor(F.col("event_id") / 500).alias("file")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    path = _landed(v, files.select(F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")), each=True)
    return feeds.rss_items(v.spark, path).select("title", "link", "description", F.col("published_at").isNotNull().alias("dated"))


@query("a12_seed_directory", "SELECT c_name AS name, lower(c_mktsegment) AS segment FROM customer")
def a12_files(v):
    seeds = v.raw("customer").groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_name").alias("name"), F.array(F.lower("c_mktsegment")).alias("segments"))).alias("s"))
    path = _landed(v, seeds.select(F.to_json("s").alias("value")), each=True)
    return feeds.seed_directory(v.spark, path, "name string, segments array<string>").select("name", F.get("segments", 0).alias("segment"))


@query("a15_announcement_cap", "SELECT 'a' || c_custkey AS announcement_id, c_name AS sec_name, 1700000000000 + c_custkey * 1000 AS at FROM customer ORDER BY c_custkey DESC LIMIT 40")
def a15_files(v):
    row = F.struct(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("announcementId"), F.col("c_name").alias("secName"), (F.lit(1700000000000) + F.col("c_custkey") * 1000).alias("announcementTime"))
    landed = v.raw("customer").groupBy("c_nationkey").agg(F.collect_list(row).alias("announcements"))
    path = _landed(v, landed.select(F.to_json(F.struct("announcements")).alias("value")), each=True)
    return feeds.announcements(v.spark, path, 40).select(F.col("announcementId").alias("announcement_id"), F.col("secName").alias("sec_name"), F.col("announcementTime").alias("at"))


@query("b13_exported_json", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def b13(v):
    import uuid

    from intelspark.session import shared_folder

    rows = v.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = f"{shared_folder(v.spark)}/export-{uuid.uuid4().hex}"
    merge.export_json(rows, path)
    return v.spark.read.schema(rows.schema).json(path)


@query("c20_landed_documents", "SELECT sha256(text || chr(10)) AS record_key, 'document' AS record_type, strlen(text) + 1 AS length FROM benchmark")
def c20_files(v):
    path = _landed(v, v.raw("benchmark").select(F.col("text").alias("value")), each=True)
    return feeds.document_facts(v.spark, path, "landed", "benchmark").select("record_key", "record_type", "length")
