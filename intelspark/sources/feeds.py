"""Landed feeds as DataFrames: JSON, XML, HTML, CSV and text files to typed rows.

Every reader works on files already landed in shared storage. Structured formats use Spark's own
sources; only concatenated JSON and unknown encodings take an Arrow-batched Python step per file.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import datetime, timedelta
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intelspark.functions.links import absolute_url
from intelspark.functions.numbers import code_text, to_number, to_percent
from intelspark.functions.rows import spread_array
from intelspark.functions.text import blank_to_null, clean, contains_any, strip
from intelspark.functions.times import matches_year_month, period_of, publication_time
from intelspark.operators.positions import number_within
from intelspark.operators.serving import latest_by

# ------------------------------------------------------------------ JSON feeds


def paged_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of ``result.records`` over all landed pages; give the record DDL to avoid inference."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(f"result struct<records: array<{schema}>>")
    return reader.json(path).select(F.explode("result.records").alias("r")).select("r.*")


def records_of(pages: DataFrame, page: str, record_ddl: str) -> DataFrame:
    """The same rows when the pages are already a text column."""
    parsed = F.from_json(page, f"struct<result: struct<records: array<{record_ddl}>>>")
    return pages.select(F.explode(parsed["result"]["records"]).alias("r")).select("r.*")


def statistics_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of ``dataSet`` with the table title."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(f"header struct<title: string>, dataSet array<{schema}>")
    return reader.json(path).select(F.col("header.title").alias("table_title"), F.explode("dataSet").alias("r")).select("table_title", "r.*")


def seed_directory(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Seed companies: a JSON array of objects; anything else in the array is dropped."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def announcements(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Announcement rows, newest first when a record cap is asked for."""
    fields = ("announcementId string, secCode string, secName string, announcementTitle string, announcementType string, "
              "announcementTime bigint, adjunctUrl string")
    struct = ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))
    rows = spark.read.option("multiLine", True).schema(f"announcements array<struct<{struct}>>").json(path)
    rows = rows.select(F.explode("announcements").alias("r")).select("r.*")
    return rows.orderBy(F.desc("announcementTime"), F.desc("announcementId")).limit(limit) if limit else rows


# Where a news payload keeps its items, in order of preference.
NEWS_LISTS = ("results", "data", "items", "news")


def _news_items(blob: str) -> tuple[list[dict], bool]:
    """Objects of the JSON values that stand one after another in ``blob``, up to the first that is broken, and whether none is."""
    decode, found, end, whole = json.JSONDecoder().raw_decode, [], 0, True
    while start := re.compile(r"\S").search(blob, end):
        try:
            value, end = decode(blob, start.start())
        except ValueError:
            whole = False
            break
        named = value if isinstance(value, dict) else {}
        boxes = [value, *(named.get(name) for name in NEWS_LISTS)]
        lists = [x for x in (box.get("results") if box is not value and isinstance(box, dict) else box for box in boxes) if isinstance(x, list)]
        found += lists[0] if lists else [named] if named.keys() & {"title", "url"} else []
    return [item for item in found if isinstance(item, dict)], whole


_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)')


def _depth_change(line: str) -> int:
    """Brackets a line opens and does not close. JSON strings hold no line break, so a line starts outside of them."""
    bare = _STRING.sub("", line)
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def concatenated_news(spark: SparkSession, path: str) -> DataFrame:
    """News items of text files holding several JSON values in a row; repeats keep the first.

    The lines of a file pass through one task in order, which holds only those of the values it is in: values are decoded as soon
    as their brackets are closed. Nothing behind a broken value of a file is read.
    """
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    ordered = lines.repartition("file").sortWithinPartitions("file", "block", "line").select("file", "value")

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "pos", "title", "url", "published", "description", "kind"]
        file, held, depth, pos, whole = None, [], 0, 0, True

        def closed() -> list[tuple]:
            nonlocal held, depth, pos, whole
            found, whole = _news_items("\n".join(held))
            rows = []
            for item in found:
                text = lambda *keys: next((str(item[k]).strip() for k in keys if item.get(k)), "")  # noqa: B023, E731
                rows.append((file, pos, text("title"), text("url"), text("publishDate", "date"), text("description"), text("newsContentType")))
                pos += 1
            held, depth = [], 0
            return rows

        for batch in batches:
            rows = []
            for name, line in zip(batch["file"], batch["value"]):
                if name != file:
                    rows += closed()
                    file, pos, whole = name, 0, True
                if whole:
                    held.append(line)
                    depth += _depth_change(line)
                    if depth <= 0:
                        rows += closed()
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(closed(), columns=columns)

    out = ordered.mapInPandas(items, "file string, pos int, title string, url string, published string, description string, kind string")
    return latest_by(out, ["title", "url", "published"], F.asc("file"), F.asc("pos"))


SDMX_SCHEMA = (
    "struct<data: struct<datasets: array<struct<structure: int, series: map<string, struct<observations: map<string, array<string>>>>>>, "
    "structures: array<struct<dimensions: struct<observation: array<struct<id: string, role: string, values: array<struct<id: string, value: string>>>>>, "
    "attributes: struct<observation: array<struct<id: string, values: array<struct<id: string, name: string>>>>>>>>>"
)


def time_series(payloads: DataFrame, payload: str, keep: list[str], dataset: int = 0, series: int = 0) -> DataFrame:
    """Observations of one series of each SDMX message, in numeric key order, with period and unit."""
    parsed = payloads.select(*keep, F.from_json(payload, SDMX_SCHEMA).alias("m"))
    picked = parsed.select(*keep, F.get("m.data.datasets", dataset).alias("d"), F.col("m.data.structures").alias("ss"))
    picked = picked.withColumn("s", F.expr("get(ss, coalesce(d.structure, 0))"))
    periods = F.expr("transform(get(filter(s.dimensions.observation, x -> x.id = 'TIME_PERIOD' OR x.role = 'time'), 0).values, v -> coalesce(v.value, v.id))")
    attribute = lambda name: F.expr(f"get(get(filter(s.attributes.observation, x -> x.id = '{name}'), 0).values, 0)")
    number = "coalesce(try_cast(x.key AS int), 0)"
    keys = F.expr("transform(array_sort(transform(map_keys(d.series), k -> named_struct('o', transform(split(k, '[.]'), p -> coalesce(try_cast(p AS int), 0)), 'k', k))), x -> x.k)")
    chosen = picked.select(*keep, periods.alias("periods"), attribute("UNIT").alias("u"), attribute("UNIT_MULT").alias("um"), F.col("d.series").alias("all"), F.get(keys, series).alias("k"))
    obs = chosen.withColumn("o", F.expr(f"array_sort(transform(map_entries(try_element_at(all, k).observations), x -> named_struct('n', {number}, 'v', get(x.value, 0))))"))
    out = obs.select(*keep, "periods", "u", "um", F.posexplode("o").alias("observation_index", "x"))
    return out.select(
        *keep, F.get("periods", F.col("observation_index")).alias("time_period"), "observation_index", F.coalesce("x.v", F.lit("")).alias("value"),
        F.col("x.v").try_cast("double").alias("value_num"), F.coalesce("u.name", "u.id").alias("unit"), F.col("um.id").try_cast("int").alias("unit_multiplier_pow10"))


# ------------------------------------------------------------------ HTML feeds


def inner_text(html: Column) -> Column:
    """Visible text of an HTML fragment: tags out, entities and blanks cleaned."""
    # Bound to a name, as clean looks at its text more than once.
    return F.get(F.transform(F.array(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), lambda t: clean(t)), 0)


def listing_rows(pages: DataFrame, html: str, keep: list[str], base: str) -> DataFrame:
    """Rows of a listing table: date, code, name and link; a row needs four cells and a link."""
    rows = spread_array(pages, keep, F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), "row", "pos")
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    rows = rows.withColumn("c", cells).filter(F.size("c") >= 4)
    link = F.get("c", 3)
    href = F.regexp_extract(link, r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)
    title = inner_text(F.regexp_extract(link, r"(?is)<a\b[^>]*>(.*?)</a>", 1))
    out = rows.filter(link.rlike(r"(?i)<a\b[^>]*\bhref")).select(
        *keep, "pos", inner_text(F.get("c", 0)).alias("publish_date"), inner_text(F.get("c", 1)).alias("stock_code"),
        inner_text(F.get("c", 2)).alias("company_name"), title.alias("title"), absolute_url(href, base).alias("detail_url"))
    return latest_by(out, [*keep, "publish_date", "stock_code", "detail_url"], F.asc("pos"))


def first_pdf(html: Column | str, base: str) -> Column:
    """First PDF reference of a page: links ending in .pdf, links holding it, frames, then plain text."""
    source = F.col(html) if isinstance(html, str) else html
    attribute = lambda tag, name, value: blank_to_null(F.regexp_extract(
        source, rf"""(?is)<{tag}\b[^>]*\b{name}\s*=\s*["']({value})["']""", 1))
    ordered = [
        attribute("a", "href", r"[^\"']*\.pdf"), attribute("a", "href", r"[^\"']*\.pdf[^\"']*"), attribute("iframe", "src", r"[^\"']*\.pdf[^\"']*"),
        attribute("embed", "src", r"[^\"']*\.pdf[^\"']*"), attribute("object", "data", r"[^\"']*\.pdf[^\"']*"),
        blank_to_null(F.regexp_extract(source, r"""(?i)(https?://[^\s'"]+\.pdf(?:\?[^\s'"]*)?)""", 1)),
        blank_to_null(F.regexp_extract(source, r"""(?i)["'](/[^'"]+\.pdf(?:\?[^'"]*)?)["']""", 1)),
    ]
    return blank_to_null(absolute_url(F.coalesce(*ordered), base))


def links_of(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Every link of a page with its text and position."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)(<a\b[^>]*\bhref\s*=\s*["'][^"']*["'][^>]*>.*?</a>)"""), F.lit(1))
    rows = spread_array(pages, keep, found, "a", "pos")
    return rows.select(*keep, "pos", F.regexp_extract("a", r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1).alias("href"), inner_text(F.col("a")).alias("text"))


def harvest_links(pages: DataFrame, html: str, keep: list[str], base: str, marker: str, years: list[str], limit: int | None = None) -> DataFrame:
    """Links with the marker whose text names a wanted year, absolute, first per address."""
    rows = links_of(pages, html, keep).filter(F.col("href").contains(marker))
    if years:
        rows = rows.filter(contains_any("text", years))
    rows = latest_by(rows.withColumn("url", absolute_url(F.col("href"), base)), "url", *[F.asc(k) for k in keep], F.asc("pos"))
    return rows.orderBy(*keep, "pos").limit(limit) if limit else rows


# ------------------------------------------------------------------ XML, CSV and text


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files."""
    schema = "title string, link string, pubDate string, description string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select(*[strip(c).alias(c) for c in ("title", "link", "pubDate", "description")], publication_time("pubDate").alias("published_at"))


def archive_window(items: DataFrame, start, end, date: str = "pubDate", link: str = "link") -> DataFrame:
    """Archive items inside a closed window, unreadable dates out, one per link, newest first."""
    dated = items.withColumn("published_at", publication_time(date)).filter(F.col("published_at").between(F.lit(start), F.lit(end)))
    return latest_by(dated, link, F.desc("published_at"), F.asc("title")).orderBy(F.desc("published_at"), F.asc(link))


def news_articles(archive: DataFrame, latest: DataFrame, as_of: datetime, months: int | None = None, days: int | None = None, start_date: str | None = None,
                  end_date: str | None = None, max_items: int = 1000, date: str = "pubDate", link: str = "link") -> DataFrame:
    """News of one window, newest first: an explicit range of days, the last months, the last days, or the latest feed.

    A range covers its last day up to 23:59:59 and excludes ``months`` and ``days``. Months are counted back from ``as_of`` with
    the day clamped to the month's end; none of them, or 0 months, reads ``latest`` instead of ``archive``. Each mode is one
    bounded predicate on the archive. ``max_items`` 0 gives nothing, a negative one everything.
    """
    given = [(d or "").strip() for d in (start_date, end_date)]
    if any(given):
        if not all(given):
            raise ValueError("start_date and end_date must be given together")
        if months is not None or days is not None:
            raise ValueError("a range of dates excludes months and days")
        try:
            start, end = (datetime.strptime(d, "%Y-%m-%d") for d in given)
        except ValueError:
            raise ValueError("start_date and end_date must be written YYYY-MM-DD") from None
        end += timedelta(days=1) - timedelta(seconds=1)
    elif months is not None:
        if months < 0:
            raise ValueError("months must not be negative")
        year, month = divmod(as_of.year * 12 + as_of.month - 1 - months, 12)
        start, end = as_of.replace(year=year, month=month + 1, day=min(as_of.day, monthrange(year, month + 1)[1])), as_of
    elif days is not None:
        if days <= 0:
            raise ValueError("days must be positive")
        start, end = as_of - timedelta(days=days), as_of
    if any(given) or months or days is not None:
        rows = archive_window(archive, start, end, date, link)
    else:
        dated = latest.withColumn("published_at", publication_time(date))
        rows = latest_by(dated, link, F.desc_nulls_last("published_at"), F.asc("title")).orderBy(F.desc_nulls_last("published_at"), F.asc(link))
    return rows if max_items < 0 else rows.limit(max_items)


def market_of_file(name: Column) -> Column:
    return (
        F.when(name.contains("北向"), "northbound").when(name.contains("沪股通"), "shanghai_connect")
        .when(name.contains("深股通"), "shenzhen_connect").when(name.contains("港股通"), "southbound")
        .otherwise(F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))))


# Chinese headers of the holdings files.
HOLDINGS_HEADERS = {
    "序号": "rank", "代码": "code", "名称": "name", "日期": "date", "所属板块": "sector", "今日收盘价": "close_price", "今日涨跌幅": "price_change_pct",
    "今日持股-股数": "holding_shares", "今日持股-市值": "holding_value", "今日持股-占流通股比": "holding_float_ratio_pct",
    "今日持股-占总股本比": "holding_total_ratio_pct", "今日增持估计-股数": "increase_shares", "今日增持估计-市值": "increase_value",
    "今日增持估计-市值增幅": "increase_value_pct", "今日增持估计-占流通股比": "increase_float_ratio_pct", "今日增持估计-占总股本比": "increase_total_ratio_pct",
}
PERCENT_FIELDS = [name for name in HOLDINGS_HEADERS.values() if name.endswith("_pct")]
NUMBER_FIELDS = ["close_price", "holding_shares", "holding_value", "increase_shares", "increase_value"]


def holdings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Holdings files with renamed headers, the market taken from the file name."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.select(
        *[F.col(f"`{c}`").alias(HOLDINGS_HEADERS.get(c.lstrip("﻿").strip(), c)) for c in raw.columns],
        F.col("_metadata.file_name").alias("source_file"))
    return named.withColumn("market", market_of_file(F.try_url_decode("source_file")))


def holdings_rows(raw: DataFrame, numbers_in=NUMBER_FIELDS, percents_in=PERCENT_FIELDS) -> DataFrame:
    """Holdings text columns to typed measures."""
    typed = {**{c: to_number(c) for c in numbers_in}, **{c: to_percent(c) for c in percents_in}}
    return raw.withColumns({
        **typed, "rank": F.coalesce(to_number("rank"), F.lit(0.0)).cast("int"), "company_id": code_text("code"), "company_name": strip("name"), "event_time": period_of("date")})


def conform_statistics(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Alternate holdings layout to the common one; ranks count within each day."""
    ranked = number_within(rows, ["date"], order)
    return ranked.select(
        "rank", F.col("code").cast("string").alias("code"), "name", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("close").alias("close_price"), F.col("change").alias("price_change_pct"), F.col("shares").alias("holding_shares"),
        F.col("value").alias("holding_value"), F.col("issued_pct").alias("holding_float_ratio_pct"), F.col("value_change_1d").alias("increase_value"),
        F.lit("southbound").alias("market"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Text of files in unknown encodings; the first that decodes wins."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(raw: bytes) -> str:
            for encoding in ("utf-8", "utf-8-sig", "gb18030", "big5", "latin-1"):
                try:
                    return raw.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return raw.decode("utf-8", errors="ignore")

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": batch["content"].map(one)})

    return files.mapInPandas(decode, "path string, text string").withColumn("text", clean("text"))


def csv_text(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """CSV texts to a header and body rows; blank rows and a purely positional first row drop out."""
    line = F.transform(F.split(clean(text), "\n"), lambda x: F.transform(
        F.regexp_extract_all(x, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)),
        lambda c: strip(F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))))
    body = F.filter(line, lambda cells: F.exists(cells, lambda c: c != ""))
    out = rows.select(*keep, body.alias("r"))
    numeric = lambda cells: (F.size(F.filter(cells, lambda c: c != "")) >= 2) & F.forall(F.filter(cells, lambda c: c != ""), lambda c: c.rlike(r"^\d+$"))
    first, second = F.get("r", 0), F.get("r", 1)
    skip = F.coalesce((F.size("r") >= 2) & numeric(first) & ~numeric(second), F.lit(False))
    start = F.when(skip, 1).otherwise(0)
    return out.filter(F.size("r") > 0).select(
        *keep, F.get("r", start).alias("headers"), F.expr("slice(r, 2, greatest(size(r), 1))").alias("tail"), skip.alias("s")).select(
        *keep, "headers", F.when(F.col("s"), F.expr("slice(tail, 2, greatest(size(tail), 1))")).otherwise(F.col("tail")).alias("rows"))


# ------------------------------------------------------------------ feed projections


def statistics_signals(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Statistical rows with a period; the special value stands in for a missing figure."""
    dated = rows.withColumn("event_time", period_of("period")).filter(F.col("event_time").isNotNull())
    return dated.select(*keep, "event_time", F.coalesce(F.col("figure").cast("double"), to_number("sd_value")).alias("value_num"))


def listing_facts(rows: DataFrame, year: str | None = None, month: str | None = None, limit: int | None = None, order=()) -> DataFrame:
    """Annual-report listings of a year or month as market signals, capped when a cap is given."""
    out = rows.filter(matches_year_month("event_time", year, month)).withColumn("signal_type", F.lit("market"))
    return out.orderBy(*order).limit(limit) if limit else out


def document_facts(spark: SparkSession, path: str, source: str, dataset: str) -> DataFrame:
    """One fact per landed file, keyed by the hash of its bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), F.sha2("content", 256).alias("record_key"),
        F.element_at(F.split("path", "/"), -1).alias("title"), "length", F.lit("document").alias("record_type"))
