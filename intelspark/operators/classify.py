"""Feed rows to facts, signals and timeline events: classification and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions.links import natural_key
from intelspark.functions.numbers import infer_unit, to_number
from intelspark.functions.text import blank_to_null, contains_any, first_group, parse_indicator, squash, strip, title_case
from intelspark.functions.times import record_time


def _joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def signal_type(indicator: Column, dataset: Column) -> Column:
    """Type of a metric signal from its dataset and indicator; the first group that fits wins."""
    return first_group(_joined(dataset, indicator), rules.SIGNAL_TYPE_GROUPS, "market")


def news_type(kind: Column, text: Column) -> Column:
    return first_group(_joined(kind, text), rules.NEWS_TYPE_GROUPS, "market")


def announcement_type(kind: Column, title: Column) -> Column:
    """Announcements; the risk token ``st`` is a plain substring, so it also fires inside words."""
    return first_group(_joined(kind, title), rules.ANNOUNCEMENT_TYPE_GROUPS, "market")


def policy_type(title: Column, description: Column, matched: Column) -> Column:
    text = _joined(title, description)
    border = matched & contains_any(text, rules.POLICY_CROSS_BORDER_TOKENS)
    return F.when(border, "cross_border").otherwise(first_group(text, rules.POLICY_TYPE_GROUPS, "market"))


def record_type(source: Column, dataset: Column) -> Column:
    name = F.lower(dataset)
    return (
        F.when(name.rlike("pdf|csv") | (source == "kpmg"), "document")
        .when(name.rlike("press_release|detail_page"), "event")
        .otherwise("metric")
    )


def timeline_of(facts: DataFrame, event_type: Column) -> DataFrame:
    """Facts as timeline events; an untitled fact is named after its source and dataset."""
    title = F.coalesce(blank_to_null(F.col("title")), F.concat_ws(" ", "source", "dataset"))
    return facts.select(
        "source", "company_id", "entity", "event_time",
        event_type.alias("event_type"),
        F.left(title, F.lit(240)).alias("headline"),
        F.col("summary").alias("detail"),
        F.to_json(F.struct("source", "dataset", "record_key")).alias("payload"),
    )


def metric_signals(records: DataFrame, dataset: Column, event_time: Column, fields: Column, keep: list[str]) -> DataFrame:
    """Wide to long: every non-date field that reads as a number becomes a signal.

    ``fields`` is a map of name to text, so rows of any width go through one explode.
    """
    numeric = F.map_filter(fields, lambda k, v: ~k.isin(*rules.NON_METRIC_FIELDS))
    long = records.select(*keep, dataset.alias("dataset"), event_time.alias("event_time"), F.explode(numeric).alias("indicator", "raw"))
    long = long.withColumns({"value_text": strip("raw")}).withColumn("value_num", to_number("value_text"))
    return long.filter(F.col("value_num").isNotNull() & F.col("event_time").isNotNull()).select(
        *keep, "dataset", "event_time", "indicator", "value_num", "value_text",
        F.concat_ws("|", "dataset", "event_time", "indicator", "value_text").alias("signal_key"),
        signal_type(F.col("indicator"), F.col("dataset")).alias("signal_type"),
        infer_unit("indicator", "value_text").alias("unit"),
        F.concat_ws(": ", "indicator", "value_text").alias("signal_text"),
    )


def macro_facts(records: DataFrame, dataset: Column, position: Column, fields: Column, keep: list[str]) -> DataFrame:
    """Macro feed rows to facts: press releases are events, everything else a metric."""
    get = lambda name: blank_to_null(strip(F.try_element_at(fields, F.lit(name))))
    known = {name: F.try_element_at(fields, F.lit(name)) for name in rules.NATURAL_KEY_FIELDS}
    title = F.coalesce(get("subject"), get("title"))
    return records.select(
        *keep,
        dataset.alias("dataset"),
        natural_key(dataset, known, F.concat(F.lit("idx-"), position.cast("string"))).alias("record_key"),
        F.when(dataset.startswith("press_releases"), "event").otherwise("metric").alias("record_type"),
        record_time(fields).alias("event_time"),
        title.alias("title"),
        F.coalesce(get("summary"), title).alias("summary"),
    )


def series_facts(observations: DataFrame, series: list[str]) -> DataFrame:
    """One summary fact per observed series: row count and covered period."""
    return observations.groupBy(*series).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count("value_num").alias("numeric_count"),
        F.min("time_period").alias("first_period"),
        F.max("time_period").alias("last_period"),
    )


def series_signals(observations: DataFrame, series: list[str], dataset: Column) -> DataFrame:
    """One signal per observation with a period."""
    return observations.filter(F.col("time_period") != "").select(
        *series,
        dataset.alias("dataset"),
        F.col("time_period").alias("event_time"),
        "value_num",
        F.concat_ws("|", *series, "time_period").alias("signal_key"),
        signal_type(F.lit(None).cast("string"), dataset).alias("signal_type"),
    )


def news_rows(items: DataFrame, kind: Column, title: Column, body: Column, keep: list[str]) -> DataFrame:
    """News items to a fact plus its headline signal on one row."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    return items.select(
        *keep,
        title.alias("title"),
        F.coalesce(blank_to_null(strip(body)), title).alias("summary"),
        news_type(kind, text).alias("signal_type"),
        F.left(title, F.lit(240)).alias("headline"),
    )


def keyword_filter(articles: DataFrame, title: str, description: str, language: str = "en",
                   keywords=None, geo=None, business=None, require_both: bool = True) -> DataFrame:
    """Articles with a keyword and, when required, also a place and a business word."""
    text = F.lower(F.concat(strip(title), F.lit("\n"), strip(description)))
    test = contains_any(text, keywords or rules.GBA_KEYWORDS[language])
    if require_both:
        test = test & contains_any(text, geo or rules.GBA_GEO_KEYWORDS[language])
        test = test & contains_any(text, business or rules.GBA_BUSINESS_KEYWORDS[language])
    return articles.filter(test)


def membership_flag(rows: DataFrame, chosen: DataFrame, key: str, flag: str) -> DataFrame:
    """Boolean column: is the row's key in the chosen set."""
    keys = chosen.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def holding_signals(rows: DataFrame, top_rank: int = 20, min_increase: float = 0.0, min_ratio: float = 5.0) -> DataFrame:
    """Up to six signals per holdings row, in rule order."""
    name, rank = F.col("company_name"), F.coalesce("rank", F.lit(0))
    inflow, ratio = F.col("increase_value"), F.col("holding_float_ratio_pct")
    change, more, value = F.col("price_change_pct"), F.col("increase_float_ratio_pct"), F.col("holding_value")

    def two(x: Column) -> Column:
        return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))

    def made(test: Column, kind: str, indicator: str, number: Column, unit: str, *text) -> Column:
        parts = [t if isinstance(t, Column) else F.lit(t) for t in text]
        return F.when(test, F.struct(
            F.lit(kind).alias("signal_type"), F.lit(indicator).alias("indicator"), number.cast("double").alias("value_num"),
            F.lit(unit).alias("unit"), F.concat(*parts).alias("signal_text")))

    candidates = F.array(
        made((rank > 0) & (rank <= top_rank), "market_attention", "ranking", rank, f"top_{top_rank}",
             name, " ranks ", rank.cast("string"), " in ", F.col("market"), " holdings."),
        made(inflow > min_increase, "growth", "estimated_increase_value", inflow, "currency",
             name, " saw estimated connect-flow increase of ", two(inflow), "."),
        made(ratio > min_ratio, "market", "holding_float_ratio_pct", ratio, "percent",
             name, " has ", two(ratio), "% connect holding over float shares."),
        made((change > 0) & (inflow > min_increase), "growth", "price_and_flow_resonance", change, "percent",
             name, " rose ", two(change), "% with simultaneous connect inflow."),
        made(more > 0, "market_attention", "increase_float_ratio_pct", more, "percent",
             name, " increased connect holding by ", two(more), "% of float shares."),
        made((value > 0) & (F.col("sector") != ""), "market", "sector_capital_presence", value, "currency",
             name, " shows material connect capital presence in sector ", F.col("sector"), "."),
    )
    return rows.select("company_id", "company_name", F.explode(F.array_compact(candidates)).alias("s")).select(
        "company_id", "company_name", "s.*")


def ui_group(kind: Column) -> Column:
    """Four display groups of signal types."""
    name = squash(kind)
    return (
        F.when(name.isin("financing", "funding"), "funding")
        .when(name.isin("policy", "macro"), "policy")
        .when(name == "crossborder", "crossborder")
        .otherwise("expansion")
    )


def type_label(kind: Column) -> Column:
    name = F.translate(F.lower(F.coalesce(blank_to_null(kind), F.lit("signal"))), "_-", "  ")
    return (
        F.when(name.contains("cross"), "Cross-border")
        .when(name.rlike("fund|financ"), "Financing")
        .when(name.rlike("policy|macro"), "Policy/Macro")
        .when(name.contains("expansion"), "Expansion")
        .otherwise(F.initcap(name))
    )


def type_class(kind: Column) -> Column:
    name = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(name.contains("cross"), "cross_border")
        .when(name.rlike("fund|financ"), "financing")
        .when(name.rlike("policy|macro"), "policy")
        .when(name.rlike("expansion|growth"), "expansion")
        .otherwise("signal")
    )


def operational_only(companies: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Leave out aggregate profiles."""
    return companies.filter(~contains_any(F.lower(name), rules.AGGREGATE_PROFILE_TERMS))


def size_bucket(revenue: Column) -> Column:
    return (
        F.when(revenue.contains("B"), "Large (>HKD 1B)").when(revenue.contains("M"), "Medium (HKD 100M-1B)").otherwise("Unverified")
    )


def indicator_display(text: Column) -> tuple[Column, Column]:
    """Display title and summary of a ``key: number`` text; other text is shown as it is."""
    parsed = parse_indicator(text)
    key = parsed["key"]
    labels = F.create_map(*[F.lit(x) for pair in rules.INDICATOR_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(labels, F.coalesce(key, F.lit(""))), title_case(key))
    title = F.when(parsed.isNotNull(), F.concat(label, F.lit(" updated"))).otherwise(text)
    summary = F.when(parsed.isNotNull(), F.concat(label, F.lit(": "), parsed["value"])).otherwise(text)
    return title, summary


def seed_companies(seeds: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """Seed directory rows, optionally only those sharing a wanted segment."""
    if not segments:
        return seeds
    wanted = F.array(*[F.lit(x.lower()) for x in segments])
    return seeds.filter(F.arrays_overlap(F.transform("segments", F.lower), wanted))
