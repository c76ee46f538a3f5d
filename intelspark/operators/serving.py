"""List, search, roll-up and latest-version operators behind the read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions.text import squash, strip


def _equals(df: DataFrame, **wanted) -> DataFrame:
    """Only the filters that were given, so each one can be pushed to the scan."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def _between(df: DataFrame, column: str, start, end) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """One sorted page; Spark plans it as a top-k per partition plus a merge."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def list_signals(signals, limit, offset=0, start=None, end=None, **equal) -> DataFrame:
    df = _between(_equals(signals, **equal), "event_time", start, end)
    return page(df, F.desc_nulls_last("event_time"), F.desc("id"), limit=limit, offset=offset)


def list_timeline(timeline, limit, offset=0, start=None, end=None, **equal) -> DataFrame:
    df = _between(_equals(timeline, **equal), "event_time", start, end)
    return page(df, F.desc_nulls_last("event_time"), F.desc("id"), limit=limit, offset=offset)


def list_insights(insights, limit, offset=0, **equal) -> DataFrame:
    return page(_equals(insights, **equal), F.desc_nulls_last("generated_at"), F.desc("id"), limit=limit, offset=offset)


def _any_contains(column: str, needle: str) -> Column:
    return F.exists(column, lambda x: F.lower(x).contains(needle))


def search_companies(companies, q=None, region=None, segment=None, industry=None) -> DataFrame:
    """Substring search on id and names, exact region, substring on any segment or industry."""
    df = companies
    if q:
        needle = q.lower()
        names = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("company_id", "canonical_name", "display_name")]
        df = df.filter(names[0].contains(needle) | names[1].contains(needle) | names[2].contains(needle))
    if region:
        df = df.filter(F.lower(F.coalesce("region", F.lit(""))) == region.lower())
    for column, wanted in (("segments", segment), ("industries", industry)):
        if wanted:
            df = df.filter(_any_contains(column, wanted.lower()))
    return df


def latest_by(df: DataFrame, key, *order: Column) -> DataFrame:
    """Newest row per key."""
    return top_n(df, key, 1, *order).drop("rank")


def top_n(df: DataFrame, key, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows per key with their rank.

    The rank filter sits on the window itself, so Spark cuts each group to ``n`` rows before the
    shuffle and one very large group never travels whole.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def latest_companies(companies: DataFrame) -> DataFrame:
    return latest_by(companies, "company_id", F.desc_nulls_last("updated_at"), F.desc("id"))


def counts_by_company(df: DataFrame, time: str, count_name: str, last_name: str) -> DataFrame:
    """Row count and newest time per company; blank company ids are left out."""
    return (
        df.filter(F.trim("company_id") != "")
        .groupBy("company_id")
        .agg(F.count(F.lit(1)).alias(count_name), F.max(time).alias(last_name))
    )


def company_activity(companies, signals, timeline, insights) -> DataFrame:
    """Latest company row with its three activity counts and the list activity time."""
    out = latest_companies(companies)
    for df, time, count_name, last_name in (
        (signals, "event_time", "signal_count", "last_signal_at"),
        (timeline, "event_time", "timeline_event_count", "last_event_at"),
        (insights, "generated_at", "generated_insight_count", "last_insight_at"),
    ):
        out = out.join(counts_by_company(df, time, count_name, last_name), "company_id", "left")
        out = out.withColumn(count_name, F.coalesce(count_name, F.lit(0)))
    return out.withColumn(
        "activity_at", F.coalesce("last_signal_at", "last_event_at", "last_insight_at", "updated_at")
    )


def company_order() -> list[Column]:
    return [F.desc_nulls_last("activity_at"), F.desc_nulls_last("updated_at"), F.asc("company_id")]


def signal_class_counts(signals: DataFrame) -> DataFrame:
    """Signals per company and per class; a signal may count in more than one class."""
    kind = F.lower("signal_type")
    classes = {
        "opportunity_signal_count": rules.OPPORTUNITY_TYPES,
        "risk_signal_count": rules.RISK_TYPES,
        "cross_border_signal_count": rules.CROSS_BORDER_TYPES,
        "financing_signal_count": rules.FINANCING_ROLLUP_TYPES,
    }
    return (
        signals.filter(F.trim("company_id") != "")
        .groupBy("company_id")
        .agg(
            F.count(F.lit(1)).alias("signal_count"),
            *[F.count_if(kind.isin(*types)).alias(name) for name, types in classes.items()],
            F.max("event_time").alias("last_signal_at"),
        )
    )


def company_rollup(companies: DataFrame, signals: DataFrame) -> DataFrame:
    counts = signal_class_counts(signals)
    out = latest_companies(companies).join(counts, "company_id", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in counts.columns if c.endswith("_count")}
    return out.withColumns(filled).withColumn("activity_at", F.coalesce("last_signal_at", "updated_at"))


def type_distribution(signals: DataFrame) -> DataFrame:
    return (
        signals.filter(F.trim("company_id") != "")
        .groupBy("company_id", F.col("signal_type").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def ordered_types(signals: DataFrame) -> DataFrame:
    """Distinct signal types per company, most frequent first, then by name."""
    return (
        type_distribution(signals)
        .groupBy("company_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "name"))).alias("ranked"))
        .select("company_id", F.transform("ranked", lambda x: x["name"]).alias("signal_types"))
    )


def evidence_summary(documents: DataFrame) -> DataFrame:
    """Eleven measures of the parsed documents of each company."""
    status = F.lower("parse_status")

    def hits(column: str) -> Column:
        return F.count_if(F.lower(F.coalesce(column, F.lit(""))).isin(*rules.HIT_STATUSES))

    return documents.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("parsed_document_count"),
        F.count_if(status == "success").alias("parsed_document_success_count"),
        F.count_if(status == "partial").alias("parsed_document_partial_count"),
        F.count_if(status == "failed").alias("parsed_document_failed_count"),
        hits("ocr_status").alias("ocr_hit_count"),
        hits("xbrl_status").alias("xbrl_hit_count"),
        F.count_if(F.trim("management_discussion_summary") != "").alias("management_discussion_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("metric_count", "risk_factor_count", "business_event_count")],
        F.max("parsed_at").alias("last_parsed_at"),
    )


def child_order() -> list[Column]:
    ties = [F.asc(c) for c in ("child_index", "document_id", "tie_1", "tie_2", "tie_3")]
    return [F.desc_nulls_last("parsed_at"), F.desc(F.coalesce("confidence", F.lit(0.0))), *ties]


def key_children(children: DataFrame, kind: str, n: int = 8) -> DataFrame:
    """The ``n`` leading extracted items of one kind per company."""
    return top_n(children.filter(F.col("kind") == kind), "company_id", n, *child_order())


def value_counts(df: DataFrame, value: Column | str, bucket: str | None = None) -> DataFrame:
    """Counts per value; null and blank values go to the bucket, or are left out without one."""
    value = F.col(value) if isinstance(value, str) else value
    named = df.select(F.nullif(strip(value), F.lit("")).alias("name"))
    named = named.filter(F.col("name").isNotNull()) if bucket is None else named.select(F.coalesce("name", F.lit(bucket)).alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("name") != "").groupBy("name").agg(F.sum("count").alias("count"))


def facets(companies: DataFrame, signals: DataFrame, facts: DataFrame) -> DataFrame:
    """Filter values with counts: regions, segments, industries, types, sources and datasets."""
    latest = latest_companies(companies)
    parts = {
        "regions": value_counts(latest, "region"),
        "segments": value_counts(latest.select(F.explode("segments").alias("v")), "v"),
        "industries": value_counts(latest.select(F.explode("industries").alias("v")), "v"),
        "signal_types": value_counts(signals, "signal_type"),
        "sources": merge_counts(value_counts(signals, "source"), value_counts(facts, "source")),
        "datasets": merge_counts(value_counts(signals, "dataset"), value_counts(facts, "dataset")),
    }
    frames = [df.select(F.lit(facet).alias("facet"), "name", "count") for facet, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def overview(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """Row count per table and the newest run, as (measure, value) rows."""
    out = runs.agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("r"))
    out = out.select(
        F.explode(
            F.array(
                F.struct(F.lit("latest_run_id").alias("measure"), F.col("r.run_id").alias("value")),
                F.struct(F.lit("latest_run_status").alias("measure"), F.col("r.status").alias("value")),
            )
        ).alias("m")
    ).select("m.*")
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("measure"), "value"))
    return out


def matches_first(df: DataFrame, text: str, wanted: str | None, *order: Column) -> DataFrame:
    """Rows whose loose text contains the filter, or is contained in it, come first."""
    if not wanted:
        return df.withColumn("matches", F.lit(False)).orderBy(*order)
    value, needle = squash(text), squash(F.lit(wanted))
    hit = (F.col(text) != "") & (value.contains(needle) | needle.contains(value))
    return df.withColumn("matches", F.coalesce(hit, F.lit(False))).orderBy(F.desc("matches"), *order)


def free_text(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))


def with_workflow(prospects: DataFrame, states: DataFrame) -> DataFrame:
    """Workflow state per prospect; a prospect without a row gets the defaults."""
    keep = states.select("prospect_id", "owner", "stage", "status", "review_status", F.lit(True).alias("stored"))
    out = prospects.select("prospect_id", "company_id").join(keep, "prospect_id", "left")
    fill = {
        c: F.when(F.col("stored"), F.col(c)).otherwise(F.lit(v)) for c, v in rules.WORKFLOW_DEFAULTS.items()
    }
    return out.withColumns(fill).drop("stored")


def with_prospect_keys(companies: DataFrame) -> DataFrame:
    return companies.withColumn("prospect_id", F.concat(F.lit("prospect:"), F.col("company_id")))


def signals_of_prospects(signals: DataFrame, prospects: DataFrame) -> DataFrame:
    """Signals of a prospect by any of several loose keys.

    An OR of equalities would plan as a nested loop, so both key lists are exploded, joined by
    equality and the repeats removed.
    """
    left = signals.select(
        F.col("id").alias("signal_id"),
        F.explode(F.array_distinct(F.filter(F.array(squash("company_id"), squash("entity")), lambda x: x != ""))).alias("k"),
    )
    right = prospects.select(
        "prospect_id",
        F.explode(
            F.array_distinct(
                F.filter(F.array(squash("prospect_id"), squash("company_id"), squash("canonical_name")), lambda x: x != "")
            )
        ).alias("k"),
    )
    return left.join(right, "k").select("signal_id", "prospect_id").distinct()


def first_by_position(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Ordered distinct: the first row of each key by position."""
    return latest_by(df, keys, F.asc(position))


def dashboard(rollup: DataFrame) -> DataFrame:
    """Home-page counts over scored company roll-ups."""
    return rollup.agg(
        F.count(F.lit(1)).alias("lead_pool"),
        F.count_if(F.col("priority_level") == "high").alias("high_priority"),
        F.count_if(F.col("cross_border_signal_count") > 0).alias("cross_border"),
        F.count_if(F.col("financing_signal_count") > 0).alias("financing_signals"),
        F.max("activity_at").alias("last_updated"),
    )


def index_status(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Index totals as one row; each part is a scalar subquery over its own table."""
    mine = embeddings.filter(F.col("embedding_model") == model)
    return documents.agg(F.count(F.lit(1)).alias("document_count")).select(
        "document_count",
        chunks.agg(F.count(F.lit(1))).scalar().alias("chunk_count"),
        mine.agg(F.count_distinct("chunk_id")).scalar().alias("embedded_chunk_count"),
        mine.agg(F.max("created_at")).scalar().alias("last_embedded_at"),
    )
