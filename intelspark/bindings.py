"""Domain views over the given star-schema tables.

Each view is a lazy DataFrame over a whole table. A user with real landed data supplies
frames of the same shape instead. ``SQL`` holds the same views as CTEs for the checker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL_TYPES = {
    "click": "policy", "view": "cross_border", "purchase": "financing", "signup": "growth", "error": "risk",
}
SIGNAL_THRESHOLD = 60.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for name, value in mapping.items():
        expr = F.when(key == name, value) if expr is None else expr.when(key == name, value)
    return expr


class Views:
    """Lazy domain views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def texts(self, name: str, key: str) -> DataFrame:
        """A text table spread over all cores.

        Parsing text costs far more than moving it, so a table stored in fewer pieces than there
        are cores is spread by key first; a large table has more pieces than cores and is left alone.
        """
        df = self.raw(name)
        cores = self.spark.sparkContext.defaultParallelism
        files = df.inputFiles()
        return df.repartition(cores * 2, key) if len(files) < cores else df

    def _company_of(self, key: str) -> Column:
        # A one-row scalar subquery: evaluated once, then a literal in the scan stage.
        n = self.raw("customer").agg(F.count(F.lit(1))).scalar()
        return (F.col(key) % n).cast("string")

    def companies(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                F.col("c_custkey").alias("id"),
                F.lit("registry").alias("source"),
                F.col("c_custkey").cast("string").alias("company_id"),
                F.col("c_name").alias("canonical_name"),
                F.col("c_name").alias("display_name"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("region"),
                F.array(F.lower("c_mktsegment")).alias("segments"),
                F.array(F.lower("c_mktsegment"), F.concat(F.lit("group "), (F.col("c_nationkey") % 5).cast("string"))).alias(
                    "industries"
                ),
                F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 1000 as int))").alias("updated_at"),
            )
        )

    def company_versions(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").cast("string").alias("company_id"),
            F.col("event_type").alias("status_text"),
            F.col("value").alias("value_num"),
            F.col("ts").alias("updated_at"),
        )

    def facts(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("src"), (F.col("event_id") % 7).cast("string")).alias("source"),
            F.concat(F.lit("feed_"), F.col("event_type")).alias("dataset"),
            F.concat_ws("|", "event_type", F.col("event_id").cast("string")).alias("record_key"),
            self._company_of("event_id").alias("company_id"),
            F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"),
            F.col("ts").alias("event_time"),
            F.concat(F.initcap("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("title"),
            F.concat(F.lit("Observed value "), F.col("value").cast("string")).alias("summary"),
            F.col("props").alias("payload"),
        )

    def signals(self) -> DataFrame:
        band = F.floor(F.col("value") / 10).cast("string")
        return self.raw("events").filter(F.col("value") >= SIGNAL_THRESHOLD).select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("src"), (F.col("event_id") % 7).cast("string")).alias("source"),
            F.concat(F.lit("feed_"), F.col("event_type")).alias("dataset"),
            F.concat_ws("|", "event_type", F.col("event_id").cast("string")).alias("signal_key"),
            _choose(F.col("event_type"), SIGNAL_TYPES).alias("signal_type"),
            self._company_of("event_id").alias("company_id"),
            F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"),
            F.col("ts").alias("event_time"),
            F.col("event_type").alias("indicator"),
            F.col("value").alias("value_num"),
            F.concat(F.initcap("event_type"), F.lit(" activity in band "), band, F.lit(". Reported by user "),
                     F.col("user_id").cast("string")).alias("signal_text"),
            F.round(F.col("value") / 500, 4).alias("signal_score"),
            F.when(F.col("value") >= 140, "high").when(F.col("value") >= 90, "medium").otherwise("low").alias("signal_level"),
            F.col("props").alias("extra"),
        )

    def timeline(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.lit("orders").alias("source"),
            F.col("o_custkey").cast("string").alias("company_id"),
            F.col("o_orderdate").alias("event_time"),
            F.col("o_orderstatus").alias("event_type"),
            F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("headline"),
            F.col("o_orderpriority").alias("detail"),
            F.col("o_totalprice").alias("amount"),
        )

    def insights(self) -> DataFrame:
        return self.raw("labels").filter(F.col("toxic") == 1).select(
            F.col("doc_id").alias("id"),
            self._company_of("doc_id").alias("company_id"),
            F.when(F.col("quality") == 1, "explanation").otherwise("risk_review").alias("insight_type"),
            F.concat(F.lit("Insight on document "), F.col("doc_id").cast("string")).alias("title"),
            F.expr("timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))").alias("generated_at"),
        )

    def documents(self) -> DataFrame:
        labels = self.raw("labels").select(F.col("doc_id").alias("l_doc"), "quality")
        doc = F.col("doc_id")
        hit = F.when(doc % 6 == 0, "used").when(doc % 6 == 1, "applied").when(doc % 6 == 2, "HIT")
        xbrl = F.when(doc % 5 == 0, "success").when(doc % 5 == 1, "extracted")
        return (
            self.raw("documents")
            .join(labels, doc == F.col("l_doc"), "left")
            .select(
                doc.alias("id"),
                self._company_of("doc_id").alias("company_id"),
                "lang", "source", "text",
                F.concat(F.lit("reports_"), F.col("lang")).alias("dataset"),
                F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "partial").otherwise("failed").alias("parse_status"),
                hit.alias("ocr_status"), xbrl.alias("xbrl_status"),
                F.when(doc % 3 == 0, F.concat(F.upper("source"), F.lit(" outlook for "), F.col("lang"), F.lit(". Details follow."))).alias(
                    "management_discussion_summary"),
                (doc % 5).alias("metric_count"), (doc % 4).alias("risk_factor_count"), (doc % 2).alias("business_event_count"),
                F.expr("timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval(0, cast(doc_id % 97 as int))").alias("parsed_at"),
            )
        )

    def children(self) -> DataFrame:
        """Every line item as one extracted metric, risk or event of its order's document."""
        kind = (
            F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 40), "risk")
            .when((F.col("l_returnflag") == "N") & (F.col("l_tax") >= 0.08) & (F.col("l_quantity") >= 40), "event")
            .otherwise("metric")
        )
        return (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_orderkey").alias("document_id"),
                F.col("o_custkey").cast("string").alias("company_id"),
                F.col("o_orderdate").alias("parsed_at"),
                F.col("l_linenumber").alias("child_index"),
                kind.alias("kind"),
                F.round(1 - F.col("l_discount"), 2).alias("confidence"),
                F.when(F.col("l_linestatus") == "O", "expansion").otherwise("acquisition").alias("event_type"),
                F.when(F.col("l_linestatus") == "O", "credit").otherwise("market").alias("category"),
                F.when(F.col("l_quantity") >= 48, "high").when(F.col("l_quantity") >= 44, "medium").otherwise("low").alias("severity"),
                F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" from supplier "),
                         F.col("l_suppkey").cast("string"), F.lit("; shipped")).alias("summary"),
                F.concat(F.lit("Order file "), F.col("l_orderkey").cast("string")).alias("title"),
                F.col("l_extendedprice").alias("value_num"),
                # The first five columns of a line do not identify it, so ties are broken by these.
                F.col("l_partkey").alias("tie_1"), F.col("l_suppkey").alias("tie_2"), F.col("l_extendedprice").alias("tie_3"),
            )
        )

    def workflow_states(self) -> DataFrame:
        """Suppliers stand for handled prospects; the others have no state row."""
        return self.raw("supplier").select(
            F.concat(F.lit("prospect:"), F.col("s_suppkey").cast("string")).alias("prospect_id"),
            F.col("s_suppkey").cast("string").alias("company_id"),
            F.col("s_name").alias("owner"),
            F.when(F.col("s_acctbal") < 0, "on_hold").otherwise("contacted").alias("stage"),
            F.lit("open").alias("status"),
            F.when(F.col("s_nationkey") % 2 == 0, "reviewed").alias("review_status"),
            F.col("s_acctbal").alias("balance"),
        )

    def holdings(self) -> DataFrame:
        """Line items per part as one connect-holdings row per security."""
        # Exact decimal sums, so the totals do not depend on the order of addition.
        exact = lambda c: F.col(c).cast("decimal(18,2)")
        total = lambda x: F.sum(x).cast("double")
        price, n = exact("l_extendedprice"), F.count(F.lit(1))
        lines = self.raw("lineitem").groupBy("l_partkey").agg(
            F.sum("l_quantity").alias("shares"),
            total(price).alias("holding_value"),
            (total(exact("l_discount")) / n * 100).alias("holding_float_ratio_pct"),
            ((total(exact("l_tax")) / n - F.lit(0.04)) * 100).alias("increase_float_ratio_pct"),
            (total(F.when(F.col("l_returnflag") == "R", price * -2).otherwise(price)) / 2).alias("increase_value"),
            (F.sum("l_quantity") / n - F.lit(25.5)).alias("price_change_pct"),
        )
        return self.raw("part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.col("p_partkey").cast("string").alias("company_id"),
            F.col("p_name").alias("company_name"),
            F.col("p_type").alias("sector"),
            F.lit("southbound").alias("market"),
            F.col("p_size").alias("rank"),
            "shares", "holding_value", "holding_float_ratio_pct", "increase_float_ratio_pct", "increase_value", "price_change_pct",
        )


SQL = {
    "companies": """companies AS (
        SELECT c_custkey AS id, 'registry' AS source, CAST(c_custkey AS VARCHAR) AS company_id, c_name AS canonical_name,
               c_name AS display_name, n_name AS country, r_name AS region, [lower(c_mktsegment)] AS segments,
               [lower(c_mktsegment), 'group ' || CAST(c_nationkey % 5 AS VARCHAR)] AS industries,
               TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS updated_at
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)""",
    "company_versions": """company_versions AS (
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS company_id, event_type AS status_text, value AS value_num, ts AS updated_at
        FROM events)""",
    "facts": """facts AS (
        SELECT event_id AS id, 'src' || CAST(event_id % 7 AS VARCHAR) AS source, 'feed_' || event_type AS dataset,
               event_type || '|' || CAST(event_id AS VARCHAR) AS record_key,
               CAST(event_id % (SELECT count(*) FROM customer) AS VARCHAR) AS company_id, 'user ' || CAST(user_id AS VARCHAR) AS entity,
               ts AS event_time, upper(event_type[1]) || event_type[2:] || ' by user ' || CAST(user_id AS VARCHAR) AS title,
               'Observed value ' || CAST(value AS VARCHAR) AS summary, props AS payload
        FROM events)""",
    "signals": """signals AS (
        SELECT event_id AS id, 'src' || CAST(event_id % 7 AS VARCHAR) AS source, 'feed_' || event_type AS dataset,
               event_type || '|' || CAST(event_id AS VARCHAR) AS signal_key,
               CASE event_type WHEN 'click' THEN 'policy' WHEN 'view' THEN 'cross_border' WHEN 'purchase' THEN 'financing'
                    WHEN 'signup' THEN 'growth' WHEN 'error' THEN 'risk' END AS signal_type,
               CAST(event_id % (SELECT count(*) FROM customer) AS VARCHAR) AS company_id, 'user ' || CAST(user_id AS VARCHAR) AS entity,
               ts AS event_time, event_type AS indicator, value AS value_num,
               upper(event_type[1]) || event_type[2:] || ' activity in band ' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)
                 || '. Reported by user ' || CAST(user_id AS VARCHAR) AS signal_text,
               round(value / 500, 4) AS signal_score,
               CASE WHEN value >= 140 THEN 'high' WHEN value >= 90 THEN 'medium' ELSE 'low' END AS signal_level, props AS extra
        FROM events WHERE value >= 60)""",
    "timeline": """timeline AS (
        SELECT o_orderkey AS id, 'orders' AS source, CAST(o_custkey AS VARCHAR) AS company_id, o_orderdate AS event_time,
               o_orderstatus AS event_type, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS headline,
               o_orderpriority AS detail, o_totalprice AS amount
        FROM orders)""",
    "insights": """insights AS (
        SELECT doc_id AS id, CAST(doc_id % (SELECT count(*) FROM customer) AS VARCHAR) AS company_id,
               CASE WHEN quality = 1 THEN 'explanation' ELSE 'risk_review' END AS insight_type,
               'Insight on document ' || CAST(doc_id AS VARCHAR) AS title,
               TIMESTAMP '2024-02-01 00:00:00' + to_minutes(doc_id) AS generated_at
        FROM labels WHERE toxic = 1)""",
    "docs": """docs AS (
        SELECT d.doc_id AS id, CAST(d.doc_id % (SELECT count(*) FROM customer) AS VARCHAR) AS company_id, lang, source, text,
               'reports_' || lang AS dataset,
               CASE WHEN quality = 1 THEN 'success' WHEN quality = 0 THEN 'partial' ELSE 'failed' END AS parse_status,
               CASE d.doc_id % 6 WHEN 0 THEN 'used' WHEN 1 THEN 'applied' WHEN 2 THEN 'HIT' END AS ocr_status,
               CASE d.doc_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'extracted' END AS xbrl_status,
               CASE WHEN d.doc_id % 3 = 0 THEN upper(source) || ' outlook for ' || lang || '. Details follow.' END AS management_discussion_summary,
               d.doc_id % 5 AS metric_count, d.doc_id % 4 AS risk_factor_count, d.doc_id % 2 AS business_event_count,
               TIMESTAMP '2024-01-10 00:00:00' + to_hours(d.doc_id % 97) AS parsed_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "children": """children AS (
        SELECT l_orderkey AS document_id, CAST(o_custkey AS VARCHAR) AS company_id, o_orderdate AS parsed_at, l_linenumber AS child_index,
               CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 AND l_quantity >= 40 THEN 'risk'
                    WHEN l_returnflag = 'N' AND l_tax >= 0.08 AND l_quantity >= 40 THEN 'event' ELSE 'metric' END AS kind,
               round(1 - l_discount, 2) AS confidence,
               CASE WHEN l_linestatus = 'O' THEN 'expansion' ELSE 'acquisition' END AS event_type,
               CASE WHEN l_linestatus = 'O' THEN 'credit' ELSE 'market' END AS category,
               CASE WHEN l_quantity >= 48 THEN 'high' WHEN l_quantity >= 44 THEN 'medium' ELSE 'low' END AS severity,
               'Part ' || CAST(l_partkey AS VARCHAR) || ' from supplier ' || CAST(l_suppkey AS VARCHAR) || '; shipped' AS summary,
               'Order file ' || CAST(l_orderkey AS VARCHAR) AS title, l_extendedprice AS value_num, l_partkey AS tie_1, l_suppkey AS tie_2, l_extendedprice AS tie_3
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "workflow_states": """workflow_states AS (
        SELECT 'prospect:' || CAST(s_suppkey AS VARCHAR) AS prospect_id, CAST(s_suppkey AS VARCHAR) AS company_id, s_name AS owner,
               CASE WHEN s_acctbal < 0 THEN 'on_hold' ELSE 'contacted' END AS stage, 'open' AS status,
               CASE WHEN s_nationkey % 2 = 0 THEN 'reviewed' END AS review_status, s_acctbal AS balance
        FROM supplier)""",
    "holdings": """holdings AS (
        SELECT CAST(p_partkey AS VARCHAR) AS company_id, p_name AS company_name, p_type AS sector, 'southbound' AS market, p_size AS rank,
               shares, holding_value, holding_float_ratio_pct, increase_float_ratio_pct, increase_value, price_change_pct
        FROM part LEFT JOIN (
          SELECT l_partkey, sum(l_quantity) AS shares, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS holding_value,
                 CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100 AS holding_float_ratio_pct,
                 (CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) - CAST(0.04 AS DOUBLE)) * 100 AS increase_float_ratio_pct,
                 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_returnflag = 'R' THEN -2 ELSE 1 END) AS DOUBLE) / 2 AS increase_value,
                 sum(l_quantity) / count(*) - CAST(25.5 AS DOUBLE) AS price_change_pct
          FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)""",
}


def with_views(names: str, body: str, ctes: str = "") -> str:
    """A checker query over the named views, optionally with further CTEs before the body."""
    parts = [SQL[name] for name in names.split()]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
