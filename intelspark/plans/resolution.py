"""Queries of company discovery, aliases and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from intelspark.bindings import with_views
from intelspark.operators import resolve as r
from intelspark.plans.registry import query

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
MARKET = """market AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'szse_cninfo' WHEN 'A' THEN 'hkex_disclosure' ELSE 'other' END AS source, CAST(l_suppkey AS VARCHAR) AS company_id,
 'Supplier ' || l_suppkey || ' unit ' || CAST(l_quantity AS VARCHAR) AS name, CASE WHEN l_linestatus = 'O' THEN 'industry ' || l_linenumber ELSE 'Listed Companies' END AS industry FROM lineitem)"""


def _market(v):
    name = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"), F.lit(" unit "), F.col("l_quantity").cast("string"))
    # Exchange titles carry the report suffix, the other market names its company in the payload.
    return v.raw("lineitem").select(
        *ORDER, F.when(F.col("l_returnflag") == "R", "szse_cninfo").when(F.col("l_returnflag") == "A", "hkex_disclosure").otherwise("other").alias("source"),
        F.col("l_suppkey").cast("string").alias("company_id"), F.concat(name, F.lit(" - Annual Report 2024")).alias("title"),
        F.when(F.col("l_returnflag") == "R", F.to_json(F.struct(name.alias("secName")))).otherwise("{}").alias("payload"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("industry "), F.col("l_linenumber").cast("string"))).alias("industry"))


@query("j1_market_companies", f"""WITH {MARKET}, m AS (SELECT * FROM market WHERE source <> 'other')
SELECT company_id, arg_max(name, rank) AS canonical_name, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, any_value(inds) AS industries FROM (
 SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY length(name), l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rank FROM m)
JOIN (SELECT company_id, string_agg(industry, '|' ORDER BY k) AS inds FROM (SELECT company_id, industry, min(rn) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM m) GROUP BY 1, 2) GROUP BY 1) USING (company_id) GROUP BY 1""")
def j1(v):
    out = r.market_companies(_market(v), ORDER)
    back = F.transform("segments", lambda s: F.when(s == "hkex", "hkex_disclosure").when(s == "szse", "szse_cninfo"))
    return out.select("company_id", "canonical_name", F.array_join(F.array_sort(F.array_compact(back)), "|").alias("sources"), F.array_join("industries", "|").alias("industries"))


@query("j2_usable_alias", """SELECT c_custkey, kind, CASE kind WHEN 'name' THEN true WHEN 'id' THEN c_custkey >= 1000 WHEN 'short' THEN false ELSE true END AS usable FROM (
 SELECT c_custkey, unnest(['name', 'id', 'short', 'cjk']) AS kind FROM customer)""")
def j2(v):
    kinds = {"name": F.lower("c_name"), "id": F.col("c_custkey").cast("string"), "short": F.lit("co."), "cjk": F.concat(F.lit("银行"), F.col("c_custkey").cast("string"))}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("alias")) for k, x in kinds.items()])
    return v.raw("customer").select("c_custkey", F.explode(rows).alias("r")).select("c_custkey", "r.kind", r.usable_alias(F.col("r.alias")).alias("usable"))


INDEX = """pairs AS (SELECT company_id, lower(canonical_name) AS alias FROM companies UNION SELECT company_id, company_id FROM companies UNION SELECT company_id, industries[2] FROM companies),
idx AS (SELECT alias, min(company_id) AS company_id FROM pairs WHERE length(regexp_replace(alias, '[^a-z0-9]', '', 'g')) >= 4 GROUP BY 1 HAVING count(DISTINCT company_id) = 1)"""


def _index(v):
    # The second industry is shared by many companies, so as an alias it is ambiguous and drops out.
    extra = F.to_json(F.struct(F.array(F.element_at("industries", 2)).alias("aliases")))
    return r.alias_index(r.alias_candidates(v.companies().withColumn("extra", extra)))


@query("j3_alias_index", with_views("companies", "SELECT alias, company_id, CAST(length(alias) AS INT) AS alias_length FROM idx", INDEX))
def j3(v):
    return _index(v)


# Orders as texts that name their customer plainly, twice, glued to other letters, or not quite.
TEXTS = """texts AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Order placed by ' || n1 || ', see file' WHEN 1 THEN n1 || ' and (' || n2 || ')' WHEN 2 THEN 'x' || n1 || ' filed'
  WHEN 3 THEN n1 || '7 filed' ELSE n1 END AS text FROM (SELECT *, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS n1, 'CUSTOMER#' || lpad(CAST((o_custkey + 1) % (SELECT count(*) FROM customer) AS VARCHAR), 9, '0') AS n2 FROM orders))"""
HITS = """, hits AS (SELECT t.id, t.text, i.alias, i.company_id, lower(t.text) = i.alias AS is_exact FROM (
  SELECT id, text, unnest(list_distinct(list_concat(regexp_extract_all(' ' || lower(text), '[^a-z0-9](customer#[0-9]+)', 1), regexp_extract_all(text, '[0-9]+')))) AS alias FROM texts) t JOIN idx i ON i.alias = t.alias),
best AS (SELECT id, any_value(text) AS text, min(company_id) AS company_id, arg_max(alias, length(alias)) AS alias, bool_or(is_exact) AS is_exact FROM hits GROUP BY 1 HAVING count(DISTINCT company_id) = 1)"""
CONF = "CASE WHEN is_exact THEN 0.95 WHEN length(alias) >= 10 THEN 0.92 WHEN length(alias) >= 6 THEN 0.88 ELSE 0.85 END::DOUBLE"


def _texts(v):
    n = v.raw("customer").agg(F.count(F.lit(1))).scalar()
    name = lambda prefix, key: F.concat(F.lit(prefix), F.lpad(key.cast("string"), 9, "0"))
    one, two = name("Customer#", F.col("o_custkey")), name("CUSTOMER#", (F.col("o_custkey") + 1) % n)
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.concat(F.lit("Order placed by "), one, F.lit(", see file"))).when(k == 1, F.concat(one, F.lit(" and ("), two, F.lit(")")))
            .when(k == 2, F.concat(F.lit("x"), one, F.lit(" filed"))).when(k == 3, F.concat(one, F.lit("7 filed"))).otherwise(one))
    return v.raw("orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query("e7_alias_occurrences", with_views("companies", "SELECT id, alias, company_id, is_exact FROM hits", INDEX + ",\n" + TEXTS + HITS))
def e7(v):
    return r.matches(_texts(v), _index(v), row="id").select("id", "alias", "company_id", "is_exact")


@query("j4_match_company", with_views("companies", f"SELECT id, company_id, alias, {CONF} AS confidence FROM best", INDEX + ",\n" + TEXTS + HITS))
def j4(v):
    return r.match_companies(_texts(v), _index(v), row="id")


@query("j5_searchable_text", with_views("facts", "SELECT id, title || ' | ' || summary || ' | ' || entity AS text FROM facts"))
def j5(v):
    facts = v.facts().withColumn("payload", F.to_json(F.struct("entity", F.lit(" ").alias("stock_name"))))
    return facts.select("id", r.searchable_text(["title", "summary"], "payload", r.RECORD_NAMES).alias("text"))


@query("j6_backfill", with_views("companies", f"SELECT t.id, coalesce(CASE WHEN t.id % 7 = 0 THEN 'kept' END, b.company_id) AS company_id FROM texts t LEFT JOIN best b ON b.id = t.id", INDEX + ",\n" + TEXTS + HITS))
def j6(v):
    rows = _texts(v).withColumn("company_id", F.when(F.col("id") % 7 == 0, "kept"))
    return r.backfill(rows, _index(v), F.col("text"), "run-1", "intelligence_records")[0].select("id", "company_id")


@query("j6_mapping_audit", with_views("companies", f"""SELECT id AS target_row_id, company_id AS new_company_id, alias AS matched_alias, {CONF} AS confidence, left(text, 400) AS matched_context FROM best WHERE id % 7 <> 0""", INDEX + ",\n" + TEXTS + HITS))
def j6b(v):
    rows = _texts(v).withColumn("company_id", F.when(F.col("id") % 7 == 0, "kept"))
    audit = r.backfill(rows, _index(v), F.col("text"), "run-1", "intelligence_records")[1]
    return audit.select("target_row_id", "new_company_id", "matched_alias", "confidence", "matched_context")


@query("j7_mapping_summary", with_views("companies", "SELECT 'intelligence_records' AS target_table, count(*) AS updated FROM best", INDEX.replace(" UNION SELECT company_id, industries[2] FROM companies", "") + ",\n" + TEXTS + HITS))
def j7(v):
    none = F.lit(None).cast("string")
    facts = _texts(v).select("id", F.col("text").alias("title"), none.alias("summary"), F.lit("{}").alias("payload"), none.alias("company_id"), F.lit("feed").alias("source"), none.alias("industry"))
    signals = v.signals().withColumn("value_text", none)
    return r.mapping_job(facts, signals, v.companies(), "run-1", ["id"])["summary"]


@query("m1_identity_evaluation", with_views("companies", """SELECT CASE t.id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'two' WHEN 2 THEN 'glued' WHEN 3 THEN 'longer' ELSE 'exact' END AS kind, count(*) AS cases,
 count(*) FILTER (WHERE CASE WHEN t.id % 5 IN (0, 4) THEN b.company_id IS NOT NULL AND b.alias LIKE 'customer#%' ELSE b.company_id IS NULL END) AS passed FROM texts t LEFT JOIN best b ON b.id = t.id GROUP BY 1""", INDEX + ",\n" + TEXTS + HITS))
def m1(v):
    from intelspark.operators.evaluate import identity_accuracy

    k = F.col("id") % 5
    should = k.isin(0, 4)
    cases = _texts(v).join(v.raw("orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id").select(
        F.col("id").alias("case_id"), "text", F.col("o_custkey").cast("string").alias("expected_company_id"),
        F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("expected_alias"), should.alias("should_match"),
        F.when(k == 0, "plain").when(k == 1, "two").when(k == 2, "glued").when(k == 3, "longer").otherwise("exact").alias("kind"))
    matched = r.match_companies(cases, _index(v), row="case_id")
    verdicts = identity_accuracy(matched, cases).join(cases.select("case_id", "kind"), "case_id")
    return verdicts.groupBy("kind").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"))
