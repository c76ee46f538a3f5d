"""Queries over lists, joins, roll-ups, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from intelspark.bindings import with_views
from intelspark.operators import lightweight as light
from intelspark.operators import serving as s
from intelspark.plans.registry import query

# Shared checker text: class counts per company and the light scorecard on top of them.
ROLLUP = """
roll AS (SELECT c.company_id, c.canonical_name, c.region, c.industries, c.updated_at,
    coalesce(n, 0) AS signal_count, coalesce(o, 0) AS opportunity_signal_count, coalesce(r, 0) AS risk_signal_count,
    coalesce(x, 0) AS cross_border_signal_count, coalesce(f, 0) AS financing_signal_count, last_signal_at,
    coalesce(last_signal_at, c.updated_at) AS activity_at
  FROM companies c LEFT JOIN (
    SELECT company_id, count(*) AS n,
      count(*) FILTER (WHERE signal_type IN ('growth','cross_border','market','financing','expansion','acquisition','m&a','trade')) AS o,
      count(*) FILTER (WHERE signal_type IN ('risk','regulatory','compliance','warning','litigation')) AS r,
      count(*) FILTER (WHERE signal_type IN ('cross_border','trade')) AS x,
      count(*) FILTER (WHERE signal_type IN ('financing','funding','market','growth','expansion')) AS f,
      max(event_time) AS last_signal_at
    FROM signals GROUP BY 1) s ON s.company_id = c.company_id)"""
LIGHT = ROLLUP + """,
light0 AS (SELECT *, CASE WHEN opportunity_signal_count >= 2 OR risk_signal_count >= 2 THEN 'actionable'
      WHEN signal_count > 0 THEN 'active' ELSE 'monitor' END AS status,
    CAST(least(100, opportunity_signal_count * 22 + signal_count * 5 + CASE WHEN signal_count > 0 THEN 8 ELSE 0 END) AS INTEGER) AS opportunity_score,
    CAST(least(100, risk_signal_count * 20) AS INTEGER) AS risk_score,
    CAST(least(100, signal_count * 15 + CASE WHEN opportunity_signal_count > 0 THEN 20 ELSE 0 END) AS INTEGER) AS evidence_confidence_score
  FROM roll),
light1 AS (SELECT *, CAST(least(100, trunc(opportunity_score * CAST(0.6 AS DOUBLE)) + trunc(evidence_confidence_score * CAST(0.15 AS DOUBLE))
      + trunc(greatest(0, 40 - risk_score) * CAST(0.25 AS DOUBLE))) AS INTEGER) AS priority_score FROM light0),
light AS (SELECT *, CASE WHEN status = 'actionable' AND priority_score >= 50 THEN 'high' WHEN priority_score >= 38 THEN 'medium'
      ELSE 'monitor' END AS priority_level FROM light1)"""


def _light(v):
    return light.light_scorecard(s.company_rollup(v.companies(), v.signals()))


# ------------------------------------------------------------------ lists and search


@query("d1_list_signals", with_views("signals", """
SELECT id, company_id, signal_type, event_time FROM signals
WHERE signal_type = 'financing' AND event_time >= TIMESTAMP '2024-01-02' AND event_time <= TIMESTAMP '2024-01-20'
ORDER BY event_time DESC, id DESC LIMIT 50 OFFSET 10"""))
def d1(v):
    df = s.list_signals(
        v.signals(), 50, 10, signal_type="financing",
        start=F.expr("timestamp_ntz'2024-01-02'"), end=F.expr("timestamp_ntz'2024-01-20'"))
    return df.select("id", "company_id", "signal_type", "event_time")


@query("d2_get_signal", with_views("signals", "SELECT id, company_id, signal_text FROM signals WHERE id BETWEEN 40 AND 69"))
def d2(v):
    return v.signals().filter(F.col("id").isin(*range(40, 70))).select("id", "company_id", "signal_text")


@query("d3_list_timeline", with_views("timeline", """
SELECT id, company_id, event_time, headline FROM timeline WHERE event_type = 'P' ORDER BY event_time DESC NULLS LAST, id DESC LIMIT 40"""))
def d3(v):
    return s.list_timeline(v.timeline(), 40, event_type="P").select("id", "company_id", "event_time", "headline")


@query("d4_list_insights", with_views("insights", """
SELECT id, company_id, title, generated_at FROM insights WHERE insight_type = 'explanation' ORDER BY generated_at DESC, id DESC LIMIT 20"""))
def d4(v):
    return s.list_insights(v.insights(), 20, insight_type="explanation").select("id", "company_id", "title", "generated_at")


@query("d5_search_companies", with_views("companies", """
SELECT company_id, canonical_name, region FROM companies
WHERE (contains(lower(company_id), '7') OR contains(lower(canonical_name), '7')) AND lower(region) = 'asia'
  AND len(list_filter(segments, lambda x: contains(lower(x), 'build'))) > 0 AND len(list_filter(industries, lambda x: contains(x, 'group'))) > 0"""))
def d5(v):
    return s.search_companies(v.companies(), q="7", region="Asia", segment="Build", industry="group").select(
        "company_id", "canonical_name", "region")


@query("d6_company_order", with_views("companies signals timeline insights", """
SELECT company_id, activity_at, updated_at FROM (
  SELECT c.company_id, c.updated_at, coalesce(s.t, tl.t, i.t, c.updated_at) AS activity_at FROM companies c
  LEFT JOIN (SELECT company_id, max(event_time) t FROM signals GROUP BY 1) s ON s.company_id = c.company_id
  LEFT JOIN (SELECT company_id, max(event_time) t FROM timeline GROUP BY 1) tl ON tl.company_id = c.company_id
  LEFT JOIN (SELECT company_id, max(generated_at) t FROM insights GROUP BY 1) i ON i.company_id = c.company_id)
ORDER BY activity_at DESC NULLS LAST, updated_at DESC, company_id LIMIT 60 OFFSET 20"""))
def d6(v):
    df = s.company_activity(v.companies(), v.signals(), v.timeline(), v.insights())
    return s.page(df, *s.company_order(), limit=60, offset=20).select("company_id", "activity_at", "updated_at")


@query("d7_prospect_ranking", with_views("companies signals", """
SELECT company_id, priority_score, opportunity_score, activity_at, (SELECT count(*) FROM light) AS total FROM light
ORDER BY priority_score DESC, opportunity_score DESC, activity_at DESC, company_id DESC LIMIT 20 OFFSET 5""", LIGHT))
def d7(v):
    scored = _light(v)
    top = s.page(scored, *light.ranked(scored), limit=20, offset=5)
    total = scored.agg(F.count(F.lit(1))).scalar()
    return top.select("company_id", "priority_score", "opportunity_score", "activity_at", total.alias("total"))


@query("d8_filter_scored", with_views("companies signals", """
SELECT company_id, status, priority_level, priority_score FROM light WHERE status = 'actionable' AND priority_level = 'high'""", LIGHT))
def d8(v):
    df = _light(v).filter((F.col("status") == "actionable") & (F.col("priority_level") == "high"))
    return df.select("company_id", "status", "priority_level", "priority_score")


@query("d9_free_text", with_views("signals", """
SELECT id, signal_text FROM signals WHERE contains(lower(concat_ws(' ', entity, signal_type, source, signal_text)), 'band 12. reported')"""))
def d9(v):
    return s.free_text(v.signals(), ["entity", "signal_type", "source", "signal_text"], "Band 12. Reported").select("id", "signal_text")


@query("d10_matches_first", with_views("companies", """
SELECT company_id, region, (region <> '' AND (contains(r, 'middleeast') OR contains('middleeast', r))) AS matches FROM (
  SELECT *, regexp_replace(lower(region), '[^a-z0-9]', '', 'g') AS r FROM companies)"""))
def d10(v):
    return s.matches_first(v.companies(), "region", "Middle-East", F.asc("id")).select("company_id", "region", "matches")


@query("d11_dashboard_cards", with_views("companies signals", """
SELECT 'prospect' AS card, company_id AS ref, CAST(priority_score AS DOUBLE) AS score FROM (
  SELECT * FROM light ORDER BY priority_score DESC, opportunity_score DESC, activity_at DESC, company_id DESC LIMIT 5)
UNION ALL SELECT 'signal', CAST(id AS VARCHAR), value_num FROM (SELECT * FROM signals ORDER BY event_time DESC, id DESC LIMIT 5)""", LIGHT))
def d11(v):
    scored = _light(v)
    top = s.page(scored, *light.ranked(scored), limit=5)
    cards = top.select(F.lit("prospect").alias("card"), F.col("company_id").alias("ref"), F.col("priority_score").cast("double").alias("score"))
    recent = s.list_signals(v.signals(), 5)
    return cards.unionByName(
        recent.select(F.lit("signal").alias("card"), F.col("id").cast("string").alias("ref"), F.col("value_num").alias("score")))


# ------------------------------------------------------------------ joins


@query("e1_company_counts", with_views("companies signals timeline insights", """
SELECT c.company_id, coalesce(s.n, 0) AS signal_count, coalesce(tl.n, 0) AS timeline_event_count, coalesce(i.n, 0) AS generated_insight_count,
  coalesce(s.t, tl.t, i.t, c.updated_at) AS activity_at FROM companies c
LEFT JOIN (SELECT company_id, count(*) n, max(event_time) t FROM signals GROUP BY 1) s ON s.company_id = c.company_id
LEFT JOIN (SELECT company_id, count(*) n, max(event_time) t FROM timeline GROUP BY 1) tl ON tl.company_id = c.company_id
LEFT JOIN (SELECT company_id, count(*) n, max(generated_at) t FROM insights GROUP BY 1) i ON i.company_id = c.company_id"""))
def e1(v):
    return s.company_activity(v.companies(), v.signals(), v.timeline(), v.insights()).select(
        "company_id", "signal_count", "timeline_event_count", "generated_insight_count", "activity_at")


@query("e2_company_rollup", with_views("companies signals", """
SELECT company_id, signal_count, opportunity_signal_count, risk_signal_count, cross_border_signal_count, financing_signal_count, activity_at FROM roll""", ROLLUP))
def e2(v):
    return s.company_rollup(v.companies(), v.signals()).select(
        "company_id", "signal_count", "opportunity_signal_count", "risk_signal_count", "cross_border_signal_count",
        "financing_signal_count", "activity_at")


@query("e3_children_with_documents", with_views("children", """
SELECT document_id, company_id, kind, count(*) AS n, max(parsed_at) AS parsed_at FROM children GROUP BY 1, 2, 3"""))
def e3(v):
    return v.children().groupBy("document_id", "company_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("parsed_at").alias("parsed_at"))


PARSED_VERSION = "multisource-v2"


@query("e4_parsing_candidates", """
SELECT doc_id AS id, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def e4(v):
    from intelspark.operators.parsing import parsing_candidates

    facts = v.raw("documents").select(
        F.lit("documents").alias("source_table"), F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("source_content_hash"))
    # A document with a good label counts as parsed in this version.
    good = v.raw("labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("source_id"))
    parsed = facts.join(good, "source_id", "left_semi").withColumn("parse_version", F.lit(PARSED_VERSION))
    out = parsing_candidates(facts, parsed, PARSED_VERSION)
    return out.select(F.col("source_id").alias("id"), F.col("source_content_hash").alias("content_hash"))


@query("e5_documents_without_chunks", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def e5(v):
    return v.raw("documents").select("doc_id").join(v.raw("labels").select("doc_id"), "doc_id", "left_anti")


@query("e6_chunks_without_embedding", """
SELECT doc_id AS chunk_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label = 3)""")
def e6(v):
    from intelspark.operators.retrieval import chunks_without_embedding

    chunks = v.raw("documents").select(F.col("doc_id").alias("chunk_id"))
    vectors = v.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("embedding_model"))
    return chunks_without_embedding(chunks, vectors, "3")


@query("e8_source_to_latest_document", with_views("docs", """
SELECT s.o_orderkey AS source_id, d.id AS document_id, d.parse_status FROM orders s LEFT JOIN (
  SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY parsed_at DESC, id DESC) = 1
) d ON d.company_id = CAST(s.o_custkey AS VARCHAR)"""))
def e8(v):
    latest = s.latest_by(v.documents(), "company_id", F.desc("parsed_at"), F.desc("id")).select(
        "company_id", F.col("id").alias("document_id"), "parse_status")
    rows = v.raw("orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").cast("string").alias("company_id"))
    return rows.join(latest, "company_id", "left").select("source_id", "document_id", "parse_status")


@query("e10_workflow_defaults", with_views("companies workflow_states", """
SELECT 'prospect:' || c.company_id AS prospect_id, c.company_id, w.owner, coalesce(w.stage, 'new') AS stage, coalesce(w.status, 'open') AS status,
  CASE WHEN w.prospect_id IS NULL THEN 'not_reviewed' ELSE w.review_status END AS review_status
FROM companies c LEFT JOIN workflow_states w ON w.prospect_id = 'prospect:' || c.company_id"""))
def e10(v):
    return s.with_workflow(s.with_prospect_keys(v.companies()), v.workflow_states())


@query("e11_company_set", with_views("companies signals", """
SELECT id, company_id FROM signals WHERE company_id IN (SELECT company_id FROM companies WHERE region = 'EUROPE')"""))
def e11(v):
    wanted = v.companies().filter(F.col("region") == "EUROPE").select("company_id")
    return v.signals().select("id", "company_id").join(wanted, "company_id", "left_semi")


@query("e12_cited_chunks", """
SELECT e.vec_id AS chunk_id, c.conv_id, e.label FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id WHERE c.role = 'assistant'""")
def e12(v):
    from intelspark.operators.retrieval import validate_citations

    cited = v.raw("conversations").filter(F.col("role") == "assistant").select(
        "conv_id", F.col("conv_id").cast("string").alias("chunk_id"))
    found = v.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return validate_citations(cited, found).select("chunk_id", "conv_id", "label")


@query("e13_signals_with_top_types", with_views("signals", """
SELECT s.id, array_to_string(t.types[1:3], ',') AS signal_types FROM signals s LEFT JOIN (
  SELECT company_id, list(signal_type ORDER BY n DESC, signal_type) AS types FROM (
    SELECT company_id, signal_type, count(*) n FROM signals GROUP BY 1, 2) GROUP BY 1) t ON t.company_id = s.company_id"""))
def e13(v):
    types = s.ordered_types(v.signals())
    return v.signals().select("id", "company_id").join(types, "company_id", "left").select(
        "id", F.array_join(F.slice("signal_types", 1, 3), ",").alias("signal_types"))


@query("e14_signals_of_prospects", with_views("companies signals", """
SELECT DISTINCT s.id AS signal_id, 'prospect:' || c.company_id AS prospect_id FROM
 (SELECT id, unnest([company_id, regexp_replace(lower(entity), '[^a-z0-9]', '', 'g')]) AS k FROM signals) s JOIN
 (SELECT company_id, unnest([company_id, 'prospect' || company_id, regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g')]) AS k FROM companies) c
 ON s.k = c.k"""))
def e14(v):
    return s.signals_of_prospects(v.signals(), s.with_prospect_keys(v.companies()))


@query("e15_membership_flag", "SELECT d.doc_id, (l.doc_id IS NOT NULL) AS matched FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id")
def e15(v):
    from intelspark.operators.classify import membership_flag

    flagged = v.raw("labels").filter(F.col("toxic") == 1)
    return membership_flag(v.raw("documents").select("doc_id"), flagged, "doc_id", "matched")


# ------------------------------------------------------------------ aggregations


@query("f1_activity_counts", with_views("signals timeline insights", """
SELECT 'signals' AS feed, company_id, count(*) AS n, max(event_time) AS last_at FROM signals GROUP BY 2 UNION ALL
SELECT 'timeline', company_id, count(*), max(event_time) FROM timeline GROUP BY 2 UNION ALL
SELECT 'insights', company_id, count(*), max(generated_at) FROM insights GROUP BY 2"""))
def f1(v):
    out = None
    for feed, df, time in (("signals", v.signals(), "event_time"), ("timeline", v.timeline(), "event_time"), ("insights", v.insights(), "generated_at")):
        part = s.counts_by_company(df, time, "n", "last_at").withColumn("feed", F.lit(feed))
        out = part if out is None else out.unionByName(part)
    return out


@query("f2_type_distribution", with_views("signals", "SELECT company_id, signal_type AS name, count(*) AS count FROM signals GROUP BY 1, 2"))
def f2(v):
    return s.type_distribution(v.signals())


@query("f3_evidence_summary", with_views("docs", """
SELECT company_id, count(*) AS parsed_document_count, count(*) FILTER (WHERE parse_status = 'success') AS parsed_document_success_count,
 count(*) FILTER (WHERE parse_status = 'partial') AS parsed_document_partial_count, count(*) FILTER (WHERE parse_status = 'failed') AS parsed_document_failed_count,
 count(*) FILTER (WHERE lower(coalesce(ocr_status, '')) IN ('used','success','completed','hit')) AS ocr_hit_count,
 count(*) FILTER (WHERE lower(coalesce(xbrl_status, '')) IN ('used','success','completed','hit')) AS xbrl_hit_count,
 count(*) FILTER (WHERE trim(management_discussion_summary) <> '') AS management_discussion_count,
 CAST(sum(metric_count) AS BIGINT) AS metric_count, CAST(sum(risk_factor_count) AS BIGINT) AS risk_factor_count,
 CAST(sum(business_event_count) AS BIGINT) AS business_event_count, max(parsed_at) AS last_parsed_at
FROM docs GROUP BY 1"""))
def f3(v):
    return s.evidence_summary(v.documents())


@query("f4_signal_classes", with_views("companies signals", """
SELECT company_id, signal_count, opportunity_signal_count, risk_signal_count, cross_border_signal_count, financing_signal_count FROM roll WHERE signal_count > 0""", ROLLUP))
def f4(v):
    return s.signal_class_counts(v.signals()).drop("last_signal_at")


@query("f5_list_activity", with_views("companies timeline insights", """
SELECT c.company_id, coalesce(tl.t, i.t, c.updated_at) AS activity_at FROM companies c
LEFT JOIN (SELECT company_id, max(event_time) t FROM timeline GROUP BY 1) tl ON tl.company_id = c.company_id
LEFT JOIN (SELECT company_id, max(generated_at) t FROM insights GROUP BY 1) i ON i.company_id = c.company_id"""))
def f5(v):
    none = v.signals().filter(F.lit(False))
    return s.company_activity(v.companies(), none, v.timeline(), v.insights()).select("company_id", "activity_at")


@query("f6_state_activity", with_views("companies signals timeline insights docs", """
SELECT c.company_id, greatest(s.t, tl.t, i.t, d.t) AS activity_at FROM companies c
LEFT JOIN (SELECT company_id, max(event_time) t FROM signals GROUP BY 1) s ON s.company_id = c.company_id
LEFT JOIN (SELECT company_id, max(event_time) t FROM timeline GROUP BY 1) tl ON tl.company_id = c.company_id
LEFT JOIN (SELECT company_id, max(generated_at) t FROM insights GROUP BY 1) i ON i.company_id = c.company_id
LEFT JOIN (SELECT company_id, max(parsed_at) t FROM docs GROUP BY 1) d ON d.company_id = c.company_id"""))
def f6(v):
    # One pass: every feed contributes its newest time, and the maximum is taken per company.
    feeds = [v.signals().select("company_id", F.col("event_time").alias("t")), v.timeline().select("company_id", F.col("event_time").alias("t")),
             v.insights().select("company_id", F.col("generated_at").alias("t")), v.documents().select("company_id", F.col("parsed_at").alias("t"))]
    union = feeds[0]
    for feed in feeds[1:]:
        union = union.unionByName(feed)
    newest = union.groupBy("company_id").agg(F.max("t").alias("activity_at"))
    return v.companies().select("company_id").join(newest, "company_id", "left")


@query("f7_ordered_types", with_views("signals", """
SELECT company_id, array_to_string(list(signal_type ORDER BY n DESC, signal_type), ',') AS signal_types FROM (
  SELECT company_id, signal_type, count(*) n FROM signals GROUP BY 1, 2) GROUP BY 1"""))
def f7(v):
    return s.ordered_types(v.signals()).select("company_id", F.array_join("signal_types", ",").alias("signal_types"))


@query("f8_overview", with_views("facts signals timeline insights", """
SELECT 'intelligence_records' AS measure, CAST(count(*) AS VARCHAR) AS value FROM facts UNION ALL SELECT 'trigger_signals', CAST(count(*) AS VARCHAR) FROM signals
UNION ALL SELECT 'timeline_events', CAST(count(*) AS VARCHAR) FROM timeline UNION ALL SELECT 'generated_insights', CAST(count(*) AS VARCHAR) FROM insights
UNION ALL SELECT 'ingestion_runs', CAST(count(DISTINCT conv_id) AS VARCHAR) FROM conversations
UNION ALL (SELECT 'latest_run_id', CAST(max(conv_id) AS VARCHAR) FROM conversations)
UNION ALL (SELECT 'latest_run_status', CASE WHEN count(*) > 4 THEN 'success' ELSE 'failed' END FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations))"""))
def f8(v):
    runs = v.raw("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("conv_id").alias("started_at"),
        F.when(F.col("n") > 4, "success").otherwise("failed").alias("status"))
    tables = {"intelligence_records": v.facts(), "trigger_signals": v.signals(), "timeline_events": v.timeline(),
              "generated_insights": v.insights(), "ingestion_runs": runs}
    return s.overview(tables, runs)


@query("f8_overview_distributions", with_views("facts signals", """
SELECT 'signal_type' AS facet, signal_type AS name, count(*) AS count FROM signals GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM facts GROUP BY 2"""))
def f8b(v):
    types = s.value_counts(v.signals(), "signal_type").withColumn("facet", F.lit("signal_type"))
    return types.unionByName(s.value_counts(v.facts(), "source").withColumn("facet", F.lit("source")))


@query("f9_facets", with_views("companies facts signals", """
SELECT 'regions' AS facet, region AS name, count(*) AS count FROM companies WHERE region <> '' GROUP BY 2
UNION ALL SELECT 'segments', x, count(*) FROM (SELECT unnest(segments) x FROM companies) GROUP BY 2
UNION ALL SELECT 'industries', x, count(*) FROM (SELECT unnest(industries) x FROM companies) GROUP BY 2
UNION ALL SELECT 'signal_types', signal_type, count(*) FROM signals GROUP BY 2
UNION ALL SELECT 'sources', source, count(*) FROM (SELECT source FROM signals UNION ALL SELECT source FROM facts) GROUP BY 2
UNION ALL SELECT 'datasets', dataset, count(*) FROM (SELECT dataset FROM signals UNION ALL SELECT dataset FROM facts) GROUP BY 2"""))
def f9(v):
    return s.facets(v.companies(), v.signals(), v.facts())


@query("f10_dashboard_rollup", with_views("companies signals", """
SELECT count(*) AS lead_pool, count(*) FILTER (WHERE priority_level = 'high') AS high_priority, count(*) FILTER (WHERE cross_border_signal_count > 0) AS cross_border,
 count(*) FILTER (WHERE financing_signal_count > 0) AS financing_signals, max(activity_at) AS last_updated FROM light""", LIGHT))
def f10(v):
    return s.dashboard(_light(v))


@query("f10_dashboard_breakdown", with_views("companies", """
SELECT 'industry' AS facet, x AS name, count(*) AS count FROM (SELECT unnest(industries) x FROM companies) GROUP BY 2
UNION ALL SELECT 'region', region, count(*) FROM companies GROUP BY 2"""))
def f10b(v):
    latest = s.latest_companies(v.companies())
    industries = s.value_counts(latest.select(F.explode("industries").alias("x")), "x").withColumn("facet", F.lit("industry"))
    return industries.unionByName(s.value_counts(latest, "region").withColumn("facet", F.lit("region")))


@query("f11_index_status", """
SELECT count(*) AS document_count, (SELECT count(*) FROM conversations) AS chunk_count,
 (SELECT count(DISTINCT vec_id) FROM embeddings WHERE label = 3) AS embedded_chunk_count,
 (SELECT max(TIMESTAMP '2024-01-01' + to_minutes(vec_id)) FROM embeddings WHERE label = 3) AS last_embedded_at FROM documents""")
def f11(v):
    vectors = v.raw("embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("embedding_model"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(vec_id as int))").alias("created_at"))
    return s.index_status(v.raw("documents"), v.raw("conversations"), vectors, "3")


@query("f15_distributions", """
SELECT coalesce(CASE WHEN s_acctbal >= 0 THEN 'nation ' || CAST(s_nationkey AS VARCHAR) END, 'Unknown') AS name, count(*) AS count FROM supplier GROUP BY 1""")
def f15(v):
    key = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")))
    return s.value_counts(v.raw("supplier"), key, bucket="Unknown")


@query("f15_size_buckets", """
SELECT CASE WHEN b = 'B' THEN 'Large (>HKD 1B)' WHEN b = 'M' THEN 'Medium (HKD 100M-1B)' ELSE 'Unverified' END AS name, count(*) AS count FROM (
 SELECT CASE WHEN o_totalprice >= 400000 THEN 'B' WHEN o_totalprice >= 100000 THEN 'M' END AS b FROM orders) GROUP BY 1""")
def f15b(v):
    from intelspark.operators.classify import size_bucket

    unit = F.when(F.col("o_totalprice") >= 400000, "HKD 4B").when(F.col("o_totalprice") >= 100000, "HKD 100M")
    return s.value_counts(v.raw("orders").select(size_bucket(unit).alias("b")), "b")


@query("f16_job_summary", """
SELECT count(*) AS scanned, count(*) FILTER (WHERE quality = 1) AS succeeded, count(*) FILTER (WHERE quality = 0) AS errors,
 CASE WHEN count(*) FILTER (WHERE quality = 0) = 0 THEN 'success' WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM labels""")
def f16(v):
    from intelspark.sinks.ledger import job_summary

    return job_summary(v.raw("labels").select((F.col("quality") == 0).alias("failed")))


# ------------------------------------------------------------------ windows


@query("g1_latest_company", with_views("company_versions", """
SELECT id, company_id, status_text, value_num, updated_at FROM company_versions QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY updated_at DESC, id DESC) = 1"""))
def g1(v):
    return s.latest_companies(v.company_versions())


@query("g2_recent_signals", with_views("signals", """
SELECT id, company_id, signal_type, CAST(row_number() OVER (PARTITION BY company_id ORDER BY event_time DESC, id DESC) AS INTEGER) AS rank
FROM signals QUALIFY rank <= 10"""))
def g2(v):
    return s.top_n(v.signals(), "company_id", 10, F.desc("event_time"), F.desc("id")).select("id", "company_id", "signal_type", "rank")


@query("g3_recent_documents", with_views("docs", """
SELECT id, company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY parsed_at DESC, id DESC) AS INTEGER) AS rank FROM docs QUALIFY rank <= 5"""))
def g3(v):
    return s.top_n(v.documents(), "company_id", 5, F.desc("parsed_at"), F.desc("id")).select("id", "company_id", "rank")


def _key_items(name, kind):
    @query(name, with_views("children", f"""
SELECT company_id, document_id, child_index, value_num, summary, CAST(row_number() OVER (PARTITION BY company_id
  ORDER BY parsed_at DESC, confidence DESC, child_index, document_id, tie_1, tie_2, tie_3) AS INTEGER) AS rank
FROM children WHERE kind = '{kind}' QUALIFY rank <= 8"""))
    def build(v):
        return s.key_children(v.children(), kind).select("company_id", "document_id", "child_index", "value_num", "summary", "rank")


_key_items("g4_key_metrics", "metric")
_key_items("g5_key_risks", "risk")
_key_items("g6_key_events", "event")


@query("g7_latest_parse", with_views("docs", """
SELECT source, lang, id, parse_status FROM docs QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY parsed_at DESC, id DESC) = 1"""))
def g7(v):
    return s.latest_by(v.documents(), ["source", "lang"], F.desc("parsed_at"), F.desc("id")).select("source", "lang", "id", "parse_status")


# ------------------------------------------------------------------ set operations


@query("h1_document_source_rows", with_views("facts signals timeline", """
SELECT 'intelligence_records' AS source_table, id AS source_id, source, dataset, record_key, NULL AS signal_key, entity, company_id, event_time, NULL AS signal_type, title, NULL AS signal_text FROM facts
UNION ALL SELECT 'trigger_signals', id, source, dataset, NULL, signal_key, entity, company_id, event_time, signal_type, indicator, signal_text FROM signals WHERE signal_text <> ''
UNION ALL SELECT 'client_one_view_timeline', id, source, event_type, NULL, NULL, NULL, company_id, event_time, NULL, headline, NULL FROM timeline"""))
def h1(v):
    from intelspark.operators.retrieval import source_rows

    return source_rows(v.facts(), v.signals(), v.timeline()).select(
        "source_table", "source_id", "source", "dataset", "record_key", "signal_key", "entity", "company_id", "event_time", "signal_type", "title", "signal_text")


@query("h2_merge_counts", with_views("facts signals", """
SELECT source AS name, count(*) AS count FROM (SELECT source FROM facts UNION ALL SELECT source FROM signals) GROUP BY 1"""))
def h2(v):
    return s.merge_counts(s.value_counts(v.facts(), "source"), s.value_counts(v.signals(), "source"))


@query("h3_ordered_distinct", with_views("signals", """
SELECT id, company_id, signal_type, signal_level FROM signals QUALIFY row_number() OVER (PARTITION BY company_id, signal_type, signal_level ORDER BY id) = 1"""))
def h3(v):
    return s.first_by_position(v.signals(), ["company_id", "signal_type", "signal_level"], "id").select("id", "company_id", "signal_type", "signal_level")


@query("i26_light_scorecard", with_views("companies signals", """
SELECT company_id, status, opportunity_score, risk_score, evidence_confidence_score, priority_score, priority_level FROM light""", LIGHT))
def i26(v):
    return _light(v).select("company_id", "status", "opportunity_score", "risk_score", "evidence_confidence_score", "priority_score", "priority_level")


@query("i26_compact_themes", with_views("signals", """
SELECT company_id, array_to_string(CASE WHEN len(t) = 0 THEN ['Corporate Banking'] ELSE t[1:4] END, ',') AS themes FROM (
 SELECT company_id, list_concat(list_concat(CASE WHEN list_has_any(tags, ['cross_border','trade']) THEN ['cross-border payments','trade finance','treasury'] ELSE [] END,
   CASE WHEN list_has_any(tags, ['financing','growth','expansion','acquisition','m&a']) THEN ['working capital','term loan','cash management'] ELSE [] END),
   list_concat(CASE WHEN list_contains(tags, 'market') THEN ['capital markets'] ELSE [] END,
   CASE WHEN list_has_any(tags, ['risk','regulatory','compliance','warning','litigation','risk_review']) THEN ['risk review'] ELSE [] END)) AS t
 FROM (SELECT company_id, (list(signal_type ORDER BY n DESC, signal_type))[1:3] AS tags FROM (SELECT company_id, signal_type, count(*) n FROM signals GROUP BY 1, 2) GROUP BY 1))"""))
def i26b(v):
    tags = s.ordered_types(v.signals()).select("company_id", F.slice("signal_types", 1, 3).alias("tags"))
    return tags.select("company_id", F.array_join(light.product_themes(F.col("tags")), ",").alias("themes"))


@query("i31_display_bands", with_views("companies signals", """
SELECT company_id, CASE priority_level WHEN 'high' THEN 'A' WHEN 'medium' THEN 'B' ELSE 'C' END AS tier,
 CASE WHEN priority_score >= 50 THEN 'High' WHEN priority_score >= 38 THEN 'Medium' ELSE 'Low' END AS priority_band,
 CASE WHEN risk_score <= 10 THEN 'Low friction' WHEN risk_score <= 35 THEN 'Manageable risk' ELSE 'Elevated risk' END AS risk_band,
 CASE WHEN opportunity_score >= 70 THEN 'Strong' WHEN opportunity_score >= 40 THEN 'Moderate' WHEN opportunity_score > 0 THEN 'Early signal' ELSE 'No clear signal' END AS opportunity_band,
 'Evidence confidence: ' || CASE WHEN evidence_confidence_score >= 85 THEN 'High' WHEN evidence_confidence_score >= 70 THEN 'Moderate' ELSE 'Review' END
   || ' (' || CAST(evidence_confidence_score AS VARCHAR) || '/100)' AS confidence_label FROM light""", LIGHT))
def i31(v):
    return _light(v).select(
        "company_id", light.tier(F.col("priority_level")).alias("tier"),
        light.score_band(F.col("priority_score"), "priority").alias("priority_band"),
        light.score_band(F.col("risk_score"), "risk").alias("risk_band"),
        light.score_band(F.col("opportunity_score"), "opportunity").alias("opportunity_band"),
        light.confidence_text(F.col("evidence_confidence_score")).alias("confidence_label"))


@query("i32_prospect_slices", with_views("signals timeline insights", """
SELECT 'signal' AS kind, id, company_id FROM signals QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY event_time DESC, id DESC) <= 3
UNION ALL SELECT 'timeline', id, company_id FROM timeline QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY event_time DESC, id DESC) <= 3
UNION ALL SELECT 'insight', id, company_id FROM insights QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY generated_at DESC, id DESC) <= 3"""))
def i32(v):
    parts = [("signal", v.signals(), "event_time"), ("timeline", v.timeline(), "event_time"), ("insight", v.insights(), "generated_at")]
    out = None
    for kind, df, time in parts:
        part = s.top_n(df, "company_id", 3, F.desc_nulls_last(time), F.desc("id")).select(F.lit(kind).alias("kind"), "id", "company_id")
        out = part if out is None else out.unionByName(part)
    return out
