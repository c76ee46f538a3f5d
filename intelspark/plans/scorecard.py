"""Queries of the full scorecard, the recommendation layer and the reviews.

The checker SQL is relational throughout: evidence items are rows with a position, where the
Spark side works on bounded arrays.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from intelspark import rules
from intelspark.bindings import with_views
from intelspark.operators import fusion as fu
from intelspark.operators import scorecard as sc
from intelspark.operators import serving as s
from intelspark.plans.registry import query

VIEWS = "companies signals timeline insights docs children"
OPP, RISK = "('growth','cross_border','market','financing','expansion','acquisition','m&a','trade')", "('risk','regulatory','compliance','warning','litigation')"
CTX = "('market','cross_border','trade','policy','macro','financing')"

STATE = f"""
sig10 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY event_time DESC, id DESC) AS rank FROM signals QUALIFY rank <= 10),
kid8 AS (SELECT *, row_number() OVER (PARTITION BY company_id, kind ORDER BY parsed_at DESC, confidence DESC, child_index, document_id, tie_1, tie_2, tie_3) AS rank
  FROM children QUALIFY rank <= 8),
topdoc AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY parsed_at DESC, id DESC) = 1),
typ AS (SELECT company_id, list(signal_type ORDER BY n DESC, signal_type) AS types FROM (SELECT company_id, signal_type, count(*) n FROM signals GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT c.company_id, c.canonical_name, c.region, coalesce(sg.n, 0) AS signal_count, coalesce(tl.n, 0) AS timeline_event_count, coalesce(ins.n, 0) AS generated_insight_count,
    coalesce(dc.n, 0) AS parsed_document_count, coalesce(dc.md, 0) AS management_discussion_count, coalesce(dc.mc, 0) AS metric_count, coalesce(dc.rc, 0) AS risk_factor_count,
    coalesce(dc.bc, 0) AS business_event_count, coalesce(dc.ocr, 0) AS ocr_hit_count, coalesce(dc.xbrl, 0) AS xbrl_hit_count, coalesce(ne.n, 0) AS n_events, coalesce(typ.types, []) AS types,
    greatest(sg.t, tl.t, ins.t, dc.t) AS activity_at
  FROM companies c
  LEFT JOIN (SELECT company_id, count(*) n, max(event_time) t FROM signals GROUP BY 1) sg ON sg.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(*) n, max(event_time) t FROM timeline GROUP BY 1) tl ON tl.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(*) n, max(generated_at) t FROM insights GROUP BY 1) ins ON ins.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(*) n, count(management_discussion_summary) md, sum(metric_count) mc, sum(risk_factor_count) rc, sum(business_event_count) bc,
      count(*) FILTER (WHERE lower(ocr_status) IN ('used','success','completed','hit')) ocr, count(*) FILTER (WHERE lower(xbrl_status) IN ('used','success','completed','hit')) xbrl,
      max(parsed_at) t FROM docs GROUP BY 1) dc ON dc.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(*) n FROM kid8 WHERE kind = 'event' GROUP BY 1) ne ON ne.company_id = c.company_id
  LEFT JOIN typ ON typ.company_id = c.company_id),
raw AS (
  SELECT company_id, 'o' AS lst, rank AS ord, ttl || ' signal' AS title, split_part(signal_text, '. ', 1) AS detail, 'trigger_signal' AS source_type, source, signal_type, NULL AS severity
    FROM sig10 JOIN (VALUES ('growth','Growth'),('cross_border','Cross Border'),('financing','Financing')) m(k, ttl) ON signal_type = k WHERE signal_type IN {OPP}
  UNION ALL SELECT company_id, 'o', 100 + rank, upper(event_type[1]) || event_type[2:] || ' event', split_part(summary, '; ', 1), 'parsed_business_event', 'parsed_documents', event_type, NULL
    FROM kid8 WHERE kind = 'event'
  UNION ALL SELECT company_id, 'o', 1000, 'Management discussion takeaway', split_part(management_discussion_summary, '. ', 1), 'parsed_document', source, 'management_discussion', NULL
    FROM topdoc WHERE management_discussion_summary <> ''
  UNION ALL SELECT company_id, 'r', rank, 'Risk signal', split_part(signal_text, '. ', 1), 'trigger_signal', source, signal_type, signal_level FROM sig10 WHERE signal_type IN {RISK}
  UNION ALL SELECT company_id, 'r', 100 + rank, upper(category[1]) || category[2:] || ' risk', split_part(summary, '; ', 1), 'parsed_risk_factor', 'parsed_documents', category, severity
    FROM kid8 WHERE kind = 'risk'
  UNION ALL SELECT company_id, 'c', rank, ttl || ' context', split_part(signal_text, '. ', 1), 'market_signal', source, signal_type, signal_level
    FROM sig10 JOIN (VALUES ('policy','Policy'),('cross_border','Cross Border'),('financing','Financing')) m(k, ttl) ON signal_type = k WHERE signal_type IN {CTX}
  UNION ALL SELECT company_id, 'c', 1000, 'Company context from latest report', split_part(management_discussion_summary, '. ', 1), 'parsed_document', source, 'company_context', NULL
    FROM topdoc WHERE management_discussion_summary <> ''),
once AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY company_id, lst, title, detail, source_type ORDER BY ord) = 1),
items AS (SELECT *, row_number() OVER (PARTITION BY company_id, lst ORDER BY ord) AS pos, coalesce(nullif(detail, ''), title) AS txt,
    'direct_company_link' AS linkage_type, 'strong' AS linkage_strength FROM once QUALIFY pos <= CASE lst WHEN 'c' THEN 5 ELSE 4 END),
cnt AS (SELECT company_id, count(*) FILTER (WHERE lst = 'o') AS n_o, count(*) FILTER (WHERE lst = 'r') AS n_r, count(*) FILTER (WHERE lst = 'c') AS n_c,
    count(*) FILTER (WHERE lst = 'o' AND signal_type IN ('growth','expansion','acquisition','m&a','management_discussion')) AS n_growth,
    count(*) FILTER (WHERE lst IN ('o','c') AND signal_type IN ('cross_border','trade')) AS n_border,
    count(*) FILTER (WHERE lst = 'o' AND signal_type IN ('financing','growth','expansion')) AS n_fin,
    max(CASE WHEN lst = 'r' THEN CASE lower(coalesce(severity, '')) WHEN 'high' THEN 35 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 ELSE 15 END END) AS penalty,
    bool_or(lst = 'r' AND severity = 'high') AS any_high, count(DISTINCT nullif(source, '')) AS n_sources FROM items GROUP BY 1),
s0 AS (SELECT st.*, coalesce(n_o, 0) AS n_o, coalesce(n_r, 0) AS n_r, coalesce(n_c, 0) AS n_c, coalesce(n_growth, 0) AS n_growth, coalesce(n_border, 0) AS n_border, coalesce(n_fin, 0) AS n_fin,
    penalty, coalesce(any_high, false) AS any_high, coalesce(n_sources, 0) AS n_sources,
    CASE WHEN generated_insight_count > 0 OR coalesce(n_o, 0) >= 2 OR coalesce(n_r, 0) >= 2 THEN 'actionable'
         WHEN signal_count > 0 OR parsed_document_count > 0 OR timeline_event_count > 0 THEN 'active' ELSE 'monitor' END AS status
  FROM st LEFT JOIN cnt ON cnt.company_id = st.company_id),
catalog AS (SELECT * FROM (VALUES ('cross-border payments', 88, ['cross_border','trade'], false), ('trade finance', 80, ['cross_border','trade'], false), ('treasury', 78, ['cross_border','trade'], false),
    ('working capital', 76, ['growth','expansion','financing','management_discussion'], false), ('term loan', 73, ['financing','expansion','acquisition','m&a'], false),
    ('cash management', 72, ['growth','expansion','financing','cross_border','management_discussion'], false), ('capital markets', 68, ['market','acquisition','m&a'], false),
    ('risk review', 64, ['-'], true)) p(product, fit, kinds, risk)),
sup AS (SELECT company_id, product, fit, txt, row_number() OVER (PARTITION BY company_id, product ORDER BY CASE lst WHEN 'o' THEN 1 WHEN 'c' THEN 2 ELSE 3 END, pos) AS k
  FROM items JOIN catalog ON (risk AND lst = 'r') OR (NOT risk AND list_contains(kinds, signal_type)) QUALIFY k <= 3),
supt AS (SELECT company_id, product, txt, min(k) AS k FROM sup GROUP BY 1, 2, 3),
pf AS (SELECT a.company_id, a.product, a.fit, b.texts[1:2] AS supporting, row_number() OVER (PARTITION BY a.company_id ORDER BY a.fit DESC, a.product) AS pos
  FROM (SELECT DISTINCT company_id, product, fit FROM sup) a JOIN (SELECT company_id, product, list(txt ORDER BY k) AS texts FROM supt GROUP BY 1, 2) b
  ON a.company_id = b.company_id AND a.product = b.product QUALIFY pos <= 4),
pfl AS (SELECT company_id, list(product ORDER BY pos) AS products, max(fit) AS top_fit, first(supporting ORDER BY pos) AS top_supporting FROM pf GROUP BY 1)"""

FEATS = """,
f0 AS (SELECT s0.*, coalesce(products, []) AS products, products[1] AS top_product, top_fit,
    (parsed_document_count > 0)::INT + (management_discussion_count > 0)::INT + (metric_count > 0)::INT + (business_event_count > 0)::INT + (risk_factor_count > 0)::INT AS covered
  FROM s0 LEFT JOIN pfl ON pfl.company_id = s0.company_id),
feats AS (
  SELECT company_id, 'growth_activity_intensity' AS feature_key, 'commercial_attractiveness' AS feature_group, n_growth::DOUBLE AS value_num, least(n_growth * 12, 24)::INT AS points FROM f0 WHERE n_growth > 0
  UNION ALL SELECT company_id, 'market_visibility', 'commercial_attractiveness', (n_o + n_c)::DOUBLE, least((n_o + n_c) * 4, 12)::INT FROM f0 WHERE signal_count > 0
  UNION ALL SELECT company_id, 'business_event_specificity', 'commercial_attractiveness', n_events::DOUBLE, least(n_events * 10, 10)::INT FROM f0 WHERE n_events > 0
  UNION ALL SELECT company_id, 'recent_activity_momentum', 'immediacy', (signal_count + timeline_event_count)::DOUBLE, least((signal_count + timeline_event_count) * 4, 12)::INT FROM f0 WHERE signal_count + timeline_event_count > 0
  UNION ALL SELECT company_id, 'management_update_availability', 'immediacy', 1.0::DOUBLE, 10 FROM f0 WHERE management_discussion_count > 0
  UNION ALL SELECT company_id, 'top_product_fit_strength', 'product_fit', top_fit::DOUBLE, least(CAST(trunc(top_fit / 10) AS INT), 15) FROM f0 WHERE len(products) > 0
  UNION ALL SELECT company_id, 'cross_border_operating_exposure', 'product_fit', n_border::DOUBLE, least(n_border * 6, 18)::INT FROM f0 WHERE n_border > 0
  UNION ALL SELECT company_id, 'linked_risk_severity', 'risk_penalty', n_r::DOUBLE, least(penalty, 35)::INT FROM f0 WHERE n_r > 0
  UNION ALL SELECT company_id, 'structured_risk_coverage', 'risk_penalty', risk_factor_count::DOUBLE, 10 FROM f0 WHERE risk_factor_count > 0
  UNION ALL SELECT company_id, 'direct_evidence_ratio', 'evidence_confidence', 1.0::DOUBLE, 30 FROM f0 WHERE n_o + n_r + n_c > 0
  UNION ALL SELECT company_id, 'structured_evidence_coverage', 'evidence_confidence', covered::DOUBLE, least(covered * 5, 25)::INT FROM f0 WHERE covered > 0
  UNION ALL SELECT company_id, 'source_diversity', 'evidence_confidence', n_sources::DOUBLE, least(n_sources * 5, 15)::INT FROM f0 WHERE n_sources > 0),
grp AS (SELECT company_id, least(coalesce(sum(points) FILTER (WHERE feature_group = 'commercial_attractiveness'), 0), 40)::INT AS commercial,
    least(coalesce(sum(points) FILTER (WHERE feature_group = 'immediacy'), 0), 25)::INT AS immediacy, least(coalesce(sum(points) FILTER (WHERE feature_group = 'product_fit'), 0), 35)::INT AS fit_score,
    least(coalesce(sum(points) FILTER (WHERE feature_group = 'risk_penalty'), 0), 100)::INT AS risk, least(coalesce(sum(points) FILTER (WHERE feature_group = 'evidence_confidence'), 0), 100)::INT AS conf
  FROM feats GROUP BY 1),
g0 AS (SELECT f0.*, coalesce(commercial, 0) AS commercial, coalesce(immediacy, 0) AS immediacy, coalesce(fit_score, 0) AS fit_score, coalesce(risk, 0) AS risk, coalesce(conf, 0) AS conf
  FROM f0 LEFT JOIN grp ON grp.company_id = f0.company_id)"""

SCORES = """,
p0 AS (SELECT *, least(commercial + immediacy + fit_score, 100)::INT AS opportunity_score, least(risk, 100)::INT AS risk_score FROM g0),
p1 AS (SELECT *, CAST(trunc(opportunity_score * CAST(0.6 AS DOUBLE)) AS INT) AS w1, CAST(trunc(conf * CAST(0.15 AS DOUBLE)) AS INT) AS w2,
    CAST(trunc(greatest(0, 40 - risk_score) * CAST(0.25 AS DOUBLE)) AS INT) AS w3 FROM p0),
p2 AS (SELECT *, least(w1 + w2 + w3, 100)::INT AS priority_score FROM p1),
p3 AS (SELECT *, CASE WHEN status = 'actionable' AND priority_score >= 50 THEN 'high' WHEN priority_score >= 38 THEN 'medium' ELSE 'monitor' END AS priority_level FROM p2)"""

LENS = """,
q0 AS (SELECT p3.*, list_filter(products, lambda p: p IN ('working capital','cash management','capital markets','cross-border payments'))[1:3] AS pa,
    list_filter(products, lambda p: p IN ('working capital','term loan','cash management'))[1:3] AS pfin,
    list_filter(products, lambda p: p IN ('cross-border payments','trade finance','treasury'))[1:3] AS pcb,
    o1.txt AS primary_opportunity, r1.txt AS key_risk, CASE WHEN c1.detail <> '' THEN 'Directly linked context reinforces the company evidence: ' || c1.detail END AS context_alignment
  FROM p3 LEFT JOIN items o1 ON o1.company_id = p3.company_id AND o1.lst = 'o' AND o1.pos = 1
  LEFT JOIN items r1 ON r1.company_id = p3.company_id AND r1.lst = 'r' AND r1.pos = 1
  LEFT JOIN items c1 ON c1.company_id = p3.company_id AND c1.lst = 'c' AND c1.pos = 1),
q1 AS (SELECT *,
    CAST(greatest(0, least(100, round_even(commercial + immediacy * CAST(0.8 AS DOUBLE) + least(conf / CAST(4 AS DOUBLE), 20.0::DOUBLE) - risk / CAST(3 AS DOUBLE) + CASE WHEN len(pa) > 0 THEN 8 ELSE 0 END, 0))) AS INT) AS acq,
    CAST(greatest(0, least(100, round_even(fit_score * CAST(1.2 AS DOUBLE) + immediacy * CAST(0.6 AS DOUBLE) + n_fin * 6 + conf / CAST(5 AS DOUBLE) - risk / CAST(3 AS DOUBLE) + CASE WHEN len(pfin) > 0 THEN 6 ELSE 0 END, 0))) AS INT) AS fin,
    CASE WHEN n_border = 0 AND len(pcb) = 0 THEN 0 ELSE CAST(greatest(0, least(100, round_even(n_border * 18 + CASE WHEN len(pcb) > 0 THEN 18 ELSE 0 END + immediacy * CAST(0.5 AS DOUBLE) + conf / CAST(5 AS DOUBLE) - risk / CAST(4 AS DOUBLE), 0))) AS INT) END AS cb
  FROM q0),
q2 AS (SELECT *, CASE WHEN fin >= acq AND fin >= cb THEN 'financing' WHEN cb >= acq AND cb > fin THEN 'cross_border' ELSE 'acquisition' END AS lens FROM q1),
q3 AS (SELECT *, CASE lens WHEN 'acquisition' THEN 'client acquisition' WHEN 'financing' THEN 'financing need' ELSE 'cross-border opportunity' END AS lens_label,
    CASE WHEN n_r > 0 AND any_high THEN 'review high-severity risks before outreach and decide whether escalation is required'
         WHEN n_r > 0 THEN 'review latest risk factors alongside business signals before RM outreach'
         WHEN top_product IS NULL THEN 'review linked evidence and prepare RM follow-up'
         WHEN lens = 'cross_border' THEN 'prepare RM outreach anchored on ' || top_product || ' and validate the cross-border evidence path'
         WHEN lens = 'financing' THEN 'prepare financing-focused outreach anchored on ' || top_product || ' and confirm timing through recent filings'
         ELSE 'prepare acquisition outreach anchored on ' || top_product || ' and validate the supporting evidence' END AS next_step,
    nullif(concat_ws('; ', 'opportunity: ' || primary_opportunity, 'context: ' || context_alignment, 'risk watch: ' || key_risk), '') AS why_now
  FROM q2),
q AS (SELECT *, concat_ws('; ', 'Direct company evidence points to ' || primary_opportunity, 'the strongest current lens is ' || lens_label, 'with ' || top_product || ' as the leading product hypothesis',
      lower(context_alignment), 'while keeping in view that ' || lower(key_risk)) AS fusion_summary,
    CASE status WHEN 'actionable' THEN 'Company has enough linked evidence for immediate RM follow-up' WHEN 'active' THEN 'Company has recent linked evidence worth review'
      ELSE 'Company currently has limited linked evidence' END || CASE WHEN signal_count + parsed_document_count + generated_insight_count > 0 THEN ': ' || concat_ws(', ',
      CASE WHEN signal_count > 0 THEN signal_count || ' recent signals' END, CASE WHEN parsed_document_count > 0 THEN parsed_document_count || ' parsed documents' END,
      CASE WHEN generated_insight_count > 0 THEN generated_insight_count || ' generated insights' END) || '.' ELSE '' END AS state_summary,
    CASE WHEN signal_count > 0 THEN signal_count || ' recent signals linked, led by ' || array_to_string(types[1:3], ', ') END AS hl1,
    CASE WHEN parsed_document_count > 0 THEN concat_ws(', ', parsed_document_count || ' parsed documents', CASE WHEN management_discussion_count > 0 THEN management_discussion_count || ' with management discussion' END,
      CASE WHEN ocr_hit_count > 0 THEN 'OCR support hit' END, CASE WHEN xbrl_hit_count > 0 THEN 'XBRL support hit' END) END AS hl2,
    CASE WHEN metric_count + risk_factor_count + business_event_count > 0 THEN 'Structured extraction captured ' || concat_ws(', ', CASE WHEN metric_count > 0 THEN metric_count || ' metrics' END,
      CASE WHEN risk_factor_count > 0 THEN risk_factor_count || ' risk factors' END, CASE WHEN business_event_count > 0 THEN business_event_count || ' business events' END) END AS hl3,
    canonical_name || ' is currently in ' || status || ' state, and the strongest business case points to ' || lens_label || '.' AS answer1,
    coalesce(why_now, 'Current evidence is still limited, so immediate outreach is not yet strongly supported.') AS answer2
  FROM q3)"""

FULL = STATE + FEATS + SCORES + LENS


def _sql(body: str, ctes: str = FULL) -> str:
    return with_views(VIEWS, body, ctes)


def _profile(v):
    return sc.profile(v.companies(), v.signals(), v.timeline(), v.insights(), v.documents(), v.children())


def _items(v):
    return sc.linked_items(sc.item_rows(v.signals(), v.documents(), v.children()))


def _state(v):
    return sc.company_state(_profile(v))


def _features(v):
    rows = sc.with_features(_state(v)).select("company_id", F.explode_outer("decision_features").alias("f"))
    return rows.filter(F.col("f").isNotNull()).select("company_id", "f.*")


def _prospects(v):
    return fu.prospects(_profile(v))


def _joined(name, sep="|"):
    return F.array_join(name, sep)


# ------------------------------------------------------------------ state


@query("i1_linkage", with_views("companies signals", """
, pairs AS (SELECT s.id, s.signal_type, s.entity, s.company_id AS signal_company, CAST((s.id - s.id % 2) % (SELECT count(*) FROM customer) AS VARCHAR) AS viewer FROM signals s)
SELECT p.id, c.company_id, t.linkage_type, t.strength AS linkage_strength, t.scoring AS supports_company_scoring, t.ctx AS context_only
FROM (SELECT *, CASE WHEN signal_company = viewer THEN 'direct_company_link' WHEN signal_type IN ('market','policy','macro') THEN 'macro_context_link'
  WHEN signal_type IN ('cross_border','trade') AND entity <> '' THEN 'cross_border_exposure_link' ELSE 'industry_link' END AS lt FROM pairs) p
JOIN companies c ON c.company_id = p.viewer
JOIN (VALUES ('direct_company_link','strong',true,false),('industry_link','medium',true,false),('region_link','medium',true,false),
  ('cross_border_exposure_link','medium',true,false),('macro_context_link','weak',false,true)) t(linkage_type, strength, scoring, ctx) ON t.linkage_type = p.lt""").replace("\n, pairs", ",\npairs"))
def i1(v):
    # Every signal seen from the company of its even neighbour: half of the pairs are direct.
    n = v.raw("customer").agg(F.count(F.lit(1))).scalar()
    pairs = v.signals().withColumnRenamed("company_id", "signal_company").withColumn(
        "company_id", ((F.col("id") - F.col("id") % 2) % n).cast("string"))
    df = pairs.join(v.companies().select("company_id", "region"), "company_id")
    kind = sc.linkage_type(F.col("signal_company"), F.col("company_id"), F.col("signal_type"), F.col("entity"), F.col("region"))
    return sc.with_linkage(df, kind).select("id", "company_id", "linkage_type", "linkage_strength", "supports_company_scoring", "context_only")


def _item_query(name, lst):
    @query(name, _sql(f"""
SELECT company_id, CAST(pos AS INT) AS pos, title, detail, source_type, source, signal_type, severity, linkage_type, linkage_strength FROM items WHERE lst = '{lst}'""", STATE))
    def build(v):
        names = {"o": "opportunity", "r": "risk", "c": "context"}
        return _items(v).filter(F.col("list") == names[lst]).select(
            "company_id", "pos", "title", "detail", "source_type", "source", "signal_type", "severity", "linkage_type", "linkage_strength")


_item_query("i2_opportunity_items", "o")
_item_query("i3_risk_items", "r")
_item_query("i4_context_items", "c")


@query("i5_coverage_flags", _sql("""
SELECT company_id, signal_count > 0 AS has_recent_signals, timeline_event_count > 0 AS has_recent_timeline, generated_insight_count > 0 AS has_generated_insights,
 parsed_document_count > 0 AS has_parsed_reports, management_discussion_count > 0 AS has_management_discussion, metric_count > 0 AS has_structured_metrics,
 risk_factor_count > 0 AS has_risk_factors, business_event_count > 0 AS has_business_events, ocr_hit_count > 0 AS has_ocr_support, xbrl_hit_count > 0 AS has_xbrl_support FROM st""", STATE))
def i5(v):
    return sc.company_counts(v.companies(), v.signals(), v.timeline(), v.insights(), v.documents()).select("company_id", *sc.FLAGS)


@query("i6_focus_tags", _sql("""
SELECT st.company_id, array_to_string(list_concat(types[1:3], list_filter([e.event_type, CASE WHEN management_discussion_count > 0 THEN 'management_discussion' END,
 CASE WHEN xbrl_hit_count > 0 THEN 'xbrl' END, CASE WHEN risk_factor_count > 0 THEN 'risk_review' END], lambda x: x IS NOT NULL)), '|') AS focus_tags
FROM st LEFT JOIN (SELECT company_id, event_type FROM kid8 WHERE kind = 'event' AND rank = 1) e ON e.company_id = st.company_id""", STATE))
def i6(v):
    return _profile(v).select("company_id", _joined(sc.focus_tags()).alias("focus_tags"))


@query("i7_product_fit", _sql("""
SELECT company_id, CAST(pos AS INT) AS pos, product AS product_name, fit AS fit_score, array_to_string(supporting, '|') AS supporting_signals FROM pf""", STATE))
def i7(v):
    state = _profile(v).select("company_id", F.posexplode_outer(sc.product_fit()).alias("p", "x"))
    return state.filter(F.col("x").isNotNull()).select(
        "company_id", (F.col("p") + 1).alias("pos"), "x.product_name", "x.fit_score", _joined("x.supporting_signals").alias("supporting_signals"))


def _feature_query(number, key):
    @query(f"i8_{number}_{key}", _sql(f"SELECT company_id, value_num, points AS score_contribution FROM feats WHERE feature_key = '{key}'", STATE + FEATS))
    def build(v):
        # One feature needs its own scalar columns only, not the whole feature array.
        present, value, _ = sc.FEATURE_RULES[key]
        return _state(v).filter(F.expr(present)).select(
            "company_id", F.expr(f"cast({value} AS double)").alias("value_num"), F.col(f"points_{key}").alias("score_contribution"))


for _number, _feature in enumerate(rules.FEATURES, start=1):
    _feature_query(_number, _feature[0])


@query("i8_feature_evidence", _sql("""
SELECT company_id, feature_key, array_to_string(list(txt ORDER BY k)[1:3], '|') AS evidence FROM (
 SELECT company_id, feature_key, txt, min(k) AS k FROM (
  SELECT company_id, 'growth_activity_intensity' AS feature_key, txt, pos AS k FROM items WHERE lst = 'o' AND signal_type IN ('growth','expansion','acquisition','m&a','management_discussion')
  UNION ALL SELECT company_id, 'cross_border_operating_exposure', txt, CASE lst WHEN 'o' THEN 0 ELSE 100 END + pos FROM items WHERE lst IN ('o','c') AND signal_type IN ('cross_border','trade')
  UNION ALL SELECT company_id, 'linked_risk_severity', txt, pos FROM items WHERE lst = 'r'
  UNION ALL SELECT company_id, 'direct_evidence_ratio', txt, CASE lst WHEN 'o' THEN 0 WHEN 'r' THEN 100 ELSE 200 END + pos FROM items
  UNION ALL SELECT company_id, 'business_event_specificity', title, rank FROM kid8 WHERE kind = 'event'
 ) GROUP BY 1, 2, 3) GROUP BY 1, 2""", STATE))
def i8e(v):
    rows = _features(v)
    wanted = ("growth_activity_intensity", "cross_border_operating_exposure", "linked_risk_severity", "direct_evidence_ratio", "business_event_specificity")
    return rows.filter(F.col("feature_key").isin(*wanted)).select("company_id", "feature_key", _joined("evidence_items").alias("evidence"))


@query("i9_feature_metadata", _sql("""
SELECT company_id, f.feature_key, d.label AS feature_label, d.question AS business_question, d.cap AS max_score_contribution FROM feats f JOIN (VALUES """
    + ", ".join(f"('{k}', '{label}', '{q}', {cap})" for k, label, _, q, cap in rules.FEATURES) + ") d(k, label, question, cap) ON d.k = f.feature_key", STATE + FEATS))
def i9(v):
    return sc.feature_rows(sc.with_features(_state(v))).select("company_id", "feature_key", "feature_label", "business_question", "max_score_contribution")


@query("i10_status", _sql("SELECT company_id, status FROM s0", STATE))
def i10(v):
    return _profile(v).select("company_id", sc.status().alias("status"))


@query("f13_group_scores", _sql("""
SELECT company_id, commercial AS commercial_attractiveness_score, immediacy AS immediacy_score, fit_score AS product_fit_score, risk AS risk_penalty_score, conf AS evidence_confidence_score FROM g0""", STATE + FEATS))
def f13(v):
    return _state(v).select("company_id", "commercial_attractiveness_score", "immediacy_score", "product_fit_score", "risk_penalty_score", "evidence_confidence_score")


@query("i11_opportunity_risk_scores", _sql("""
SELECT p0.company_id, opportunity_score, risk_score, coalesce(o.parts, '') AS opportunity_components FROM p0 LEFT JOIN (
 SELECT company_id, string_agg(feature_key || '=' || points, '|' ORDER BY feature_key) AS parts FROM feats WHERE feature_group IN ('commercial_attractiveness','immediacy','product_fit') GROUP BY 1) o
 ON o.company_id = p0.company_id""", STATE + FEATS + SCORES))
def i11(v):
    parts = F.transform(sc.score_components("opportunity"), lambda x: F.concat(x["name"], F.lit("="), x["points"].cast("string")))
    return sc.with_features(sc.scored(_state(v))).select("company_id", "opportunity_score", "risk_score", _joined(F.array_sort(parts)).alias("opportunity_components"))


@query("i12_priority_score", _sql("SELECT company_id, w1 AS opportunity_weighted, w2 AS evidence_confidence_weighted, w3 AS risk_buffer, priority_score FROM p3", STATE + FEATS + SCORES))
def i12(v):
    df = sc.scored(_state(v)).withColumn("c", sc.priority_components())
    names = ("opportunity_weighted", "evidence_confidence_weighted", "risk_buffer")
    return df.select("company_id", *[F.get("c", i)["points"].alias(n) for i, n in enumerate(names)], "priority_score")


@query("i13_priority_level", _sql("SELECT company_id, priority_level, priority_score, status FROM p3", STATE + FEATS + SCORES))
def i13(v):
    return sc.scored(_state(v)).select("company_id", "priority_level", "priority_score", "status")


@query("f12_linkage_quality", _sql("""
SELECT company_id, (n_o + n_r + n_c) AS linked_evidence_count, (n_o + n_r + n_c) AS direct_evidence_count, (n_o + n_r + n_c) AS strong_linkage_count, CAST(0 AS BIGINT) AS context_only_count,
 CASE WHEN n_o + n_r + n_c > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS direct_evidence_ratio FROM s0""", STATE))
def f12(v):
    return _profile(v).select("company_id", sc.linkage_quality().alias("q")).select(
        "company_id", "q.linked_evidence_count", "q.direct_evidence_count", "q.strong_linkage_count", "q.context_only_count", "q.direct_evidence_ratio")


@query("f12_linkage_type_counts", _sql("SELECT company_id, linkage_type, count(*) AS count FROM items GROUP BY 1, 2", STATE))
def f12b(v):
    return sc.linkage_type_counts(_items(v))


GOV = """list_filter([CASE WHEN priority_level = 'high' AND conf < 50 THEN 'high_priority_below_confidence_target' END,
 CASE WHEN priority_score >= 50 AND n_o + n_r + n_c = 0 THEN 'priority_relies_on_contextual_linkage' END,
 CASE WHEN risk_score >= 30 AND NOT contains(next_step, 'risk') THEN 'risk_not_explicit_in_next_step' END], lambda x: x IS NOT NULL)"""


@query("i14_governance_flags", _sql(f"SELECT company_id, array_to_string({GOV}, '|') AS governance_flags FROM q"))
def i14(v):
    return _prospects(v).select("company_id", _joined("governance_flags").alias("governance_flags"))


@query("i15_opportunity_lenses", _sql("""
SELECT company_id, 'acquisition' AS lens_key, acq AS lens_score, array_to_string(pa, '|') AS products, lens = 'acquisition' AS leads FROM q
UNION ALL SELECT company_id, 'financing', fin, array_to_string(pfin, '|'), lens = 'financing' FROM q
UNION ALL SELECT company_id, 'cross_border', cb, array_to_string(pcb, '|'), lens = 'cross_border' FROM q"""))
def i15(v):
    df = fu.fused(_state(v)).select("company_id", "primary_lens_key", F.explode_outer(fu.lenses()).alias("l"))
    return df.select("company_id", "l.lens_key", "l.lens_score", _joined("l.recommended_products").alias("products"), (F.col("l.lens_key") == F.col("primary_lens_key")).alias("leads"))


@query("i16_context_alignment", _sql("SELECT company_id, context_alignment FROM q"))
def i16(v):
    return _profile(v).select("company_id", fu.context_alignment().alias("context_alignment"))


@query("i17_next_step", _sql("SELECT company_id, next_step AS recommended_next_step FROM q"))
def i17(v):
    return fu.fused(_state(v)).select("company_id", "recommended_next_step")


@query("i18_entry_angles", _sql("""
SELECT company_id, concat_ws('|', 'Lead with the company event: ' || primary_opportunity,
 CASE WHEN lens = 'cross_border' THEN 'Position the discussion around cross-border execution needs, starting with ' || top_product || '.'
      WHEN lens = 'financing' THEN 'Anchor the conversation on near-term funding or liquidity planning, starting with ' || top_product || '.'
      ELSE 'Open with the current growth window and frame the outreach around why this company merits attention now.' END, context_alignment,
 'Keep the pitch evidence-led and acknowledge the main caution point: ' || key_risk) AS entry_angles FROM q"""))
def i18(v):
    return fu.fused(_state(v)).select("company_id", _joined("recommended_entry_angles").alias("entry_angles"))


@query("i19_fusion_texts", _sql("SELECT company_id, why_now, fusion_summary FROM q"))
def i19(v):
    return fu.fused(_state(v)).select("company_id", "why_now", "fusion_summary")


@query("i20_reasoning_steps", _sql("""
SELECT q.company_id, s.step_key, s.keys AS feature_keys FROM q JOIN (
  SELECT company_id, 'company_evidence' AS step_key, string_agg(feature_key, '|' ORDER BY feature_key) AS keys FROM feats WHERE feature_group IN ('commercial_attractiveness','immediacy') GROUP BY 1
  UNION ALL SELECT company_id, 'context_linkage', string_agg(feature_key, '|' ORDER BY feature_key) FROM feats WHERE feature_group = 'evidence_confidence' GROUP BY 1
  UNION ALL SELECT company_id, 'product_match', string_agg(feature_key, '|' ORDER BY feature_key) FROM feats WHERE feature_group = 'product_fit' GROUP BY 1
  UNION ALL SELECT company_id, 'risk_constraint', string_agg(feature_key, '|' ORDER BY feature_key) FROM feats WHERE feature_group = 'risk_penalty' GROUP BY 1) s ON s.company_id = q.company_id
WHERE (step_key = 'company_evidence' AND n_o > 0) OR (step_key = 'context_linkage' AND n_c > 0) OR (step_key = 'product_match' AND len(products) > 0) OR (step_key = 'risk_constraint' AND n_r > 0)"""))
def i20(v):
    state = fu.fused(sc.with_features(_state(v)))
    rows = state.select("company_id", F.explode_outer(fu.reasoning_steps()).alias("s")).filter(F.col("s").isNotNull())
    return rows.select("company_id", "s.step_key", _joined(F.array_sort("s.feature_keys")).alias("feature_keys"))


@query("i21_decision_answers", _sql("""
SELECT company_id, 'priority' AS question_key, answer1 AS answer FROM q UNION ALL SELECT company_id, 'why_now', answer2 FROM q UNION ALL SELECT company_id, 'entry_angle', next_step FROM q
UNION ALL SELECT company_id, 'risk_watch', coalesce(key_risk, 'No major high-severity risk is visible yet, but evidence coverage is still incomplete.') FROM q
UNION ALL SELECT company_id, 'context', context_alignment FROM q WHERE context_alignment IS NOT NULL
UNION ALL SELECT company_id, 'confidence', 'The current evidence confidence score is ' || conf || '/100, so this should be treated as a strong starting point rather than a final conclusion.' FROM q"""))
def i21(v):
    return _prospects(v).select("company_id", F.explode_outer("decision_answers").alias("a")).select("company_id", "a.question_key", "a.answer")


@query("i22_state_texts", _sql("SELECT company_id, state_summary, concat_ws('|', hl1, hl2, hl3) AS signal_highlights FROM q"))
def i22(v):
    return fu.fused(_state(v)).select("company_id", "state_summary", _joined("signal_highlights").alias("signal_highlights"))


@query("i23_why_prioritized", _sql("""
SELECT company_id, array_to_string(list(txt ORDER BY k)[1:4], '|') AS why_prioritized FROM (SELECT company_id, txt, min(k) AS k FROM (
 SELECT company_id, answer1 AS txt, 1 AS k FROM q UNION ALL SELECT company_id, answer2, 2 FROM q
 UNION ALL SELECT company_id, unnest(list_filter([hl1, hl2, hl3], lambda x: x IS NOT NULL)[1:2]), unnest([3, 4]) FROM q
 UNION ALL SELECT company_id, fusion_summary, 5 FROM q UNION ALL SELECT company_id, why_now, 6 FROM q UNION ALL SELECT company_id, state_summary, 7 FROM q)
 WHERE txt <> '' GROUP BY 1, 2) GROUP BY 1"""))
def i23(v):
    return _prospects(v).select("company_id", _joined("why_prioritized").alias("why_prioritized"))


@query("i24_prospect_summary", _sql(f"""
SELECT 'prospect:' || company_id AS prospect_id, company_id, canonical_name, region, activity_at, status, priority_level, priority_score, opportunity_score, risk_score, conf AS evidence_confidence_score,
 commercial AS commercial_attractiveness_score, immediacy AS immediacy_score, fit_score AS product_fit_score, next_step AS recommended_next_step, array_to_string(products, '|') AS product_themes,
 lens AS primary_lens_key, why_now, fusion_summary, state_summary, array_to_string({GOV}, '|') AS governance_flags, 'prospect-scorecard-v0.2' AS scorecard_version FROM q"""))
def i24(v):
    return _prospects(v).select(
        "prospect_id", "company_id", "canonical_name", "region", "activity_at", "status", "priority_level", "priority_score", "opportunity_score", "risk_score",
        "evidence_confidence_score", "commercial_attractiveness_score", "immediacy_score", "product_fit_score", "recommended_next_step",
        _joined("recommended_product_themes").alias("product_themes"), "primary_lens_key", "why_now", "fusion_summary", "state_summary",
        _joined("governance_flags").alias("governance_flags"), "scorecard_version")


@query("i25_scoring_inputs", _sql("""
SELECT st.company_id, signal_count, timeline_event_count, generated_insight_count, parsed_document_count, CAST(coalesce(b.n, 0) AS INT) AS key_risks,
 CAST(n_events AS INT) AS key_events, array_to_string(types, '|') AS signal_types FROM st
LEFT JOIN (SELECT company_id, count(*) n FROM kid8 WHERE kind = 'risk' GROUP BY 1) b ON b.company_id = st.company_id""", STATE))
def i25(v):
    return _profile(v).select(
        "company_id", "signal_count", "timeline_event_count", "generated_insight_count", "parsed_document_count",
        (F.size("key_children") - F.col("key_event_count")).cast("int").alias("key_risks"), F.col("key_event_count").cast("int").alias("key_events"), _joined("signal_types").alias("signal_types"))


@query("i27_brief", _sql("""
SELECT company_id, canonical_name || ' brief' AS title, canonical_name || ' is currently ' || priority_level || ' priority with status ' || status || '. ' || canonical_name ||
 CASE lens WHEN 'acquisition' THEN ' shows an acquisition-first opportunity' WHEN 'financing' THEN ' shows a financing-led opportunity' ELSE ' shows a cross-border opportunity' END
 || ' Next step: ' || next_step || '.' AS summary FROM q"""))
def i27(v):
    return fu.brief(_prospects(v)).select("company_id", "title", "summary")


@query("i27_suggested_questions", _sql("""
SELECT company_id, concat_ws('|', CASE WHEN n_o > 0 THEN 'What are the strongest opportunity signals for ' || canonical_name || '?' END,
 CASE WHEN n_r > 0 THEN 'What are the main risks to watch for ' || canonical_name || '?' END,
 CASE WHEN business_event_count > 0 THEN 'What recent business events matter most for ' || canonical_name || '?' END,
 CASE WHEN metric_count > 0 THEN 'Which metrics best support RM outreach for ' || canonical_name || '?' END) AS questions FROM s0""", STATE))
def i27b(v):
    return _profile(v).select("company_id", _joined(fu.suggested_questions()).alias("questions"))


@query("i28_review", _sql("""
SELECT company_id, concat_ws('|', CASE WHEN priority_level = 'high' AND conf < 40 THEN 'high_priority_low_confidence' END,
  CASE WHEN top_product IN ('cross-border payments','trade finance','treasury') AND n_border = 0 THEN 'cross_border_product_overreach' END,
  CASE WHEN risk >= 30 AND NOT contains(next_step, 'risk') THEN 'risk_underemphasized' END) AS audit_findings,
 concat_ws('|', CASE WHEN management_discussion_count = 0 THEN 'management_discussion' END, CASE WHEN business_event_count = 0 THEN 'business_events' END,
  CASE WHEN metric_count = 0 THEN 'structured_metrics' END, CASE WHEN risk_factor_count = 0 THEN 'risk_factors' END) AS extraction_opportunities,
 CAST(least(n_o + n_c + n_r, 5) AS INT) AS review_count FROM q"""))
def i28(v):
    return fu.review(_prospects(v)).select(
        "company_id", _joined("audit_findings").alias("audit_findings"), _joined("extraction_opportunities").alias("extraction_opportunities"),
        F.size("linkage_reviews").alias("review_count"))


@query("i29_merged_reviews", _sql("""
, rev AS (SELECT company_id, 'signal_' || row_number() OVER (PARTITION BY company_id ORDER BY CASE lst WHEN 'o' THEN 1 WHEN 'c' THEN 2 ELSE 3 END, pos) AS item_key, linkage_type FROM items QUALIFY
   row_number() OVER (PARTITION BY company_id ORDER BY CASE lst WHEN 'o' THEN 1 WHEN 'c' THEN 2 ELSE 3 END, pos) <= 5),
ext AS (SELECT CAST(s_suppkey AS VARCHAR) AS company_id, 'signal_' || (s_nationkey % 6) AS item_key, CASE WHEN s_acctbal > 5000 THEN 'challenge' END AS status FROM supplier)
SELECT e.company_id, e.item_key, r.linkage_type AS suggested_linkage_type, coalesce(e.status, CASE WHEN r.company_id IS NOT NULL THEN 'confirm' END, 'uncertain') AS review_status FROM ext e LEFT JOIN rev r ON r.company_id = e.company_id AND r.item_key = e.item_key
UNION ALL SELECT company_id, item_key, linkage_type, 'confirm' FROM rev WHERE company_id NOT IN (SELECT company_id FROM ext)""", STATE).replace("\n, rev", ",\nrev").replace("GROUP BY 1), rev", "GROUP BY 1),\nrev"))
def i29(v):
    # Suppliers stand in for rows returned by an outside reviewer.
    external = v.raw("supplier").select(
        F.col("s_suppkey").cast("string").alias("company_id"), F.concat(F.lit("signal_"), (F.col("s_nationkey") % 6).cast("string")).alias("item_key"),
        F.lit("").alias("suggested_linkage_type"), F.when(F.col("s_acctbal") > 5000, "challenge").alias("review_status"), F.lit(None).cast("string").alias("reason"))
    base = _profile(v).select("company_id", fu.linkage_reviews().alias("linkage_reviews"))
    return fu.merge_reviews(base, external).drop("reason")


@query("i30_explanation", _sql("""
SELECT company_id, canonical_name || CASE lens WHEN 'acquisition' THEN ' shows an acquisition-first opportunity' WHEN 'financing' THEN ' shows a financing-led opportunity' ELSE ' shows a cross-border opportunity' END AS headline,
 why_now, fusion_summary AS lens_summary, key_risk AS risk_note, next_step AS action_note, lens AS primary_lens_key FROM q"""))
def i30(v):
    return _prospects(v).select("company_id", fu.explanation().alias("e")).select(
        "company_id", *[F.col(f"e.{c}") for c in fu.EXPLANATION_FIELDS])


@query("m4_contract_checks", _sql("""
SELECT 'priority_matches_parts' AS check_name, count(*) AS checked, count(*) FILTER (WHERE priority_score = least(w1 + w2 + w3, 100)) AS passed FROM p3
UNION ALL SELECT 'opportunity_matches_groups', count(*), count(*) FILTER (WHERE opportunity_score = least(commercial + immediacy + fit_score, 100)) FROM p3
UNION ALL SELECT 'scores_in_range', count(*), count(*) FILTER (WHERE priority_score BETWEEN 0 AND 100 AND risk_score BETWEEN 0 AND 100) FROM p3
UNION ALL SELECT 'required_parts_present', count(*), count(*) FILTER (WHERE status IS NOT NULL AND priority_level IS NOT NULL) FROM p3""", STATE + FEATS + SCORES))
def m4(v):
    from intelspark.operators.evaluate import contract_checks

    return contract_checks(_prospects(v))
