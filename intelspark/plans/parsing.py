"""Queries of document parsing and extraction over whole texts.

The given prose has no banking words, so these queries pass word lists that occur in it; the
default lists are covered by tests on authored documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from intelspark.functions.rows import spread_array
from intelspark.functions.text import clean, strip
from intelspark.operators import parsing as p
from intelspark.plans.registry import query

# Word lists for the given prose.
CATEGORIES = (("article", ("the ", "les ", "die ")), ("linking", ("and ", "und ", "con ")), ("licence", ("licensed", "copyright", "mit license")))
ANCHORS = ("tion", "ung", "eau", "license")
HINTS = ("hat", "que", "sch")
EVENTS = (("opening", (r"th[aeiou]", r"qu[aeiou]")), ("number", (r"[0-9]{4}",)), ("mail", (r"[a-z]@[a-z]",)))
NEGATIVE = ("redistribution", "warranty")
METRICS = (("count", r"(?:the |les |und )", False), ("share", r"(?:of |de |con )", True))


def clean_sql(column: str) -> str:
    out = column
    for entity, plain in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&apos;", "''''"), ("&amp;", "'&'")):
        out = f"replace({out}, '{entity}', {plain})"
    steps = (("chr(160)", "' '"), (r"'\r\n?'", "chr(10)"), (r"'[\x{feff}\x{200b}\x{200c}\x{200d}]'", "''"), (r"'[ \t\f\x0B]+'", "' '"), (r"' +\n'", "chr(10)"), (r"'\n{3,}'", "chr(10) || chr(10)"),
             (r"'^[\s\p{Z}]+|[\s\p{Z}]+$'", "''"))
    for pattern, plain in steps:
        out = f"regexp_replace({out}, {pattern}, {plain}, 'g')"
    return out


STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SENTS = rf"""docs0 AS (SELECT doc_id, lang, source, {clean_sql('text')} AS body FROM documents),
parts AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM (SELECT doc_id,
  string_split(regexp_replace(regexp_replace(body, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)) AS l FROM docs0)),
sents AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM (SELECT doc_id, k, {STRIP.format('raw')} AS s FROM parts) WHERE s <> '')"""
NOISE = r"""(regexp_matches(lower(s), 'all rights reserved|copyright|member firm|private english company limited by guarantee|contact us|table of contents|contents|kpmg\.com|www\.|http://|https://')
 OR regexp_full_match(lower(s), 'page\s+\d+') OR (length(s) < 8 AND NOT regexp_matches(s, '\d')))"""


def _alt(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _docs(v):
    return v.texts("documents", "doc_id")


@query("k1_route", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'html' WHEN 2 THEN 'json' WHEN 3 THEN 'text' ELSE 'fallback' END AS parser FROM pages""")
def k1(v):
    k = F.col("page_id") % 5
    content = F.when(k == 1, F.col("html")).when(k == 2, F.to_json(F.struct("url"))).when(k == 3, F.col("url")).otherwise(F.lit(""))
    return v.texts("pages", "page_id").select("page_id", p.route(F.lit(None).cast("string"), F.when(k == 0, "landing/report.pdf"), content).alias("parser"))


@query("k2_primary_content", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' ELSE 'text/plain' END AS media_type, CAST(CASE page_id % 3 WHEN 0 THEN length(regexp_replace(html, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))
 WHEN 1 THEN length('{"url":' || to_json(url) || '}') ELSE length(url) END AS BIGINT) AS size FROM pages""".replace("\\\\", "\\"))
def k2(v):
    k = F.col("page_id") % 3
    payload = F.when(k == 0, F.to_json(F.struct("url", "html"))).when(k == 1, F.to_json(F.struct("url")))
    return v.texts("pages", "page_id").select("page_id", p.primary_content(payload, F.lit(" "), F.col("url")).alias("c")).select(
        "page_id", "c.media_type", F.length("c.content").cast("bigint").alias("size"))


@query("k3_sentences", f"WITH {SENTS} SELECT doc_id, pos, s AS sentence FROM sents")
def k3(v):
    out = spread_array(_docs(v), ["doc_id"], p.sentences("text"), "sentence", "i")
    return out.select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), "sentence")


@query("k4_noise", f"WITH {SENTS} SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE {NOISE}) AS noise FROM sents GROUP BY 1")
def k4(v):
    return _docs(v).withColumn("s", p.sentences("text")).filter(F.size("s") > 0).select(
        "doc_id", F.size("s").cast("bigint").alias("sentences"), F.size(F.filter("s", p.is_noise)).cast("bigint").alias("noise"))


VALUE = (r"(?i)(?:(?:HK\$|US\$|RMB|CNY|\$)\s*)?(?:[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+))"
         r"(?:\s?(?:million|billion|trillion|bn|mn|m|%|亿港元|億元|億港元|亿元|萬元|万元|百万元|百萬元|万亿元|萬億元|亿|億))?")
SCALE = r"(?i)(HK\$|US\$|RMB|CNY|\$|million|billion|trillion|bn|mn|亿港元|亿元|万元|百万元|万亿元)"


def _metric_sql() -> str:
    """Values after the metric's name compete first, else the ones before it; nearest last."""
    parts = []
    for i, (name, pattern, pct) in enumerate(METRICS):
        bad_percent = "" if pct else " AND NOT ends_with(v, '%')"
        penalty = "0" if pct else "CASE WHEN contains(v, '%') THEN 1 ELSE 0 END"
        parts.append(f"""SELECT doc_id, pos, s, '{name}' AS name, {i} AS spec, (list(v ORDER BY side, scaled, penalty, near))[1] AS value FROM (
  SELECT doc_id, pos, s, v, side, CASE WHEN regexp_matches(v, '{SCALE}') THEN 0 ELSE 1 END AS scaled, {penalty} AS penalty, CASE side WHEN 0 THEN i ELSE -i END AS near FROM (
   SELECT doc_id, pos, s, 0 AS side, unnest(a) AS v0, trim(unnest(a)) AS v, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, pos, s, regexp_extract_all(s[length(head) + 1:], '{VALUE}') AS a FROM (SELECT *, regexp_extract(s, '(?is)^(.*?{pattern})', 1) AS head FROM ok) WHERE head <> '')
   UNION ALL SELECT doc_id, pos, s, 1, unnest(a), trim(unnest(a)), generate_subscripts(a, 1) FROM (SELECT doc_id, pos, s, regexp_extract_all(head, '{VALUE}') AS a FROM (SELECT *, regexp_extract(s, '(?is)^(.*?{pattern})', 1) AS head FROM ok) WHERE head <> ''))
  WHERE regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '^[0-9](,[0-9]){{2,}}$'){bad_percent}) GROUP BY 1, 2, 3""")
    return " UNION ALL ".join(parts)


METRIC_CTES = f"{SENTS}, ok AS (SELECT * FROM sents WHERE NOT {NOISE} AND regexp_matches(s, '\\d')), found AS ({_metric_sql()})"


@query("k5_text_metrics", f"""WITH {METRIC_CTES} SELECT doc_id, pos, name, value, CASE WHEN contains(value, '%') THEN '%' END AS unit FROM found""")
def k5(v):
    s = _docs(v).select("doc_id", F.posexplode(F.filter(F.transform(p.sentences("text"), lambda x, i: F.struct(x.alias("s"), i.alias("i"))), lambda x: x["s"].rlike(r"\d") & ~p.is_noise(x["s"]))).alias("k", "x"))
    out = s.select("doc_id", (F.col("x.i") + 1).cast("bigint").alias("pos"), F.explode_outer(p.sentence_metrics(F.col("x.s"), METRICS)).alias("m")).filter(F.col("m").isNotNull())
    return out.select("doc_id", "pos", "m.name", "m.value", "m.unit")


@query("k6_table_metrics", """SELECT o_orderkey, 'revenue' AS name, 'HK$' || CAST(o_totalprice AS VARCHAR) AS value, '2023' AS period, 0.7::DOUBLE AS confidence FROM orders
UNION ALL SELECT o_orderkey, 'npl ratio', o_orderpriority[1] || '.5%', NULL, 0.6 FROM orders""")
def k6(v):
    headers = F.array(F.lit("Item"), F.lit("2023"), F.lit("NPL ratio"))
    cells = F.array(F.lit("Total revenue"), F.concat(F.lit("HK$"), F.col("o_totalprice").cast("string")), F.concat(F.left("o_orderpriority", F.lit(1)), F.lit(".5%")))
    table = v.raw("orders").select("o_orderkey", headers.alias("h"), F.array(cells).alias("r"))
    out = table.select("o_orderkey", F.explode_outer(p.table_metrics(F.col("h"), F.col("r"))).alias("m")).filter(F.col("m").isNotNull())
    return out.select("o_orderkey", "m.name", "m.value", "m.period", "m.confidence")


@query("k7_deduped_metrics", f"""WITH {METRIC_CTES}, f2 AS (SELECT *, CASE WHEN contains(s[1:8], ':') THEN 1 ELSE 0 END AS c, min(pos * 10 + spec) OVER (PARTITION BY doc_id, name, value) AS first_at,
  CASE WHEN regexp_matches(coalesce(nullif(regexp_extract(s, '\\b(?:FY\\s?20\\d{{2}}|20\\d{{2}}|Q[1-4]\\s?20\\d{{2}}|H[12]\\s?20\\d{{2}}|[1-4]Q20\\d{{2}})\\b'), ''), '-'), '(?i)(FY|Q[1-4]|H[12]|年|月)') THEN 0 ELSE 1 END AS a FROM found),
one AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY doc_id, name, value ORDER BY a, c, pos, spec) = 1)
SELECT doc_id, name, value, left(s, 240) AS context FROM one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first_at) <= 20""")
def k7(v):
    out = p.with_metrics(_docs(v).withColumn("s", p.sentences("text")), "s", METRICS, 20)
    return out.select("doc_id", F.explode_outer("metrics").alias("m")).filter(F.col("m").isNotNull()).select("doc_id", "m.name", "m.value", "m.context")


@query("k8_risks", f"""WITH {SENTS}, hit AS (SELECT doc_id, pos, s, c.i, c.name FROM (SELECT * FROM sents WHERE NOT {NOISE} AND regexp_matches(lower(s), '{_alt(ANCHORS)}')) JOIN (VALUES """
       + ", ".join(f"({i}, '{n}', '{_alt(w)}')" for i, (n, w) in enumerate(CATEGORIES)) + f""") c(i, name, pat) ON regexp_matches(lower(s), pat)),
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, name, s ORDER BY pos) = 1)
SELECT doc_id, name AS category, left(s, 300) AS description, CASE WHEN regexp_matches(lower(s), '{_alt(HINTS)}') THEN 'high' ELSE 'medium' END AS severity FROM one
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) <= 12""")
def k8(v):
    found = p.risks(p.sentences("text"), CATEGORIES, ANCHORS, HINTS, 12)
    return _docs(v).select("doc_id", F.explode_outer(found).alias("r")).filter(F.col("r").isNotNull()).select("doc_id", "r.category", "r.description", "r.severity")


@query("k9_events", f"""WITH {SENTS}, seeds AS (SELECT doc_id, 0 AS pos, 'Notice 2024 from ' || source AS s FROM documents UNION ALL SELECT doc_id, pos, s FROM sents),
hit AS (SELECT doc_id, pos, s, c.i, c.name FROM (SELECT * FROM seeds WHERE NOT {NOISE} AND NOT regexp_matches(lower(s), '{_alt(NEGATIVE)}')) JOIN (VALUES """
       + ", ".join(f"({i}, '{n}', '(?i){'|'.join(w)}')" for i, (n, w) in enumerate(EVENTS)) + """) c(i, name, pat) ON regexp_matches(s, pat)),
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, name, s ORDER BY pos) = 1)
SELECT doc_id, name AS event_type, left(s, 300) AS summary FROM one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) <= 12""")
def k9(v):
    seeds = F.concat(F.array(F.concat(F.lit("Notice 2024 from "), "source")), p.sentences("text"))
    found = p.events(seeds, EVENTS, NEGATIVE, 12)
    return _docs(v).select("doc_id", F.explode_outer(found).alias("e")).filter(F.col("e").isNotNull()).select("doc_id", "e.event_type", "e.summary")


@query("k10_management_discussion", f"""WITH {SENTS}, ok AS (SELECT doc_id, s, pos FROM sents WHERE NOT {NOISE}),
marked AS (SELECT doc_id, s, min(pos) AS pos FROM ok WHERE regexp_matches(lower(s), '{_alt(HINTS)}') GROUP BY 1, 2),
best AS (SELECT doc_id, list(s ORDER BY pos)[1:5] AS l FROM marked GROUP BY 1 UNION ALL SELECT doc_id, list(s ORDER BY pos)[1:3] FROM ok WHERE doc_id NOT IN (SELECT doc_id FROM marked) GROUP BY 1)
SELECT doc_id, left(array_to_string(l[1:3], ' '), 600) AS summary, CAST(len(l) AS INT) AS highlights FROM best
UNION ALL SELECT doc_id, head, 0 FROM (SELECT doc_id, {clean_sql('left(text, 240)')} AS head FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM best)) WHERE head <> ''""")
def k10(v):
    # The whole document is one section under a discussion heading.
    sections = F.array(F.struct(F.lit("Chairman's statement").alias("heading"), F.col("text").alias("text")))
    out = p.with_discussion(_docs(v).withColumns({"sections": sections, "title": F.lit("")}), "title", "sections", "text", highlights=HINTS)
    # A plain filter would be pushed below the steps that find the discussion and work all of them out again.
    found = spread_array(out, ["doc_id"], F.array("management_discussion"), "found")
    return found.select("doc_id", "found.summary", F.size("found.highlights").alias("highlights"))



def _drop_sql() -> str:
    out = "html"
    for tag in ("script", "style", "nav", "footer", "noscript", "form", "aside"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return rf"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"


INNER = r"regexp_replace({}, '(?s)<[^>]*>', ' ', 'g')"


@query("k11_html_titles", rf"""SELECT page_id, {clean_sql(INNER.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS title,
 CAST(len(regexp_extract_all({_drop_sql()}, '(?i)<h1[ >]')) AS INT) > 0 AS has_heading FROM pages""")
def k11(v):
    out = p.with_html(v.texts("pages", "page_id"), "html")
    return out.select("page_id", "title", F.exists("sections", lambda s: s["heading"] != "Body").alias("has_heading"))


@query("k11_html_sections")
def k11b(v):
    out = p.with_html(v.texts("pages", "page_id"), "html")
    return out.select("page_id", F.posexplode("sections").alias("pos", "s")).select("page_id", "pos", "s.heading", F.length("s.text").alias("size"))


@query("k12_json_parts", "SELECT event_id, 'k' AS heading, json_extract_string(props, '$.k') AS text, 'field' AS section_type FROM events")
def k12(v):
    out = p.json_parts(v.raw("events"), "event_id", "props")
    return out.select("event_id", F.explode("sections").alias("s")).select("event_id", "s.heading", "s.text", "s.section_type")


PARAS = rf"""docs0 AS (SELECT doc_id, {clean_sql('text')} AS body FROM documents),
paras AS (SELECT doc_id, k, {STRIP.format('raw')} AS p FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(replace(body, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM docs0)) WHERE {STRIP.format('raw')} <> '')"""
HEADS = ("license", "public")


@query("k13_text_sections", rf"""WITH {PARAS}, flagged AS (SELECT *, CASE WHEN length(h) <= 120 AND h <> '' AND (regexp_matches(lower(h), '{_alt(HEADS)}') OR starts_with(h, '#') OR regexp_matches(h, '^\d+(\.\d+){{0,3}}[).\s-]+\S')
   OR regexp_matches(h, '^[A-Z][A-Z0-9 /&,\-]{{2,80}}$') OR (regexp_matches(h, '^[\x{{4e00}}-\x{{9fff}}A-Za-z0-9（）()、/\- ]{{2,40}}$') AND (len(regexp_split_to_array(h, '\s+')) <= 10 OR length(h) <= 24))) THEN 1 ELSE 0 END AS head
   FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(translate(p, '_-', '  '), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^[# ]+|[# ]+$', '', 'g'), '^[:：]+|[:：]+$', '', 'g') AS h FROM paras)),
grouped AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY k) AS sec FROM flagged)
SELECT doc_id, coalesce(max(CASE WHEN head = 1 THEN h END), 'Body') AS heading, string_agg(CASE WHEN head = 0 THEN p END, chr(10) || chr(10) ORDER BY k) AS text FROM grouped GROUP BY doc_id, sec HAVING count(*) FILTER (WHERE head = 0) > 0""")
def k13(v):
    # Single line breaks become paragraph breaks, so that every line is looked at as a heading.
    body = F.replace(clean("text"), F.lit("\n"), F.lit("\n\n"))
    out = _docs(v).select("doc_id", F.explode(p.text_sections(body, hints=HEADS)).alias("s"))
    return out.select("doc_id", "s.heading", "s.text")


@query("k14_page_boilerplate", rf"""WITH pg AS (SELECT conv_id, turn, {clean_sql("'Shared header line' || chr(10) || text || chr(10) || 'www.example.com'")} AS body FROM conversations),
ln AS (SELECT conv_id, turn, k, {STRIP.format('raw')} AS line FROM (SELECT conv_id, turn, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM (SELECT conv_id, turn, string_split(body, chr(10)) AS l FROM pg)) WHERE {STRIP.format('raw')} <> ''),
rep AS (SELECT conv_id, lower(line) AS key FROM ln JOIN (SELECT conv_id, count(DISTINCT turn) AS pages FROM conversations GROUP BY 1) USING (conv_id)
  WHERE length(line) BETWEEN 8 AND 180 AND NOT regexp_matches(line, '[.!?。！？]') GROUP BY conv_id, lower(line) HAVING count(DISTINCT turn) >= 2 AND count(DISTINCT turn) >= greatest(2, round_even(any_value(pages) * 0.4::DOUBLE, 0)))
SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY k) AS text FROM ln WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.conv_id = ln.conv_id AND rep.key = lower(ln.line) AND length(ln.line) <= 180)
 AND NOT regexp_matches(lower(line), '^page\s+\d+$|\b(?:https?://|www\.|[\w.-]+\.com(?:/\S*)?)\b|all rights reserved|copyright|member firm|private english company limited by guarantee')
 AND lower(line) NOT IN ('contents','aml','(aml)') AND NOT regexp_matches(line, '^(?:\d+\s*){{2,}}$') AND NOT regexp_matches(line, '^[^\p{{L}}\p{{N}}]+$') GROUP BY 1, 2""")
def k14(v):
    pages = v.raw("conversations").withColumn("text", F.concat_ws("\n", F.lit("Shared header line"), "text", F.lit("www.example.com")))
    return p.clean_pages(pages, "conv_id", "turn", "text")


@query("k15_clean_tables", """SELECT o_orderkey, 'Item|Total' AS headers, 'Order|' || CAST(o_totalprice AS VARCHAR) AS first_row FROM orders WHERE o_orderkey % 3 <> 2""")
def k15(v):
    k = F.col("o_orderkey") % 3
    head, row = F.array(F.lit("Item"), F.lit(" Total")), F.array(F.lit("Order"), F.col("o_totalprice").cast("string"))
    blank, numbers = F.array(F.lit(""), F.lit(" ")), F.array(F.lit("0"), F.lit("1"))
    words = F.array(F.lit("see"), F.lit("notes"))
    matrix = F.when(k == 0, F.array(numbers, head, blank, head, row)).when(k == 1, F.array(head, row)).otherwise(F.array(head, words))
    out = spread_array(v.raw("orders"), ["o_orderkey"], F.array(p.clean_table(matrix)), "t")
    return out.select("o_orderkey", F.array_join("t.headers", "|").alias("headers"), F.array_join(F.get("t.rows", 0), "|").alias("first_row"))


@query("k16_xbrl_facts", """SELECT l_suppkey, string_agg('part ' || l_partkey || ': ' || CAST(l_quantity AS VARCHAR), chr(10) ORDER BY pos) AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem) WHERE pos <= 200 GROUP BY 1""")
def k16(v):
    facts = v.raw("lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_quantity").cast("string").alias("value"), F.col("l_returnflag").alias("context"))
    order = [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return p.xbrl_facts(facts, "l_suppkey", order).select("l_suppkey", "text")


@query("k17_rag_text", rf"""WITH docs0 AS (SELECT doc_id, source, {clean_sql('text')} AS body FROM documents)
SELECT doc_id, 'Title: ' || source || chr(10) || chr(10) || CASE WHEN body <> '' THEN 'Parsed text:' || chr(10) || body || chr(10) || chr(10) ELSE '' END || 'Risk factors:' || chr(10) || '- [high] licence: ' || source AS text FROM docs0""")
def k17(v):
    risk = F.array(F.struct(F.lit("licence").alias("category"), F.col("source").alias("description"), F.lit("high").alias("severity")))
    metrics = F.array().cast(f"array<{p.METRIC_DDL}>")
    events = F.array().cast(f"array<{p.EVENT_DDL}>")
    return _docs(v).select("doc_id", p.rag_text(F.col("source"), clean("text"), metrics, risk, events).alias("text"))


CAND = (("license", "public"), ("tion", "eau"), ("thrub", "unggen"))


@query("k18_candidates", rf"""WITH docs0 AS (SELECT doc_id, source, {clean_sql('text')} AS body FROM documents),
paras AS (SELECT doc_id, source, {STRIP.format('raw')} AS p, k FROM (SELECT doc_id, source, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, source, string_split(body, chr(10)) AS l FROM docs0))),
num AS (SELECT doc_id, source, p, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS n FROM paras WHERE p <> ''),
folded AS (SELECT doc_id, source, list_reduce(list_concat([''], string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), lambda acc, x:
   acc || CASE WHEN acc = '' OR ends_with(acc, chr(2)) THEN '' ELSE chr(3) END || x
   || CASE WHEN length(replace(regexp_extract(acc, '[^\x02]*$'), chr(3), '')) + length(x) >= 900 THEN chr(2) ELSE '' END) AS f FROM num WHERE n = 1 AND length(p) > 1400),
pieces AS (SELECT doc_id, source, p, j FROM num WHERE NOT (n = 1 AND length(p) > 1400)
  UNION ALL SELECT doc_id, source, replace(p, chr(3), ' '), j - 1 FROM (SELECT doc_id, source, unnest(l) AS p, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, source, string_split(rtrim(f, chr(2)), chr(2)) AS l FROM folded))),
scored AS (SELECT doc_id, j, CASE WHEN length(p) > 1200 THEN rtrim(p[1:1200]) || '...' ELSE p END AS text, CASE WHEN source IN ('src1','src2') THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(lower(p), 'license|public|sector src1 |sector src2 ') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(p), 'tion|eau') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(p), 'thrub|unggen') THEN 2 ELSE 0 END AS score
  FROM pieces)
SELECT doc_id, 's0:p' || j AS chunk_id, score, text FROM scored WHERE score > 0 AND length(text) >= 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, j) <= 8""")
def k18(v):
    body = F.replace(clean("text"), F.lit("\n"), F.lit("\n\n"))
    # One section per document; its heading carries a title marker for two of the sources.
    df = _docs(v).withColumn("sections", F.array(F.struct(F.concat(F.lit("Sector "), "source", F.lit(" ")).alias("heading"), body.alias("text"))))
    titles = ("license", "public", "sector src1 ", "sector src2 ")
    return p.candidate_paragraphs(df, "doc_id", "sections", titles, CAND[1], CAND[2]).select("doc_id", "chunk_id", "score", "text")


@query("k18_candidate_counts")
def k18b(v):
    df = _docs(v).withColumn("sections", p.text_sections("text", hints=HEADS))
    return p.candidate_paragraphs(df, "doc_id", "sections", *CAND).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


# Five proposed facts per document, each quoting its whole text: fine, a repeat of it, absent quote, low confidence, unknown paragraph.
GATE = rf"""b AS (SELECT doc_id, {clean_sql('text')} AS shown FROM documents),
prop AS (SELECT doc_id, shown, unnest([1,2,3,4,5]) AS pos FROM b),
fact AS (SELECT doc_id, pos, shown, CASE WHEN pos = 5 THEN 'metric' WHEN pos = 4 THEN 'management_statement' ELSE 'risk_factor' END AS fact_type,
  {STRIP.format("CASE WHEN pos = 3 THEN 'zzzz ' || shown ELSE shown END")} AS q, CASE WHEN pos = 4 THEN 0.5 ELSE 0.9 END AS conf FROM prop),
res AS (SELECT *, list_filter([CASE WHEN conf < 0.6 THEN 'low_extraction_confidence' END, CASE WHEN pos = 5 THEN 'unknown_chunk_id' WHEN length(q) < 8 THEN 'missing_or_short_quote' WHEN NOT contains(lower(shown), lower(q)) THEN 'quote_not_found_in_candidate' END,
   CASE WHEN pos <> 5 AND length(q) < 20 AND q <> '' THEN 'too_generic' END], lambda x: x IS NOT NULL) AS rs FROM fact),
done AS (SELECT doc_id, pos, fact_type, CASE WHEN pos = 2 AND len(rs) = 0 THEN 'duplicate_existing_fact' ELSE array_to_string(rs, '|') END AS reasons FROM res)"""


def _gated(v):
    base = _docs(v).select(F.col("doc_id").alias("document_id"), clean("text").alias("text"), F.lit("s0:p0").alias("chunk_id"))
    facts = base.select("document_id", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("pos"), F.col("text").alias("q")).select(
        "document_id", "pos", F.when(F.col("pos") == 5, "metric").when(F.col("pos") == 4, "management_statement").otherwise("risk_factor").alias("fact_type"),
        F.lit("Credit").alias("kind"), F.lit("Net sales").alias("name"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("summary"),
        F.when(F.col("pos") == 4, 0.5).otherwise(0.9).alias("confidence"), F.when(F.col("pos") == 5, "s9:p9").otherwise("s0:p0").alias("chunk_id"),
        F.when(F.col("pos") == 3, F.concat(F.lit("zzzz "), "q")).otherwise(F.col("q")).alias("quoted_text"))
    return p.gate(facts, base)


@query("k19_evidence_gate", f"WITH {GATE} SELECT doc_id AS document_id, pos, reasons, reasons = '' AS accepted, reasons = '' AND fact_type <> 'management_statement' AS eligible FROM done")
def k19(v):
    return _gated(v).select("document_id", "pos", F.array_join("reasons", "|").alias("reasons"), "accepted", "eligible")


@query("k20_merged_facts", f"WITH {GATE} SELECT doc_id AS document_id, 'risk' AS kind, 'credit' AS label FROM done WHERE reasons = '' UNION ALL SELECT doc_id, 'event', lang FROM documents")
def k20(v):
    children = _docs(v).select(F.col("doc_id").alias("document_id"), F.lit("event").alias("kind"), F.col("lang").alias("label"), F.lit("x").alias("content"), F.lit(0.6).alias("confidence"))
    return p.merge_eligible(children, _gated(v)).select("document_id", "kind", "label")


@query("f14_extraction_view", f"""WITH {GATE} SELECT doc_id AS document_id, 'eligible:' || fact_type AS measure, count(*) AS count FROM done WHERE reasons = '' GROUP BY 1, 2
UNION ALL SELECT doc_id, 'rejected:' || r, count(*) FROM (SELECT doc_id, unnest(string_split(reasons, '|')) AS r FROM done WHERE reasons <> '') GROUP BY 1, 2""")
def f14(v):
    return p.extraction_view(_gated(v))


@query("k21_parse_batch", f"""WITH {SENTS}, hit AS (SELECT DISTINCT doc_id, c.name, s AS k FROM (SELECT * FROM sents WHERE NOT {NOISE} AND regexp_matches(lower(s), '{_alt(ANCHORS)}')) JOIN (VALUES """
       + ", ".join(f"('{n}', '{_alt(w)}')" for n, w in CATEGORIES) + """) c(name, pat) ON regexp_matches(lower(s), pat))
SELECT d.doc_id, 'text' AS parser_name, 'success' AS parse_status, CAST(least(count(hit.doc_id), 12) AS INT) AS risk_factor_count FROM documents d LEFT JOIN hit ON hit.doc_id = d.doc_id WHERE trim(d.text) <> '' GROUP BY 1""")
def k21(v):
    rows = _docs(v).select("doc_id", "text", F.lit(None).cast("string").alias("media"), F.lit("").alias("title"))
    out = p.parse_batch(rows, ["doc_id"], "text", "media", "title", "multisource-v2", specs=METRICS, categories=CATEGORIES, anchors=ANCHORS, hints=HINTS, patterns=EVENTS)
    return out.filter(F.col("parser_name") == "text").select("doc_id", "parser_name", "parse_status", F.size("risk_factors").alias("risk_factor_count"))


# Every source at once: pages with a table of figures, documents, and JSON reports, a tenth of which is cut off.
_REPORT = """'report title' || chr(10) || 'Annual report ' || n || chr(10) || chr(10) || 'management discussion' || chr(10) || said || chr(10) || chr(10)
 || 'financials' || chr(10) || 'item: Total revenue' || chr(10) || 'FY2024: HK$' || n || ' million' || chr(10) || 'item: Headcount' || chr(10) || chr(10) || 'meta' || chr(10) || 'source name: ' || event_type || chr(10) || 'tags[1]: a' || chr(10) || 'tags[3]: True'"""
ALL_SOURCES = rf"""WITH docs0 AS (SELECT doc_id, {clean_sql('text')} AS body FROM documents),
rep AS (SELECT event_id AS n, event_type, 'Demand grows with our strategy. We see opportunity number ' || event_id || '.' AS said FROM events),
told AS (SELECT n, said, {_REPORT} AS text FROM rep)
SELECT 'document' AS kind, doc_id AS id, CASE WHEN body = '' THEN 'fallback' ELSE 'text' END AS parser_name, CASE WHEN body = '' THEN 'failed' ELSE 'success' END AS parse_status, CAST(0 AS INT) AS tables, '' AS metrics,
 CAST(length(body) AS INT) AS text_chars, NULL AS discussion, NULL AS rag_text FROM docs0
UNION ALL SELECT 'page', page_id, 'html', 'success', CAST(len(regexp_extract_all({_drop_sql()}, '(?is)<table\b[^>]*>.*?</table\s*>')) + 1 AS INT), 'revenue|HK$' || page_id || ' million|FY2024', NULL, NULL, NULL FROM pages
UNION ALL SELECT 'report', n, 'json', CASE WHEN n % 10 = 0 THEN 'failed' ELSE 'success' END, CAST(CASE WHEN n % 10 = 0 THEN 0 ELSE 1 END AS INT), CASE WHEN n % 10 = 0 THEN '' ELSE 'revenue|HK$' || n || ' million|FY2024' END,
 CAST(CASE WHEN n % 10 = 0 THEN 0 ELSE length(text) END AS INT), CASE WHEN n % 10 <> 0 THEN said END, CASE WHEN n % 10 = 0 THEN '' ELSE 'Parsed text:' || chr(10) || text || chr(10) || chr(10) || 'Management discussion summary: ' || said || chr(10) || chr(10)
 || 'Management discussion highlights:' || chr(10) || '- Demand grows with our strategy.' || chr(10) || '- We see opportunity number ' || n || '.' || chr(10) || chr(10)
 || 'Extracted metrics:' || chr(10) || '- revenue: HK$' || n || ' million (FY2024) | item: Total revenue | FY2024: HK$' || n || ' million' || chr(10) || chr(10)
 || 'Tables:' || chr(10) || 'financials:' || chr(10) || '- item: Total revenue; FY2024: HK$' || n || ' million' || chr(10) || '- item: Headcount' END FROM told"""


@query("k21_parse_all_sources", ALL_SOURCES)
def k21b(v):
    n = F.col("event_id").cast("string")
    report = F.concat(
        F.lit('{"report_title":"Annual report '), n, F.lit('","management_discussion":"Demand grows with our strategy. We see opportunity number '), n,
        F.lit('.","financials":[{"item":"Total revenue","FY2024":"HK$'), n, F.lit(' million"},{"item":"Headcount"}],"meta":{"source_name":"'), F.col("event_type"), F.lit('","tags":["a",null,true]}}'))
    cut = F.when(F.col("event_id") % 10 == 0, F.left(report, F.length(report) - 1)).otherwise(report)
    figures = F.concat(F.lit("<table><tr><th>Item</th><th>FY2024</th></tr><tr><td>Total revenue</td><td>HK$"), F.col("page_id").cast("string"), F.lit(" million</td></tr></table>"))
    none = F.lit(None).cast("string")
    rows = (
        _docs(v).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content"), none.alias("media"), none.alias("title"))
        .unionByName(v.texts("pages", "page_id").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.concat("html", figures).alias("content"), none.alias("media"), none.alias("title")))
        .unionByName(v.texts("events", "event_id").select(F.lit("report").alias("kind"), F.col("event_id").alias("id"), cut.alias("content"), F.lit("application/json").alias("media"), none.alias("title"))))
    out = p.parse_batch(rows, ["kind", "id"], "content", "media", "title", "multisource-v2")
    metrics = F.array_join(F.transform("metrics", lambda m: F.concat_ws("|", m["name"], m["value"], m["period"])), ";")
    report_only = lambda c: F.when(F.col("kind") == "report", c)
    return out.select(
        "kind", "id", "parser_name", "parse_status", F.size("tables").alias("tables"), metrics.alias("metrics"), F.when(F.col("kind") != "page", F.length("text")).alias("text_chars"),
        report_only(F.col("management_discussion.summary")).alias("discussion"), report_only(F.col("rag_text")).alias("rag_text"))


@query("m2_parse_evaluation", """SELECT doc_id, contains(lower(text), 'license') OR NOT contains(lower(text), 'licensed') AS passed FROM documents""")
def m2(v):
    from intelspark.operators.evaluate import expected_found

    # A text that says "licensed" must yield the word "license" among its found words.
    low = F.lower("text")
    expected = F.array_compact(F.array(F.when(low.contains("licensed"), F.lit("license"))))
    actual = F.array_distinct(F.regexp_extract_all(low, F.lit("license"), F.lit(0)))
    return expected_found(_docs(v).select("doc_id", expected.alias("e"), actual.alias("a")), "e", "a").select("doc_id", "passed")


@query("a5_listing_rows")
def a5(v):
    from intelspark.sources.feeds import listing_rows

    row = F.concat(F.lit("<table><tbody><tr><td>2024-01-05</td><td>"), F.col("page_id").cast("string"), F.lit("</td><td>Co</td><td><a href='/doc/"), F.col("page_id").cast("string"), F.lit(".pdf'>Annual report</a></td></tr></tbody></table>"))
    return listing_rows(v.texts("pages", "page_id").withColumn("html", F.concat(F.col("html"), row)), "html", ["page_id"], "https://www.example.org")


@query("a6_first_pdf", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.example.org/files/' || page_id || '.pdf' END AS pdf FROM pages")
def a6(v):
    from intelspark.sources.feeds import first_pdf

    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<p><A class="x" HREF="/files/'), F.col("page_id").cast("string"), F.lit('.pdf">file</A>'))).otherwise("")
    return v.texts("pages", "page_id").withColumn("html", F.concat("html", link)).select("page_id", first_pdf("html", "https://www.example.org").alias("pdf"))


@query("a14_links", """SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1))) AS BIGINT) AS links FROM pages WHERE regexp_matches(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>.*?</a>')""")
def a14(v):
    from intelspark.sources.feeds import links_of

    return links_of(v.texts("pages", "page_id"), "html", ["page_id"]).groupBy("page_id").agg(F.count_distinct("href").alias("links"))


@query("a18_csv_texts", """SELECT p_partkey, 'Name|Brand|Size' AS headers, p_name || '|' || p_brand || ', x|' || p_size AS first_row FROM part""")
def a18(v):
    from intelspark.sources.feeds import csv_text

    k = F.col("p_partkey") % 2
    text = F.concat(F.when(k == 0, "0,1,2\n").otherwise(""), F.lit("Name,Brand,Size\n,,\n"), F.col("p_name"), F.lit(',"'), F.col("p_brand"), F.lit(', x",'), F.col("p_size").cast("string"))
    return csv_text(v.raw("part").select("p_partkey", text.alias("t")), "t", ["p_partkey"]).select("p_partkey", F.array_join("headers", "|").alias("headers"), F.array_join(F.get("rows", 0), "|").alias("first_row"))
