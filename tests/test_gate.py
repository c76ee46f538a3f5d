"""The evidence gate works out each text once, whatever is asked of its verdicts; cleaning leaves tidy texts alone."""

import re

from pyspark.sql import functions as F

from intelspark.functions.text import _tidy, BASIC_ENTITIES, clean, strip
from intelspark.operators import parsing as p

FACT = "document_id int, pos int, fact_type string, kind string, name string, value string, summary string, confidence double, chunk_id string, quoted_text string"


def test_gate_texts_are_not_worked_out_again_for_filters(spark):
    text = "Our credit risk rises with the market."
    row = lambda pos, **kw: tuple({"d": 1, "pos": pos, "t": "risk_factor", "k": "Credit", "n": None, "v": None, "s": None, "c": 0.9, "p": "s0:p0", "q": text, **kw}.values())
    facts = spark.createDataFrame([row(1), row(2), row(3, q="absent words here"), row(4, t="management_statement"), row(5, c=0.1), row(6, p="x", q=text), row(7, q="short")], FACT)
    shown = spark.createDataFrame([(1, "s0:p0", text.upper() + "&nbsp;"), (1, "x", None)], "document_id int, chunk_id string, text string")
    gated = p.gate(facts, shown)
    got = {r.pos: (",".join(r.reasons), r.eligible) for r in gated.collect()}
    assert got == {1: ("", True), 2: ("duplicate_existing_fact", False), 3: ("quote_not_found_in_candidate,too_generic", False), 4: ("", False),
                   5: ("low_extraction_confidence", False), 6: ("unknown_chunk_id", False), 7: ("missing_or_short_quote,too_generic", False)}
    view = {r.measure: r["count"] for r in p.extraction_view(gated).collect()}
    assert view == {"eligible:risk_factor": 1, "context_only": 1, "rejected:duplicate_existing_fact": 1, "rejected:quote_not_found_in_candidate": 1, "rejected:too_generic": 2,
                    "rejected:low_extraction_confidence": 1, "rejected:unknown_chunk_id": 1, "rejected:missing_or_short_quote": 1}
    # A filter below the window repeated the whole verdict, once for each of its parts.
    for df in (gated.filter("eligible").select("document_id", "kind"), p.extraction_view(gated)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("quoted_text#", plan)) < 60 and "UnionAll" not in plan and "Union" not in plan


def test_clean_equals_its_steps(spark):
    texts = ["plain text", " ends \n", "a  b", "a \nb", "a\n\n\nb", "a\n\nb", "a\tb", "a\r\nb\rc", "x&nbsp;&lt;y&amp;lt;", "z​w﻿", "n b", "", None, "a\x0b\x0cb", "　wide "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    steps = strip(_tidy(F.coalesce("t", F.lit("")), BASIC_ENTITIES))
    assert [r for r in rows.select("t", clean("t").alias("a"), steps.alias("b")).collect() if r.a != r.b] == []
