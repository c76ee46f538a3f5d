"""HTML entities against the standard library."""

import html
import random

from intelspark.functions.text import clean, entities_to_text


def test_entities_equal_the_standard_library(spark):
    rng = random.Random(12)
    names = sorted(html.entities.html5)
    texts = ["&amp;lt; &lt;", "&notit; &not; &notin;", "&#146;&#x92;&#0;&#13;&#11;&#127;&#xFFFE;&#xD800;&#99999999999999999999;&#x110000;", "&#65 &#x41 &#x41; &#128512;", "&", "&&amp", "a & b", "&;", "&#;", "&#x;",
             "&unknown; &Aacute &Aacutex", "no entity", "", "&NotEqualTilde;", "1&sup2;2 &copy2024", "&eacute;t&eacute; &nbsp;x&hellip;"]
    texts += ["".join(rng.choice(["&", rng.choice(names), "#", "x41", "65", ";", " ", "b", "é"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += ["&" + n for n in names] + [f"&#{rng.randint(0, 0x110010)};" for _ in range(200)] + [f"&#x{n:x};" for n in range(0, 300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", entities_to_text("t").alias("u")).collect()
    assert [(r.t, r.u) for r in got if r.u != html.unescape(r.t)] == []


def test_clean_decodes_once_and_takes_null(spark):
    rows = spark.createDataFrame([(1, "Caf&eacute;&nbsp;&ndash; &#8364;5&#xa0;&amp;lt;\r\n\r\n\r\n\r\nend"), (2, None)], "i int, t string")
    assert [r.u for r in rows.select(clean("t", every_entity=True).alias("u")).collect()] == ["Café – €5 &lt;\n\nend", ""]
