"""License scans by ordered signature rules: keyword gate, regular expressions, priorities, containment suppression.

Everything runs as DataFrame expressions inside a document's row: no join, no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_PRIORITY = 4

# Licence families: label, words the family is named by (a pattern over single-spaced lower-case words).
NAMES = {
    "mit": "mit|expat|x11", "apache-2": "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache-1": "apache(?: software)?(?: license)?(?: version)? 1(?: [01])?",
    "gpl-3": "(?:gnu )?(?:general public|gpl)(?: license)?(?: version| v)? ?3(?: 0)?|gplv3", "gpl-2": "(?:gnu )?(?:general public|gpl)(?: license)?(?: version| v)? ?2(?: 0)?|gplv2",
    "gpl": "gnu general public|gnu gpl|gpl", "lgpl": "(?:gnu )?lesser general public|gnu library general public|lgpl(?:v[23])?",
    "agpl": "(?:gnu )?affero general public|agpl(?:v3)?", "fdl": "gnu free documentation", "bsd-2": "(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause",
    "bsd-3": "(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause", "bsd": "bsd", "isc": "isc", "mpl-2": "mozilla public(?: license)?(?: version| v)? ?2(?: 0)?|mpl 2(?: 0)?",
    "mpl": "mozilla public|mpl", "epl": "eclipse public|epl", "cddl": "common development and distribution|cddl", "artistic": "(?:perl )?artistic", "zlib": "zlib(?: libpng)?",
    "unlicense": "unlicense", "wtfpl": "wtfpl|do what the fuck you want to public", "eupl": "european union public|eupl", "boost": "boost(?: software)?", "python": "python software foundation|psf",
    "postgresql": "postgresql", "openssl": "openssl", "ofl": "sil open font|open font", "odbl": "open database|odbl", "cc0": "cc0|creative commons zero",
    "cc-by": "cc by|creative commons attribution", "cc-by-sa": "cc by sa|creative commons attribution share ?alike", "cc-by-nd": "cc by nd|creative commons attribution no ?deriv(?:ative)?s?",
    "cc-by-nc": "cc by nc|creative commons attribution non ?commercial", "cc-by-nc-sa": "cc by nc sa|creative commons attribution non ?commercial share ?alike",
    "cc-by-nc-nd": "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?",
}
# How a text states a licence: template, priority.
TEMPLATES = (
    ("(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:%s)(?: licen[sc]e)?", 3),
    ("under (?:the )?(?:terms|conditions) of (?:the )?(?:%s)(?: licen[sc]e)?", 3),
    ("spdx license identifier (?:%s)(?: only| or later)?", 3),
    ("licen[sc]ed? (?:as|is|name|type)? ?(?:the )?(?:%s)", 2),
    ("(?:subject|according) to (?:the )?(?:%s) licen[sc]e", 2),
    ("(?:%s) (?:public )?licen[sc]e(?: version [0-9](?: [0-9])?| v[0-9](?: [0-9])?)?", 1),
)
# Notices that name no family: label, pattern, priority.
NOTICES = (
    ("all-rights-reserved", "all rights reserved", 2), ("copyright", "copyright (?:c )?(?:[0-9]{4} )+(?:by )?[^ ]+", 1), ("copyright", "copyright (?:by|holder|holders|notice)", 1),
    ("public-domain", "(?:in|into|to) the public domain", 2), ("public-domain", "public domain", 1), ("proprietary", "proprietary licen[sc]e", 2),
    ("commercial", "commercial licen[sc]e", 1), ("no-warranty", "without warranty of any kind", 1), ("license-text", "permission is hereby granted free of charge", 2),
    ("license-text", "redistribution and use in source and binary forms", 2), ("license-notice", "this work is licen[sc]ed", 1), ("license-notice", "see the licen[sc]e for", 1),
)
CONFIDENCE = {1: 0.5, 2: 0.75, 3: 0.9, BASE_PRIORITY: 1.0}
# A text without any of these in lower case matches no rule but those of UNDER, which need not say licence.
KEYWORDS = ("licen", "gpl", "mozilla", "creative", "copyright", "rights", "domain", "warranty", "permission", "redistribution")
UNDER = tuple(t for t, _ in TEMPLATES if "licen" not in t.replace("(?: licen[sc]e)?", "").replace("licensed|", ""))
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # what stands between words of lower case


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, pattern, label, priority): every family in every template, and the notices; priority counts up."""
    out = [("under" if t in UNDER else "licen", t % names, label, p) for t, p in TEMPLATES for label, names in NAMES.items()]
    return out + [(next(k for k in KEYWORDS if k in pattern), pattern, label, p) for label, pattern, p in NOTICES]


def _words(text: Column) -> Column:
    """Words of a piece of the normal form, in which a space stands before each word."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(normal: Column, pattern: Column) -> Column:
    """Array of (start, end) in words of the matches of a pattern over whole words."""
    whole = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    hits, pieces = F.regexp_extract_all(normal, whole, F.lit(0)), F.split(normal, whole, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + _words(pair["p"])
        end = start + _words(pair["h"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("s"), end.alias("e")))).alias("found"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    A detection inside another of at least its priority is suppressed; of two over the same words the
    higher priority, then the first label stays. Base labels always stay. score is the confidence of the
    best detection left, 0 without one. Null and empty texts have no words and no labels. Rows are judged
    one by one, repeated ones alike; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = low.contains("cc") & low.rlike(f"cc{BETWEEN}by")
    stated = low.contains("under") & low.rlike("|".join(t % "|".join(NAMES.values()) for t in UNDER).replace(" ", f"(?:{BETWEEN})"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    normal = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, upper, upper.lower()), BETWEEN, " ")), F.lit(" "))
    gate = reduce(lambda a, b: a | b, [low.contains(k) for k in KEYWORDS], named | stated)
    none = F.array().cast("array<struct<s:int,n:int,p:int,label:string>>")
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p).alias("pattern"), F.lit(label).alias("label"), F.lit(n).alias("priority")) for k, p, label, n in rules()])

    def detections(pattern: Column, label: Column, priority: Column) -> Column:
        return F.transform(_places(F.col("normal"), pattern), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), (-priority).alias("p"), label.alias("label")))

    base = F.concat(*[detections(F.lit(p), F.lit(label), F.lit(BASE_PRIORITY)) for p, label in BASE.items()])
    active = F.filter(table, lambda r: F.contains(F.col("normal"), r["key"]) & F.rlike(F.col("normal"), F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))))
    more = F.flatten(F.transform(active, lambda r: detections(r["pattern"], r["label"], r["priority"])))
    levels = sorted(CONFIDENCE)
    start = F.struct(*[F.lit(0).alias(f"e{p}") for p in levels], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["n"], -d["p"]
        seen = reduce(lambda rest, p: F.when(priority == p, acc[f"e{p}"]).otherwise(rest), levels, F.lit(0))
        stays = end > seen
        reach = [F.when(priority >= p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels]
        trust = reduce(lambda rest, p: F.when(priority == p, F.lit(CONFIDENCE[p])).otherwise(rest), levels, F.lit(0.0))
        return F.struct(
            *reach, F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(stays, F.greatest(acc["score"], trust)).otherwise(acc["score"]).alias("score"))

    marked = docs.select("doc_id", text.alias("text"), gate.alias("gate")).select(
        "doc_id", F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long").alias("n_words"), F.when(F.col("gate"), normal).alias("normal"))
    found = marked.select(
        "doc_id", "n_words", F.when(F.col("normal").isNull(), none).otherwise(base).alias("base"),
        F.when(F.col("normal").isNull(), none).otherwise(more).alias("more"))
    kept = found.withColumn("left", F.aggregate(F.sort_array(F.concat("base", "more")), start, step))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    return kept.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["s"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("left.labels"))), ",").alias("labels"), F.col("left.score").alias("score"))
