"""Company discovery, alias index and alias matching.

Finding aliases inside texts is an equality join, never a pairwise comparison: texts and aliases
are both cut into the same keys, candidates are joined on those keys, and only the candidates are
verified against the text. Keys are salted, so one frequent word does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions.rows import spread_array
from intelspark.functions.text import alias_key, blank_to_null, strip
from intelspark.sinks.merge import new_rows

GRAM_MAX = 4  # longest character key of aliases that are matched as plain substrings
WORDS_MAX = 3  # longest key in words; the whole alias is verified afterwards


# ------------------------------------------------------------------ discovery


def market_name(source: Column, payload: Column, title: Column) -> Column:
    """Company name of a market fact: payload names first, then the title without its report suffix."""
    field = lambda name: blank_to_null(strip(F.get_json_object(payload, f"$.{name}")))
    text = strip(title)
    at = F.instr(F.lower(text), " annual report")
    base = blank_to_null(F.regexp_replace(F.left(text, at - 1), "^[ -]+|[ -]+$", ""))
    from_payload = F.when(source == "szse_cninfo", F.coalesce(field("stock_name"), field("secName"), field("sec_name"))).when(
        source == "hkex_disclosure", F.coalesce(field("company_name"), field("stock_name"), F.when(at > 0, base)))
    return F.coalesce(from_payload, text)


def market_companies(facts: DataFrame, order: list[str]) -> DataFrame:
    """Company profiles found in market facts: longest name, united segments, industries as first seen.

    ``order`` names numeric columns that order the facts; facts are read once and aggregated map-side first.
    """
    known = facts.filter(F.col("source").isin(*rules.MARKET_SOURCES) & (F.trim("company_id") != ""))
    named = known.select(
        "company_id", "source", *order, market_name(F.col("source"), F.col("payload"), F.col("title")).alias("name"),
        F.coalesce(blank_to_null(strip("industry")), F.lit("Listed Companies")).alias("industry")).filter(F.col("name") != "")
    first = F.struct(*[F.col(c).cast("double").alias(c) for c in order])
    earliest = F.struct(F.length("name").alias("n"), *[(-F.col(c).cast("double")).alias(c) for c in order])
    seen = named.groupBy("company_id", "industry").agg(
        F.max(F.struct(earliest.alias("by"), "name")).alias("best"), F.min(F.struct(first.alias("at"), "source")).alias("start"), F.collect_set("source").alias("sources"))
    base = seen.groupBy("company_id").agg(
        F.max("best")["name"].alias("canonical_name"), F.min("start")["source"].alias("discovered_from"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"),
        F.array_sort(F.collect_list(F.struct(F.col("start.at").alias("at"), "industry"))).alias("i"))
    tags = F.create_map(*[x for name, row in rules.MARKET_SOURCES.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in row[2]]))])
    region = F.create_map(*[x for name, row in rules.MARKET_SOURCES.items() for x in (F.lit(name), F.lit(row[0]))])
    return base.select(
        "company_id", "canonical_name", F.element_at(region, F.col("discovered_from")).alias("region"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("sources", lambda s: F.element_at(tags, s))))).alias("segments"),
        F.transform("i", lambda x: x["industry"]).alias("industries"), "discovered_from")


# ------------------------------------------------------------------ alias index


def usable_alias(alias: Column) -> Column:
    """Aliases specific enough to search for."""
    ascii_only = alias.rlike(r"^[\x00-\x7f]*$")
    compact = F.length(F.regexp_replace(alias, "[^a-z0-9]+", ""))
    return (
        (alias != "") & ~alias.isin(*rules.GENERIC_ALIASES) & ~(alias.rlike(r"^\d+$") & (F.length(alias) < 4))
        & F.when(ascii_only, compact >= 4).otherwise(F.length(alias) >= 2))


def alias_candidates(companies: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Every (alias text, company) pair: names, ids, extra aliases and market names."""
    columns = [F.col("canonical_name"), F.col("display_name"), F.col("company_id")]
    extra = F.from_json("extra", "struct<aliases: array<string>>")["aliases"] if "extra" in companies.columns else F.array().cast("array<string>")
    pairs = companies.select("company_id", F.explode(F.concat(F.array(*columns), F.coalesce(extra, F.array().cast("array<string>")))).alias("raw"))
    if market is not None:
        field = lambda name: F.get_json_object("payload", f"$.{name}")
        names = F.array(F.col("company_id"), market_name(F.col("source"), F.col("payload"), F.col("title")), field("company_name"), field("stock_name"), field("secName"))
        rows = market.filter(F.col("source").isin(*rules.MARKET_SOURCES) & (F.trim("company_id") != ""))
        pairs = pairs.unionByName(rows.select("company_id", F.explode(names).alias("raw")))
    return pairs.filter(F.col("raw").isNotNull()).distinct()


def alias_index(pairs: DataFrame) -> DataFrame:
    """Usable aliases owned by exactly one company."""
    keyed = pairs.select("company_id", alias_key("raw").alias("alias")).filter(usable_alias(F.col("alias")))
    owners = keyed.groupBy("alias").agg(F.min("company_id").alias("company_id"), F.max("company_id").alias("other"))
    return owners.filter(F.col("company_id") == F.col("other")).select("alias", "company_id", F.length("alias").alias("alias_length"))


# ------------------------------------------------------------------ matching

_WORD, _DIGITS, _WIDE = "[a-z0-9]+", "[0-9]+", r"[^\x00-\x7f]"


def _runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def alias_kind(alias: Column) -> Column:
    """How an alias must stand in the text: digits alone, a Latin word, or anywhere."""
    return (
        F.when(alias.rlike(r"^\d+$"), "digits")
        .when(alias.rlike(r"^[\x00-\x7f]*$") & alias.rlike("[a-z]"), "word").otherwise("plain"))


def keyed_aliases(index: DataFrame) -> DataFrame:
    """Aliases with their join key, which starts with the kind.

    A Latin alias is keyed by its first ``WORDS_MAX`` letter-digit runs, any other by up to ``GRAM_MAX``
    characters around its first character that is not ASCII (its first digit, if all are ASCII).
    """
    alias, kind = F.col("alias"), alias_kind(F.col("alias"))
    words = F.array_join(F.slice(_runs(alias, _WORD), 1, WORDS_MAX), " ")
    mark = F.coalesce(F.nullif(F.regexp_instr(alias, F.lit(_WIDE)), F.lit(0)), F.regexp_instr(alias, F.lit("[0-9]")))
    gram = F.substring(alias, F.least(mark, F.greatest(F.length(alias) - GRAM_MAX + 1, F.lit(1))), F.lit(GRAM_MAX))
    key = F.when(kind == "digits", alias).when(kind == "word", words).otherwise(gram)
    return index.select("alias", "company_id", "alias_length", kind.alias("kind"), F.concat(kind, F.lit(":"), key).alias("key"))


def _text_keys(text: Column, words: Column) -> Column:
    """Distinct keys of a text, given its letter-digit runs: neighbouring runs joined, and character keys.

    A look-ahead gives overlapping matches. A character key needs a character that is not ASCII, or a digit
    and no letter, as every alias matched as a plain substring has around its mark.
    """
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    named = lambda kind, keys: F.transform(keys, lambda k: F.concat(F.lit(f"{kind}:"), k))
    runs = [F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))
            for n in range(1, WORDS_MAX + 1)]
    wide = F.concat(*[every(rf"(?s)(?=.{{0,{n - 1}}}{_WIDE})(?=(.{{{n}}}))") for n in range(2, GRAM_MAX + 1)])
    wide = F.when(text.rlike(_WIDE), wide).otherwise(F.array().cast("array<string>"))
    bare = every(rf"(?s)(?=[^a-z]{{0,{GRAM_MAX - 1}}}[0-9])(?=([^a-z]{{{GRAM_MAX}}}))")
    digits = F.filter(_runs(text, _DIGITS), lambda d: F.length(d) >= 4)
    return F.array_distinct(F.concat(named("digits", digits), *[named("word", k) for k in runs], named("plain", wide), named("plain", bare)))


def matches(texts: DataFrame, index: DataFrame, row: str = "row_id", text: str = "text", salts: int = 8) -> DataFrame:
    """All verified (row, alias, company) occurrences."""
    aliases = keyed_aliases(index)
    # An empty text has no key, so no filter folds every text a second time.
    normal = texts.select(row, alias_key(text).alias("_text"))
    # The key side carries no text, so a long document is not copied per key.
    cut = normal.withColumn("_words", _runs(F.col("_text"), _WORD))
    keys = spread_array(cut, [row], _text_keys(F.col("_text"), F.col("_words")), "key").withColumn("salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    spread = aliases.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])))
    # Aliases and texts grow with the input and are larger than their files suggest, so neither is broadcast.
    found = keys.join(spread.hint("merge"), ["key", "salt"]).select(row, "kind", "alias", "company_id", "alias_length")
    joined = found.join(normal.hint("merge"), row)
    literal = F.concat(F.lit(r"\Q"), F.replace(F.col("alias"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    inside = (
        F.when(F.col("kind") == "digits", F.lit(True))
        .when(F.col("kind") == "word", F.regexp_like(F.col("_text"), F.concat(F.lit("(?<![a-z0-9])"), literal, F.lit("(?![a-z0-9])"))))
        .otherwise(F.contains("_text", F.col("alias"))))
    return joined.filter(inside).select(row, "alias", "company_id", "alias_length", (F.col("_text") == F.col("alias")).alias("is_exact"))


def match_companies(texts: DataFrame, index: DataFrame, row: str = "row_id", text: str = "text", salts: int = 8) -> DataFrame:
    """The company of each text when exactly one company's aliases occur in it.

    Longest alias wins within the company; equally long ones are ordered by text.
    """
    found = matches(texts, index, row, text, salts)
    best = found.groupBy(row).agg(
        F.min("company_id").alias("company_id"), F.max("company_id").alias("other"),
        F.max_by(F.struct("alias", "is_exact"), F.struct("alias_length", "alias")).alias("b"))
    size = F.length("b.alias")
    confidence = F.when(F.col("b.is_exact"), 0.95).when(size >= 10, 0.92).when(size >= 6, 0.88).otherwise(0.85)
    return best.filter(F.col("company_id") == F.col("other")).select(row, "company_id", F.col("b.alias").alias("alias"), confidence.alias("confidence"))


# ------------------------------------------------------------------ backfill


def searchable_text(columns: list[str], payload: str, names: tuple[str, ...]) -> Column:
    """Text columns and payload names joined for matching."""
    parts = [blank_to_null(strip(c)) for c in columns] + [blank_to_null(strip(F.get_json_object(payload, f"$.{n}"))) for n in names]
    return F.concat_ws(" | ", *parts)


RECORD_NAMES = ("company_name", "stock_name", "secName", "entity")
SIGNAL_NAMES = ("company_name", "stock_name", "secName")


def backfill(rows: DataFrame, index: DataFrame, text: Column, run_id: str, target: str, key: str = "id", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with missing company ids filled where the text names one company, plus the audit rows."""
    open_rows = rows.filter(F.col("company_id").isNull()).select(F.col(key).alias("row_id"), text.alias("text"))
    if limit:
        open_rows = open_rows.orderBy("row_id").limit(limit)
    matched = match_companies(open_rows, index).withColumnRenamed("company_id", "new_company_id")
    filled = rows.join(matched.select(F.col("row_id").alias(key), "new_company_id").hint("merge"), key, "left").withColumn(
        "company_id", F.coalesce("company_id", "new_company_id")).drop("new_company_id")
    audit = matched.join(open_rows.hint("merge"), "row_id").select(
        F.lit(run_id).alias("run_id"), F.lit(target).alias("target_table"), F.col("row_id").alias("target_row_id"), "new_company_id",
        F.lit("alias_match").alias("mapping_method"), "confidence", F.col("alias").alias("matched_alias"), F.left("text", F.lit(400)).alias("matched_context"))
    return filled, audit


def mapping_job(facts: DataFrame, signals: DataFrame, companies: DataFrame, run_id: str, order: list[str], do_sync: bool = True, do_backfill: bool = True) -> dict[str, DataFrame]:
    """Discovery and backfill in one run; the result frames and a summary, nothing is written."""
    out: dict[str, DataFrame] = {}
    known = companies
    if do_sync:
        found = market_companies(facts, order)
        out["new_companies"] = new_rows(companies, found, ["company_id"])
        known = companies.unionByName(out["new_companies"].withColumn("display_name", F.col("canonical_name")), allowMissingColumns=True)
    if do_backfill:
        index = alias_index(alias_candidates(known, facts))
        out["facts"], a = backfill(facts, index, searchable_text(["title", "summary"], "payload", RECORD_NAMES), run_id, "intelligence_records")
        out["signals"], b = backfill(signals, index, searchable_text(["signal_text", "value_text"], "extra", SIGNAL_NAMES), run_id, "trigger_signals")
        out["audit"] = a.unionByName(b)
        out["summary"] = out["audit"].groupBy("target_table").agg(F.count(F.lit(1)).alias("updated"))
    return out
