"""Text expressions: Column in, Column out, all inside whole-stage codegen unless noted."""

from __future__ import annotations

import html
import html.entities
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The entities that most texts have.
BASIC_ENTITIES = (
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"),
)
CJK_CLASS = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


# Fixed value: the characters that count as white space at the ends of a text.
BLANKS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(value: Column | str) -> Column:
    """Null-safe trim of every kind of white space at both ends."""
    return F.btrim(F.coalesce(col(value).cast("string"), F.lit("")), F.lit(BLANKS))


def squeeze(value: Column | str) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col(value), r"[\s\p{Z}]+", " "))


def _entity_map() -> Column:
    """Every named HTML entity, as written after the ampersand, from the standard library's table; a constant of the plan."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string, string>")


def _code_point(number: Column) -> Column:
    """The character of a numeric entity by the rules of HTML: Windows places for 128 to 159, nothing for what is no character."""
    moved = {n: html.unescape(f"&#{n};") for n in (0, 13, *range(128, 160))}
    shown = F.from_json(F.lit(json.dumps(moved)), "map<string, string>")
    outside = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    nothing = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
    made = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.coalesce(F.element_at(shown, number.cast("string")), F.when(outside, "\ufffd").when(nothing, "").otherwise(made))


ENTITY = r"^&(?:#([0-9]++)|#[xX]([0-9a-fA-F]++)|([^\t\n\f <&#;]{1,32}+));?"
LONGEST_BARE = 6  # letters of the longest entity that needs no semicolon


def entities_to_text(value: Column | str) -> Column:
    """Named, decimal and hexadecimal HTML entities as characters; a text without an ampersand is left alone.

    A name must end in a semicolon, except the old ones that HTML also knows without: of these the longest that the
    text begins with is taken, as browsers do. The text is cut before each ampersand, so all of it stays within the row.
    """
    text = col(value)
    names = _entity_map()

    def one(part: Column) -> Column:
        whole, decimal, hexed, name = (F.regexp_extract(part, ENTITY, i) for i in range(4))
        number = F.when(decimal != "", F.when(F.length(F.ltrim(decimal, F.lit("0"))) > 9, 0x110000).otherwise(decimal.try_cast("bigint"))).when(
            hexed != "", F.when(F.length(F.ltrim(hexed, F.lit("0"))) > 8, 0x110000).otherwise(F.conv(hexed, 16, 10).cast("bigint")))
        bare = [F.when(F.length(name) >= n, F.concat(F.element_at(names, F.left(name, F.lit(n))), F.substring(part, n + 2, 1 << 30))) for n in range(LONGEST_BARE, 1, -1)]
        rest = F.substring(part, F.length(whole) + 1, F.lit(1 << 30))
        exact = F.when(whole.endswith(";"), F.element_at(names, F.concat(name, F.lit(";"))))
        return (
            F.when(number.isNotNull(), F.concat(_code_point(number), rest))
            .when(name != "", F.coalesce(F.concat(exact, rest), *bare, part)).otherwise(part))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


def clean(value: Column | str, unescape: bool = True, every_entity: bool = False) -> Column:
    """Deep clean: entities, line endings, invisible marks, blanks, at most one empty line.

    Plain replacements do most of the work; only runs of blanks and of line breaks need a pattern. ``every_entity``
    knows the whole table of HTML, a large expression that is meant for whole columns, not for array functions.
    """
    text = F.coalesce(col(value).cast("string"), F.lit(""))
    if every_entity:
        return strip(_tidy(entities_to_text(text)))
    # Most texts have nothing to clean but their ends, which one look at them tells.
    return strip(F.when(text.rlike(UNTIDY), _tidy(text, BASIC_ENTITIES if unescape else ())).otherwise(text))


# What at least one step of ``_tidy`` would change.
UNTIDY = r"[&\r\t\f\x0b\u00a0\ufeff\u200b-\u200d]| [ \n]|\n\n\n"


def _tidy(text: Column, entities=()) -> Column:
    for entity, plain in entities:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    # One character map: carriage returns to line feeds, blanks to a blank, invisible marks to nothing.
    text = F.translate(text, "\r\t\f\x0b\u00a0\ufeff\u200b\u200c\u200d", "\n    ")
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.replace(text, F.lit(" \n"), F.lit("\n"))
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility folding, which Spark has no built-in for."""
    return text.map(lambda value: unicodedata.normalize("NFKC", value), na_action="ignore")


def alias_key(value: Column | str, fold: bool = True) -> Column:
    """The form aliases are compared in: NFKC, lower case, single blanks."""
    text = strip(value)
    if fold:
        # Only text with a non-ASCII character can change; the rest crosses to Python as null.
        text = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def contains_any(text: Column | str, words: tuple[str, ...] | list[str]) -> Column:
    """True when any word occurs as a plain substring."""
    pattern = "|".join(quote(word) for word in words)
    return F.coalesce(col(text).rlike(pattern), F.lit(False))


def quote(word: str) -> str:
    """Escape a literal for use inside a Java regular expression."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|&#" else ch for ch in word)


def first_group(text: Column | str, groups, otherwise: str) -> Column:
    """Name of the first group with a word in the text."""
    expr = None
    for name, words in groups:
        hit = contains_any(text, words)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(otherwise)


def first_sentence(value: Column | str) -> Column:
    """Text up to the first separator that occurs: '. ', then '; ', then the CJK full stop."""
    return leading_sentence(blank_to_null(squeeze(value)))


def leading_sentence(text: Column) -> Column:
    """As :func:`first_sentence`, for text that is single-blank already."""
    expr = None
    for mark in (". ", "; ", "。"):
        cut = F.trim(F.split_part(text, F.lit(mark), F.lit(1)))
        expr = F.when(text.contains(mark), cut) if expr is None else expr.when(text.contains(mark), cut)
    return expr.otherwise(text)


def pretty_label(value: Column | str) -> Column:
    text = F.trim(F.translate(col(value), "_-", "  "))
    return F.coalesce(blank_to_null(text), F.lit("unknown"))


def title_case(value: Column | str) -> Column:
    """Capital letter at the start and after every non-letter, lower case elsewhere."""
    pieces = F.split(F.lower(pretty_label(value)), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")


def truncate(value: Column | str, limit: int) -> Column:
    """Single-blank text, cut to ``limit`` characters with a trailing ellipsis when longer."""
    text = squeeze(value)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("..."))).otherwise(text)


def distinct_non_blank(array: Column, limit: int | None = None) -> Column:
    """Array without nulls, blanks and repeats, first occurrence kept."""
    kept = F.array_distinct(F.filter(array, lambda x: x.isNotNull() & (x != "")))
    return F.slice(kept, 1, limit) if limit else kept


def list_of(value: Column | str) -> Column:
    """Comma-separated text to an array of trimmed non-empty strings."""
    return F.filter(F.transform(F.split(col(value), ","), strip), lambda x: x != "")


def looks_like_html(value: Column | str, pattern: str) -> Column:
    head = F.substring(F.ltrim(F.coalesce(col(value), F.lit(""))), 1, 500)
    return head.rlike("(?i)" + pattern)


def media_type(explicit: Column | str, path: Column | str) -> Column:
    given = F.lower(strip(explicit))
    name = F.lower(strip(path))
    by_suffix = (
        (("pdf",), "application/pdf"), (("xbrl",), "application/xbrl+xml"), (("xml", "xhtml"), "application/xml"),
        (("json",), "application/json"), (("html", "htm"), "text/html"), (("csv",), "text/csv"),
        (("txt", "md"), "text/plain"),
    )
    expr = F.when(given != "", given)
    for suffixes, kind in by_suffix:
        expr = expr.when(name.rlike(r"\.(" + "|".join(suffixes) + ")$"), kind)
    return expr


def date_candidates(value: Column | str, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(value), F.lit(pattern), F.lit(0)))


def parse_indicator(value: Column | str) -> Column:
    """``key: number`` text to a struct, null when the text has another shape."""
    text = F.trim(F.coalesce(col(value), F.lit("")))
    pattern = r"(?i)^([a-z0-9_]+):\s*([+-]?\d+(?:\.\d+)?)$"
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.lower(F.regexp_extract(text, pattern, 1)).alias("key"),
            F.regexp_extract(text, pattern, 2).alias("value"),
        ),
    )


def squash(value: Column | str) -> Column:
    """Lower-case letters and digits only: the loose key used to compare names and filters."""
    return F.regexp_replace(F.lower(F.coalesce(col(value).cast("string"), F.lit(""))), "[^a-z0-9]", "")
