"""URL, identifier, JSON and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions import json_tree
from intelspark.functions.rows import spread_array
from intelspark.functions.text import blank_to_null, col, strip


def slug(name: Column | str, namespace: str = "hkg") -> Column:
    def part(text: Column, default: str) -> Column:
        dashed = F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "-")
        return F.coalesce(blank_to_null(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit(default))

    return F.concat(part(F.lit(namespace), "hkg"), F.lit("-"), part(col(name), "unknown-company"))


def public_url(raw: Column | str) -> Column:
    text = strip(raw)
    return (
        F.when(text.rlike("^https?://"), text)
        .when(text.startswith("www."), F.concat(F.lit("https://"), text))
        .when(text.contains(".") & ~text.startswith("/"), F.concat(F.lit("https://"), text))
    )


def wikipedia_title(url: Column | str) -> Column:
    full = public_url(url)
    host = F.lower(F.coalesce(F.regexp_extract(full, r"^https?://([^/?#]*)", 1), F.lit("")))
    path = F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)
    title = F.regexp_extract(F.regexp_replace(path, "^/+|/+$", ""), "^wiki/(.*)$", 1)
    # A plus sign is literal in a path, but the decoder reads it as a blank.
    decoded = F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B")))
    text = strip(F.replace(F.coalesce(decoded, title), F.lit("_"), F.lit(" ")))
    return F.when(host.contains("wikipedia.org"), blank_to_null(text))


def article_id(link: Column | str) -> Column:
    """Last path element of a link without its .html ending."""
    path = F.regexp_extract(strip(link), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(name, r"\.html$", "")


def absolute_url(link: Column | str, base: str) -> Column:
    """Root-relative or plain-relative link made absolute under the base address."""
    text = strip(link)
    root = base.rstrip("/")
    return (
        F.when(text == "", "")
        .when(text.rlike("^https?://"), text)
        .otherwise(F.concat(F.lit(root + "/"), F.regexp_replace(text, "^/+", "")))
    )


def canonical_json(columns: list[str]) -> Column:
    """JSON of the given columns in name order, nulls kept: the text content hashes are made of."""
    return F.to_json(F.struct(*[F.col(name) for name in sorted(columns)]), {"ignoreNullFields": "false"})


def content_hash(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def natural_key(dataset: Column, fields: dict[str, Column], fallback: Column | None = None) -> Column:
    """dataset|present key fields|fallback, the joined part cut to 400 characters."""
    parts = [blank_to_null(strip(fields[name])) for name in rules.NATURAL_KEY_FIELDS if name in fields]
    if fallback is not None:
        parts.append(blank_to_null(fallback))
    joined = F.concat_ws("|", *parts)
    names = sorted(fields)
    hashed = F.left(
        F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in names]), {"ignoreNullFields": "false"}), 256), F.lit(16)
    )
    body = F.when(joined == "", hashed).otherwise(F.left(joined, F.lit(400)))
    return F.concat(dataset, F.lit("|"), body)


def find_text_deep(df: DataFrame, payload: str, keys: tuple[str, ...], out: str) -> DataFrame:
    """First non-blank string under one of the keys, depth first at any depth; null where the payload is not JSON."""
    return df.withColumn(out, json_tree.find_text(payload, keys))


def json_lines(df: DataFrame, key: str, payload: str) -> DataFrame:
    """One ``path: value`` row per leaf of each JSON text, numbered in document order; other texts give no row."""
    return spread_array(df, [key], json_tree.json_lines(payload), "line", "pos")
