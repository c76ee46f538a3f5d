"""Number coercion and unit inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions.text import blank_to_null, col, strip


def is_date_like(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit("")).rlike(r"^20\d{2}(\d{2}){0,2}$|20\d{2}[年/\-.]\d{1,2}")


def to_number(value: Column | str) -> Column:
    """Messy number text to double; missing marks, dates and plain words give null.

    Two patterns per value: one that rules dates out and one that finds the number.
    """
    text = strip(value)
    negative = text.startswith("(") & text.endswith(")")
    body = F.when(negative, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    scale = F.when(body.endswith("亿"), F.lit(1e8)).when(body.endswith("万"), F.lit(1e4)).when(body.endswith("千"), F.lit(1e3)).otherwise(F.lit(1.0))
    # Currency marks, separators, percent signs and blanks stand for nothing.
    digits = F.translate(F.replace(text, F.lit("HK$"), F.lit("")), "$,，%％ \u00a0", "")
    number = F.regexp_extract(digits, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")
    missing = F.lower(text).isin(*rules.MISSING_TOKENS) | is_date_like(text)
    return F.when(~missing, number * scale * F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0)))


def to_percent(value: Column | str) -> Column:
    return to_number(F.replace(strip(value), F.lit("%"), F.lit("")))


def code_text(value: Column | str) -> Column:
    """Security code: a float suffix is dropped, digits win, other text is kept."""
    text = F.regexp_replace(strip(value), r"\.0$", "")
    digits = F.regexp_replace(text, r"\D", "")
    return F.coalesce(blank_to_null(digits), blank_to_null(text))


def infer_unit(indicator: Column | str, value_text: Column | str) -> Column:
    key = F.lower(F.coalesce(col(indicator), F.lit("")))
    return (
        F.when(F.coalesce(col(value_text).rlike("[%％]"), F.lit(False)), "percent")
        .when(key.rlike("rate|ratio|hibor"), "percent")
        .when(key.rlike("usd|hkd|cny|fob"), "currency")
    )
