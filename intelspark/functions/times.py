"""Period, timestamp and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions.text import col, strip

_SEP = r"[年/\-.]"
_COMPACT_DAY = r"^(20\d{2})(\d{2})(\d{2})$"
_COMPACT_MONTH = r"^(20\d{2})(\d{2})$"
_DAY = rf"(20\d{{2}}){_SEP}(\d{{1,2}})[月/\-.](\d{{1,2}})"
_MONTH = rf"(20\d{{2}}){_SEP}(\d{{1,2}})"
_YEAR = r"(?U)\b(20[0-9]{2})\b"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _in_range(text: Column, top: int) -> Column:
    number = text.try_cast("int")
    return F.coalesce(number.between(1, top), F.lit(False))


def period_of(value: Column | str) -> Column:
    """The period named in a text as YYYY-MM-DD, YYYY-MM or YYYY; the first rule that fits wins."""
    text = strip(value)

    def day(pattern: str) -> tuple[Column, Column]:
        year, month, dom = (_part(text, pattern, i) for i in (1, 2, 3))
        fits = text.rlike(pattern) & _in_range(month, 12) & _in_range(dom, 31)
        return fits, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(dom, 2, "0"))

    def month(pattern: str) -> tuple[Column, Column]:
        year, mon = (_part(text, pattern, i) for i in (1, 2))
        return text.rlike(pattern) & _in_range(mon, 12), F.concat_ws("-", year, F.lpad(mon, 2, "0"))

    rules_in_order = [day(_COMPACT_DAY), month(_COMPACT_MONTH), day(_DAY), month(_MONTH)]
    expr = None
    for fits, out in rules_in_order:
        expr = F.when(fits, out) if expr is None else expr.when(fits, out)
    return expr.when(text.rlike(_YEAR), _part(text, _YEAR, 1))


def record_time(record: Column, keys: tuple[str, ...] = rules.DATE_KEYS) -> Column:
    """Time of a record held as map<string,string>: preferred keys first, then any value."""
    preferred = [period_of(F.try_element_at(record, F.lit(key))) for key in keys]
    others = F.filter(F.transform(F.map_values(record), period_of), lambda x: x.isNotNull())
    return F.coalesce(*preferred, F.get(others, 0))


def loose_timestamp(value: Column | str) -> Column:
    """ISO with or without offset, slash dates, months and years; no offset means UTC; junk is null."""
    text = strip(value)
    shapes = (
        (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$", None),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        (r"^\d{4}-\d{1,2}$", "yyyy-M"),
        (r"^\d{4}$", "yyyy"),
    )
    expr = None
    for shape, fmt in shapes:
        parsed = text.try_cast("timestamp") if fmt is None else F.try_to_timestamp(text, F.lit(fmt))
        expr = F.when(text.rlike(shape), parsed) if expr is None else expr.when(text.rlike(shape), parsed)
    return expr


def epoch_ms_text(value: Column | str, zone: str = "Asia/Shanghai") -> Column:
    """Epoch milliseconds to local date-time text; anything else gives an empty text."""
    millis = strip(value).try_cast("bigint")
    local = F.from_utc_timestamp(F.timestamp_millis(millis), zone)
    return F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def epoch_ms_date(value: Column | str, zone: str = "Asia/Shanghai") -> Column:
    return F.split_part(epoch_ms_text(value, zone), F.lit(" "), F.lit(1))


def publication_time(value: Column | str) -> Column:
    """RFC-822 feed dates (with or without the weekday) and archive dates."""
    text = F.regexp_replace(strip(value), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
        .when(text.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"),
              F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss xx")))
        .when(text.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}$"),
              F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")))
    )


def split_iso(value: Column | str) -> Column:
    """ISO date-time text to its date and its 'date time' text."""
    text = strip(value)
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", "")
    return F.struct(F.left(text, F.lit(10)).alias("date"), plain.alias("datetime"))


def matches_year_month(period: Column | str, year: str | None, month: str | None) -> Column:
    if not year and not month:
        return F.lit(True)
    text = F.coalesce(col(period), F.lit(""))
    ok = text != ""
    if year:
        ok = ok & (F.split_part(text, F.lit("-"), F.lit(1)) == year)
    if month:
        ok = ok & (F.split_part(text, F.lit("-"), F.lit(2)) == month)
    return ok


def news_window(as_of: Column | str, *, months: int | None = None, days: int | None = None) -> Column:
    """Start of the last N months (day clamped to the month's end) or the last N days."""
    if months is not None:
        if months < 0:
            raise ValueError("months must not be negative")
        start = F.add_months(col(as_of), -months)
    else:
        start = F.date_sub(col(as_of), days or 0)
    return start


def month_keys(start: Column | str, end: Column | str) -> Column:
    """yyyyMM keys of every month touched by a closed range; empty when the range is reversed."""
    first, last = F.trunc(col(start), "month"), F.trunc(col(end), "month")
    keys = F.transform(
        F.sequence(first, F.greatest(first, last), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyyMM")
    )
    return F.when(col(start) > col(end), F.array().cast("array<string>")).otherwise(keys)
