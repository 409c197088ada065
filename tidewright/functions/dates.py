"""Tolerant dates: a bad start is flagged, never dropped; an end says whether something is still going on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, is_blank, trim_ws

ONGOING = ("", "-", "on-going", "ongoing", "tbd", "current", "present")
FIRST_YEAR, LAST_YEAR = 1990, 2100
LAST_SERIAL = 60_000
#: tried in this order; the guards ask for the exact number of digits
FORMATS = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
    (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "MM/dd/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "dd/MM/yyyy"),
)
INVALID = "date_invalid"


def is_ongoing(end: Column | str) -> Column:
    return F.lower(trim_ws(F.coalesce(as_column(end), F.lit("")))).isin(*ONGOING)


def within_range(day: Column) -> Column:
    return F.year(day).between(FIRST_YEAR, LAST_YEAR)


def parse_start(start: Column | str) -> Column:
    """A date out of text: the part before a space or ``T``, a spreadsheet serial or one of the formats, in range."""
    token = F.regexp_extract(trim_ws(F.coalesce(as_column(start), F.lit(""))), r"^[^ T]*", 0)
    # a lambda's variable holds the token, which would be cut out again for every format
    return F.get(F.transform(F.array(token), _parsed), F.lit(0))


def _parsed(token: Column) -> Column:
    serial = F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("int"))
    counted = F.when((serial > 0) & (serial < LAST_SERIAL), F.date_add(F.lit("1899-12-30").cast("date"), serial))
    tried = [F.when(token.rlike(guard), F.call_function("try_to_date", token, F.lit(form))) for guard, form in FORMATS]
    day = F.coalesce(counted, *tried)
    return F.when(within_range(day), day)


def normalize_dates(start: Column | str, end: Column | str) -> Column:
    """``start`` (date or null), ``is_active`` and ``flag`` (set if the start is invalid)."""
    day = parse_start(start)
    return F.struct(day.alias("start"), is_ongoing(end).alias("is_active"), F.when(day.isNull(), F.lit(INVALID)).alias("flag"))


__all__ = ["FORMATS", "INVALID", "ONGOING", "is_blank", "is_ongoing", "normalize_dates", "parse_start", "within_range"]
