"""Dates from statement text: many written forms, ambiguous orders, serial numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS, bound

FIRST_YEAR, LAST_YEAR = 1990, 2100


def full_year(year: Column) -> Column:
    """Two digits: below 50 in the 2000s, else in the 1900s."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("9999")).cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    y = full_year(y)
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when(y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & d.between(1, 31), made)


def _month(text: Column, pattern: str, group: int) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(F.regexp_extract(text, pattern, group), 1, 3)))
    return F.when(at > 0, at.cast("int"))


def parse_date(col: Column, order: str | Column = "DMY") -> Column:
    """A date or null.  A number above 12 settles day and month; else ``order`` does (DMY or MDY, of all or of each row)."""
    return bound(_without_extras(col), lambda t: _parse(t, order))


def _without_extras(col: Column) -> Column:
    """The text without a weekday before, a time of day after and the endings of ordinal numbers."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"(?i)[T\s]+\d{1,2}:\d{2}(:\d{2})?(\.\d+)?\s*([ap]m)?Z?$", ""))
    return F.regexp_replace(t, r"(?i)(\d)(st|nd|rd|th)\b", "$1")


def _parse(t: Column, order: str | Column) -> Column:
    ymd, name_dmy, name_mdy, both, compact = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/\s]+([A-Za-z]{3,9})[-/\s,]*(\d{4}|\d{2})$", r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s*(\d{4}|\d{2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", r"^(\d{4})(\d{2})(\d{2})$"
    first = order == "MDY" if isinstance(order, Column) else F.lit(order == "MDY")

    def of(x: Column) -> Column:
        month_first = (x["b"] > 12) | ((x["a"] <= 12) & first)
        return _date(x["y"], F.when(month_first, x["a"]).otherwise(x["b"]), F.when(month_first, x["b"]).otherwise(x["a"]))

    # A text is of one form at most, and only that one's numbers are looked for, each once.
    n = lambda p, k, name: _number(t, p, k).alias(name)
    made = lambda *parts: bound(F.struct(*parts), lambda x: _date(x["y"], x["m"], x["d"]))
    found = F.when(t.rlike(both), bound(F.struct(n(both, 1, "a"), n(both, 2, "b"), n(both, 3, "y")), of))
    found = found.when(t.rlike(ymd), made(n(ymd, 1, "y"), n(ymd, 2, "m"), n(ymd, 3, "d")))
    found = found.when(t.rlike(name_dmy), made(n(name_dmy, 3, "y"), _month(t, name_dmy, 2).alias("m"), n(name_dmy, 1, "d")))
    found = found.when(t.rlike(name_mdy), made(n(name_mdy, 3, "y"), _month(t, name_mdy, 1).alias("m"), n(name_mdy, 2, "d")))
    return found.when(t.rlike(compact), made(n(compact, 1, "y"), n(compact, 2, "m"), n(compact, 3, "d")))


def order_votes(col: Column) -> list[Column]:
    """Aggregates: rows whose first number can only be a day, and whose second can; more of the second mean MDY."""
    p = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]\d{2,4}"
    first, second = _number(col, p, 1), _number(col, p, 2)
    return [F.count_if(first > 12).alias("day_first"), F.count_if(second > 12).alias("month_first")]


def serial_date(n: Column) -> Column:
    """Spreadsheet day number (1 is 1899-12-31) to a date between 1990 and 2100."""
    d = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))
    return F.when(n.between(1, 100_000) & F.year(d).between(FIRST_YEAR, LAST_YEAR), d)


def date_in_text(col: Column, order: str = "DMY") -> Column:
    """The text itself, or the first date-like part of it."""
    part = F.regexp_extract(col, r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}[-\s][A-Za-z]{3,9}[-\s,]*\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})", 1)
    return F.coalesce(parse_date(col, order), parse_date(part, order))


def checked_date(col: Column) -> Column:
    """The date of an extracted field, or null: years of four digits before or after, month names of three letters, else
    the year first in two digits.  A number above 12 settles day and month, else the day is first; 1900 to 2100."""
    iso, named, ended, short = r"^(\d{4})[-/](\d{2})[-/](\d{2})$", r"^(\d{1,2})(?:\s+|-)([A-Za-z]{3})(?:[, ]+|-)(\d{4})$", r"^(\d{2})[-/](\d{2})[-/](\d{4})$", r"^(\d{2})[-/](\d{2})[-/](\d{2})$"

    def of(t: Column) -> Column:
        n = lambda p, k: _number(t, p, k)
        a, b = n(ended, 1), n(ended, 2)
        month_first = (a <= 12) & (b > 12)
        day = lambda y, m, d: F.when(y.between(1900, 2100), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))
        return F.coalesce(
            day(n(iso, 1), n(iso, 2), n(iso, 3)),
            day(n(named, 3), _month(t, named, 2), n(named, 1)),
            day(n(ended, 3), F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a)),
            day(n(short, 1) + 2000, n(short, 2), n(short, 3)),
        )

    return bound(col, of)
