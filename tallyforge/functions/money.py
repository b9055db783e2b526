"""Amounts from statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

GLYPHS = "₹$€£¥₩₽₺₫₱฿₦₴₪"


def parse_amount(col: Column, zero_is_null: bool = False) -> Column:
    """A number from '1,234.56', '1.234,56', '(500)', '₹ 1,23,456.78', '500 CR' or 'Rs. 500'; null for none, '-' and 'null'.

    Brackets and a minus sign make it negative.  A comma is a decimal mark if it stands after the last point with one
    or two digits behind it.
    """
    value = bound(F.trim(F.coalesce(col, F.lit(""))), _signed)
    return bound(value, lambda v: F.when(v != 0, v)) if zero_is_null else value


def _signed(t: Column) -> Column:
    empty = F.lower(t).isin("", "-", "--", "null", "n/a")
    negative = t.rlike(r"^\(.*\)$") | F.regexp_replace(t, rf"[{GLYPHS}\s]", "").startswith("-")
    bare = F.regexp_replace(F.regexp_replace(t, r"[A-Za-z]+\.?", ""), r"[^0-9.,]", "")
    # Most cells are digits, points and commas only: nothing to take out, and no sign.
    return F.when(t.rlike(r"^[0-9.,]+\z"), _plain(t)).when(~empty, bound(bound(bare, _plain), lambda v: F.when(negative, -v).otherwise(v)))


def _plain(bare: Column) -> Column:
    decimal_comma = bare.contains(",") & bare.rlike(r",\d{1,2}$") & ~bare.rlike(r",.*\.")
    plain = F.when(decimal_comma, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    return F.regexp_extract(plain, r"^\d*\.?\d+", 0).try_cast("double")


def debit_credit(debit: Column, credit: Column, amount: Column, kind: Column | None = None) -> Column:
    """struct(amount, type): the non-zero side, debit first; else a single amount by its type word or sign."""
    word = kind if kind is not None else F.lit(None).cast("string")
    sign = F.when(amount >= 0, "credit").otherwise("debit")
    make = lambda a, t: F.struct(F.abs(a).alias("amount"), t.alias("type"))
    return F.when(F.coalesce(debit, F.lit(0.0)) != 0, make(debit, F.lit("debit"))).when(F.coalesce(credit, F.lit(0.0)) != 0, make(credit, F.lit("credit"))).when(amount.isNotNull(), make(amount, F.coalesce(word, sign)))


#: Digits left of a place where a separator stands, by grouping style: threes, or a three and then twos.
GROUPS = {"western": r"\B(?=(\d{3})+$)", "indian": r"\B(?=(\d{2})*\d{3}$)", "none": r"$^"}


def grouped(number: Column, style: str = "western", mark: str = ",", point: str = ".") -> Column:
    """A plain decimal number (text, not negative) with its whole digits in groups; signs and what follows the point stay as they are."""
    whole, rest = F.substring_index(number, ".", 1), F.regexp_extract(number, r"\.(\d+)$", 1)
    return F.concat(F.regexp_replace(whole, GROUPS[style], mark), F.when(rest != "", F.concat(F.lit(point), rest)).otherwise(F.lit("")))


def abbreviated(points: Column) -> Column:
    return F.when(points >= 1_000_000, F.concat(F.format_number(points / 1_000_000, 1), F.lit("M"))).when(points >= 1000, F.concat(F.format_number(points / 1000, 1), F.lit("K"))).otherwise(points.cast("string"))
