"""Recurring payments: merchant clusters, intervals, frequency classes, confidence and the next date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import recurring_name

from .firstfit import first_fit
from .spending import half_up

#: Expected days and tolerance of each frequency, in order of preference.
FREQUENCIES = [("weekly", 7, 2), ("monthly", 30, 7), ("quarterly", 91, 14), ("yearly", 365, 30)]
#: Words that never make two merchants one, and subscription words.
COMMON_WORDS = ["the", "and", "for", "inc", "ltd"]
SUBSCRIPTION_WORDS = ["netflix", "spotify", "youtube", "gym", "membership", "subscription", "monthly", "annual", "insurance", "internet", "phone", "hosting", "cloud"]
SCORE = 0.7


def first_long_word(name: Column) -> Column:
    return F.get(F.filter(F.split(name, " "), lambda w: F.length(w) > 2), 0)


def merchants_match(a: Column, b: Column) -> Column:
    """Equal, one within the other, or the same first word of more than two letters that is not a common one."""
    word = first_long_word(a)
    same = (word == first_long_word(b)) & ~word.isin(*COMMON_WORDS)
    return (a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a) | F.coalesce(same, F.lit(False)))


def clusters(txns: DataFrame) -> DataFrame:
    """name, cluster: first-fit groups of distinct normalized names in order of first appearance, named by their first.

    Rows with neither merchant nor description, or whose name is nothing but signs and company words, are in no group."""
    names = txns.groupBy(recurring_name(F.coalesce("merchant", "description")).alias("name")).agg(F.min("ord").alias("ord")).filter("name != ''")
    word = first_long_word(F.col("name"))
    return first_fit(names, F.when(~word.isin(*COMMON_WORDS), word))


def intervals(txns: DataFrame, key: str = "merchant") -> DataFrame:
    """Whole days between consecutive payments of a key, those above zero."""
    at = F.unix_micros(F.col("date").cast("timestamp"))
    gap = half_up((at - F.lag(at).over(Window.partitionBy(key).orderBy(at, "ord"))) / 86_400_000_000).cast("int")
    return txns.withColumn("gap", gap).filter("gap > 0").select(key, "id", "gap")


def gap_stats(gaps: DataFrame, key: str = "merchant") -> DataFrame:
    """n, mean and population deviation from exact sums."""
    n, s, q = F.count(F.lit(1)), F.sum("gap"), F.sum(F.col("gap").cast("long") * F.col("gap"))
    return gaps.groupBy(key).agg(n.alias("n"), (s.cast("double") / n).alias("mean_gap"), (F.sqrt((n * q - s * s).cast("double")) / n).alias("gap_deviation"))


def frequency(mean: Column, deviation: Column) -> Column:
    out = None
    for name, days, tolerance in FREQUENCIES:
        fits = (F.abs(mean - days) <= tolerance) & (deviation <= 1.5 * tolerance)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def expected_days(freq: Column) -> Column:
    out = None
    for name, days, _ in FREQUENCIES:
        out = F.when(freq == name, days) if out is None else out.when(freq == name, days)
    return out


def confidence(n: Column, cv: Column, interval_variance: Column, subscription: Column) -> Column:
    """0 to 1 from the number of payments, the spread of amounts (0 above 10 %) and of intervals, and a known word."""
    count = F.when(n >= 6, 0.3).when(n >= 4, 0.2).when(n >= 3, 0.1).when(n >= 2, 0.05).otherwise(0.0)
    amount = F.when(cv < 0.05, 0.2).when(cv < 0.10, 0.15).otherwise(-0.1)
    steady = F.when(interval_variance < 0.1, 0.2).when(interval_variance < 0.2, 0.15).when(interval_variance < 0.3, 0.1).otherwise(-0.1)
    score = F.lit(0.5) + count + amount + steady + F.when(subscription, 0.1).otherwise(0.0)
    return F.when(cv > 0.10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def next_date(last: Column, freq: Column) -> Column:
    """Seven days, or one, three or twelve months on; a day past the month's end runs over into the next."""
    months = F.when(freq == "monthly", 1).when(freq == "quarterly", 3).when(freq == "yearly", 12)
    moved = F.date_add(F.add_months(F.trunc(last, "month"), months), F.dayofmonth(last) - 1)
    return F.when(freq == "weekly", F.date_add(last, 7)).otherwise(moved)


def monthly_equivalent(amount: Column, freq: Column) -> Column:
    a = amount.cast("double")
    return F.when(freq == "weekly", a * 4.33).when(freq == "monthly", a).when(freq == "quarterly", a / 3).when(freq == "yearly", a / 12)


def recurring_payments(txns: DataFrame, as_of: str, key: str = "merchant", least: float = SCORE) -> DataFrame:
    """One row a key: n, frequency, confidence, latest amount and category (by ingest order), dates, activity.

    Active: the last payment is at most three expected periods before ``as_of``.
    """
    gaps = gap_stats(intervals(txns, key), key).withColumnsRenamed({key: "gap_key", "n": "gaps"})
    c = F.round(F.abs("amount") * 100, 0).cast("long")
    n, s, q = F.count(F.lit(1)), F.sum(c), F.sum((c * c).cast("decimal(36,0)"))
    spread = F.greatest((n.cast("decimal(12,0)") * q.cast("decimal(26,0)")).cast("double") - s.cast("double") * s.cast("double"), F.lit(0.0))
    sums = txns.groupBy(key).agg(
        n.alias("n"), F.try_divide(F.sqrt(spread), s.cast("double")).alias("cv"), F.max("date").cast("date").alias("last"),
        F.max_by("amount", "ord").alias("amount"), F.min_by("category", "ord").alias("category"),
    )
    df = sums.join(gaps, F.col(key) == F.col("gap_key")).withColumn("frequency", frequency(F.col("mean_gap"), F.col("gap_deviation"))).filter("frequency is not null")
    days = expected_days(F.col("frequency"))
    known = F.lower(F.col(key)).rlike("|".join(SUBSCRIPTION_WORDS))
    df = df.withColumn("confidence", confidence(F.col("n"), F.coalesce("cv", F.lit(0.0)), F.col("gap_deviation") / days, known)).filter(F.col("confidence") >= least)
    df = df.withColumns({"next": next_date(F.col("last"), F.col("frequency")), "active": F.datediff(F.lit(as_of).cast("date"), "last") <= days * 3})
    return df.select(key, "n", "frequency", "confidence", "amount", "category", "last", "next", "active")


def without_excluded(payments: DataFrame, excluded: DataFrame, key: str = "merchant") -> DataFrame:
    """Payments whose name neither holds nor lies within an excluded one (``excluded``: name; a short list by hand)."""
    e = excluded.select(F.lower("name").alias("ex"))
    name = F.lower(F.col(key))
    return payments.join(e, name.contains(F.col("ex")) | F.col("ex").contains(name), "left_anti")


def monthly_total(payments: DataFrame) -> DataFrame:
    each = monthly_equivalent(F.col("amount"), F.col("frequency"))
    return payments.filter("active").groupBy("frequency").agg(F.count(F.lit(1)).alias("n"), F.sum(half_up(each * 100).cast("long")).alias("monthly_cents"))
