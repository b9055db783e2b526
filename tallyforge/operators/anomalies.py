"""Amount, duplicate and frequency anomalies of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alike import first_partners
from .spending import half_up, is_expense

#: Fixed values of the detectors.
Z_SCORE, MIN_ROWS = 2.5, 5
SIMILARITY, DUPLICATE_HOURS = 0.8, 48
DAY_COUNT, WEEK_COUNT = 3, 5


def exact_stats(value: str = "amount") -> list[Column]:
    """n, mean and population deviation in cents from exact sums, so that any order of rows gives the same doubles."""
    c = F.round(F.abs(value) * 100, 0).cast("decimal(18,0)")
    n, s, q = F.count(F.lit(1)), F.sum(c), F.sum((c * c).cast("decimal(36,0)"))
    spread = (n.cast("decimal(12,0)") * q.cast("decimal(26,0)")).cast("double") - s.cast("double") * s.cast("double")
    return [n.alias("n"), (s.cast("double") / n).alias("mean"), (F.sqrt(F.greatest(spread, F.lit(0.0))) / n).alias("deviation")]


def category_stats(txns: DataFrame) -> DataFrame:
    """Of categories with enough expenses that differ."""
    return txns.filter(is_expense()).groupBy("category").agg(*exact_stats()).filter((F.col("n") >= MIN_ROWS) & (F.col("deviation") > 0))


def amount_anomalies(txns: DataFrame, z: float = Z_SCORE) -> DataFrame:
    """id, category, z, kind of expenses far from their category's mean.  The statistics are one row a category."""
    df = txns.filter(is_expense()).join(category_stats(txns).withColumnRenamed("category", "c"), F.col("category") == F.col("c"))
    df = df.withColumn("z", (F.round(F.abs("amount") * 100, 0).cast("double") - F.col("mean")) / F.col("deviation"))
    kind = F.when(F.col("z") > z, "high_amount").when(F.col("z") < -z, "low_amount")
    return df.withColumn("kind", kind).filter("kind is not null").select("id", "category", "z", "kind")


def global_outliers(txns: DataFrame, z: float = 2.0, k: int = 5) -> DataFrame:
    """The ``k`` expenses farthest above the mean of all."""
    stats = txns.filter(is_expense()).agg(*exact_stats()).filter((F.col("n") >= MIN_ROWS) & (F.col("deviation") > 0))
    df = txns.filter(is_expense()).join(F.broadcast(stats), F.lit(True))  # one row
    df = df.withColumn("z", (F.round(F.abs("amount") * 100, 0).cast("double") - F.col("mean")) / F.col("deviation")).filter(F.col("z") > z)
    return df.orderBy(F.col("z").desc(), "ord").limit(k).select("id", "amount", half_up(F.col("z") * 100).cast("long").alias("z_hundredths"))


def duplicates(txns: DataFrame, hours: float = DUPLICATE_HOURS, similarity: float = SIMILARITY, measure: str = "edit") -> DataFrame:
    """id and duplicate_of of expenses with another within a cent, ``hours`` and alike in description: the first by cent offset, then ingest order."""
    return first_partners(txns, hours, similarity, measure)


def window_counts(txns: DataFrame, key: str = "merchant") -> DataFrame:
    """Rows of the same key within a day and a week, before and after, itself included.

    A row is counted in its own week of the calendar and stands in the two beside it for the others' sake, so that a
    busy key is split by weeks.
    """
    day, week = 86_400_000_000, 604_800_000_000
    at = F.unix_micros(F.col("date").cast("timestamp"))
    own = F.floor(F.col("_at") / week)
    df = txns.withColumn("_at", at).withColumn("_own", own).withColumn("_week", F.explode(F.when(F.col("_at").isNull(), F.array(own)).otherwise(F.array(own - 1, own, own + 1))))
    w = lambda span: Window.partitionBy(key, "_week").orderBy("_at").rangeBetween(-span, span)
    df = df.withColumns({"in_day": F.count(F.lit(1)).over(w(day)), "in_week": F.count(F.lit(1)).over(w(week))})
    return df.filter(F.col("_week").eqNullSafe(F.col("_own"))).drop("_at", "_own", "_week")


def frequency_anomalies(txns: DataFrame, key: str = "merchant") -> DataFrame:
    df = window_counts(txns.filter(is_expense()), key)
    by_day, by_week = F.col("in_day") >= DAY_COUNT, F.col("in_week") >= WEEK_COUNT
    df = df.withColumns({"period": F.when(by_day, "24h").when(by_week, "7d"), "times": F.when(by_day, F.col("in_day")).when(by_week, F.col("in_week"))})
    return df.filter("period is not null").select("id", "period", "times")


def assemble(txns: DataFrame) -> DataFrame:
    """Every row with anomaly_types (in the order amount, duplicate, frequency) and the details; other columns stay."""
    a = amount_anomalies(txns).select("id", "kind", F.col("z").alias("amount_deviation"))
    d, f = duplicates(txns), frequency_anomalies(txns)
    df = txns.join(a, "id", "left").join(d, "id", "left").join(f, "id", "left")
    kinds = F.array_compact(F.array(F.col("kind"), F.when(F.col("duplicate_of").isNotNull(), "duplicate"), F.when(F.col("period").isNotNull(), "frequency")))
    return df.withColumns({"anomaly_types": kinds, "is_anomaly": F.size(kinds) > 0}).drop("kind")


def type_counts(assembled: DataFrame) -> DataFrame:
    return assembled.select(F.explode("anomaly_types").alias("anomaly_type")).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
