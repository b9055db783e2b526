"""Debt payoff: simulations as folds over a bounded number of months, projections and payment strategies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import stored

#: Smallest payment as a part of the balance and in money, and the longest simulation.
MIN_PART, MIN_MONEY, MAX_MONTHS = 0.05, 200.0, 600


@F.pandas_udf(T.StructType([T.StructField("b", T.DoubleType()), T.StructField("m", T.IntegerType()), T.StructField("i", T.DoubleType()), T.StructField("p", T.DoubleType())]))
def _paid_off(balance: pd.Series, apr: pd.Series, part: pd.Series, least: pd.Series) -> pd.DataFrame:
    """Balance, months, interest and sum paid after paying ``part`` of the balance with its interest, ``least`` at
    least, each month until nothing is left; less than 1 counts as nothing and is paid with the last payment.

    Month by month over all rows of a batch that still owe something, since a month needs the one before.
    """
    b, m, i, p = balance.to_numpy(dtype=float).copy(), np.zeros(len(balance)), np.zeros(len(balance)), np.zeros(len(balance))
    apr, part, least = apr.to_numpy(dtype=float), part.to_numpy(dtype=float), least.to_numpy(dtype=float)
    nothing = np.isnan(b) | np.isnan(apr) | np.isnan(least)
    at = np.flatnonzero(~nothing & (b > 0))
    for _ in range(MAX_MONTHS):
        if not len(at):
            break
        interest = b[at] * apr[at] / 12
        due = b[at] + interest
        payment = np.minimum(np.maximum(due * part[at], least[at]), due)
        left = due - payment
        small = left < 1
        m[at] += 1
        i[at] += interest
        p[at] += np.where(small, due, payment)
        b[at] = np.where(small, 0.0, left)
        at = at[b[at] > 0]
    out = pd.DataFrame({"b": b, "m": pd.array(m, dtype="Int32"), "i": i, "p": p})
    out.loc[nothing] = None
    return out


def minimum_payoff(balance: Column, apr: Column) -> Column:
    """Paying the minimum of the balance with its interest, which falls with it."""
    return _paid_off(balance.cast("double"), apr.cast("double"), F.lit(MIN_PART), F.lit(MIN_MONEY))


def fixed_payoff(balance: Column, apr: Column, payment: Column) -> Column:
    """Paying a fixed sum; months is -1 and interest infinite if it does not cover the first month's interest."""
    never = payment.cast("double") <= balance.cast("double") * apr / 12
    f = _paid_off(balance.cast("double"), apr.cast("double"), F.lit(0.0), payment.cast("double"))
    inf = F.lit(float("inf"))
    return F.when(never, F.struct(balance.cast("double").alias("b"), F.lit(-1).alias("m"), inf.alias("i"), inf.alias("p"))).otherwise(f)


def projections(cards: DataFrame, scales: tuple[float, ...] = (1.1, 1.25, 1.5, 2.0)) -> DataFrame:
    """For each card (total_due, apr): payoff with the minimum, and with its first amount scaled up and fixed."""
    first = F.greatest(F.col("total_due").cast("double") * MIN_PART, F.lit(MIN_MONEY))
    df = cards.filter(F.col("total_due") > 0).withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    df = df.withColumn("payment", F.ceil(first * F.col("scale")).cast("long")).withColumn("f", fixed_payoff(F.col("total_due"), F.col("apr"), F.col("payment")))
    return df.filter("f.m >= 0").withColumns({"months": F.col("f.m"), "interest": F.col("f.i")}).drop("f")


def strategy(cards: DataFrame, available: float, order: str = "avalanche", group: list[str] | None = None) -> DataFrame:
    """Payments from a budget: minimums first, then the rest by rate (avalanche) or balance (snowball), as running sums.

    ``cards``: ord, balance, apr.  ``group``: each group has a budget of its own.  Cards are laid out in ranges of the
    order; a card's sums are those of the ranges before its own, of which there are as many as tasks, and those within
    it, so that one budget over all cards is not one task's work.  The ranges are a table, as they come from a sample.
    """
    group = group or []
    keys = [F.col("apr").desc(), F.col("ord")] if order == "avalanche" else [F.col("balance"), F.col("ord")]
    zero, a = F.lit(0.0), F.lit(float(available))
    df = cards.withColumn("_least", F.least(F.greatest(F.col("balance") * MIN_PART, F.lit(MIN_MONEY)), F.col("balance"))).withColumn("_open", F.col("balance") - F.col("_least"))
    tasks = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = stored(df.repartitionByRange(tasks, *[F.col(g) for g in group], *keys).withColumn("_range", F.spark_partition_id()))
    sums = ["_least", "_open", "_n"]
    ranges = df.withColumn("_n", F.lit(1)).groupBy(*group, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_range").alias("_of"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums], F.sum("_least").over(Window.partitionBy(*group)).alias("_all"))
    on = F.col("_range") == F.col("_of")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    w = Window.partitionBy(*group, "_range").orderBy(*keys)
    before = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero)
    base = F.least(F.col("_least"), F.greatest(zero, a - before("_least")))
    extra = F.least(F.col("_open"), F.greatest(zero, F.greatest(zero, a - F.col("_all")) - before("_open")))
    df = df.join(ranges, on).withColumns({"payment": base + extra, "priority": (F.col("_n_before") + F.row_number().over(w)).cast("int")})
    return df.select(*cards.columns, "payment", "priority")


def debt_free_months(total: Column, apr: Column, payment: Column, most: int = 120) -> Column:
    """Months until a sum of debts is paid with one payment, ``most`` at most."""
    left = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.struct(total.cast("double").alias("b"), F.lit(0).alias("m")),
        lambda a, _: F.struct(F.when(a["b"] <= 0, a["b"]).otherwise(a["b"] * (1 + apr / 12) - payment.cast("double")).alias("b"), F.when(a["b"] <= 0, a["m"]).otherwise(a["m"] + 1).alias("m")),
    )
    return left["m"]


def interest_totals(cards: DataFrame) -> DataFrame:
    """Sum of all balances (total_due, apr), and of the interest that paying minimums costs, in cents."""
    f = minimum_payoff(F.col("total_due"), F.col("apr"))
    each = cards.filter("total_due > 0").withColumn("f", f).select("total_due", F.floor(F.col("f.i") * 100 + 0.5).alias("c"))
    return each.agg(F.sum("total_due").alias("balance"), F.sum("c").alias("interest_cents"))
