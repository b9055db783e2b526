"""Credit-card analytics over statements: latest, utilization, dues, payment behaviour, rewards, debt risk, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spending import half_up

CARD = ["card_issuer", "card_last_four"]
#: Interest rate a year and value of a point where the issuer is not known.
DEFAULT_APR, DEFAULT_POINT_VALUE = 0.42, 0.20


def latest(statements: DataFrame) -> DataFrame:
    """The newest statement of each card; of equal dates the first in order."""
    w = Window.partitionBy(*CARD).orderBy(F.col("statement_date").desc(), "ord")
    return statements.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def utilization(statements: DataFrame) -> DataFrame:
    """Due against limit of each card and of all together."""
    all_cards = Window.partitionBy()
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(0.0)
    df = latest(statements).select(*CARD, "total_due", "credit_limit")
    df = df.withColumn("utilization", ratio(F.col("total_due"), F.col("credit_limit")))
    return df.withColumn("overall", ratio(F.sum("total_due").over(all_cards), F.sum("credit_limit").over(all_cards)))


def utilization_band(u: Column) -> Column:
    return F.when(u <= 0.1, "excellent").when(u <= 0.3, "good").when(u <= 0.5, "fair").otherwise("high")


def due_dates(statements: DataFrame, as_of: str) -> DataFrame:
    """Unpaid latest statements with the days left, soonest first."""
    df = latest(statements).filter(~F.col("is_paid")).withColumn("days_left", F.datediff("payment_due_date", F.lit(as_of).cast("date")))
    return df.withColumn("overdue", F.col("days_left") < 0).orderBy("days_left", *CARD).select(*CARD, "payment_due_date", "total_due", "minimum_due", "days_left", "overdue")


def since_months(as_of: str, months: int) -> Column:
    return F.trunc(F.add_months(F.lit(as_of).cast("date"), -months), "month")


def payment_behaviour(statements: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    df = statements.filter(F.col("statement_date") >= since_months(as_of, months))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("payments_received") >= F.col("total_due")).alias("full"),
        F.count_if(F.col("late_fee") == 0).alias("on_time"),
        F.coalesce(F.sum("interest_charged"), F.lit(0).cast("decimal(28,2)")).alias("interest"),
    )


def cashback(statements: DataFrame) -> DataFrame:
    """Cashback, spending and rate of each card, best rate first."""
    df = statements.groupBy(*CARD).agg(F.sum("cashback_earned").alias("cashback"), F.sum("total_due").alias("spend"))
    rate = F.when(F.col("spend") > 0, F.col("cashback").cast("double") / F.col("spend").cast("double")).otherwise(0.0)
    return df.withColumn("rate", rate).orderBy(F.col("rate").desc(), *CARD)


def reward_points(statements: DataFrame, point_value: float = DEFAULT_POINT_VALUE) -> DataFrame:
    """Points of each card; ``smoothed`` halves the distance to each statement's points for unit spend, in order."""
    rate = F.try_divide(F.col("points_earned").cast("double"), F.col("total_due").cast("double"))
    rates = F.array_sort(F.collect_list(F.when(F.col("points_earned") > 0, F.struct("ord", rate.alias("rate")))))  # a card's own statements
    df = statements.groupBy(*CARD).agg(F.sum("points_earned").alias("earned"), F.sum("points_redeemed").alias("redeemed"), rates.alias("_rates"))
    smooth = F.aggregate("_rates", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["rate"]).otherwise((a + x["rate"]) / 2))
    return df.select(*CARD, "earned", "redeemed", smooth.alias("smoothed"), ((F.col("earned") - F.col("redeemed")) * F.lit(point_value)).alias("value"))


def compare_cards(txns: DataFrame, statements: DataFrame) -> DataFrame:
    """Every card with its spending (zero without), count, utilization and its three largest categories."""
    own = txns.filter(F.col("source_type") == "credit_card")
    by = own.groupBy(*CARD, "category").agg(F.sum("amount").alias("t"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*CARD).orderBy(F.col("t").desc(), "category")
    by = by.withColumn("place", F.row_number().over(w))
    sums = by.groupBy(*CARD).agg(F.sum("t").alias("total"), F.sum("c").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "category")))), lambda x: x["category"])).alias("top_categories"))
    df = utilization(statements).select(*CARD, "utilization").join(sums, CARD, "left")
    return df.fillna(0, ["total", "n"]).fillna("", ["top_categories"]).orderBy(F.col("total").desc(), *CARD)


def true_balance(txns: DataFrame, statements: DataFrame) -> DataFrame:
    """Bank income less bank expenses less what the cards owe."""
    bank = F.coalesce(F.col("source_type"), F.lit("bank")) != "credit_card"
    total = lambda c: F.coalesce(F.sum(F.when(bank & c, F.col("amount"))), F.lit(0).cast("decimal(28,2)"))
    a = txns.agg(total(F.col("category_type") == "Income").alias("income"), total(F.col("category_type") == "Expense").alias("expense"))
    owed = latest(statements).agg(F.coalesce(F.sum("total_due"), F.lit(0).cast("decimal(28,2)")).alias("owed"))
    return a.join(F.broadcast(owed), F.lit(True)).withColumn("balance", F.col("income") - F.col("expense") - F.col("owed"))  # one row each


def revolving_runs(statements: DataFrame) -> DataFrame:
    """The longest run of consecutive statements of a card that were paid less than 95 %."""
    short = F.col("payments_received").cast("decimal(20,4)") * 100 < F.col("total_due").cast("decimal(20,4)") * 95
    own = Window.partitionBy(*CARD).orderBy("statement_date", "ord")
    df = statements.withColumn("short", short).withColumn("a", F.row_number().over(own)).withColumn("b", F.row_number().over(Window.partitionBy(*CARD, "short").orderBy("statement_date", "ord")))
    runs = df.groupBy(*CARD, "short", (F.col("a") - F.col("b")).alias("island")).agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(*CARD).agg(F.coalesce(F.max(F.when(F.col("short"), F.col("len"))), F.lit(0)).alias("longest"), F.sum("len").alias("n"))


def balance_trend(statements: DataFrame) -> DataFrame:
    """Slope of the balance a month (30 days from the first statement) against the mean balance; 0 if undefined."""
    first = Window.partitionBy(*CARD)
    x = F.datediff("statement_date", F.min("statement_date").over(first)) / 30.0
    y = F.col("total_due").cast("double")
    df = statements.withColumns({"x": x, "y": y}).groupBy(*CARD).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.avg("y").alias("mean"))
    return df.withColumn("trend", F.when((F.col("n") >= 2) & (F.col("mean") != 0), F.coalesce(F.col("slope"), F.lit(0.0)) / F.col("mean")).otherwise(0.0))


def revolving_status(statements: DataFrame) -> DataFrame:
    """Rates of full and minimum-only payment, the longest run, and the risk that follows."""
    paid, due, least = (F.col(c).cast("decimal(20,4)") for c in ("payments_received", "total_due", "minimum_due"))
    df = statements.groupBy(*CARD).agg(F.count(F.lit(1)).alias("n"), F.count_if(paid * 100 >= due * 95).alias("full"), F.count_if((paid > 0) & (paid * 100 <= least * 105)).alias("minimum"), F.sum("total_due").alias("owed"))
    df = df.join(revolving_runs(statements).select(*CARD, "longest"), CARD)
    rate = F.col("full").cast("double") / F.col("n")
    risk = F.when((rate >= 0.9) & (F.col("longest") < 3), "none").when((rate >= 0.7) & (F.col("longest") < 6), "low").when((rate >= 0.5) & (F.col("longest") < 12), "medium").otherwise("high")
    return df.withColumns({"full_rate": rate, "revolving": 2 * (F.col("n") - F.col("full")) > F.col("n"), "minimum_only": 2 * F.col("minimum") > F.col("n"), "risk": risk})


def debt_trap(statements: DataFrame) -> DataFrame:
    """Cards at risk, what they owe on average, and the worst risk; two high ones are critical."""
    df = revolving_status(statements)
    high = F.count_if(F.col("risk") == "high")
    worst = F.when(high >= 2, "critical").when(high == 1, "high").when(F.count_if(F.col("risk") == "medium") > 0, "medium").when(F.count_if(F.col("risk") == "low") > 0, "low").otherwise("none")
    return df.agg(F.count_if(F.col("risk") != "none").alias("cards"), F.sum(F.when(F.col("risk") != "none", half_up(F.col("owed").cast("double") / F.col("n")).cast("long")).otherwise(0)).alias("owed"), worst.alias("worst"))


def band_score(value: Column, limits: list[tuple[float, int]], rest: int) -> Column:
    out = F.when(value <= limits[0][0], limits[0][1])
    for most, score in limits[1:]:
        out = out.when(value <= most, score)
    return out.otherwise(rest)


def credit_health(statements: DataFrame, as_of: str) -> DataFrame:
    """0 to 100: utilization 40 %, full payment 35 %, on time 15 %, a clean record of late fees 10 %."""
    u = utilization(statements).agg(F.max("overall").alias("u"))
    b = payment_behaviour(statements, as_of)
    df = b.join(F.broadcast(u), F.lit(True))  # one row each
    full, on_time = (F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n")), F.lit(0.0)) for c in ("full", "on_time"))
    used = band_score(F.coalesce("u", F.lit(0.0)), [(0.1, 100), (0.3, 80), (0.5, 60)], 40)
    trend = F.when(on_time >= 0.5, 100).otherwise(50)
    return df.select(half_up(used * 0.40 + full * 100 * 0.35 + on_time * 100 * 0.15 + trend * 0.10).cast("int").alias("score"), "n", "full", "on_time")


def of_card(statements: DataFrame, issuer: str, last_four: str | None = None) -> DataFrame:
    df = statements.filter(F.col("card_issuer") == issuer)
    return df if last_four is None else df.filter(F.col("card_last_four") == last_four)


def unpaid(statements: DataFrame) -> DataFrame:
    """Unpaid statements, the soonest due first."""
    return statements.filter(~F.col("is_paid")).orderBy("payment_due_date", "ord")


def most_urgent(statements: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The next due date that is not overdue by more than ``days``."""
    return due_dates(statements, as_of).filter(~F.col("overdue") | (F.abs("days_left") <= days)).orderBy("days_left", *CARD).limit(1)


def due_with_statement(statements: DataFrame, as_of: str) -> DataFrame:
    """Due dates with the statement (ord) by which each card is marked as paid."""
    return due_dates(statements, as_of).join(latest(statements).select(*CARD, F.col("ord").alias("statement")), CARD, "left")


def top_card_categories(txns: DataFrame, k: int = 3) -> DataFrame:
    """place, category and total of the ``k`` largest categories of each card."""
    sums = txns.filter(F.col("source_type") == "credit_card").groupBy(*CARD, "category").agg(F.sum("amount").alias("total"))
    place = F.row_number().over(Window.partitionBy(*CARD).orderBy(F.col("total").desc(), "category"))
    return sums.withColumn("place", place).filter(F.col("place") <= k)


def ordered(comparison: DataFrame, by: str = "total", descending: bool = True) -> DataFrame:
    """A comparison of cards by total, n or utilization."""
    if by not in ("total", "n", "utilization"):
        raise ValueError(f"cards are not ordered by {by}")
    return comparison.orderBy(F.col(by).desc() if descending else F.col(by), *CARD)


def rewards_total(cashbacks: DataFrame, points: DataFrame) -> DataFrame:
    """Cashback and the value of points of all cards in one sum."""
    both = cashbacks.agg(F.coalesce(F.sum("cashback"), F.lit(0)).cast("double").alias("c")).join(F.broadcast(points.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("p"))), F.lit(True))  # one row each
    return both.select((F.col("c") + F.col("p")).alias("total"))


def statement_rows(summaries: DataFrame, parsed_at: str) -> DataFrame:
    """Card statements from extracted summaries: missing sums are 0, texts empty, dates the time of parsing; nothing is
    paid or expired yet.  A period needs both of its ends."""
    now = F.lit(parsed_at).cast("date")
    money = ["total_due", "minimum_due", "credit_limit", "available_credit", "previous_balance", "payments_received", "purchases_and_charges", "interest_charged", "late_fee", "other_charges", "cashback_earned"]
    period = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    return summaries.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)") for c in money},
            **{c: F.coalesce(F.col(c), F.lit("")) for c in CARD},
            **{c: F.coalesce(F.col(c), now) for c in ("statement_date", "payment_due_date")},
            **{c: F.when(period, F.col(c)).otherwise(now) for c in ("period_start", "period_end")},
            "points_expired": F.lit(0).cast("long"),
            "is_paid": F.lit(False),
        }
    )
