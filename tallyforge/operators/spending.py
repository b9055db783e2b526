"""Grouped analytics of a ledger: months, categories, merchants, weekdays, dimensions, trends, periods.

``txns``: id, ord (ingest order, breaks ties), date, description, amount (decimal), type, category, category_type,
merchant and, for cards, source_type, card_issuer, card_last_four, card_holder, is_international, original_currency.
Dates of "today" are parameters.  Every function is a plain plan without actions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

is_income = lambda: F.col("category_type") == "Income"
is_expense = lambda: F.col("category_type") == "Expense"
is_excluded = lambda: F.col("category_type") == "Excluded"
on_card = lambda: F.col("source_type") == "credit_card"

#: Upper ends of the amount ranges (exclusive) with their keys; the last is open.
AMOUNT_RANGES = [(500, "<500"), (2000, "500-2000"), (10000, "2000-10000"), (None, ">10000")]


def half_up(col: Column) -> Column:
    """floor(x + 0.5): halves go up, also negative ones."""
    return F.floor(col + F.lit(0.5))


def month_key(col: Column | str = "date") -> Column:
    return F.date_format(col, "yyyy-MM")


def signed_amount() -> Column:
    return F.when(F.col("type") == "credit", F.col("amount")).otherwise(-F.col("amount"))


def flags(txns: DataFrame) -> DataFrame:
    return txns.withColumns({"is_income": is_income(), "is_expense": is_expense(), "is_excluded": is_excluded(), "signed_amount": signed_amount()})


def explore(txns: DataFrame, search: str | None = None, category: str | None = None, kind: str | None = None, source: str | None = None, date_from=None, date_to=None, issuer: str | None = None, last_four: str | None = None, txn_type: str | None = None) -> DataFrame:
    """Rows that meet all given filters (dates inclusive), newest first."""
    df = txns
    kinds = {"income": is_income(), "expense": is_expense(), "transfer": is_excluded()}
    for value, cond in (
        (search, lambda v: F.lower("description").contains(v.lower())),
        (category, lambda v: F.col("category") == v),
        (kind, lambda v: kinds[v]),
        (source, lambda v: F.col("source_type") == v),
        (issuer, lambda v: F.col("card_issuer") == v),
        (last_four, lambda v: F.col("card_last_four") == v),
        (txn_type, lambda v: F.col("type") == v),
        (date_from, lambda v: F.col("date") >= F.lit(v).cast("timestamp_ntz")),
        (date_to, lambda v: F.col("date") <= F.lit(v).cast("timestamp_ntz")),
    ):
        if value is not None:
            df = df.filter(cond(value))
    return df.orderBy(F.col("date").desc(), "ord")


def by_month(txns: DataFrame) -> DataFrame:
    """month, income, expense; whatever is not income counts as expense here."""
    zero = F.lit(0).cast("decimal(18,2)")
    return txns.groupBy(month_key().alias("month")).agg(F.sum(F.when(is_income(), F.col("amount")).otherwise(zero)).alias("income"), F.sum(F.when(is_income(), zero).otherwise(F.col("amount"))).alias("expense"))


def by_category(txns: DataFrame) -> DataFrame:
    return txns.groupBy("category").agg(F.sum(F.abs("amount")).alias("total"), F.count(F.lit(1)).alias("n"))


def by_category_month(txns: DataFrame) -> DataFrame:
    return txns.filter(is_expense()).groupBy("category", month_key().alias("month")).agg(F.sum("amount").alias("total"))


def with_share(df: DataFrame, value: str = "total", keys: list[str] | None = None, name: str = "share") -> DataFrame:
    """Share of the total (of each ``keys`` group), 0 where that is 0.  The totals are few rows, joined by no key or theirs."""
    w = Window.partitionBy(*(keys or []))
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(value).cast("double"), F.sum(value).over(w).cast("double")), F.lit(0.0)))


def by_weekday(txns: DataFrame) -> DataFrame:
    """Expenses by day of the week, all of 0 (Sunday) to 6."""
    days = txns.sparkSession.range(7).select(F.col("id").cast("int").alias("day"))
    sums = txns.filter(is_expense()).groupBy((F.dayofweek("date") - 1).alias("day")).agg(F.sum("amount").alias("total"))
    return days.join(sums, "day", "left").select("day", F.coalesce("total", F.lit(0)).cast("decimal(28,2)").alias("total"))


def top(df: DataFrame, k: int, value: str = "total", *ties: str) -> DataFrame:
    return df.orderBy(F.col(value).desc(), *ties).limit(k)


def top_merchants(txns: DataFrame, k: int = 5) -> DataFrame:
    key = F.coalesce(F.when(F.col("merchant") != "", F.col("merchant")), F.substring("description", 1, 30))
    return top(txns.filter(is_expense()).groupBy(key.alias("merchant")).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n")), k, "total", "merchant")


def top_categories(txns: DataFrame, k: int = 5, without: tuple[str, ...] = ("income", "transfer")) -> DataFrame:
    """With the rounded percentage of the total of the categories left."""
    df = with_share(by_category(txns).filter(~F.col("category").isin(*without)))
    return top(df.withColumn("percent", half_up(F.col("share") * 100).cast("int")), k, "total", "category")


def category_pie(txns: DataFrame, k: int = 8) -> DataFrame:
    """The largest categories, with tenths of a percent of their own sum."""
    df = with_share(top(by_category(txns), k, "total", "category"))
    return df.withColumn("tenths", half_up(F.col("share") * 1000).cast("int"))


def recent_average(txns: DataFrame, months: int = 3) -> DataFrame:
    """Averages over the latest months present, rounded to whole units."""
    last = by_month(txns).orderBy(F.col("month").desc()).limit(months)
    mean = lambda c: half_up(F.sum(c).cast("double") / F.count(F.lit(1))).cast("long")
    return last.agg(mean("income").alias("income"), mean("expense").alias("expense"), F.count(F.lit(1)).alias("months"))


def dashboard(txns: DataFrame) -> DataFrame:
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0).cast("decimal(28,2)"))
    df = txns.agg(total(is_income()).alias("income"), total(is_expense()).alias("expense"), F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))
    df = df.withColumn("balance", F.col("income") - F.col("expense"))
    return df.withColumn("savings_tenths", F.when(F.col("income") > 0, half_up(F.col("balance").cast("double") / F.col("income").cast("double") * 1000)).otherwise(0).cast("long"))


def trend(txns: DataFrame, unit: str = "month", last: int = 12) -> DataFrame:
    """Income and expense of the latest ``last`` weeks (from Monday) or months, empty ones as zeros."""
    step = F.expr(f"interval 1 {unit}")
    at = F.date_trunc(unit, "date").cast("date")
    span = txns.agg(F.min(at).alias("a"), F.max(at).alias("b"))
    axis = span.select(F.explode(F.sequence("a", "b", step)).alias("start")).orderBy(F.col("start").desc()).limit(last)
    zero = F.lit(0).cast("decimal(18,2)")
    sums = txns.groupBy(at.alias("start")).agg(F.sum(F.when(is_income(), F.col("amount")).otherwise(zero)).alias("income"), F.sum(F.when(is_expense(), F.col("amount")).otherwise(zero)).alias("expense"))
    return axis.join(sums, "start", "left").fillna(0, ["income", "expense"])


def dimension(name: str) -> Column:
    """The group key of a dimension."""
    size = F.abs("amount")
    ranges = F.when(size < AMOUNT_RANGES[0][0], AMOUNT_RANGES[0][1])
    for most, key in AMOUNT_RANGES[1:-1]:
        ranges = ranges.when(size < most, key)
    return {
        "category": F.coalesce("category", F.lit("uncategorized")),
        "card": F.when(on_card() & F.col("card_issuer").isNotNull(), F.concat("card_issuer", F.lit("-****"), "card_last_four")).otherwise("bank"),
        "amount_range": ranges.otherwise(AMOUNT_RANGES[-1][1]),
        "country": F.when(F.col("is_international") & F.col("original_currency").isNotNull(), F.concat(F.lit("International ("), "original_currency", F.lit(")"))).otherwise("Domestic"),
        "holder": F.coalesce("card_holder", F.lit("Primary")),
        "month": month_key(),
    }[name]


def by_dimension(txns: DataFrame, name: str) -> DataFrame:
    """Spending (expenses, or anything on a card) by one dimension, with count and share, largest first."""
    df = txns.filter(is_expense() | on_card()).groupBy(dimension(name).alias("key")).agg(F.sum(F.abs("amount")).alias("total"), F.count(F.lit(1)).alias("n"))
    return with_share(df).orderBy(F.col("total").desc(), "key")


def rollups(txns: DataFrame) -> DataFrame:
    """Category, month and both in one pass over the rows, by grouping sets."""
    df = txns.filter(is_expense()).withColumn("month", month_key())
    return df.groupingSets([["category", "month"], ["category"], ["month"], []], "category", "month").agg(F.grouping_id().cast("int").alias("level"), F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))


def compare_periods(txns: DataFrame, current: tuple[str, str], previous: tuple[str, str], key: str = "category") -> DataFrame:
    """Sums of two ranges (inclusive) for each key of either, with the change in percent (0 without a previous sum)."""
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    inside = lambda p: F.col("date").between(ts(p[0]), ts(p[1]))
    total = lambda p: F.coalesce(F.sum(F.when(inside(p), F.abs("amount"))), F.lit(0).cast("decimal(28,2)"))
    df = txns.filter((inside(current) | inside(previous)) & (is_expense() | on_card())).groupBy(key).agg(total(current).alias("now"), total(previous).alias("before"))
    change = F.when(F.col("before") > 0, (F.col("now") - F.col("before")).cast("double") / F.col("before").cast("double") * 100).otherwise(0.0)
    return df.withColumn("change", change).orderBy(F.col("now").desc(), key)


def card_merchants(txns: DataFrame, k: int = 5) -> DataFrame:
    """Card debits by the first two words of the description, 20 characters at most."""
    key = F.substring(F.array_join(F.slice(F.split("description", " "), 1, 2), " "), 1, 20)
    df = txns.filter(on_card() & (F.col("type") == "debit")).groupBy(key.alias("merchant")).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))
    return top(df, k, "total", "merchant")


def card_spend(txns: DataFrame, keys: list[str]) -> DataFrame:
    df = txns.filter(on_card() & (F.col("type") == "debit"))
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))


def card_months(txns: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Card spending of the latest months up to ``as_of``, empty ones as zeros."""
    end = F.trunc(F.lit(as_of).cast("date"), "month")
    axis = txns.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(end, 1 - months), end, F.expr("interval 1 month"))).alias("m"))
    axis = axis.select(F.date_format("m", "yyyy-MM").alias("month"))
    sums = txns.filter(on_card() & (F.col("type") == "debit")).groupBy(month_key().alias("month")).agg(F.sum("amount").alias("total"))
    return axis.join(sums, "month", "left").fillna(0, ["total"])


def international(txns: DataFrame) -> DataFrame:
    df = txns.filter(on_card() & F.col("is_international") & F.col("original_currency").isNotNull())
    return df.groupBy("original_currency").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n")).orderBy(F.col("total").desc(), "original_currency")


def distinct_cards(txns: DataFrame) -> DataFrame:
    """Each card with its first seen holder."""
    return txns.filter(on_card()).groupBy("card_issuer", "card_last_four").agg(F.min_by("card_holder", F.when(F.col("card_holder").isNotNull(), F.col("ord"))).alias("holder"), F.count(F.lit(1)).alias("n"))


def latest_months(txns: DataFrame, months: int = 2) -> DataFrame:
    """Income, expense and savings rate of the latest months present, and the change from the month before."""
    df = by_month(txns).orderBy(F.col("month").desc()).limit(months)
    rate = F.when(F.col("income") > 0, (F.col("income") - F.col("expense")).cast("double") / F.col("income").cast("double")).otherwise(0.0)
    w = Window.orderBy("month")
    return df.withColumn("rate", rate).withColumn("rate_change", F.col("rate") - F.lag("rate").over(w))


def forecast(txns: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """Monthly expense of each category: the sum since the first of the month ``months`` ago, divided by ``months``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    start = F.trunc(F.add_months(F.lit(as_of).cast("date"), -months), "month").cast("timestamp_ntz")
    df = txns.filter(is_expense() & F.col("date").between(start, now)).groupBy("category").agg(F.sum("amount").alias("total"))
    return df.withColumn("monthly", F.col("total").cast("double") / months)


def average_income(txns: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    start = F.trunc(F.add_months(F.lit(as_of).cast("date"), -months), "month").cast("timestamp_ntz")
    df = txns.filter(is_income() & F.col("date").between(start, now)).agg(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,2)")).alias("total"))
    return df.withColumn("monthly", F.col("total").cast("double") / months)


def budget_progress(spent: DataFrame, allocations: DataFrame) -> DataFrame:
    """category, budgeted, spent, percent and status: on-track to 75 %, warning to 100 %, over-budget beyond."""
    df = allocations.join(spent, "category", "left").withColumn("spent", F.coalesce("spent", F.lit(0).cast("decimal(28,2)")))
    percent = F.when(F.col("budgeted") > 0, F.col("spent").cast("double") / F.col("budgeted").cast("double") * 100).otherwise(0.0)
    return df.withColumn("percent", percent).withColumn("status", F.when(F.col("percent") <= 75, "on-track").when(F.col("percent") <= 100, "warning").otherwise("over-budget"))


def distribute_budget(forecasts: DataFrame, income: int) -> DataFrame:
    """Income dealt to the categories in proportion to their forecasts, rounded to whole units."""
    share = F.try_divide(F.col("total").cast("double"), F.sum("total").over(Window.partitionBy()).cast("double"))
    return forecasts.withColumn("budgeted", half_up(F.coalesce(share, F.lit(0.0)) * income).cast("long"))


def recent_months(txns: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Spending by month from the first day of ``months`` - 1 months ago, largest first."""
    start = F.trunc(F.add_months(F.lit(as_of).cast("date"), 1 - months), "month")
    return by_dimension(txns.filter(F.col("date") >= start), "month")


def latest_month(txns: DataFrame) -> DataFrame:
    """Income, expense, net and savings rate (tenths of a percent) of the last month present."""
    df = by_month(txns).orderBy(F.col("month").desc()).limit(1).withColumn("net", F.col("income") - F.col("expense"))
    return df.withColumn("savings_tenths", F.when(F.col("income") > 0, half_up(F.col("net").cast("double") / F.col("income").cast("double") * 1000)).otherwise(0).cast("long"))


def budget_totals(allocations: DataFrame, income: float, group: list[str] | None = None) -> DataFrame:
    """Sum of what is budgeted, and what is left of the income."""
    df = allocations.groupBy(*(group or [])).agg(F.sum("budgeted").alias("allocated"))
    return df.withColumn("remaining", F.lit(income).cast("decimal(18,2)") - F.coalesce("allocated", F.lit(0)))


def by_sub_type(txns: DataFrame, kinds: list[str], name: str = "total") -> DataFrame:
    """Sum of the rows whose transaction_sub_type is one of ``kinds``."""
    return txns.agg(F.coalesce(F.sum(F.when(F.col("transaction_sub_type").isin(*kinds), F.col("amount"))), F.lit(0).cast("decimal(28,2)")).alias(name))


def report(txns: DataFrame, as_of: str) -> DataFrame:
    """The analytics of a ledger as rows: section, key, key2, amount, other, n.

    Sections: month (income, expense), category, category_month, weekday, merchant and top_category (the largest),
    current_month and previous_month of ``as_of``, and all (rows; key and key2: first and last day).
    """
    none, nothing = F.lit(None).cast("string"), F.lit(0).cast("decimal(28,2)")

    def part(df: DataFrame, section: str, key: Column, key2: Column, amount: Column, other: Column, n: Column) -> DataFrame:
        kinds = (F.lit(section), key.cast("string"), key2.cast("string"), amount.cast("decimal(28,2)"), other.cast("decimal(28,2)"), n.cast("long"))
        return df.select(*[c.alias(x) for c, x in zip(kinds, ("section", "key", "key2", "amount", "other", "n"), strict=True)])

    c, months = F.col, by_month(txns)
    now = F.date_format(F.lit(as_of).cast("date"), "yyyy-MM")
    before = F.date_format(F.add_months(F.lit(as_of).cast("date"), -1), "yyyy-MM")
    ask = txns.sparkSession.range(1)
    of = lambda name, m: part(ask.join(months, c("month") == m, "left"), name, m, none, F.coalesce("income", nothing), F.coalesce("expense", nothing), F.lit(None))
    fine = txns.groupBy("category", month_key().alias("month"), F.dayofweek("date").alias("day")).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))
    sums = lambda *keys: fine.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    parts = [
        part(months, "month", c("month"), none, c("income"), c("expense"), F.lit(None)),
        part(sums("category"), "category", c("category"), none, c("total"), none, c("n")),
        part(sums("category", "month"), "category_month", c("category"), c("month"), c("total"), none, c("n")),
        part(sums("day"), "weekday", c("day") - 1, none, c("total"), none, c("n")),
        part(top_merchants(txns), "merchant", c("merchant"), none, c("total"), none, c("n")),
        part(top_categories(txns.filter(is_expense())), "top_category", c("category"), none, c("total"), none, F.lit(None)),
        of("current_month", now),
        of("previous_month", before),
        part(txns.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count(F.lit(1)).alias("n")), "all", F.to_date("a"), F.to_date("b"), none, none, c("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
