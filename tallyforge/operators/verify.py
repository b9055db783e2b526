"""Checks of extracted statements: validation, reconciliation, running balances, row evidence, near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import checked_date, parse_date
from tallyforge.functions.text import noise_row, verification_text

from .alike import all_partners, earlier_partners

TOLERANCE = 1.0
ACCEPT = 75


def validate_rows(rows: DataFrame) -> DataFrame:
    """Add errors and warnings (arrays of codes) to extracted rows (date, description as text, amount)."""
    errors = F.array_compact(F.array(F.when(F.col("date").isNull() | (F.trim("date") == ""), "no date"), F.when(F.col("amount").isNull(), "no amount"), F.when(F.col("amount") <= 0, "amount not positive"), F.when(noise_row(F.col("description")), "balance or total line")))
    warnings = F.array_compact(F.array(F.when((F.trim("date") != "") & parse_date(F.col("date")).isNull(), "unknown date format")))
    return rows.withColumns({"errors": errors, "warnings": warnings})


def reconcile_bank(txns: DataFrame, summary: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Opening balance and movements against the closing balance of each statement."""
    zero = F.lit(0).cast("decimal(18,2)")
    sums = txns.groupBy(*keys).agg(F.sum(F.when(F.col("type") == "credit", F.col("amount")).otherwise(zero)).alias("credits"), F.sum(F.when(F.col("type") == "debit", F.col("amount")).otherwise(zero)).alias("debits"))
    df = summary.join(sums, keys, "left").fillna(0, ["credits", "debits"]).withColumn("difference", F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing"))
    return df.withColumn("reconciled", F.abs("difference") <= tolerance)


def reconcile_card(statements: DataFrame, movements: DataFrame, keys: list[str], tolerance: float = 10) -> DataFrame:
    """Debits against purchases, credits against payments; 50 points, and 25 for each that agrees."""
    df = statements.join(movements, keys, "left").fillna(0, ["debits", "credits"])
    a, b = F.abs(F.col("debits") - F.col("purchases")) < tolerance, F.abs(F.col("credits") - F.col("payments")) < tolerance
    gap = lambda x, y: F.abs(F.col(x) - F.col(y)) * 100 > F.col(y) * 15
    warnings = F.array_compact(F.array(F.when(gap("debits", "purchases"), "purchases"), F.when(gap("credits", "payments"), "payments")))
    return df.withColumns({"confidence": 50 + F.when(a, 25).otherwise(0) + F.when(b, 25).otherwise(0), "warnings": warnings})


def correct_by_balance(rows: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Direction and amount of rows from the change of the running balance, where it disagrees."""
    change = F.col("balance") - F.lag("balance").over(Window.partitionBy(*keys).orderBy("ord"))
    df = rows.withColumn("_change", change)
    off = F.col("_change").isNotNull() & (F.col("_change") != 0)
    kind = F.when(off, F.when(F.col("_change") > 0, "credit").otherwise("debit")).otherwise(F.col("type"))
    amount = F.when(off & (F.abs(F.abs("_change") - F.col("amount")) > tolerance), F.abs("_change")).otherwise(F.col("amount"))
    return df.withColumns({"fixed_type": kind, "fixed_amount": amount.cast("decimal(20,2)"), "corrected": (kind != F.col("type")) | (amount != F.col("amount"))}).drop("_change")


def near_duplicates(txns: DataFrame, hours: float = 24, similarity: float = 0.85) -> DataFrame:
    """id, other: rows with an earlier one within a cent and a day, alike in letter pairs; all such pairs."""
    return all_partners(txns, hours, similarity, "dice")


def near_duplicate_report(txns: DataFrame, hours: float = 24, similarity: float = 0.85) -> DataFrame:
    """id, matched_with: each such row once, with the first of its earlier ones, so that it grows with the rows only."""
    return earlier_partners(txns, hours, similarity, "dice")


def merge_confidence(warnings: Column) -> Column:
    """1 less what each class of warning costs."""
    naming = lambda word: F.size(F.filter(warnings, lambda w: F.lower(w).contains(word)))
    cost = F.lit(0.0)
    for word, part in (("duplicate", 0.05), ("missing", 0.1), ("mismatch", 0.15), ("balance", 0.2)):
        cost = cost + naming(word) * part
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cost))


def settle(rows: DataFrame, keys: list[str], accept: float = ACCEPT) -> DataFrame:
    """Add status of each row (ord, date, amount, type, description, score, anchor) of its statement (``keys``): the first
    accepted row of a signature is verified, all after it are duplicates, others are rejected.

    A signature is the day, the sum, the direction, 40 letters of the description and the anchor's place in the text.
    """
    anchor = F.coalesce(F.floor(F.col("anchor") / 8).cast("string"), F.lit("na"))
    sig = F.concat_ws("|", F.col("date").cast("string"), F.col("amount").cast("decimal(18,2)").cast("string"), "type", F.substring(verification_text(F.col("description")), 1, 40), anchor)
    first = F.min(F.when(F.col("score") >= accept, F.col("ord"))).over(Window.partitionBy(*keys, "_sig"))
    df = rows.withColumn("_sig", sig).withColumn("_first", first)
    status = F.when(F.col("ord") > F.col("_first"), "duplicate").when(F.col("ord") == F.col("_first"), "verified").otherwise("rejected")
    return df.withColumn("status", status).drop("_sig", "_first")


def distinct_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each day, sum and 30 letters of description in a statement."""
    own = Window.partitionBy(*keys, F.to_date("date"), F.col("amount").cast("decimal(18,2)"), F.substring("description", 1, 30)).orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def derived_totals(txns: DataFrame, keys: list[str]) -> DataFrame:
    """debits, credits (whatever is no debit) and n of each statement."""
    zero = F.lit(0).cast("decimal(18,2)")
    part = lambda debit: F.sum(F.when((F.col("type") == "debit") == F.lit(debit), F.col("amount")).otherwise(zero))
    return txns.groupBy(*keys).agg(part(True).alias("debits"), part(False).alias("credits"), F.count(F.lit(1)).alias("n"))


def card_warnings(summary: DataFrame, totals: DataFrame, keys: list[str], part: int = 15, how: str = "left") -> DataFrame:
    """Add warnings where the movements' totals are off the card summary's (purchases, payments) by more than ``part`` percent."""
    df = summary.join(totals, keys, how)
    off = lambda mine, said: (F.col("n") > 0) & (F.col(said) > 0) & (F.abs(F.col(mine) - F.col(said)) * 100 > F.col(said) * part)
    return df.withColumn("warnings", F.array_compact(F.array(F.when(off("debits", "purchases"), "debits mismatch"), F.when(off("credits", "payments"), "credits mismatch"))))


def bank_warnings(summary: DataFrame, totals: DataFrame, keys: list[str], how: str = "left", tolerance: float = TOLERANCE) -> DataFrame:
    """Add warnings where opening, movements and closing of a bank summary disagree by more than ``tolerance``."""
    df = summary.join(totals, keys, how)
    gap = F.abs(F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing"))
    return df.withColumn("warnings", F.array_compact(F.array(F.when((F.col("n") > 0) & (gap > tolerance), "balance mismatch"))))


def merge_statements(txns: DataFrame, summary: DataFrame, keys: list[str], warnings: Column | None = None) -> DataFrame:
    """One row a bank statement: totals of all its rows, warnings and confidence.

    ``txns``: keys, ord, amount, type, balance; ``summary``: keys, opening, closing, both possibly null (then not compared).
    Near-duplicates are reported by near_duplicates() and stay: two alike payments of a day may both be true.
    ``warnings``: a column of ``summary`` with those of earlier steps.  A summary without rows is warned of, as are rows without a summary.
    """
    ends = txns.filter("balance is not null").groupBy(*keys).agg(F.min_by("balance", "ord").alias("first_balance"), F.max_by("balance", "ord").alias("last_balance"))
    given = summary.withColumns({"_upstream": F.array().cast("array<string>") if warnings is None else warnings, "_summary": F.lit(True)})
    df = bank_warnings(given, derived_totals(txns, keys), keys, "full").join(ends, keys, "left")
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > TOLERANCE
    more = F.array_compact(F.array(F.when(F.col("_summary").isNull(), "summary missing"), F.when(F.col("n").isNull(), "transactions missing"), F.when(off("first_balance", "opening"), "balance differs at the start"), F.when(off("last_balance", "closing"), "balance differs at the end")))
    df = df.withColumn("warnings", F.concat(F.coalesce("_upstream", F.array().cast("array<string>")), more, "warnings"))
    return df.withColumn("confidence", merge_confidence(F.col("warnings"))).drop("_upstream", "_summary", "first_balance", "last_balance")


def merge_cards(txns: DataFrame, summary: DataFrame, keys: list[str], rewards: DataFrame | None = None) -> DataFrame:
    """One row a card statement: totals of all its rows, its reward points where given, warnings and confidence.

    ``summary``: keys, purchases, payments, null where unknown; ``rewards``: keys and any further columns, one row a statement.
    """
    df = card_warnings(summary.withColumn("_summary", F.lit(True)), derived_totals(txns, keys), keys, how="full")
    more = F.array_compact(F.array(F.when(F.col("_summary").isNull(), "summary missing"), F.when(F.col("n").isNull(), "transactions missing")))
    df = df.withColumn("warnings", F.concat(more, "warnings")).drop("_summary")
    df = df if rewards is None else df.join(rewards, keys, "left")
    return df.withColumn("confidence", merge_confidence(F.col("warnings")))


#: Points of the totals of a card statement, of sums that all agree, and of purchases, payments and fees alone.
CLOSE = 100
TOTAL_POINTS, CLOSE_POINTS, SUM_POINTS = 50, 25, 50
PART_POINTS = {"purchases": 17, "payments": 17, "fees": 16}
#: Kinds of movements that make up each sum of a statement.
SUM_KINDS = {"purchases": ["purchase", "charge"], "payments": ["bill_payment"], "fees": ["fee", "interest"]}


def verify_card(txns: DataFrame, statements: DataFrame, keys: list[str], tolerance: float = TOLERANCE, near: float = 10) -> DataFrame:
    """Card statements against their movements: total due, the three sums, and points of both.

    ``txns``: keys, amount, type, sub_type; ``statements``: keys, previous_balance, total_due, purchases, payments,
    interest, late_fee, each null where the statement does not say.  The total is previous balance and debits less
    credits (0 without a previous balance; a total that is not said counts as 0).  Debits and credits are compared with
    purchases and payments; where not all sums agree, each kind of movement that agrees by itself has its part of the points.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    part = lambda cond: F.sum(F.when(cond, F.col("amount")).otherwise(zero))
    sums = txns.groupBy(*keys).agg(part(F.col("type") == "debit").alias("debits"), part(F.col("type") == "credit").alias("credits"), *[part(F.col("sub_type").isin(*kinds)).alias(f"sum_{k}") for k, kinds in SUM_KINDS.items()])
    names = ["debits", "credits", *[f"sum_{k}" for k in SUM_KINDS]]
    df = statements.join(sums, keys, "left").withColumns({c: F.coalesce(c, zero) for c in names})
    computed = F.when(F.col("previous_balance").isNull(), zero).otherwise(F.col("previous_balance") + F.col("debits") - F.col("credits"))
    df = df.withColumns({"computed_due": computed, "difference": F.abs(computed - F.coalesce("total_due", zero)), "fees": F.coalesce(F.col("interest") + F.col("late_fee"), "interest", "late_fee")})
    agrees = lambda mine, said: F.col(said).isNull() | (F.abs(F.col(mine) - F.col(said)) < near)
    df = df.withColumns({"total_agrees": F.col("difference") <= tolerance, "sums_agree": agrees("debits", "purchases") & agrees("credits", "payments") & agrees("sum_fees", "fees")})
    total = F.when(F.col("total_agrees"), TOTAL_POINTS).when(F.col("difference") < CLOSE, CLOSE_POINTS).otherwise(0)
    # Fees that are not said count as none in the parts.
    parts = sum((F.when(agrees(f"sum_{k}", k) if k != "fees" else F.abs(F.col("sum_fees") - F.coalesce("fees", zero)) < near, points).otherwise(0) for k, points in PART_POINTS.items()), F.lit(0))
    return df.withColumn("confidence", total + F.when(F.col("sums_agree"), SUM_POINTS).otherwise(parts))


def merge_checked(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows with verification_confidence of ``checked`` (id, score in percent); null where nothing was checked."""
    return rows.join(checked.select("id", (F.col("score") / 100.0).alias("verification_confidence")), "id", "left")


def check_bank_summary(summaries: DataFrame) -> DataFrame:
    """Add problems: the date fields (text) of a bank's summary that are given and are no dates."""
    fields = ["statement_date", "period_start", "period_end"]
    return summaries.withColumn("problems", F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & checked_date(F.col(c)).isNull(), c) for c in fields])))
