"""Evidence of rows in texts, and checks of card statements, by hand."""

import datetime as dt
from decimal import Decimal

from tallyforge.operators import evidence, verify

D = dt.date(2024, 1, 5)
TEXT = "Opening balance 1,000.00\n05/01/2024 COFFEE HOUSE 12.50 DR\n" + "x " * 200 + "\nJan 05, 2024 salary ACME Ltd (1,23,456.70) credit INR\n" + "y " * 200 + "12.50 tip"


def rows(spark, *values):
    return spark.createDataFrame(values, "k string, id long, day date, amount decimal(18,2), type string, description string, currency string")


def test_evidence(spark):
    texts = spark.createDataFrame([("a", TEXT), ("b", None), ("c", "")], "k string, raw_text string")
    given = rows(
        spark,
        ("a", 1, D, Decimal("12.50"), "debit", "coffee house", None), ("a", 2, D, Decimal("123456.70"), "credit", "Salary ACME", "INR"), ("a", 3, D, Decimal("2.50"), "debit", "coffee", "USD"),
        ("a", 4, D, Decimal("12.50"), "credit", "coffee house", None), ("a", 5, None, None, None, None, None), ("b", 6, D, Decimal("12.50"), "debit", "coffee", None),
        ("c", 7, D, Decimal("12.50"), "debit", "coffee", None), ("nowhere", 8, D, Decimal("12.50"), "debit", "coffee", None), ("a", 9, dt.date(2024, 5, 1), Decimal("1000"), "debit", "opening", None),
    )
    got = {r.id: r for r in evidence.evidence(given, texts, "k").collect()}
    assert sorted(got) == list(range(1, 10))
    assert got[1].score == 100 and got[1].anchors == 1 and got[1].accepted
    clean = " ".join(TEXT.lower().replace("(", "").replace(")", "").split())
    assert got[1].anchor == clean.index("12.50") and got[2].anchor == clean.index("1,23,456.70") and got[2].score == 100
    assert not got[3].amount_found and not got[3].currency_found and got[3].day_found and got[3].anchor is None
    # A credit counts as such unless a minus stands before it.
    assert got[4].direction_found
    assert got[5].score == evidence.DIRECTION + evidence.CURRENCY and all(got[k].score == 35 and got[k].anchor is None for k in (6, 7, 8))
    assert got[9].amount_found and got[9].day_found is False or got[9].anchor is not None


def test_index_places(spark):
    texts = spark.createDataFrame([("a", TEXT)], "k string, raw_text string")
    clean = " ".join(TEXT.lower().replace("(", "").replace(")", "").split())
    index = sorted((r.pos, r.at, r.token) for r in evidence.token_index(texts, "k").collect())
    assert [p for p, _, _ in index] == list(range(len(index))) and all(clean[a : a + len(t)] == t for _, a, t in index)


def test_card_without_figures(spark):
    """What a statement does not say agrees; without a previous balance the total counts as nothing."""
    said = spark.createDataFrame([("x", None, None, None, None, None, None), ("y", Decimal(100), Decimal(150), Decimal(60), Decimal(10), Decimal(1), None)], "k string, previous_balance decimal(18,2), total_due decimal(18,2), purchases decimal(18,2), payments decimal(18,2), interest decimal(18,2), late_fee decimal(18,2)")
    moves = spark.createDataFrame([("y", Decimal(60), "debit", "purchase"), ("y", Decimal(10), "credit", "bill_payment"), ("y", Decimal(30), "debit", "fee")], "k string, amount decimal(18,2), type string, sub_type string")
    got = {r.k: r for r in verify.verify_card(moves, said, ["k"]).collect()}
    assert got["x"].confidence == 100 and got["x"].computed_due == 0
    assert got["y"].computed_due == 180 and got["y"].confidence == 25 + 17 + 17


def test_tokens_of_days_and_amounts(spark):
    """What is looked up in the index has the look of the tokens that are kept for it."""
    from pyspark.sql import functions as F

    from tallyforge.operators import evidence as e

    df = spark.sql("select explode(sequence(date '0001-01-01', date '9999-12-31', interval 37 days)) as day")
    parts = df.select(F.explode(F.array(*[F.lower(F.date_format("day", p)) for form in e.DAY_FORMS for p in form])).alias("t"))
    assert parts.filter(~F.col("t").rlike(e.DAY_TOKEN)).count() == 0
    sums = spark.range(0, 10**7, 997).select(F.explode(e.amount_forms((F.col("id") / 100 - 10).cast("decimal(18,2)"))).alias("t"))
    assert sums.filter(~F.col("t").rlike("^[0-9]")).count() == 0
