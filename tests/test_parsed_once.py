"""Dates and amounts of many rows: a text is looked through once for its form, and its numbers are taken once."""

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.functions import dates, money


def test_dates_are_looked_for_once(spark):
    assert str(dates.parse_date(F.col("t"), F.col("o"))).count("regexp_extract") <= 20
    given = {"2024-02-30": None, "30/02/2024": None, "20240229": dt.date(2024, 2, 29), "13/12/49": dt.date(2049, 12, 13), "12/13/50": None, "1-Foo-2024": None, "Feb 3 24": dt.date(2024, 2, 3), "3 febr, 2024": dt.date(2024, 2, 3), "13/13/2024": None, "1/2/123": None, "": None}
    rows = spark.createDataFrame([(t, "MDY") for t in given] + [(None, "DMY")], "t string, o string")
    assert {r.t: r.d for r in rows.select("t", dates.parse_date(F.col("t"), F.col("o")).alias("d")).collect()} == {**given, None: None}


def test_amounts_are_looked_for_once(spark):
    told = str(money.parse_amount(F.col("t"), zero_is_null=True))
    assert told.count("regexp_replace") <= 3 and told.count("regexp_extract") <= 2
    given = {"1,234.56": 1234.56, "1.234,56": 1234.56, "1,234": 1234.0, "12,3": 12.3, "..": None, ",": None, "5.": 5.0, ".5": 0.5, "0.00": None, "-": None, "-0": None, "(1,5)": -1.5, "- 7": -7.0, "₹ -8 CR": -8.0, "7\n": 7.0, "1.2.3": 1.2, "null": None, "": None}
    rows = spark.createDataFrame([(t,) for t in given] + [(None,)], "t string")
    assert {r.t: r.a for r in rows.select("t", money.parse_amount(F.col("t"), zero_is_null=True).alias("a")).collect()} == {**given, None: None}
