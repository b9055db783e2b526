"""Rows alike, against all pairs of small tables, and a large band."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import alike

T0 = dt.datetime(2024, 3, 1)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b, measure):
    if a == b:
        return 1.0
    if measure == "edit":
        return 1 - edit(a, b) / max(len(a), len(b)) if a and b else 0.0
    x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def brute(rows, hours, least, measure):
    """id -> [(offset, ord, id)] of partners."""
    rows = [r for r in rows if None not in r[2:5]]
    out = {}
    for i, o, at, text, amount in rows:
        for j, p, at2, text2, amount2 in rows:
            off = round(abs(amount2) * 100) - round(abs(amount) * 100)
            if i != j and abs(off) <= 1 and abs((at - at2).total_seconds()) <= hours * 3600 and likeness(text.strip().lower(), text2.strip().lower(), measure) >= least:
                out.setdefault(i, []).append((off, p, j))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, ord long, date timestamp, description string, amount decimal(18,2)")
    return df.withColumns({"category_type": F.lit("Expense"), "type": F.lit("debit"), "extra": F.lit(1)})


def made(seed):
    """Texts of few letters and changed copies, few instants and amounts; nulls, empty texts, repeats."""
    rng, rows = random.Random(seed), []
    for k in range(140):
        text = "".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 21])))
        if rows and rng.random() < 0.6:
            text = list(rng.choice(rows)[3] or "x")
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é"])
            text = "".join(text)
        at = T0 + dt.timedelta(hours=rng.choice([0, 0, 12, 24, 47, 48, 49, 96, 100]), microseconds=rng.choice([0, 0, 1]))
        rows.append((k, 1000 - k if seed % 2 else k, None if rng.random() < 0.03 else at, None if rng.random() < 0.03 else text, None if rng.random() < 0.03 else Decimal(rng.choice([100, 101, 102, 103, -101])) / 100))
    return rows


@pytest.mark.parametrize("measure,least,hours", [("edit", 0.8, 48), ("dice", 0.85, 24), ("edit", 0.9, 1.5)])
def test_partners(spark, measure, least, hours):
    for seed in (1, 2):
        rows = made(seed)
        df, want = frame(spark, rows), brute(rows, hours, least, measure)
        order = {r[0]: r[1] for r in rows}
        assert {tuple(r) for r in alike.first_partners(df, hours, least, measure).collect()} == {(i, min(c)[2]) for i, c in want.items()}
        earlier = {i: [c for c in cs if c[1] < order[i]] for i, cs in want.items()}
        pairs = alike.all_partners(df, hours, least, measure).collect()
        assert sorted(map(tuple, pairs)) == sorted((i, c[2]) for i, cs in earlier.items() for c in cs)
        assert sorted(map(tuple, alike.earlier_partners(df, hours, least, measure).collect())) == sorted((i, min(cs, key=lambda c: c[1])[2]) for i, cs in earlier.items() if cs)


def test_empty(spark):
    none = frame(spark, [])
    assert alike.first_partners(none, 48, 0.8, "edit").count() == 0 and alike.all_partners(none, 48, 0.8, "dice").count() == 0 and alike.earlier_partners(none, 48, 0.8, "dice").count() == 0


def test_one_amount_and_day(spark):
    """100,000 rows of one amount and day with one text, and pairs of others: results grow with the rows."""
    same = spark.range(100_000).select(F.col("id").alias("ord"), F.lit("pay monthly rent for the flat").alias("description"))
    own = spark.range(100_000, 100_200).select(F.col("id").alias("ord"), F.concat(F.md5(F.floor(F.col("id") / 2).cast("string")), F.when(F.col("id") % 2 == 1, "x").otherwise("")).alias("description"))
    df = same.unionByName(own).select(F.col("ord").alias("id"), "ord", "description", F.lit(Decimal("9.99")).alias("amount"), F.lit("2024-03-01").cast("date").alias("date"), F.lit("Expense").alias("category_type"), F.lit("debit").alias("type"))
    earlier = {i: 0 for i in range(1, 100_000)} | {i: i - 1 for i in range(100_001, 100_200, 2)}
    assert dict(map(tuple, alike.earlier_partners(df, 24, 0.85, "dice").collect())) == earlier
    assert dict(map(tuple, alike.first_partners(df, 48, 0.8, "edit").collect())) == earlier | {0: 1} | {i: i + 1 for i in range(100_000, 100_200, 2)}


def test_letter_pairs(spark):
    """Numbers of pairs are as different as the pairs, and a point's are worked out before points meet."""
    texts = ["", "a", "ab", "aaa", "abab", "é😀b", "user 17 user 17"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", alike.letter_pairs(F.col("text")).alias("p"))
    assert {r.text: list(r.p) for r in df.collect()} == {t: [ord(a) * 0x110000 + ord(b) for a, b in dict.fromkeys(zip(t, t[1:]))] for t in texts}


def test_most_edits(spark):
    """The most edits of a length are those that the likeness by division allows."""
    df = spark.range(0, 300).select(F.col("id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"))
    for least in (0.8, 0.85, 0.9, 0.7, 1.0):
        got = {r.id: r.n for r in df.select("id", alike.edits(F.col("t"), least).alias("n")).collect()}
        assert got == {n: max((d for d in range(n + 1) if n == 0 or 1 - d / n >= least), default=0) for n in range(300)}


def test_crowded_band(spark, monkeypatch):
    """20,000 different texts of one amount and instant that are all alike: 200 million pairs, of which few are compared."""
    df = spark.range(20_000).select("id", F.col("id").alias("ord"), F.concat(F.lit("monthly rent of the flat, number "), F.col("id").cast("string")).alias("description"))
    df = df.select("*", F.lit(Decimal("9.99")).alias("amount"), F.lit("2024-03-01").cast("date").alias("date"), F.lit("Expense").alias("category_type"), F.lit("debit").alias("type"))
    assert dict(map(tuple, alike.first_partners(df, 48, 0.8, "edit").collect())) == {0: 1} | {i: 0 for i in range(1, 20_000)}
    monkeypatch.setattr(alike, "BLOCK", 7)
    monkeypatch.setattr(alike, "SKIP", 3)
    rows = made(3)
    got = {tuple(r) for r in alike.first_partners(frame(spark, rows), 48, 0.8, "edit").collect()}
    assert got == {(i, min(c)[2]) for i, c in brute(rows, 48, 0.8, "edit").items()}
