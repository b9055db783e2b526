"""First fit against the sequence it stands for."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.firstfit import first_fit, held_names


def brute(names):
    """names: (name, ord, word)."""
    heads, out = [], {}
    for name, _, word in sorted(names, key=lambda x: (x[1], x[0])):
        hit = next((h for h, w in heads if name and h and (h in name or name in h) or (word is not None and w == word)), None)
        if hit is None:
            heads.append((name, word))
        out[name] = name if hit is None else hit
    return out


@pytest.mark.parametrize("seed", range(6))
def test_first_fit(spark, seed):
    rng = random.Random(seed)
    letters = "abc"[: 1 + seed % 3]
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(120)}
    rows = [(n, rng.randint(0, 60), rng.choice(["x", "y", "z", None, None, None, n[:6]])) for n in sorted(names)]
    df = spark.createDataFrame(rows, "name string, ord long, word string").repartition(3)
    got = {r.name: r.cluster for r in first_fit(df, F.col("word")).collect()}
    assert got == brute(rows)


def test_held_names(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 16))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {tuple(r) for r in held_names(df).collect()}
    assert got == {(a, b) for a in names for b in names if a != b and a in b}


def test_long_chains(spark):
    """Each name matches its neighbours only, so the second round can only begin where the first ended."""
    rows = [(f"{chr(97 + i)}{chr(97 + i)}{chr(98 + i)}{chr(98 + i)}", i, None) for i in range(12)]
    rows += [(f"{chr(97 + i)}{chr(97 + i)}", 100 + i, None) for i in range(13)]
    got = {r.name: r.cluster for r in first_fit(spark.createDataFrame(rows, "name string, ord long, word string"), F.col("word")).collect()}
    assert got == brute(rows)


def test_one_common_word(spark):
    """Many names of one first word meet its head, not each other."""
    n = 100_000
    df = spark.range(n).select(F.format_string("supplier %07d", "id").alias("name"), "id").withColumnRenamed("id", "ord")
    out = first_fit(df, F.lit("supplier"))
    assert out.count() == n and [r.cluster for r in out.select("cluster").distinct().collect()] == ["supplier 0000000"]


def test_empty(spark):
    df = spark.createDataFrame([], "name string, ord long")
    assert first_fit(df, F.lit("x")).count() == 0


def test_no_table_goes_to_the_driver(spark):
    """Tables of names and matches are small as files only; none may be broadcast, as it would pass through the driver whole."""
    df = spark.createDataFrame([(f"shop {k}", k) for k in range(30)], "name string, ord long")
    for out in (held_names(df), first_fit(df, F.lit("shop"))):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
