"""Transactions that a question is about."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import tokens


def relevance(txns: DataFrame, question: str) -> DataFrame:
    """Add score: 3 for each of the question's words in the description, merchant or category, 1 if one of those begins
    with it, 6 for each number that is the amount, 1 for each of four hints that fits."""
    text = F.lower(F.concat_ws(" ", "description", "merchant", "category"))
    q = question.lower()
    score = F.lit(0)
    for t in tokens(question):
        starts = F.lower("description").startswith(t) | F.lower("merchant").startswith(t) | F.lower("category").startswith(t)
        score = score + F.when(text.contains(t), 3).otherwise(0) + F.when(starts, 1).otherwise(0)
    for n in re.findall(r"\d+(?:\.\d+)?", q):
        score = score + F.when(F.abs(F.col("amount").cast("double") - float(n)) <= 0.01, 6).otherwise(0)
    for words, fits in ((("spend", "spent", "expense"), F.col("category_type") == "Expense"), (("income", "salary", "earn"), F.col("category_type") == "Income"), (("transfer",), F.col("category_type") == "Excluded"), (("refund", "credit"), F.col("type") == "credit")):
        if any(w in q for w in words):
            score = score + F.when(fits, 1).otherwise(0)
    return txns.withColumn("score", score)


def most_relevant(txns: DataFrame, question: str, k: int = 10) -> DataFrame:
    return relevance(txns, question).orderBy(F.col("score").desc(), F.col("date").desc(), F.abs("amount").desc(), "ord").limit(k)


def route(question: str) -> dict:
    """How much history, how many rows and letters an answer may take: broad questions no rows, follow-ups more history."""
    q = question.lower()
    if re.search(r"\b(overall|summary|overview|trend|total)\b", q):
        return {"history": 5, "rows": 0, "letters": 2600}
    if re.search(r"^(and|what about|why|how about)\b", q):
        return {"history": 8, "rows": 12, "letters": 3400}
    return {"history": 6, "rows": 8, "letters": 3400}


LETTERS, LEAST, BATCH = 3500, 3, 20


def contexts(lines: DataFrame, keys: list[str], line: str = "line", order: str = "ord", letters: int = LETTERS, least: int = LEAST, heads: DataFrame | None = None) -> DataFrame:
    """keys, lines (how many are kept) and text: of each key the first lines that fit the budget, ``least`` of them in any case, cut to it.

    ``heads``: keys and ``head``, a text before the lines that counts too; a key with a head and no lines has the head alone.  Null
    lines are none.  Of a key's lines only as many are gathered as fit.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    given = lines.filter(F.col(line).isNotNull())
    if heads is not None:
        given = given.join(heads.select(*keys, F.length("head").alias("_head")), keys, "left")
    before = F.coalesce("_head", F.lit(-1)) if heads is not None else F.lit(-1)
    run = F.sum(F.length(line) + 1).over(own.rowsBetween(Window.unboundedPreceding, 0)) + before
    kept = given.withColumns({"_run": run, "_n": F.row_number().over(own)}).filter((F.col("_run") <= letters) | (F.col("_n") <= least))
    out = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring(line, 1, letters).alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    if heads is not None:
        out = heads.select(*keys, "head").join(out, keys, "full").select(*keys, F.coalesce("lines", F.lit(0)).alias("lines"), F.concat_ws("\n", "head", "text").alias("text"))
    return out.withColumn("text", F.when(F.length("text") > letters, F.concat(F.substring("text", 1, letters - 3), F.lit("..."))).otherwise(F.col("text")))


def prompt_batches(rows: DataFrame, bucket: Column, line: Column, order: str = "ord", size: int = BATCH) -> DataFrame:
    """bucket, batch, n, text: prompts of ``size`` rows.  Rows are numbered within buckets (such as a hash of the id), so that no
    order of all rows is needed; the last batch of a bucket may be smaller."""
    each = rows.select(bucket.alias("bucket"), line.alias("line"), F.col(order).alias("ord"))
    each = each.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("ord")) - 1) / size).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return each.groupBy("bucket", "batch").agg(F.count(F.lit(1)).alias("n"), text.alias("text"))


def context(lines: list[str], letters: int = LETTERS, least: int = LEAST) -> str:
    """contexts() of the lines of a chosen few rows, in the driver."""
    kept = list(lines)
    while len("\n".join(kept)) > letters and len(kept) > least:
        kept.pop()
    text = "\n".join(kept)
    return text if len(text) <= letters else text[: letters - 3] + "..."
