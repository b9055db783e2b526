"""Rows alike in amount, time and text.

Rows of one cent, instant and text are one point, so that repeats, which make amounts and days crowded, cost nothing:
only different texts of a cell, which is a cent and a stretch of time as long as the window, are compared.  All pairs are
as many as there are, each compared once; the first partner of a point is looked for in order and ends at the first that is alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spending import is_expense



def letter_pairs(text: Column) -> Column:
    """The different pairs of letters of a text, each as one number."""
    code = lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long")
    return F.when(F.length(text) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: code(i) * 0x110000 + code(i + 1)))).otherwise(F.array().cast("array<long>"))


def _dice(a: Column, b: Column, x: Column, y: Column) -> Column:
    """text.dice_similarity of folded texts from their letter pairs."""
    both = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def edits(text: Column, similarity: float) -> Column:
    """The most edits with which a text no longer than this one is alike."""
    n = F.length(text)
    least = F.floor((1 - similarity) * n).cast("int")
    return F.when(n == 0, 0).when(1 - (least + 1) / n >= similarity, least + 1).when(1 - least / n >= similarity, least).otherwise(least - 1)


#: What is worked out once for each point, and whether two points' texts are alike by it.
MEASURES = {
    "edit": (edits, lambda a, b, x, y, _: F.call_function("levenshtein", a, b, F.greatest(x, y)) >= 0),
    "dice": (lambda text, _: letter_pairs(text), lambda a, b, x, y, similarity: _dice(a, b, x, y) >= similarity),
}
#: A point looks for partners in its own cell and the later ones beside it, as (cents, stretches of time).
FORWARD = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
POINT = ["cent", "at", "text"]
#: Points of a crowded cell are searched in blocks of about BLOCK; SKIP of them are passed over at once after a find.
BLOCK, SKIP = 512, 32


def expense_rows(txns: DataFrame) -> DataFrame:
    """id, ord and point (cent, at in microseconds, text folded) of expenses; a row that lacks any of these has no partner."""
    rows = txns.filter(is_expense()).select(
        "id", "ord", F.round(F.abs("amount") * 100, 0).cast("long").alias("cent"), F.unix_micros(F.col("date").cast("timestamp")).alias("at"), F.lower(F.trim("description")).alias("text")
    )
    return rows.dropna(subset=POINT)


def points(rows: DataFrame) -> DataFrame:
    """Each point with n and its first row (ord, id)."""
    return rows.groupBy(*POINT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "id")).alias("first"))


def linked_points(pts: DataFrame, hours: float, similarity: float, measure: str) -> DataFrame:
    """Pairs of different points (cent, at, text, first; other_...) within a cent, ``hours`` and alike; each both ways.

    ``offset`` is the other's cents less the own.
    """
    width = int(hours * 3_600_000_000)
    prepared, alike = MEASURES[measure]
    cells = pts.select(*POINT, "first", F.floor(F.col("at") / width).alias("stretch"), prepared(F.col("text"), similarity).alias("parts"))
    steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in FORWARD])
    left = cells.withColumn("step", F.explode(steps)).withColumns({"cell": F.col("cent") + F.col("step.c"), "time": F.col("stretch") + F.col("step.s")})
    theirs = cells.select(*[F.col(c).alias(f"other_{c}") for c in [*POINT, "first", "stretch", "parts"]])
    same = (F.col("step.c") == 0) & (F.col("step.s") == 0)
    on = (F.col("cell") == F.col("other_cent")) & (F.col("time") == F.col("other_stretch")) & (F.abs(F.col("at") - F.col("other_at")) <= width)
    on = on & (~same | (F.struct("at", "text") < F.struct("other_at", "other_text")))
    own, other = [*POINT, "first"], [f"other_{c}" for c in [*POINT, "first"]]
    found = left.join(theirs, on).filter(alike(*[F.col(c) for c in ("text", "other_text", "parts", "other_parts")], similarity)).select(*own, *other)
    ways = F.array(F.struct(*own, *other), F.struct(*[F.col(o).alias(c) for c, o in zip(own, other)], *[F.col(c).alias(o) for c, o in zip(own, other)]))
    return found.select(F.explode(ways).alias("w")).select("w.*").withColumn("offset", F.col("other_cent") - F.col("cent"))


def _blocks(pts: DataFrame, width: int, parts: Column) -> DataFrame:
    """cent, stretch, block, members: the points of each cell, those of a crowded one dealt over blocks."""
    cells = pts.select(*POINT, "first", F.floor(F.col("at") / width).alias("stretch"), parts.alias("parts"))
    counts = cells.groupBy("cent", "stretch").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = cells.join(counts, ["cent", "stretch"]).withColumn("block", F.pmod(F.xxhash64("at", "text"), "blocks"))
    return dealt.groupBy("cent", "stretch", "block").agg(F.collect_list(F.struct("first", "at", "text", "parts")).alias("members"))


def nearest_points(pts: DataFrame, hours: float, similarity: float, measure: str, by_offset: bool) -> DataFrame:
    """Points (cent, at, text) with found (offset, first): the first point that is alike, of each block around their cell.

    The blocks hold the points of a cell and of those beside it in the order asked for, and a search ends at its first
    find, so points that have partners are compared with few others.  ``offset`` counts if ``by_offset``, else it is 0.
    """
    width = int(hours * 3_600_000_000)
    prepared, alike = MEASURES[measure]
    table = _blocks(pts, width, prepared(F.col("text"), similarity))
    steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c in (-1, 0, 1) for s in (-1, 0, 1)])
    offset = (F.col("step.c") if by_offset else F.lit(0)).cast("long")
    moved = F.transform("members", lambda m: F.struct(F.struct(offset.alias("offset"), m["first"].alias("first")).alias("rank"), m["at"].alias("at"), m["text"].alias("text"), m["parts"].alias("parts")))
    around = table.withColumn("step", F.explode(steps)).select((F.col("cent") - F.col("step.c")).alias("cent"), (F.col("stretch") - F.col("step.s")).alias("stretch"), "block", moved.alias("moved"))
    around = around.groupBy("cent", "stretch", "block").agg(F.sort_array(F.flatten(F.collect_list("moved"))).alias("others"))
    starts = F.sequence(F.lit(0), F.floor((F.size("others") - 1) / SKIP))
    around = around.select("cent", "stretch", F.transform(starts, lambda i: F.slice("others", (i * SKIP + 1).cast("int"), F.lit(SKIP))).alias("others"))
    rank = F.lit(None).cast(T.StructType([T.StructField("offset", T.LongType()), T.StructField("first", pts.schema["first"].dataType)]))

    def first_of(p: Column) -> Column:
        fits = lambda q: (F.abs(q["at"] - p["at"]) <= width) & alike(p["text"], q["text"], p["parts"], q["parts"], similarity) & (q["rank"]["first"]["id"] != p["first"]["id"])
        one = lambda found, q: F.when(found.isNotNull(), found).when(fits(q), q["rank"])
        return F.aggregate("others", rank, lambda found, some: F.when(found.isNotNull(), found).otherwise(F.aggregate(some, rank, one)))

    each = F.transform("members", lambda p: F.struct(p["at"].alias("at"), p["text"].alias("text"), first_of(p).alias("found")))
    searched = table.select("cent", "stretch", "members").join(around, ["cent", "stretch"])
    return searched.select("cent", F.explode(F.filter(each, lambda f: f["found"].isNotNull())).alias("f")).select("cent", "f.*")


def _with_point(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    return rows.join(table, POINT, how)


def first_partners(txns: DataFrame, hours: float, similarity: float, measure: str) -> DataFrame:
    """id and duplicate_of: the partner of the least cents, then the first in ingest order.  ids are unique."""
    rows = expense_rows(txns)
    pts = points(rows)
    best = nearest_points(pts, hours, similarity, measure, True).groupBy(*POINT).agg(F.min(F.struct("found.offset", "found.first.ord", "found.first.id")).alias("best"))
    many = pts.filter("n > 1").select(*POINT, "first")
    second = _with_point(rows, many, "inner").filter(F.col("id") != F.col("first.id")).groupBy(*POINT).agg(F.first("first").alias("first"), F.min(F.struct("ord", "id")).alias("second"))
    df = _with_point(_with_point(rows, best, "left"), second, "left")
    twin = F.when(F.col("id") == F.col("first.id"), F.col("second")).otherwise(F.col("first"))
    own = F.when(F.col("first").isNotNull(), F.struct(F.lit(0).cast("long").alias("offset"), twin["ord"].alias("ord"), twin["id"].alias("id")))
    return df.select("id", F.least("best", own).getField("id").alias("duplicate_of")).filter("duplicate_of is not null")


def earlier_partners(txns: DataFrame, hours: float, similarity: float, measure: str) -> DataFrame:
    """id and matched_with: the first row in ingest order that is alike, for each row that comes after it."""
    rows = expense_rows(txns)
    pts = points(rows)
    linked = nearest_points(pts, hours, similarity, measure, False).select(*POINT, "found.first")
    table = linked.unionByName(pts.select(*POINT, "first")).groupBy(*POINT).agg(F.min("first").alias("first"))
    return _with_point(rows, table, "inner").filter(F.col("first.ord") < F.col("ord")).select("id", F.col("first.id").alias("matched_with"))


def all_partners(txns: DataFrame, hours: float, similarity: float, measure: str) -> DataFrame:
    """Pairs (id, other) of rows alike, the other earlier in ingest order; as many as there are such pairs."""
    rows = expense_rows(txns)
    pts = points(rows)
    links = linked_points(pts, hours, similarity, measure).select(*POINT, *[f"other_{c}" for c in POINT])
    links = links.unionByName(pts.filter("n > 1").select(*POINT, *[F.col(c).alias(f"other_{c}") for c in POINT]))
    theirs = rows.select(F.col("id").alias("other"), F.col("ord").alias("other_ord"), *[F.col(c).alias(f"other_{c}") for c in POINT])
    return _with_point(rows, links, "inner").join(theirs, [f"other_{c}" for c in POINT]).filter("other_ord < ord").select("id", "other")
