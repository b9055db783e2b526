"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words (weights, a total share, a cap); each of its documents is expected
``target / source_size`` times.  The expected copies are summed along a fixed order within the source, one random
offset is added, and a document is emitted once for each integer that its stretch of the sum crosses.

The running sum never puts a source into one task: within a source all documents have the same expectation, so the
sum is a rank.  Ranks are counted in buckets (source, size class, leading hex digits of the id's hash), whose counts
are summed into offsets; rows are numbered within their bucket only.  Ordering by size class first spreads the copies
evenly over short and long documents, so that the words taken come near the target.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import top_bits

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20240607
CLASS_BITS = 3
PREFIX_DIGITS = 2


def offset_of(seed: int) -> float:
    """The one random offset, in [0, 1)."""
    return random.Random(seed).random()


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """``sizes``: source_key, source_null, source_size -> the same with target (double).

    Sources in order of code points, null last, weigh ``weights``, repeating.  Together they get ``share`` times all
    sizes; a target stops at ``cap`` times its source's size and the excess goes to the others by weight until none is
    above.  That is water-filling: in order of cap / weight, a source is capped if the level that the sources before it
    leave is above its own.  One row a source, so the windows over all sources stay small.
    """
    everything = Window.orderBy("source_null", "source_key")
    total = Window.partitionBy()
    order = Window.orderBy("ratio", "source_null", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    df = df.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("all", F.sum("source_size").over(total) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(total))
    before_cap, before_w = F.coalesce(F.sum("cap").over(order), F.lit(0.0)), F.coalesce(F.sum("w").over(order), F.lit(0.0))
    df = df.withColumn("capped", (F.col("all") - before_cap) / (F.col("all_w") - before_w) > F.col("ratio"))
    df = df.withColumn("left", F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(total)).withColumn("left_w", F.col("all_w") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0.0)).over(total))
    level = F.try_divide(F.col("left"), F.col("left_w"))
    return df.select("source_key", "source_null", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(level * F.col("w"), F.lit(0.0))).alias("target"))


def mix(df: DataFrame, size: str, source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """Add source_size (long), target (double) and copies (long): how often the mix takes each row.

    ``size``: name of a long column, not null.  The input is read twice, for the counts and for the rows; only the
    second reading is shuffled, once.  A null source is a source of its own, a null id counts as an empty one.  Rows
    that repeat an id keep one rank each.  Sources of size 0 have target 0 and are taken 0 times.  An empty table gives
    an empty result.  Columns of the input that are named as the added ones are replaced, the others keep their values;
    ``_mix_*`` names are used here.
    """
    df = df.drop("source_size", "target", "copies")
    keyed = df.withColumns(
        {
            "_mix_key": F.coalesce(F.col(source).cast("string"), F.lit("")),
            "_mix_null": F.col(source).isNull(),
            "_mix_class": top_bits(F.col(size), CLASS_BITS),
            "_mix_hash": F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))),
        }
    ).withColumn("_mix_prefix", F.substring("_mix_hash", 1, PREFIX_DIGITS))
    bucket = ["_mix_key", "_mix_null", "_mix_class", "_mix_prefix"]
    counts = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_mix_n"), F.sum(size).alias("_mix_size"))
    sizes = counts.groupBy(F.col("_mix_key").alias("source_key"), F.col("_mix_null").alias("source_null")).agg(F.sum("_mix_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    before = Window.partitionBy("_mix_key", "_mix_null").orderBy("_mix_class", "_mix_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_mix_before", F.coalesce(F.sum("_mix_n").over(before), F.lit(0)))
        .join(targets, (F.col("_mix_key") == F.col("source_key")) & (F.col("_mix_null") == F.col("source_null")))
        .select(*[F.col(c).alias(f"o{c}") for c in bucket], "_mix_before", F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    )
    ranked = keyed.withColumn("_mix_rank", F.row_number().over(Window.partitionBy(*bucket).orderBy("_mix_hash", size)))
    joined = ranked.join(offsets, [F.col(c) == F.col(f"o{c}") for c in bucket])
    rate = F.coalesce(F.try_divide(F.col("_mix_target"), F.col("_mix_source_size").cast("double")), F.lit(0.0))
    rank = (F.col("_mix_before") + F.col("_mix_rank")).cast("double")
    u = F.lit(offset_of(seed))
    copies = F.floor(rank * rate + u) - F.floor((rank - 1.0) * rate + u)
    return joined.select(*df.columns, F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), copies.cast("long").alias("copies"))
