"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.graph import components, cut, discard, shared_folder, stored

__all__ = ["bucket_width", "components", "cut", "discard", "literal", "maybe_broadcast", "shared_folder", "spread", "stored", "table", "top_bits", "word_count"]

#: A word is a run of characters other than these (space, tab, line ends, vertical tab, form feed).
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input (fewer parts than cores, as of a file of one row group) to all cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 50_000) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` (of at most a few hundred bytes each) are few; else Spark plans a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def literal(values: list) -> Column:
    """An array of longs or doubles, or of such arrays, as one expression (F.lit() asks the JVM for each entry)."""
    text = lambda v: f"array({', '.join(map(text, v))})" if isinstance(v, list) else f"{v!r}{'D' if isinstance(v, float) else 'L'}"
    return F.expr(text(values))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def top_bits(value: Column, bits: int) -> Column:
    """A non-negative long with all but its ``bits`` leading bits cleared: the lower edge of a log-linear bucket.

    Integer arithmetic only, so that any engine finds the same bucket.
    """
    shift = F.greatest(F.length(F.bin(value)) - F.lit(bits), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def bucket_width(edge: Column, bits: int) -> Column:
    """Width of the bucket of top_bits() that begins at ``edge``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(edge)) - F.lit(bits), F.lit(0)).cast("int"))
