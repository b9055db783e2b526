"""Incremental import: a stream of statement rows appended to the ledger without repeats, and trailing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.store import Ledger


def import_stream(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the rows that the ledger at ``table`` lacks, batch by batch, until the source is read.

    Of the ledger each batch reads the months of its own days, however long the history is; a late row brings its month
    along.  A batch that is repeated after a failure adds nothing twice.
    """
    ledger = Ledger(rows.sparkSession, table, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    return rows.writeStream.foreachBatch(lambda batch, _: ledger.add(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows whose id was not seen within the watermark."""
    return rows.withWatermark("date", late).dropDuplicatesWithinWatermark(["id"])


def trailing_counts(rows: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Rows of a merchant in each sliding window (trailing, unlike the batch detector's counts on both sides)."""
    w = F.window("date", window, slide)
    return rows.withWatermark("date", late).groupBy("merchant", w).agg(F.count(F.lit(1)).alias("n")).select("merchant", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
