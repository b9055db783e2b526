"""A reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered in the order of their key, then of a hash of the whole row; equal rows may change places, which
changes nothing.  The number goes through a permutation of [0, n): Feistel rounds over the smallest even split of bits
that holds n, walked on while the outcome is n or more.  Place p is shard p mod shards, slot p div shards: shards differ by one row at
most and slots have no gaps.  Where a numbered row went, and which number lies at a slot, is computed
(``places``, ``numbers``) without any table; another seed is another order of the same numbers.

The order is found by a range sort, which splits a hot key by the rows' hashes and copies of one row by their place in the input.  A
count per partition reaches the driver.  Null keys come first; an empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, literal

ROUNDS = 6
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """Hash of 64-bit values under a key: multiply and fold."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & (2**64 - 1)) * _STEP + _STEP
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A permutation of the numbers 0 to n - 1, given by a seed."""

    def __init__(self, n: int, seed: int):
        self.n, self.half = n, (max(n - 1, 1).bit_length() + 1) // 2
        self.keys = [int(_mixed(np.array([r], dtype=np.uint64), seed)[0]) for r in range(ROUNDS)]

    def _rounds(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            left, right = (right ^ (_mixed(left, key) & mask), left) if back else (right, left ^ (_mixed(right, key) & mask))
        return (left << half) | right

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        out = np.asarray(x).astype(np.uint64)
        outside = np.arange(len(out))
        while len(outside):
            out[outside] = self._rounds(out[outside], keys, back)
            outside = outside[out[outside] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys, False)

    def numbers(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys[::-1], True)


def numbered(df: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with each row's global number (long) in the order of key and row, and the number of rows."""
    whole = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)) for seed in (1, 2)]
    ordered = cut(df.orderBy(F.col(f"`{key}`").asc_nulls_first(), *whole, F.monotonically_increasing_id()))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counts = dict(ordered.groupBy(F.spark_partition_id()).count().collect())
    n, before = 0, []
    for part in range(max(counts, default=-1) + 1):
        before.append(n)
        n += counts.get(part, 0)
    start = F.element_at(literal(before or [0]), F.spark_partition_id() + 1)
    return ordered.withColumn(name, start + inside), n


def shard_rows(df: DataFrame, key: str, shards: int, seed: int = 0, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``df`` with the shard (int) and slot (long) of each row; columns of these names are replaced."""
    df = df.drop(*names)
    number = next(f"_number{k}" for k in range(len(df.columns) + 1) if f"_number{k}" not in df.columns)
    rows, n = numbered(df, key, number)
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def place(numbers):
        return numbers.__class__(permutation.places(numbers.to_numpy()))

    placed = place(number)
    return rows.withColumn(number, placed).withColumns({names[0]: F.expr(f"cast({number} % {int(shards)} as int)"), names[1]: F.expr(f"{number} div {int(shards)}")}).drop(number)


def written(df: DataFrame, path: str, shards: int, names: tuple[str, str] = ("shard", "slot")) -> None:
    """Write the shards as folders of files in the order of their slots; a shard may be several files."""
    df.repartitionByRange(max(shards, df.sparkSession.sparkContext.defaultParallelism), *names).sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)


def sources_of(spark, n: int, shards: int, shard: int, seed: int = 0) -> DataFrame:
    """slot and number of the rows of one shard, in the order of slots: computed, nothing is read."""
    permutation = Permutation(n, seed)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            slots = batch["id"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"slot": slots, "number": permutation.numbers(slots * shards + shard)})

    return spark.range(max(0, (n - shard + shards - 1) // shards)).mapInArrow(work, "slot long, number long")
