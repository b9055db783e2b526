"""Whitening of embeddings by the singular values of their centred rows, with Spark's own distributed SVD.

Entries become integers, so sums, means and deviations are exact; a row is centred as (n * x - S) / n, rounded once, before anything is
multiplied.  The fit list is each distinct vector once.  RowMatrix.computeSVD of its centred rows gives all components;
s * s / n is a component's variance.  The total variance comes from the exact deviations, not from the values found, so
the explained shares show what a rounding or a missing value would hide.  The matrix of components (dims x dims) is all that reaches the driver.

Left out are null vectors and those with null or non-finite entries, entries of more than LARGEST (beyond exact longs),
and lengths other than the most frequent one (the longer if equal).  Components whose singular value is not beyond RCOND of the largest have no scale and
are not returned; of fewer than two distinct vectors there are none, and the result is empty.  Equal rows have equal results.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal, spread, stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)
#: Singular values of a smaller share of the largest are noise: squared, they are near the last digit of a double.
RCOND = 1e-7


def integers(vector: Column) -> Column:
    """The vector as floor(SCALE * entry) + SHIFT, or null if it is left out."""
    fit = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= F.lit(LARGEST), F.lit(False)))
    return F.when(fit & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def _dims(df: DataFrame) -> int:
    top = df.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def components_of(centred: DataFrame, n: int, dims: int) -> tuple[list[float], list[list[float]]]:
    """Variances and unit vectors of the array column ``c``, falling; the largest entry of each vector is positive."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("v")))
    svd = RowMatrix(rows, n, dims).computeSVD(dims, False, RCOND)
    columns = svd.V.toArray().T.tolist()
    positive = [-1.0 if max(v, key=abs) < 0 else 1.0 for v in columns]
    return [float(s) ** 2 / n for s in svd.s], [[sign * x for x in v] for sign, v in zip(positive, columns, strict=True)]


def whiten(df: DataFrame, most: int = 16) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of each row of ``df`` (id, vector) that is not left out."""
    spark = df.sparkSession
    whole = spread(df.select("id", integers(F.col("vector")).alias("x"))).filter("x is not null")
    dims = _dims(whole)
    whole = whole.filter(F.size("x") == dims)
    empty = spark.createDataFrame([], df.select("id").schema).selectExpr("id", "0 component", "0L n", "0L deviation", "0d whitened", "0d explained", "0d identity_error")
    if not dims:
        return empty
    fit = stored(whole.select("x").distinct())
    wide = lambda i: F.col("x")[i].cast("decimal(20,0)")
    got = fit.agg(F.count(F.lit(1)), *[f for i in range(dims) for f in (F.sum(wide(i)), F.min(F.col("x")[i]), F.max(F.col("x")[i]))]).first()
    n, sums, low, high = got[0], [int(s) for s in got[1::3]], got[2::3], got[3::3]
    if n < 2:
        return empty
    # n * x - S in longs where it and its squares fit, else in decimals.
    most_off = max(max(abs(n * v - s) for v in (a, b)) for a, b, s in zip(low, high, sums, strict=True))
    kind = "long" if max(dims * most_off**2, n * max(map(abs, low + high)), *map(abs, sums)) < 2**62 else "decimal(38,0)"
    total = literal(sums) if kind == "long" else F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    off = F.zip_with("x", total, lambda x, s: x.cast(kind) * F.lit(n) - s)
    square = lambda a, o: (a + (o * o).cast(kind)).cast(kind)
    deviation = F.aggregate("off", F.lit(0).cast(kind), square)
    centre = lambda rows: rows.withColumn("off", off).select("*", deviation.alias("deviation"), F.transform("off", lambda o: o.cast("double") / F.lit(float(n))).alias("c"))
    centred = centre(fit)
    spent = int(centred.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0])
    if not spent:
        return empty
    variance, vectors = components_of(centred, n, dims)
    kept = range(min(most, len(variance)))
    # spent / n^3 is the trace of the covariance; integers of any size divide exactly before the rounding.
    shares = [variance[k] / (spent / n**3) for k in kept]
    scaled = [[x / variance[k] ** 0.5 for x in vectors[k]] for k in kept]
    project = lambda weights: F.aggregate(F.zip_with("c", weights, lambda a, w: a * w), F.lit(0.0), lambda a, p: a + p)
    w = centred.select(*[project(literal(v)).alias(f"w{k}") for k, v in enumerate(scaled)])
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    seen = w.agg(*[F.avg(f"w{k}") for k in kept], *[F.avg(F.col(f"w{i}") * F.col(f"w{j}")) for i, j in pairs]).first()
    mean, moment = seen[: len(kept)], seen[len(kept) :]
    error = max(abs(m - mean[i] * mean[j] - (i == j)) for (i, j), m in zip(pairs, moment, strict=True))
    each = F.array(*[F.struct(F.lit(k + 1).alias("component"), literal(v).alias("weights"), F.lit(shares[k]).alias("explained")) for k, v in enumerate(scaled)])
    out = centre(whole).select("id", F.col("deviation").try_cast("long").alias("deviation"), "c", F.inline(each))
    return out.select("id", "component", F.lit(n).cast("long").alias("n"), "deviation", project(F.col("weights")).alias("whitened"), "explained", F.lit(error).alias("identity_error"))
