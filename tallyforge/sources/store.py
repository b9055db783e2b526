"""The ledger's own tables: a staging area, and a Parquet table by months that is changed month by month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge.operators.graph import stored
from tallyforge.operators.rules import only_new, update_rows

TRANSACTIONS = "id string, ord bigint, date timestamp_ntz, description string, amount decimal(18,2), type string, category string, category_type string, merchant string, source_type string, card_issuer string, card_last_four string, needs_review boolean"
DEFAULTS = {"category": "other", "category_type": "Excluded", "needs_review": False}
MONTH = "month"


def read_transactions(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    df = spark.read.schema(TRANSACTIONS).format(form).load(path)
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})


def write_transactions(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Appended by month of the date, so that later reads of a range skip the other months."""
    df.withColumn(MONTH, F.date_format("date", "yyyy-MM")).write.mode("append").partitionBy(MONTH).format(form).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file, in whatever file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Ledger:
    """A table of rows with a date, as Parquet by month.

    A change rewrites the months it touches and no others: their new rows are written in full beside the table first, then
    put in place of the old ones (dynamic partition overwrite, which moves files only once all tasks are done).  So a change that fails
    or is killed while it computes leaves the table as it was; one killed while files are moved is repeated, which is
    safe, as updates, deletions and imports of the same input change nothing the second time.  One change at a time.
    Rows without a date are in a month of their own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = TRANSACTIONS):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema

    def read(self, months: list[str | None] | None = None) -> DataFrame:
        """All rows, or those of some months, whose folders alone are read."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(StructType([*self.schema.fields, StructField(MONTH, StringType())])).parquet(self.path)
        if months is not None:
            df = df.filter(self._in(months))
        return df.drop(MONTH)

    @staticmethod
    def _in(months: list[str | None]) -> Column:
        named = F.col(MONTH).isin(*[m for m in months if m is not None])
        return named | F.col(MONTH).isNull() if None in months else named

    @staticmethod
    def _month() -> Column:
        return F.date_format("date", "yyyy-MM")

    def _months(self, rows: DataFrame) -> list[str | None]:
        """The months of rows: a few hundred of a lifetime."""
        return [r[0] for r in rows.select(self._month()).distinct().collect()]

    def _put(self, rows: DataFrame, mode: str) -> None:
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(MONTH, self._month())
        out.write.mode(mode).partitionBy(MONTH).option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._put(rows, "append")

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose day, sum and description the ledger lacks; of the ledger, the months of the batch's days are read.

        A row can repeat rows of its own day only, so months that the batch has no day of can not hold it."""
        return only_new(batch, self.read(self._months(batch)).select("date", "amount", "description"))

    def add(self, batch: DataFrame) -> None:
        """Append what is new in a batch."""
        self.append(self.new_rows(stored(batch)))

    def rewrite(self, months: list[str | None], change: Callable[[DataFrame], DataFrame]) -> None:
        """Put ``change`` of the months' rows in their place.  Rows that it moves to another month take that month along;
        a month that is left without rows goes."""
        held = list(months)
        new = stored(change(self.read(held)))
        more = [m for m in self._months(new) if m not in held]
        if more:
            new = stored(new.unionByName(self.read(more)))
        self._put(new, "overwrite")
        left = set(self._months(new))
        for m in [m for m in held if m not in left]:
            self._remove(m)

    def _remove(self, month: str | None) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MONTH}={month or '__HIVE_DEFAULT_PARTITION__'}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def months_of(self, ids: DataFrame, key: str = "id") -> list[str | None]:
        """The months that hold any of the ids; two columns are read."""
        if not exists(self.spark, self.path):
            return []
        return self._months(self.read().select(key, "date").join(ids.select(key).distinct(), key, "left_semi"))

    def update(self, changes: DataFrame, key: str = "id") -> None:
        """Change rows by key; a null changes nothing, unknown keys neither."""
        changes = stored(changes)
        months = self.months_of(changes, key)
        if months:
            self.rewrite(months, lambda rows: update_rows(rows, changes, key))

    def delete(self, ids: DataFrame, key: str = "id") -> None:
        ids = stored(ids.select(key).distinct())
        months = self.months_of(ids, key)
        if months:
            self.rewrite(months, lambda rows: rows.join(ids, key, "left_anti"))

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(rows: DataFrame, report: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an import and the report of their checks, kept until they are reviewed; returned as they are kept."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    report.write.mode("overwrite").parquet(f"{path}/report")
    return staged(rows.sparkSession, path)


def staged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/report")


def accept(ledger: Ledger, path: str, reviewed: DataFrame | None = None) -> None:
    """Move staged rows into the ledger, without what it holds already; ``reviewed``: changes by id that go before.

    What the files do not say of a ledger's row is null.  The staging area is emptied last, so an interrupted call is repeated."""
    rows, _ = staged(ledger.spark, path)
    rows = rows if reviewed is None else update_rows(rows, reviewed)
    have = set(rows.columns)
    ord_ = F.xxhash64("id") if "ord" not in have else F.col("ord")
    full = rows.withColumn("ord", ord_).select(*[(F.col(f.name) if f.name in have | {"ord"} else F.lit(None)).cast(f.dataType).alias(f.name) for f in ledger.schema])
    ledger.add(full)
    p = ledger.spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(ledger.spark._jsc.hadoopConfiguration()).delete(p, True)


def write_log(rows: DataFrame, path: str) -> None:
    """A line of JSON for each row, as text."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
