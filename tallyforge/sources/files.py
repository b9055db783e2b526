"""One reader for a folder of statement files: CSV, workbooks, and whatever else a decoder is given for.

Spark lists and opens the files (so any of its file systems will do), a task decodes a file at a time into rows of cells, and
all that follows is a query: the header row of each sheet, its columns' roles, the order of day and month voted by each file's
own dates, amounts, directions, the largest sheet of a workbook.  What can not be read is a row of the report.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.currency import currency_of_headers
from tallyforge.functions.dates import order_votes, parse_date, serial_date
from tallyforge.functions.money import debit_credit, parse_amount
from tallyforge.functions.text import debit_or_credit
from tallyforge.operators.graph import stored
from tallyforge.operators.rules import REGISTRY, import_categories

from .statements import MAX_BYTES, map_columns
from .store import stage

#: Rows of a sheet among which its header is looked for, and rows sent to Spark at a time.
HEADER_ROWS = 30
BATCH = 5_000
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

Decoder = Callable[[bytes], Iterator[tuple[str, list[str]]]]


def decode_csv(content: bytes) -> Iterator[tuple[str, list[str]]]:
    """Rows of a CSV file, whose separator is the one of comma, semicolon, tab and bar that the first lines hold most often."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    head = "\n".join(text.splitlines()[:5])
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=max(",;\t|", key=head.count)):
        yield "", row


def decode_workbook(content: bytes) -> Iterator[tuple[str, list[str]]]:
    """Rows of all sheets of an xlsx workbook; values are texts, numbers as they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name))
        joined = lambda x: "".join(t.text or "" for t in x.iter(f"{_SHEET}t"))
        shared = [joined(x) for x in part("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        files = {x.get("Id"): x.get("Target").lstrip("/") for x in part("xl/_rels/workbook.xml.rels")}
        for sheet in part("xl/workbook.xml").iter(f"{_SHEET}sheet"):
            target = files[sheet.get(_LINK)]
            for row in part(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_SHEET}row"):
                cells: list[str] = []
                for c in row.iter(f"{_SHEET}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r", "")).group():
                        at = 26 * at + ord(letter) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = c.findtext(f"{_SHEET}v") or ""
                    cells.append(shared[int(value)] if c.get("t") == "s" else joined(c) if c.get("t") == "inlineStr" else value)
                yield sheet.get("name"), cells


#: How a file of each suffix becomes rows (sheet, cells).  xls and pdf need decoders that are given to read_folder.
DECODERS: dict[str, Decoder] = {"csv": decode_csv, "xlsx": decode_workbook}
_CELLS = "path string, sheet string, row int, cells array<string>, problem string"


def read_cells(spark: SparkSession, path: str, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """path, sheet, row, cells, problem of all files below ``path`` (or the one there).  A file that is too large, of an unknown
    kind or broken has a problem and no cells; files of no bytes are passed over by Spark's listing."""
    known = {**DECODERS, **(decoders or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fit = F.col("length") <= MAX_BYTES
    files = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), fit.alias("fit"), F.when(fit, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f_path, suffix, fits = (batch.column(c)[i].as_py() for c in ("path", "suffix", "fit"))
                sheets, held, n, problem = [], [], 0, None
                try:
                    if not fits:
                        raise ValueError(f"larger than {MAX_BYTES} bytes")
                    if suffix not in known:
                        raise ValueError(f"no reader for .{suffix} files; there are {', '.join(sorted(known))}")
                    for sheet, cells in known[suffix](batch.column("content")[i].as_py()):
                        sheets.append(sheet)
                        held.append([c if c is None else str(c) for c in cells])
                        n += 1
                        if len(held) == BATCH:
                            yield _batch(f_path, sheets, n - len(held), held)
                            sheets, held = [], []
                    problem = None if n else "no rows"
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file must not stop the others
                    problem = f"{type(e).__name__}: {e}"[:500]
                yield _batch(f_path, sheets, n - len(held), held)
                if problem:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((f_path, None, None, None, problem), _TYPES, strict=True)], names=_NAMES)

    return files.mapInArrow(run, _CELLS)


_NAMES = ["path", "sheet", "row", "cells", "problem"]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]


def _batch(path: str, sheets: list[str], first: int, cells: list[list[str]]) -> pa.RecordBatch:
    n = len(cells)
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, _TYPES[0]), n), pa.array(sheets, _TYPES[1]), pa.array(range(first, first + n), _TYPES[2]), pa.array(cells, _TYPES[3]), pa.nulls(n, _TYPES[4])], names=_NAMES)


_ROLES = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("date", "debit", "credit", "amount", "type", "balance")], T.StructField("description", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_ROLES)
def roles(cells: pd.Series) -> pd.DataFrame:
    """Places (from 1) of the columns of a header row; all null if it is none."""
    names, out = _ROLES.names[:-1], []
    for row in cells:
        headers = [f"{h or ''}".strip() for h in row]
        unique = [h if h and h not in headers[:i] else f"{h} column {i}" for i, h in enumerate(headers)]
        try:
            m = map_columns(unique)
            out.append([*[unique.index(m.roles[n]) + 1 if n in m.roles else None for n in names], [unique.index(d) + 1 for d in m.description]])
        except ValueError:
            out.append([None] * 7)
    return pd.DataFrame(out, columns=[*names, "description"]).astype({n: "Int32" for n in names})


def _cell(place: Column) -> Column:
    return F.nullif(F.trim(F.get("cells", place - 1)), F.lit(""))


def ledger_rows(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the ledger and a report of the files, from read_cells().

    Rows: path, sheet, row, date, description, amount (above 0), type, balance, currency; of a workbook, its sheet with the most of
    them (the first by name if equal).  Report: path, problem, sheet, n_rows, n_ledger, date_order, currency, first and last date.  A date that may be
    read both ways follows the file's other dates, and else has the day first; workbooks may hold day numbers.
    """
    cells = stored(cells)
    sheet = Window.partitionBy("path", "sheet")
    found = cells.filter(F.col("row").isNotNull() & (F.col("problem").isNull())).withColumn("place", F.row_number().over(sheet.orderBy("row")))
    headers = found.filter(F.col("place") <= HEADER_ROWS).select("path", "sheet", "row", "cells", roles("cells").alias("r")).filter("r.date is not null")
    header = headers.groupBy("path", "sheet").agg(F.min_by(F.struct("row", "r", "cells"), "row").alias("h")).select("path", "sheet", F.col("h.row").alias("header_row"), F.col("h.r").alias("r"), currency_of_headers(F.col("h.cells")).alias("currency"))
    body = found.join(stored(header), ["path", "sheet"]).filter("row > header_row and exists(cells, c -> trim(c) <> '')")
    written = body.withColumn("written", _cell(F.col("r.date")))
    first, second = order_votes(F.col("written"))
    book = F.lower("path").rlike(r"\.xlsx?$")
    votes = written.filter(~book).groupBy("path").agg(first, second).select("path", F.when(F.col("month_first") > F.col("day_first"), "MDY").otherwise("DMY").alias("date_order"))
    dated = written.join(stored(votes), "path", "left").withColumn("date_order", F.coalesce("date_order", F.lit("DMY")))
    number = lambda role: parse_amount(_cell(F.col(f"r.{role}")), zero_is_null=True)
    day = F.coalesce(parse_date(F.col("written"), F.col("date_order")), F.when(book, serial_date(F.col("written").try_cast("double"))))
    words = F.array_join(F.filter(F.transform("r.description", lambda i: F.trim(F.get("cells", i - 1))), lambda x: x != ""), " — ")
    sides = ["debit", "credit", "amount"]
    both = debit_credit(*[F.col(f"_{x}") for x in sides], debit_or_credit(_cell(F.col("r.type"))))
    read = dated.withColumns({f"_{x}": number(x) for x in sides}).select("path", "sheet", "row", day.alias("date"), F.coalesce(F.nullif(words, F.lit("")), F.lit("Transaction")).alias("description"), both.alias("m"), parse_amount(_cell(F.col("r.balance"))).alias("balance"), "currency", "date_order")
    read = stored(read)
    money = lambda c: F.col(c).cast("decimal(18,2)")
    sound = read.filter("date is not null and m.amount > 0").select("path", "sheet", "row", "date", "description", money("m.amount").alias("amount"), F.col("m.type").alias("type"), money("balance").alias("balance"), "currency")
    best = sound.groupBy("path", "sheet").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("n"), "sheet")).alias("b")).select("path", F.col("b.sheet").alias("sheet"))
    rows = sound.join(best, ["path", "sheet"])
    per = read.join(best, ["path", "sheet"], "left_semi").groupBy("path", "sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("date").isNotNull() & (F.col("m.amount") > 0), 1)).alias("n_ledger"), F.first("date_order").alias("date_order"), F.first("currency").alias("currency"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    files = cells.groupBy("path").agg(F.max("problem").alias("problem"))
    headed = header.select("path").distinct().withColumn("headed", F.lit(True))
    report = files.join(per, "path", "left").join(headed, "path", "left")
    none = F.when(F.col("headed").isNull(), "no columns of dates and amounts").when(F.col("n_ledger").isNull(), "no rows with a date and an amount")
    report = report.withColumn("problem", F.coalesce("problem", none)).drop("headed").fillna(0, ["n_rows", "n_ledger"])
    return rows, report


def read_folder(spark: SparkSession, path: str, decoders: dict[str, Decoder] | None = None, registry=REGISTRY) -> tuple[DataFrame, DataFrame]:
    """Rows of all statements below ``path``, with merchants and keyword categories to be reviewed, and the report of the files."""
    rows, report = ledger_rows(read_cells(spark, path, decoders))
    nothing = {"category": "string", "categorized_by": "string", "category_confidence": "double", "needs_review": "boolean"}
    fresh = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in nothing.items()})
    return import_categories(fresh, registry).withColumn("id", F.sha2(F.concat_ws("|", "path", "sheet", "row"), 256)), report


def stage_folder(spark: SparkSession, path: str, staging: str, decoders: dict[str, Decoder] | None = None, registry=REGISTRY) -> tuple[DataFrame, DataFrame]:
    """read_folder(), kept in ``staging`` until reviewed (store.staged() reads it again)."""
    rows, report = read_folder(spark, path, decoders, registry)
    return stage(rows, report, staging)
