"""Statement files: CSV with detected columns, workbooks, positioned text lines, chunks of long text; and sinks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import parse_date
from tallyforge.functions.money import debit_credit, parse_amount
from tallyforge.functions.text import bound, debit_or_credit, quoted

#: Words of each role's header, looked for as whole words.
ROLES = {
    "date": ["date", "txn date", "transaction date", "posted"],
    "debit": ["debit", "withdrawal", "withdrawal amount", "dr", "spent"],
    "credit": ["credit", "deposit", "deposit amount", "cr", "received"],
    "amount": ["amount", "amt", "value"],
    "type": ["type", "dr/cr", "cr/dr"],
    "balance": ["balance", "closing balance"],
    "description": ["description", "narration", "details", "particulars", "merchant", "memo", "remarks"],
}
CHUNK_LETTERS, CHUNK_LINES, CHUNK_SIZE, CHUNK_OVERLAP = 12_000, 250, 180, 12
SUFFIXES = ("csv", "pdf", "xls", "xlsx")
MAX_BYTES = 10 << 20


@dataclass
class Mapping:
    roles: dict[str, str] = field(default_factory=dict)
    description: list[str] = field(default_factory=list)


def map_columns(headers: list[str]) -> Mapping:
    """Which header has which role: an exact name first, then one that holds a role's word.  Descriptions may be many."""
    clean = {h: re.sub(r"[^a-z0-9/ ]", "", h.lower()).strip() for h in headers}
    out, used = Mapping(), set()
    for exact in (True, False):
        for role, words in ROLES.items():
            for h in headers:
                hit = clean[h] in words if exact else any(re.search(rf"(^|[^a-z]){re.escape(w)}($|[^a-z])", clean[h]) for w in words)
                if not hit or h in used:
                    continue
                if role == "description":
                    out.description.append(h)
                    used.add(h)
                elif role not in out.roles:
                    out.roles[role] = h
                    used.add(h)
    out.description.sort(key=headers.index)
    if "date" not in out.roles:
        raise ValueError(f"no date column in {headers}")
    if not {"amount", "debit", "credit"} & set(out.roles):
        raise ValueError(f"no amount column in {headers}")
    if not out.description:
        out.description = [h for h in headers if h not in used][:1]
    return out


def statement_rows(raw: DataFrame, mapping: Mapping | None = None, order: str = "DMY") -> DataFrame:
    """date, description, amount, type, balance of string columns; rows without a date or an amount are left out."""
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    m = mapping or map_columns(raw.columns)
    number = lambda role: parse_amount(F.col(f"`{m.roles[role]}`"), zero_is_null=True) if role in m.roles else F.lit(None).cast("double")
    parts = F.filter(F.array(*[F.trim(F.col(f"`{c}`")) for c in m.description]), lambda x: F.coalesce(x, F.lit("")) != "") if m.description else F.array().cast("array<string>")
    kind = debit_or_credit(F.col(f"`{m.roles['type']}`")) if "type" in m.roles else None
    both = debit_credit(number("debit"), number("credit"), number("amount"), kind)
    df = raw.select(parse_date(F.col(f"`{m.roles['date']}`"), order).alias("date"), F.coalesce(F.nullif(F.array_join(parts, " — "), F.lit("")), F.lit("Transaction")).alias("description"), both.alias("_m"), (parse_amount(F.col(f"`{m.roles['balance']}`")) if "balance" in m.roles else F.lit(None).cast("double")).alias("balance"))
    return df.filter("date is not null and _m is not null").select("date", "description", F.col("_m.amount").alias("amount"), F.col("_m.type").alias("type"), "balance")


def read_csv(spark: SparkSession, path: str, order: str = "DMY") -> DataFrame:
    return statement_rows(spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"'), order=order)


def acceptable_files(files: DataFrame) -> DataFrame:
    """Files (path, length) of a known suffix and size."""
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*SUFFIXES) & (F.col("length") <= MAX_BYTES))


def lines_of_items(items: DataFrame, near: int = 3, gap: int = 50) -> DataFrame:
    """doc, page, line, text of positioned items (doc, page, x, y, text): items whose heights are near make a line, from
    the top; wide gaps become tabs."""
    page = Window.partitionBy("doc", "page").orderBy(F.col("y").desc(), "x")
    df = items.withColumn("line", F.sum(F.when(F.coalesce(F.lag("y").over(page) - F.col("y"), F.lit(near)) >= near, 1).otherwise(0)).over(page))
    row = Window.partitionBy("doc", "page", "line").orderBy("x")
    df = df.withColumn("piece", F.concat(F.when(F.col("x") - F.lag("x").over(row) > gap, "\t").when(F.lag("x").over(row).isNotNull(), " ").otherwise(""), "text"))
    return df.groupBy("doc", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "piece"))), lambda p: p["piece"]), "").alias("text"))


def stitch_lines(lines: DataFrame, key: str, text: str = "text", order: str = "line", is_start: Column | None = None) -> DataFrame:
    """Lines without a date are put behind the dated line before them."""
    start = is_start if is_start is not None else F.col(text).rlike(r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")
    df = lines.withColumn("entry", F.sum(F.when(start, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order))).filter("entry > 0")
    return df.groupBy(key, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), " ").alias("text"))


def chunk_plan(texts: DataFrame, text: str = "text", letters: int = CHUNK_LETTERS, most: int = CHUNK_LINES, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """chunk, first_line, chunk_text of each text; those of more ``letters`` or more than ``most`` lines are cut into chunks of
    ``size`` lines with an overlap.  A text is split once, not for each of its chunks."""
    step = size - overlap
    piece = lambda chunk, first, words: F.struct(chunk.alias("chunk"), first.alias("first_line"), words.alias("chunk_text"))

    def pieces(lines: Column) -> Column:
        n = F.size(lines)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), last), lambda c: piece(c, c * step, F.array_join(F.slice(lines, c * step + 1, size), "\n")))
        return F.when((F.length(text) > letters) | (n > most), cut).otherwise(F.array(piece(F.lit(0), F.lit(0), F.col(text))))

    df = texts.withColumn("_piece", F.explode(bound(F.split(text, "\n"), pieces)))
    return df.withColumns({c: F.col(f"_piece.{c}") for c in ("chunk", "first_line", "chunk_text")}).drop("_piece")


def csv_lines(txns: DataFrame) -> DataFrame:
    """One quoted line a row: date, description, amount, type, category, merchant."""
    fields = [F.date_format("date", "yyyy-MM-dd"), F.col("description"), F.col("amount").cast("string"), F.col("type"), F.col("category"), F.col("merchant")]
    return txns.select(F.concat_ws(",", *[quoted(f) for f in fields]).alias("line"))


def write_csv(txns: DataFrame, path: str) -> None:
    csv_lines(txns).write.text(path)


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files, such as tables that are read as text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
