"""Extraction of rows from long statements by a model: chunks, checked answers, and further rounds for those that fail.

A round asks the client about the open chunks only, in tasks, a batch of prompts at a time.  Answers are parsed leniently, once, and
validated as columns; what a round found is stored, as a client is dear and need not answer alike twice.  Chunks whose answers have
errors go into the next round, told what they answered and what was wrong, and more strictly each time.  After the last round the
best that was understood counts: the sound rows of the last answer that was JSON.  Rows that overlapping chunks both hold are then one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.answers import EXTRACTED, EXTRACTED_ROW, warned_dates
from tallyforge.functions.json import json_of
from tallyforge.functions.schema import LISTS, Schema, errors
from tallyforge.functions.text import bound, noise_row, squeeze
from tallyforge.sources.statements import chunk_plan

from .graph import stored
from .rules import keep_best

ROUNDS = 3
BATCH = 8
ASK = "List the transactions of this statement as JSON: {\"transactions\": [{date, description, amount, type}]}.\n\n"
#: What a further round adds, by its number.
STRICTER = ["", "", "Correct every error. Answer with JSON only.", "Answer with the smallest valid JSON, no other field, no other text."]
EXTRACTED_ITEM = Schema(EXTRACTED_ROW)
#: The schema of an answer with nothing but flat rows, whose fields are of their kinds or null.
_NAMED = {kind: "|".join(f.name for f in EXTRACTED_ROW if f.kind == kind) for kind in ("string", "number")}
_FLAT = rf"(?:(?:{_NAMED['string']}): (?:STRING|VOID)|(?:{_NAMED['number']}): (?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)|VOID)|(?!(?:{'|'.join(_NAMED.values())}):)\w+: [A-Z]+(?:\(\d+,\d+\))?)"
PLAIN = rf"^OBJECT<transactions: ARRAY<OBJECT<{_FLAT}(?:, {_FLAT})*>>>$"
ROW = "date string, description string, amount double, type string, balance double, confidence double, original_currency string, original_amount double"


def prompt(chunk: Column, answer: Column, problems: Column, attempt: int) -> Column:
    if attempt == 1:
        return F.concat(F.lit(ASK), chunk)
    listed = F.concat_ws("\n", F.transform(problems, lambda e: F.concat(F.lit("- "), e)))
    return F.concat(F.lit(ASK), chunk, F.lit("\n\nThe answer before:\n"), F.coalesce(answer, F.lit("")), F.lit("\n\nIts errors:\n"), listed, F.lit(f"\n\n{STRICTER[min(attempt, len(STRICTER) - 1)]}"))


def _ask(asked: DataFrame, client: Callable, batch: int) -> DataFrame:
    """The columns of ``asked`` without the prompt, and answer, failure."""
    keep = [c for c in asked.columns if c != "prompt"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            answers, failures = [], []
            for at in range(0, frame.num_rows, batch):
                prompts = frame.column("prompt").slice(at, batch).to_pylist()
                try:
                    said = pa.array(list(client(prompts)), pa.string()).to_pylist()
                    if len(said) != len(prompts):
                        raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
                    failed = None
                except Exception as e:  # noqa: BLE001  whatever a client raises is an answer that failed
                    said, failed = [None] * len(prompts), f"client failed: {type(e).__name__}: {e}"[:500]
                answers += said
                failures += [failed] * len(prompts)
            yield pa.RecordBatch.from_arrays([*[frame.column(c) for c in keep], pa.array(answers, pa.string()), pa.array(failures, pa.string())], names=[*keep, "answer", "failure"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name in keep)
    return asked.mapInArrow(run, f"{schema}, answer string, failure string")


def _listed(whole: Column) -> Column:
    """Whether transactions are an array; its items are not built anew to see it."""
    return F.try_variant_get(whole, "$.transactions", f"array<{LISTS}>").isNotNull()


def understood(answer: Column) -> Column:
    """An answer's object with ``transactions`` as a variant; a bare list is one too, and null is an answer without JSON."""
    wrapped = lambda v: F.try_parse_json(F.concat(F.lit('{"transactions":'), F.to_json(v), F.lit("}")))
    listed = lambda v: _listed(v) | F.try_variant_get(v, "$.transactions", "variant").isNotNull()
    return bound(json_of(answer), lambda v: F.when(listed(v), v).otherwise(F.coalesce(wrapped(json_of(answer, "[]")), v)))


def _item(place: Column, row: Column, wrong: Column) -> Column:
    return F.struct(place.alias("place"), row.alias("row"), wrong.alias("wrong"))


def _typed(whole: Column) -> Column:
    """The rows of an understood answer with objects for items."""
    return F.from_json(F.to_json(whole), f"transactions array<struct<{ROW.replace(', ', ',').replace(' ', ':')}>>")["transactions"]


def _all_right(rows: Column) -> Column:
    return F.transform(rows, lambda r, i: _item(i, r, F.lit(False)))


def rows_of(whole: Column) -> Column:
    """place, row and whether it is wrong, of each item of an understood answer."""
    items = F.coalesce(F.try_variant_get(whole, "$.transactions", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(items, lambda v, i: _item(i, F.from_json(F.to_json(v), ROW), F.size(errors(v, EXTRACTED_ITEM)) > 0))


def _within(r: Column) -> Column:
    """Whether a row whose fields are of their kinds keeps to the limits of EXTRACTED_ROW, which are of these sorts only."""
    kept = lambda f, x: (F.lit(True) if f.above is None else x > f.above) & (F.lit(True) if f.shortest is None else F.length(x) >= f.shortest)
    return reduce(lambda a, b: a & b, [F.when(r[f.name].isNull(), not f.needed).otherwise(kept(f, r[f.name])) for f in EXTRACTED_ROW])


def read(answer: Column, failure: Column, best: Column, last: bool) -> Column:
    """problems, whether transactions are listed, and rows of an answer; rows only if no round follows, of the best answer up to now if this one has none.

    Most answers are a list of flat rows, of which the schema of the whole tells the kinds; those with nothing else and
    within the limits have no errors, so that theirs are not looked for one by one."""
    none = F.array().cast("array<string>")
    found = lambda problems, listed, rows: F.struct(problems.alias("problems"), listed.alias("listed"), rows.alias("rows"))

    def of(whole: Column) -> Column:
        plain = F.when(failure.isNull() & F.schema_of_variant(whole).rlike(PLAIN), _typed(whole))
        return bound(plain, lambda rows: F.when(rows.isNotNull() & F.forall(rows, _within), found(none, F.lit(True), _all_right(rows))).otherwise(judged(whole)))

    def judged(whole: Column) -> Column:
        wrong = F.when(failure.isNotNull(), F.array(failure)).otherwise(errors(whole, EXTRACTED))
        return bound(wrong, lambda x: found(x, _listed(whole), rows(whole, F.size(x) == 0)))

    def rows(whole: Column, sound: Column) -> Column:
        own = F.when(sound, _all_right(_typed(whole)))
        return own.when(_listed(whole), rows_of(whole)).otherwise(bound(understood(best), rows_of)) if last else own

    return bound(understood(answer), of)


def extract(texts: DataFrame, keys: list[str], client: Callable[[list[str]], list[str]], text: str = "text", rounds: int = ROUNDS, batch: int = BATCH, **plan) -> tuple[DataFrame, DataFrame]:
    """The rows of all texts, and a report of their chunks.

    ``texts``: keys (one row each) and text; a null text has no chunk.  ``client`` gets prompts and returns as many answers; it is
    pickled to the tasks, and what it raises fails its batch for that round.  ``plan``: limits of chunk_plan().  Rows: keys, chunk,
    place, the fields of ROW, warned; without overlap, in each text the best by confidence, then the first.  Report: keys, chunk, attempts,
    success, errors, n_rows (sound rows before overlaps are merged).
    """
    chunks = chunk_plan(texts.filter(F.col(text).isNotNull()).select(*keys, text), text, **plan).select(*keys, "chunk", "chunk_text")
    # A stated number of partitions stays as it is: a chunk is short, but asking about it and reading the answer is work.
    chunks = chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "chunk")
    none = F.lit(None).cast("string")
    frontier = chunks.withColumns({"best": none, "answer": none, "problems": F.array().cast("array<string>")})
    done = []
    for attempt in range(1, rounds + 1):
        asked = frontier.withColumn("prompt", prompt(F.col("chunk_text"), F.col("answer"), F.col("problems"), attempt)).drop("answer", "problems")
        said = _ask(asked, client, batch).withColumn("read", F.explode(F.array(read(F.col("answer"), F.col("failure"), F.col("best"), attempt == rounds))))
        said = said.withColumns({"success": F.size("read.problems") == 0, "best": F.when(F.col("read.listed"), F.col("answer")).otherwise(F.col("best"))})
        # What the next round needs is kept of its chunks only.
        again = lambda c: F.when(~F.col("success"), F.col(c)).alias(c)
        said = stored(said.select(*keys, "chunk", "success", "read.problems", "read.rows", *[again(c) for c in ("chunk_text", "best", "answer")]))
        ended = said if attempt == rounds else said.filter("success")
        done.append(ended.select(*keys, "chunk", F.lit(attempt).alias("attempts"), "success", F.col("problems").alias("errors"), "rows"))
        frontier = said.filter("not success").select(*keys, "chunk", "chunk_text", "best", "answer", "problems")
        if attempt < rounds and frontier.isEmpty():
            break
    each = reduce(DataFrame.unionByName, done)
    sound = each.select(*keys, "chunk", F.explode("rows").alias("r")).filter(~F.col("r.wrong") & ~F.coalesce(noise_row(F.col("r.row.description")), F.lit(False))).select(*keys, "chunk", F.col("r.place").alias("place"), "r.row.*")
    counted = sound.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n_rows"))
    report = each.select(*keys, "chunk", "attempts", "success", "errors").join(counted, [*keys, "chunk"], "left").fillna(0, ["n_rows"])
    same = {"_day": F.coalesce("date", F.lit("")), "_sum": F.col("amount"), "_type": F.coalesce("type", F.lit("")), "_words": squeeze(F.coalesce("description", F.lit(""))), "_cur": F.coalesce("original_currency", F.lit("")), "_first": F.coalesce(F.col("original_amount").cast("string"), F.lit("")), "_sure": F.coalesce("confidence", F.lit(-1.0)), "_at": F.struct("chunk", "place")}
    rows = keep_best(sound.withColumns(same), [*keys, "_day", "_sum", "_type", "_words", "_cur", "_first"], "_sure", "_at").drop(*same)
    return rows.withColumn("warned", warned_dates(F.col("date"))), report
