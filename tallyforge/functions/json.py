"""JSON from a model's answer: whole, fenced, or somewhere in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def _candidates(text: Column, brackets: str) -> list[Column]:
    a, b = brackets
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1)
    tidy = F.regexp_replace(inner, r",\s*([\]}])", "$1")
    return [F.trim(text), F.trim(fenced), inner, tidy]


def parse_array(text: Column, item: str) -> Column:
    """array<``item``> (DDL) of the first candidate that parses, else an empty array."""
    kind = f"array<{item}>"
    tries = [F.when(c.startswith("["), F.from_json(c, kind)) for c in _candidates(text, "[]")]
    good = [F.when(F.size(t) > 0, F.when(~F.forall(t, lambda x: x.isNull()), t)) for t in tries]
    return F.coalesce(*good, F.array().cast(kind))


def json_of(text: Column, brackets: str = "{}") -> Column:
    """The first candidate that is JSON of these brackets, as a variant; null if none is."""
    return F.coalesce(*[bound(c, lambda x: F.when(x.startswith(brackets[0]), F.try_parse_json(x))) for c in _candidates(text, brackets)])


def parse_object(text: Column, fields: str) -> Column:
    """struct<``fields``> (DDL) of the first candidate that parses, else null."""
    tries = [F.when(c.startswith("{") & F.from_json(c, "map<string,string>").isNotNull(), F.from_json(c, fields)) for c in _candidates(text, "{}")]
    return F.coalesce(*tries)


def categorized(text: Column, known: list[str]) -> Column:
    """Results (id, category, confidence) of a classifier's answer: unknown categories and empty ids are left out, a
    confidence outside 0 to 1 counts as 0.2."""
    rows = parse_array(text, "struct<id:string,category:string,confidence:double>")
    good = F.filter(rows, lambda r: (F.coalesce(r["id"], F.lit("")) != "") & r["category"].isin(*known))
    fix = lambda c: F.when(c.between(0, 1), c).otherwise(0.2)
    return F.transform(good, lambda r: F.struct(r["id"].alias("id"), r["category"].alias("category"), F.coalesce(fix(r["confidence"]), F.lit(0.2)).alias("confidence")))
