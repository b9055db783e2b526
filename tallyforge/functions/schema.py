"""Validators from declared schemas: JSON (as a variant) to an array of errors.

A schema lists fields with their kind, range, values and items, and rules over several fields.  It is compiled to one
column, so validating a table of answers is a projection.  An error reads "place: what is wrong".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


@dataclass(frozen=True)
class Field:
    """``kind``: string, number, integer, boolean, object, array or any.  Limits that are not given do not hold."""

    name: str
    kind: str
    needed: bool = True
    least: float | None = None
    most: float | None = None
    above: float | None = None
    one_of: tuple[str, ...] = ()
    shortest: int | None = None
    longest: int | None = None
    check: tuple[str, Callable[[Column], Column]] | None = None  # (error, test of a text that must be true)
    fields: tuple[Field, ...] = ()  # of an object, or of each item of an array of objects
    each: Field | None = None  # every value of an object with any names


@dataclass(frozen=True)
class Schema:
    """``rules``: (error, test); a test gets a function of a field's name to its number (null where there is none), and is true if broken."""

    fields: tuple[Field, ...]
    rules: tuple[tuple[str, Callable], ...] = field(default=())


LISTS = "array<array<boolean>>"


def kind_of(v: Column) -> Column:
    """string, number, boolean, object, array or null of a variant; null (no text) of a missing one.

    The schema of an array or object is that of all it holds, so it is asked of single values only.  To tell arrays and objects,
    what they hold is read as lists of lists, which costs nothing as it mostly is none."""
    t = F.schema_of_variant(v)
    holds = lambda kind: F.try_variant_get(v, "$", kind).isNotNull()
    return F.when(v.isNotNull(), F.when(F.is_variant_null(v), "null").when(holds(f"array<{LISTS}>"), "array").when(holds(f"map<string,{LISTS}>"), "object").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").otherwise("number"))


def _each(flags: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), text) for cond, text in flags])) if flags else F.array().cast("array<string>")


def _field_errors(v: Column, f: Field, path: Column) -> Column:
    """A value and its kind are worked out once, however many limits name them."""
    return bound(v, lambda x: bound(kind_of(x), lambda kind: _value_errors(x, kind, f, path)))


def _value_errors(v: Column, kind: Column, f: Field, path: Column) -> Column:
    missing = kind.isNull() | (kind == "null")
    wanted = "number" if f.kind == "integer" else f.kind
    wrong = F.lit(False) if f.kind == "any" else ~missing & (kind != wanted)
    say = lambda what: F.concat(path, F.lit(f": {what}"))
    flags = [(missing & F.lit(f.needed), say("missing")), (wrong, F.concat(path, F.lit(f": must be {'an' if wanted[0] in 'aeiou' else 'a'} {wanted}, is "), kind))]
    number = F.try_variant_get(F.when(kind == "number", v), "$", "double")
    text = F.try_variant_get(F.when(kind == "string", v), "$", "string")
    if f.kind == "integer":
        flags.append((number != F.floor(number), say("must be whole")))
    for limit, broken, word in ((f.least, lambda x: number < x, "at least"), (f.most, lambda x: number > x, "at most"), (f.above, lambda x: number <= x, "above")):
        if limit is not None:
            flags.append((broken(limit), say(f"must be {word} {limit:g}")))
    if f.one_of:
        flags.append((~text.isin(*f.one_of), say(f"must be one of {', '.join(f.one_of)}")))
    if f.shortest is not None:
        flags.append((F.length(text) < f.shortest, say(f"shorter than {f.shortest}")))
    if f.longest is not None:
        flags.append((F.length(text) > f.longest, say(f"longer than {f.longest}")))
    if f.check:
        flags.append((text.isNotNull() & ~f.check[1](text), say(f.check[0])))
    out = _each(flags)
    if f.fields and f.kind == "object":
        out = F.concat(out, F.when(kind == "object", _errors(v, f.fields, F.concat(path, F.lit(".")))).otherwise(F.array().cast("array<string>")))
    if f.fields and f.kind == "array":
        items = F.coalesce(F.try_variant_get(F.when(kind == "array", v), "$", "array<variant>"), F.array().cast("array<variant>"))
        item = Field("", "object", fields=f.fields)
        out = F.concat(out, F.flatten(F.transform(items, lambda x, i: _field_errors(x, item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    if f.each:
        values = F.coalesce(F.map_entries(F.try_variant_get(F.when(kind == "object", v), "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
        out = F.concat(out, F.flatten(F.transform(values, lambda x: _field_errors(x["value"], f.each, F.concat(path, F.lit("."), x["key"])))))
    return out


def _errors(v: Column, fields: tuple[Field, ...], prefix: Column) -> Column:
    return F.concat(*[_field_errors(F.try_variant_get(v, f"$.{f.name}", "variant"), f, F.concat(prefix, F.lit(f.name))) for f in fields])


def errors(v: Column, schema: Schema, place: str = "") -> Column:
    """Errors of a variant, which is worked out (parsed) once; one error, if it is no object (or there is none)."""
    return bound(v, lambda x: _object_errors(x, schema, place))


def _object_errors(v: Column, schema: Schema, place: str) -> Column:
    kind = kind_of(v)
    name = place or "answer"
    number = lambda n: F.when(kind_of(F.try_variant_get(v, f"$.{n}", "variant")) == "number", F.try_variant_get(v, f"$.{n}", "double"))
    rules = _each([(test(number), F.lit(f"{place + ': ' if place else ''}{text}")) for text, test in schema.rules])
    within = F.concat(_errors(v, schema.fields, F.lit(f"{place}." if place else "")), rules)
    return F.when(F.coalesce(kind == "object", F.lit(False)), within).otherwise(F.array(F.lit(f"{name}: must be an object")))
