"""First fit of names to the heads of groups, in order of first appearance, as rounds of joins.

One name after the other joins the first head that it matches, or becomes a head.  That is a greedy independent set:
a name is a head if no earlier head matches it.  A round settles every name whose earlier matches are all settled
(heads among them have taken it away before): it becomes a head, and the names that match it are settled with it.  The
open names and the matches between them shrink each round, until none is left; then each name takes its first head.

Names match by an equal key (their first long word) or if one holds the other.  Names of one key are never paired: a group of a
key has one head at most, so its first open name stands for all.  Held names are found by their rarest gram, the one
the fewest names have; a name of n letters holds fewer than n * n / 2 others, so matches grow with the names.

All tables here grow with the names, while files of the matches, which repeat names, are small: no join may take such a table
whole to the driver because of its file's size, so all are asked to sort and merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import discard, stored

#: Letters of a gram; shorter names are their own gram.
GRAM = 8


def _parts(col: Column, size: Column | int) -> Column:
    """The different substrings of ``size`` letters; none of shorter texts."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.length(col) - size + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(col, i, size)))).otherwise(F.array().cast("array<string>"))


def _meet(a: DataFrame, b: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    return a.join(b.hint("merge"), on, how)


def held_names(names: DataFrame, gram: int = GRAM) -> DataFrame:
    """inner, outer: pairs of different ``name`` where the outer one holds the inner one."""
    short = [r.n for r in names.select(F.least(F.length("name"), F.lit(gram)).alias("n")).distinct().collect()]  # gram values at most
    grams = names.select("name", F.explode(F.flatten(F.array(*[_parts(F.col("name"), n) for n in sorted(short)]))).alias("part")) if short else names.select("name", F.col("name").alias("part"))
    often = grams.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("times"))
    own = names.select(F.col("name").alias("inner"), F.explode(_parts(F.col("name"), F.least(F.length("name"), F.lit(gram)))).alias("q"))
    rarest = _meet(own, often, F.col("q") == F.col("p")).groupBy("inner").agg(F.min(F.struct("times", "q")).alias("r"))
    # A name whose rarest gram is its own alone lies in no other.
    rarest = rarest.filter("r.times > 1").select("inner", F.col("r.q").alias("q"))
    return _meet(grams, rarest, F.col("part") == F.col("q")).filter((F.col("name") != F.col("inner")) & F.col("name").contains(F.col("inner"))).select("inner", F.col("name").alias("outer"))


def first_fit(names: DataFrame, key: Column) -> DataFrame:
    """name, cluster: each different name with the first head it matches, by equal ``key`` (null matches nothing) or as part of each other.

    ``names``: name (not null, once each), ord (its place; of equal places the smaller name is first).  An empty name matches nothing.
    """
    open_ = stored(names.select(F.struct("ord", "name").alias("at"), key.alias("word"), "name"))
    place = lambda c: open_.select(F.col("name").alias(f"name_{c}"), F.col("at").alias(f"at_{c}"))
    held = held_names(names.filter("name != ''"))
    met = _meet(_meet(held, place("i"), F.col("inner") == F.col("name_i")), place("o"), F.col("outer") == F.col("name_o"))
    edges = stored(met.select(F.least("at_i", "at_o").alias("a"), F.greatest("at_i", "at_o").alias("b")))
    every, all_edges, heads = open_, edges, []
    while True:
        first = open_.filter("word is not null").groupBy(F.col("word").alias("w")).agg(F.min("at").alias("first"))
        later = edges.select(F.col("b").alias("blocked")).distinct()
        free = _meet(_meet(open_, first, F.col("word") == F.col("w"), "left").filter("first is null or first = at"), later, F.col("at") == F.col("blocked"), "left_anti")
        heads.append(stored(free.select("at", "word")))
        taken = heads[-1].select(F.col("at").alias("gone")).unionByName(_meet(edges, heads[-1], F.col("a") == F.col("at")).select(F.col("b").alias("gone"))).distinct()
        words = heads[-1].filter("word is not null").select(F.col("word").alias("w")).distinct()
        before = (open_, edges)
        open_ = stored(_meet(_meet(open_, taken, F.col("at") == F.col("gone"), "left_anti"), words, F.col("word") == F.col("w"), "left_anti"))
        if open_.isEmpty():
            break
        still = open_.select(F.col("at").alias("there"))
        edges = stored(_meet(_meet(edges, still, F.col("a") == F.col("there")).drop("there"), still, F.col("b") == F.col("there")).drop("there"))
        for old in before:
            if old is not every and old is not all_edges:
                discard(old)
    head = reduce(DataFrame.unionByName, heads)
    by_word = _meet(every, head.filter("word is not null").select(F.col("word").alias("w"), F.col("at").alias("head")), F.col("word") == F.col("w"))
    by_part = _meet(all_edges, head.select(F.col("at").alias("head")), F.col("a") == F.col("head")).select(F.col("b").alias("at"), "head")
    itself = head.select("at", F.col("at").alias("head"))
    found = by_word.filter("head < at").select("at", "head").unionByName(by_part).unionByName(itself)
    return found.groupBy("at").agg(F.min("head").alias("head")).select(F.col("at.name").alias("name"), F.col("head.name").alias("cluster"))
