"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed base rules reject the plainly broken texts.  For the others every (lang, source) gets its own limits, read from
mergeable quantile sketches: counts of log-linear buckets (the leading bits of an integer metric), which merge by
addition, so that partial sketches combine in any order and reruns agree.  Groups with few rows use the sketch of their
language, and that of all rows if that is small too; those are sums of the same counts.  The thresholds are joined back
and documents outside them are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WS_CLASS, bucket_width, cut, maybe_broadcast, spread, top_bits

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Sketches keep so many leading bits of a metric: a relative error of at most 1/32.
SKETCH_BITS = 6
#: A group with fewer rows takes the limits of the next wider one.
MIN_GROUP = 100
#: Limits lie SPREAD times the way from the median to an outer quantile beyond that quantile, and the mean deviation of all
#: documents and a bucket further, which keeps a group of equal values from rejecting all that differs at all.  Nothing else is given.
SPREAD = 2
#: metric: (numerator, scale, denominator, percent), all integer: scale * numerator div denominator.  The outer
#: quantiles are at ``percent`` and 100 - percent of a group's documents: more where sound texts have rare high values,
#: less where many of a source may be junk.
METRICS = {
    "symbol": ("n_symbols", 1000, "n_words", 90),
    "upper": ("n_upper", 1000, "word_chars", 98),
    "dup_line": ("n_dup_lines", 1000, "n_words", 98),
    "repeat": ("n_repeat_words", 1000, "n_words", 98),
    "word_length": ("word_chars", 100, "n_words", 90),
}


#: Keys of rejected rows that are sent to the documents; more are met by a shuffle.
LISTED = 500_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_upper, n_dup_lines and n_repeat_words (long) of each whole text.

    A null text counts as an empty one.  A text whose triples of words all have different hashes repeats none; in the
    others repeats are found by sorting the text's own triples, so the cost of a very long text is n log n and nothing
    is shuffled.  Input columns named as the added ones are replaced; ``_q_*``
    names are used here.
    """
    docs = docs.drop(*MEASURES)
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: x.rlike(WORD)
    df = docs.withColumns(
        {
            "_q_words": F.array_remove(F.split(t, WS_CLASS + "+"), ""),
            "_q_lines": F.filter(F.split(t, "\n"), has_word),
            "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        }
    )
    df = df.withColumns({"n_words": F.size("_q_words").cast("long"), "word_chars": F.length(F.array_join("_q_words", "")).cast("long"), "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long")})
    w = F.col("_q_words")
    triple = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("p"))
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("_q_some", (F.size(w) >= 4) & (F.size(F.array_distinct(hashes)) < F.size(w)))
    df = df.withColumn("_q_sorted", F.when(F.col("_q_some"), F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), triple))))
    s = F.col("_q_sorted")
    same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
    df = df.withColumn("_q_again", F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"])))
    covered = F.aggregate(
        "_q_again",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # A generator of one row, through which no filter on the measures is pushed (it would repeat all of the above).
    own = F.explode(F.array(F.struct(*MEASURES))).alias("_q_measures")
    return df.select(*docs.columns, own).select(*docs.columns, "_q_measures.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def metric(name: str) -> Column:
    top, scale, below, *_ = METRICS[name]
    return F.expr(f"({top} * {scale}L) div greatest({below}, 1L)")


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable sketches of the documents that pass the base rules: q_lang, q_source, metric, bucket, n.

    ``level`` 0: of a language and source; 1: of a language; 2: of all (the other columns are null there).
    """
    rows = measured.filter(~base_failed()).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), top_bits(metric(m), SKETCH_BITS).alias("bucket")) for m in METRICS])).alias("x"))
    fine = rows.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("string")
    lang = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    every = lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    pick = lambda df, level, a, b: df.select(F.lit(level).alias("level"), a.alias("q_lang"), b.alias("q_source"), "metric", "bucket", "n")
    return pick(fine, 0, F.col("lang"), F.col("source")).unionByName(pick(lang, 1, F.col("lang"), nothing)).unionByName(pick(every, 2, nothing, nothing))


def limits(sketch: DataFrame) -> DataFrame:
    """level, q_lang, q_source and for each metric the range of buckets that is kept (``min_<metric>``, ``max_<metric>``)."""
    group = ["level", "q_lang", "q_source", "metric"]
    w = Window.partitionBy(*group)
    percent = F.expr("case metric " + " ".join(f"when '{m}' then {v[3]}" for m, v in METRICS.items()) + " end")
    df = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w), "percent": percent})
    at = lambda part: F.min(F.when(100 * F.col("upto") >= part * F.col("all"), F.col("bucket")))
    df = df.groupBy(*group).agg(at(100 - F.col("percent")).alias("low"), at(F.lit(50)).alias("mid"), at(F.col("percent")).alias("high"), F.max("all").alias("rows"))
    df = cut(df.filter((F.col("level") == 2) | (F.col("rows") >= MIN_GROUP)))
    middle = df.filter("level = 2").select(F.col("metric").alias("of"), "mid")
    off = sketch.filter("level = 2").join(F.broadcast(middle), F.col("metric") == F.col("of")).groupBy("of").agg(F.expr("sum(n * abs(bucket - mid)) div sum(n)").alias("off"))  # a row a metric
    df = df.join(F.broadcast(off), F.col("metric") == F.col("of"))
    df = df.withColumns({"least": F.col("low") - SPREAD * (F.col("mid") - F.col("low")) - F.col("off") - bucket_width(F.col("low"), SKETCH_BITS), "most": F.col("high") + SPREAD * (F.col("high") - F.col("mid")) + F.col("off") + bucket_width(F.col("high"), SKETCH_BITS)})
    one = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return df.groupBy("level", "q_lang", "q_source").agg(*[one(m, c).alias(f"{kind}_{m}") for m in METRICS for kind, c in (("min", "least"), ("max", "most"))])


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add base_failed, the metrics outside their limits (``outside``, an array) and kept.  ``bounds``: from limits(), already cut; joined by broadcast if few."""
    n, widest = bounds.count(), bounds.filter("level = 2").first()
    names = [f"{kind}_{m}" for m in METRICS for kind in ("min", "max")]
    named = lambda level: maybe_broadcast(bounds.filter(F.col("level") == level).select(F.col("q_lang").alias(f"l{level}"), F.col("q_source").alias(f"s{level}"), *[F.col(c).alias(f"{c}_{level}") for c in names]), n)
    df = measured.join(named(0), F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
    df = df.join(named(1), F.col("lang").eqNullSafe(F.col("l1")), "left")
    limit = lambda c: F.coalesce(F.col(f"{c}_0"), F.col(f"{c}_1"), F.lit(widest[c] if widest else None).cast("long"))
    off = lambda m: (top_bits(metric(m), SKETCH_BITS) > limit(f"max_{m}")) | (top_bits(metric(m), SKETCH_BITS) < limit(f"min_{m}"))
    df = df.withColumns({"base_failed": base_failed(), "outside": F.array_compact(F.array(*[F.when(off(m), m) for m in METRICS]))})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
    return df.drop(*[f"{c}_{level}" for c in names for level in range(2)], "l0", "s0", "l1", "s1")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and verdicts of every document; one pass over the texts, whose measures are cut to a table.

    Null ids, languages and sources are values of their own; repeated rows are judged each; an empty table gives an
    empty result; other columns of the input are not read.
    """
    measured = cut(measures(spread(docs.select("doc_id", "lang", "source", "text"))).drop("text"))
    return judge(measured, cut(limits(sketches(measured))))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that score_documents() keeps, with the input's columns.

    Texts are measured once; the keys of rejected rows, 16 bytes each, then meet the documents, by broadcast if they are
    few.  Rows with equal keys have equal ids, texts, languages and sources, so they are judged alike.
    """
    there = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()]
    keys = [F.xxhash64(*there("doc_id"), *there("lang"), *there("source")).alias("_q_k1"), F.xxhash64(*there("text")).alias("_q_k2")]
    measured = cut(measures(docs.select("lang", "source", "text", *keys)).drop("text"))
    rejected = judge(measured, cut(limits(sketches(measured)))).filter("not kept").select(F.col("_q_k1").alias("_q_r1"), F.col("_q_k2").alias("_q_r2")).distinct()
    rejected = cut(rejected)
    out = docs.withColumns({"_q_k1": keys[0], "_q_k2": keys[1]}).join(maybe_broadcast(rejected, rejected.count(), LISTED), (F.col("_q_k1") == F.col("_q_r1")) & (F.col("_q_k2") == F.col("_q_r2")), "left_anti")
    return out.select(*docs.columns)
