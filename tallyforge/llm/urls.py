"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

Rules are entries of a host and a path prefix; a rule fits its host and all subdomains, if the URL's path starts with
its path, and the longest rule wins.  The shapes of the rules (number of host labels, length of path) say which keys of
a URL can be listed at all.  The block list holds whole URLs, which fit by equality of their canonical forms, however
many, and hosts.  A URL probes its few keys in the filter, and only rows with a possible hit go on to the join, which
removes false positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

#: Bits of the filter for each entry, and the largest filter; beyond it more false positives reach the exact join.
BITS_PER_ENTRY = 16
MAX_FILTER_BYTES = 64 << 20
#: Parameters that tell visits apart, not pages.
TRACKING = r"^(utm_[a-z_]+|gclid|fbclid|msclkid|dclid)(=|$)"
#: Matched key lists that are broadcast; more are joined by a shuffle of the rows with a possible hit.
FEW = 50_000
WORDS = 8  # 32-bit words of a block: 256 bits, half a cache line


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One form of the URLs of a page: without scheme, user, port 80 or 443, dot after the host, '/' at the end of the
    path, tracking parameters and fragment; parameters sorted, unreserved characters not percent-encoded.  Null without a host."""
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), r"\.$", "")

    def plain(x: Column) -> Column:
        char = F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("long"))
        escaped = F.when(char.rlike("^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2))))
        return F.when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(escaped, F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%"), x))

    def decoded(x: Column) -> Column:
        parts = F.split(x, "%")
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), plain), ""))

    asked = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(asked) > 0, F.concat(F.lit("?"), decoded(F.array_join(asked, "&")))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(decoded(path), "/+$", ""), query))


def block_filter(hashes: DataFrame, entries: int) -> np.ndarray:
    """Blocks x 8 words of the Bloom filter over ``hashes`` (h, g: two independent longs), built by a distributed OR."""
    blocks = max(1, min(entries * BITS_PER_ENTRY // 256 + 1, MAX_FILTER_BYTES // 32))
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(g, {5 * i}) & 31 as int))")).alias(f"w{i}") for i in range(WORDS)]
    rows = hashes.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(*words).toArrow()
    out = np.zeros((blocks, WORDS), dtype=np.uint32)
    at = rows["block"].to_numpy()
    for i in range(WORDS):
        out[at, i] = rows[f"w{i}"].to_numpy().astype(np.uint32)
    return out


def listing_shapes(listing: DataFrame) -> list[tuple[int, int]]:
    """(host labels, path length) of the entries, longest first. """
    rows = listing.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct().collect()
    return sorted(((r.labels, r.length) for r in rows), reverse=True)


def match(df: DataFrame, listing: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Add ``entry``: struct(rule, verdict) of the longest entry of ``listing`` (host, path, verdict) that fits, or null.

    Rows without a possible hit pass by without a shuffle.  Null or empty hosts fit nothing; repeated rows are kept and
    each judged; an empty table or listing gives nulls; other columns are passed on (``_url_*`` are used here).  An
    entry that is listed twice with different verdicts counts as blocking.
    """
    listing = listing.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    keyed = listing.select(F.concat_ws("\n", "host", "path").alias("key"), F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "verdict").alias("found"))
    h, p = F.col(host), F.col(path)
    labels = F.size(F.split(h, r"\."))
    shapes = listing_shapes(listing)
    if not shapes:
        return df.withColumn("entry", F.lit(None).cast("struct<rule:string,verdict:string>"))
    shape = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n_path).alias("n")) for k, n_path in shapes])
    key = lambda s: F.when((labels >= s["k"]) & (F.length(p) >= s["n"]) & (h != ""), F.concat_ws("\n", F.call_function("substring_index", h, F.lit("."), -s["k"]), F.substr(p, F.lit(1), s["n"])))
    return _look_up(df, keyed, F.transform(shape, key))


def match_listed(df: DataFrame, listing: DataFrame, url: str = "url", host: str = "host") -> DataFrame:
    """Add ``entry`` as match() does, from a block list (host, path, verdict): an entry with a path fits URLs of its
    canonical form only, one without a path its host and all subdomains."""
    whole = F.concat(F.lit("=\n"), canonical(F.concat(F.lit("http://"), "host", "path")))
    listing = listing.withColumn("key", F.when(F.col("path") == "", F.concat("host", F.lit("\n"))).otherwise(whole)).filter("key is not null")
    listing = listing.groupBy("key").agg(F.max(F.concat("host", "path")).alias("rule"), F.max("verdict").alias("verdict"), F.max(F.when(F.col("path") == "", F.size(F.split("host", r"\.")))).alias("labels"))
    keyed = listing.select("key", F.struct(F.length("rule").alias("length"), "rule", "verdict").alias("found"))
    kinds = sorted((r.labels or 0) for r in listing.select("labels").distinct().collect())
    h = F.col(host)
    suffix = lambda k: F.when((F.size(F.split(h, r"\.")) >= k) & (h != ""), F.concat(F.substring_index(h, ".", -k), F.lit("\n")))
    if not kinds:
        return df.withColumn("entry", F.lit(None).cast("struct<rule:string,verdict:string>"))
    return _look_up(df, keyed, F.array(*[suffix(k) if k else F.concat(F.lit("=\n"), canonical(F.col(url))) for k in kinds]))


def _look_up(df: DataFrame, keyed: DataFrame, keys: Column) -> DataFrame:
    """Add ``entry`` of the longest found of ``keyed`` (key, found: struct(length, rule, verdict)) among a row's ``keys`` (an array, with nulls)."""
    n, spark = keyed.count(), df.sparkSession
    filled = spark.sparkContext.broadcast(block_filter(keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g")), n))

    @F.pandas_udf("array<string>")
    def probe(keys: pd.Series, hs: pd.Series, gs: pd.Series) -> pd.Series:
        ends = np.cumsum(keys.map(len).to_numpy(dtype=np.int64))
        if not len(ends) or not ends[-1]:
            return pd.Series([[]] * len(keys))
        k, h, g = np.concatenate(keys.to_list()), np.concatenate(hs.to_list()).astype(np.int64), np.concatenate(gs.to_list()).astype(np.int64)
        block, there = filled.value[h % len(filled.value)], np.ones(len(h), dtype=bool)
        for i in range(WORDS):
            there &= (block[:, i] >> ((g >> (5 * i)) & 31).astype(np.uint32)) & 1 == 1
        return pd.Series([x[y].tolist() for x, y in zip(np.split(k, ends[:-1]), np.split(there, ends[:-1]), strict=True)])

    df = df.withColumn("_url_keys", F.filter(keys, lambda k: k.isNotNull()))
    hashed = [F.transform("_url_keys", lambda k: F.xxhash64(k)), F.transform("_url_keys", lambda k: F.xxhash64(F.lit("second"), k))]
    df = df.withColumn("_url_possible", probe("_url_keys", *hashed))
    columns = [c for c in df.columns if not c.startswith("_url_")]
    entry = F.when(F.col("_url_found").isNotNull(), F.struct(F.col("_url_found.rule").alias("rule"), F.col("_url_found.verdict").alias("verdict")))
    some = df.filter("size(_url_possible) > 0")
    # Equal rows share their keys, so the join needs each distinct key list once; the hot ones are merged before the shuffle.
    lists = some.select("_url_possible").distinct()
    exact = (
        lists.withColumn("key", F.explode("_url_possible"))
        .join(maybe_broadcast(keyed, n), "key")
        .groupBy(F.col("_url_possible").alias("_url_list"))
        .agg(F.max("found").alias("_url_found"))
    )
    exact = cut(exact)
    n_exact, same = exact.count(), F.col("_url_possible") == F.col("_url_list")
    if n_exact <= FEW:  # one reading: no row's list is empty in ``exact``
        return df.join(F.broadcast(exact), same, "left").select(*columns, entry.alias("entry"))
    passed = df.filter("size(_url_possible) = 0").select(*columns, F.lit(None).cast("struct<rule:string,verdict:string>").alias("entry"))
    return passed.unionByName(some.join(exact, same, "left").select(*columns, entry.alias("entry")))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule, listed (boolean) and verdict of each URL.

    ``rules``: entries that decide.  ``listed``: the block list, whole URLs and hosts (see match_listed) that decide where
    no rule fits; anything else is allowed.  Input columns named as the added ones (or ``entry``) are replaced.
    """
    host, path = host_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict", "listed", "entry")
    df = match(pages.withColumns({"host": host, "path": path}), rules).withColumnRenamed("entry", "_rule")
    df = match_listed(df, listed, url).withColumn("listed", F.col("entry").isNotNull())
    verdict = F.coalesce(F.col("_rule.verdict"), F.col("entry.verdict"), F.lit("allow"))
    return df.withColumns({"rule": F.col("_rule.rule"), "verdict": verdict}).drop("_rule", "entry")
