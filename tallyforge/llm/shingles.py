"""Near copies by word shingles: Jaccard similarity of the sets of five-word shingles, for one document of each group.

Fingerprints at two bits link hardly any pair of a similarity of 0.8, and Golay keys for the ten bits in which such
pairs differ are too short to tell documents apart in a large corpus.  So groups are joined by both: op8's links, and
pairs of shingle sets that meet in a band of MinHash values and are verified by their whole sets.

Equal sets are one node from the start.  Up to SMALL sets under a band are compared in pairs.  The sets of a crowded
band are compared with one hub, the set whose keys are shared most (of edited copies, their original), which joins a
group as a star.  Keys whose sets are not one component then are settled by an exact prefix filter: two alike sets share
one of the rarest fifth of each one's shingles, so sets that have nothing but boilerplate in common never meet.  So only the bands are a search by
chance: of pairs at 0.8 they miss 1 in 2,500; every pair that is linked is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, maybe_broadcast, stored
from .simhash import fingerprint, links

WORDS = 5
BANDS = 20
ROWS = 5
#: A band's key with more sets is crowded.
SMALL = 16
#: Sets of different components under a rare shingle that are paired; more are compared in blocks.
FEW = 48
#: Sets (and hashes) in a block of such a shingle; a task compares two blocks at a time.
BLOCK_SETS = 256
BLOCK_HASHES = 1 << 21
#: Listed texts that are sent to the documents (16 bytes each); more are met by a shuffle.
LISTED = 500_000
_BLOCK = 8192

_draw = np.random.default_rng(5)
_FLIP = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_TIMES = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 32-bit hashes of the different word shingles (A-Z lower-cased); the whole of a shorter text; none without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint32)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64)
    k = min(words, len(h))
    mixed = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band: the hash of its MinHash values.  A set without shingles has none."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(own), _BLOCK):
        least = np.minimum(least, ((own[None, at : at + _BLOCK] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1))
    return [xxhash.xxh3_64_intdigest(least[ROWS * j : ROWS * (j + 1)].tobytes(), j) - (1 << 63) for j in range(BANDS)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, fps, sames, keys = batch.column(2), [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            own = shingle_set(text)
            fps.append(fingerprint(text))
            sames.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
            keys.append(bands(own))
        columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sames, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "fp", "same", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [shingle_set(t.as_py() or "").view(np.int32) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["s", "shingles"])


def _compared(group: pa.Table) -> pa.Table:
    """From s, root, shingles of two blocks: pairs of different roots that are alike, a forest of them."""
    s, root, lists = group["s"].to_numpy(), group["root"].to_numpy(), group["shingles"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    n, sizes = len(s), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows, (_, column, times) = np.repeat(np.arange(n), sizes), np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rows, column = rows[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column, common = rows[order], column[order], np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _BLOCK):
        lo, hi = np.searchsorted(column, [at, at + _BLOCK])
        held = np.zeros((n, _BLOCK), dtype=np.float32)
        held[rows[lo:hi], column[lo:hi] - at] = 1
        common += held @ held.T
    near = (9 * common.astype(np.int64) >= 4 * (sizes[:, None] + sizes[None, :])) & (root[:, None] != root[None, :])
    out, fresh = [], np.ones(n, dtype=bool)
    for start in range(n):
        if not fresh[start]:
            continue
        fresh[start], todo = False, [start]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & fresh)
            fresh[found] = False
            out += [(min(s[i], s[j]), max(s[i], s[j])) for j in found]
            todo += found.tolist()
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _alike(common: Column, a: Column, b: Column) -> Column:
    """Similarity common / (a + b - common) of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def candidates(sets: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b): pairs of sets that may be alike; and key, s, hub of the crowded keys, whose sets are paired with the
    hub only.  ``sets``: s, bands, one row a set."""
    entries = sets.select("s", F.explode("bands").alias("key"))
    often = entries.groupBy(F.col("key").alias("often")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    met = stored(entries.join(stored(often), F.col("key") == F.col("often")).drop("often"))
    lists = met.filter(F.col("times") <= small).groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("own"))  # SMALL at most
    rest = lists.select(F.explode(F.transform("own", lambda x, i: F.struct(x.alias("a"), F.slice(F.col("own"), i + 2, F.lit(small)).alias("others")))).alias("p"))
    crowded = met.filter(F.col("times") > small)
    weights = crowded.groupBy(F.col("s").alias("of")).agg(F.sum("times").alias("weight"))
    hubs = crowded.join(weights, F.col("s") == F.col("of")).groupBy(F.col("key").alias("hub_key")).agg(F.max_by("s", F.struct("weight", "s")).alias("hub"))
    crowded = stored(crowded.join(hubs, F.col("key") == F.col("hub_key")).select("key", "s", "hub"))
    stars = crowded.select(F.least("s", "hub").alias("a"), F.greatest("s", "hub").alias("b"))
    pairs = stored(rest.select("p.a", F.explode("p.others").alias("b")).unionByName(stars).filter("a < b").distinct())
    discard(met)
    return pairs, crowded


def _found(asked: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """s, shingles of the ``asked`` sets (q, once each)."""
    asked = stored(sets.join(asked, F.col("s") == F.col("q")).select("s", F.col("k").alias("of")))
    listed = maybe_broadcast(asked, asked.count(), LISTED)
    found = texts.join(listed, F.col("k") == F.col("of")).select("s", "text").mapInArrow(_sets, "s long, shingles array<int>")
    found = stored(found.groupBy("s").agg(F.first("shingles").alias("shingles")))
    discard(asked)
    return found


def verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""
    found = _found(pairs.select(F.explode(F.array("a", "b")).alias("q")).distinct(), texts, sets)
    side = lambda c: found.select(F.col("s").alias(f"of_{c}"), F.col("shingles").alias(f"own_{c}"))
    both = pairs.join(side("b"), F.col("b") == F.col("of_b")).join(side("a"), F.col("a") == F.col("of_a"))
    good = stored(both.filter(_alike(F.size(F.array_intersect("own_a", "own_b")), F.size("own_a"), F.size("own_b"))).select("a", "b"))
    discard(found)
    return good


def prefix_pairs(members: DataFrame, found: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b): all pairs of ``members`` (s, root) of different roots that may be alike; and blocks u, s, root of those that
    meet under a shingle of more than ``few`` sets, which hold the others.  ``found``: s, shingles (each once).

    Of a set of n shingles the n - ceil(0.8 n) + 1 rarest are its prefix, in one order of all shingles; alike sets share one of both
    prefixes, and differ in size by 1.25 times at most, so by one class of size.
    """
    sized = members.join(found.withColumnRenamed("s", "of"), F.col("s") == F.col("of")).select("s", "root", "shingles", F.size("shingles").alias("n"))
    each = sized.select("s", F.explode("shingles").alias("t"))
    often = each.groupBy(F.col("t").alias("of_t")).agg(F.count(F.lit(1)).alias("times"))
    ordered = each.join(often, F.col("t") == F.col("of_t")).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("times", "t"))).alias("o"))  # of one set
    size = F.size("o")
    first = F.slice("o", F.lit(1), size - F.floor((4 * size + 4) / 5).cast("int") + 1)
    prefix = ordered.select(F.col("s").alias("of"), F.explode(F.filter(first, lambda x: x["times"] > 1)).alias("x"))
    class_ = F.floor(F.log("n") / F.lit(float(np.log(1.26)))).cast("int")
    dealt = sized.select("s", "root", class_.alias("class")).join(prefix, F.col("s") == F.col("of")).select("s", "root", "class", F.col("x.t").alias("t"), F.explode(F.array("class", F.col("class") - 1)).alias("cell"))
    dealt = stored(dealt.withColumn("lower", F.col("cell") == F.col("class")))
    met = dealt.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("lower").alias("some"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    met = stored(met.filter("some and r0 != r1").select(F.col("t").alias("kt"), F.col("cell").alias("kc"), "n"))
    cells = dealt.join(met, (F.col("t") == F.col("kt")) & (F.col("cell") == F.col("kc"))).drop("kt", "kc")
    lists = cells.filter(F.col("n") <= few).groupBy("t", "cell").agg(F.collect_list(F.struct("s", "root", "lower")).alias("own"))  # few at most
    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: (x["s"] < y["s"]) & (x["root"] != y["root"]) & (x["lower"] | y["lower"])), lambda y: F.struct(x["s"].alias("a"), y["s"].alias("b")))))
    pairs = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    # Larger cells: the sets outside the largest component meet each other and those of it, which need not meet again.
    crowd = cells.filter(F.col("n") > few)
    mains = crowd.groupBy("t", "cell", "root").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("t").alias("kt"), F.col("cell").alias("kc")).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("joined"))
    block = F.greatest(F.lit(8.0), F.least(F.lit(float(BLOCK_SETS)), F.lit(float(BLOCK_HASHES)) / F.pow(F.lit(1.26), F.col("kc") + 2)))
    mains = mains.select("kt", "kc", "main", F.ceil((F.col("all") - F.col("joined")) / block).cast("int").alias("apart"), F.ceil(F.col("joined") / block).cast("int").alias("rest"))
    crowd = crowd.drop("n").join(mains, (F.col("t") == F.col("kt")) & (F.col("cell") == F.col("kc")))
    outside = F.col("root") != F.col("main")
    at = F.when(outside, F.pmod(F.xxhash64("s"), "apart")).otherwise(F.col("apart") + F.pmod(F.xxhash64("s"), "rest")).cast("int")
    crowd = crowd.select("t", "cell", "s", "root", at.alias("at"), F.explode(F.sequence(F.lit(0), F.when(outside, F.col("apart") + F.col("rest")).otherwise(F.col("apart")) - 1)).alias("with"))
    return pairs, crowd.select("s", "root", F.xxhash64("t", "cell", F.least("at", "with"), F.greatest("at", "with")).alias("u"))


def compared_blocks(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: alike pairs of different roots within the blocks (u, s, root), as many as join their components."""
    both = blocks.join(found.withColumnRenamed("s", "of"), F.col("s") == F.col("of")).select("u", "s", "root", "shingles")
    return both.groupBy("u").applyInArrow(_compared, "a long, b long")


def settled(crowded: DataFrame, links: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the links that ``links`` lack within crowded keys (key, s, hub), of every pair in different components."""
    roots = components(links, "a", "b")
    placed = crowded.join(roots, F.col("s") == F.col("node"), "left").select("key", "s", F.coalesce("root", "s").alias("root"))
    several = placed.groupBy(F.col("key").alias("of")).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1")
    unsettled = stored(placed.join(several, F.col("key") == F.col("of")).select("s", "root").distinct())
    if unsettled.isEmpty():
        return links.limit(0)
    found = _found(unsettled.select(F.col("s").alias("q")), texts, sets)
    pairs, blocks = (stored(x) for x in prefix_pairs(unsettled, found))
    return verified(pairs, texts, sets).unionByName(stored(compared_blocks(blocks, found)))


def alike(texts: DataFrame, sets: DataFrame, small: int = SMALL) -> DataFrame:
    """a, b: verified pairs whose components are those of all pairs in a band that are alike.  ``texts``: k, text, where rows
    of one k have one text; ``sets``: s, k, bands.

    Each set's smallest candidate is verified first; of the others, only pairs that are not yet in one component.
    """
    pairs, crowded = candidates(sets, small)
    first = verified(stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), texts, sets)
    roots = components(first, "a", "b")
    at = lambda c: roots.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}"))
    placed = pairs.join(at("a"), F.col("a") == F.col("n_a"), "left").join(at("b"), F.col("b") == F.col("n_b"), "left")
    apart = stored(placed.filter(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b"))
    tried = pairs.groupBy("b").agg(F.min("a").alias("a")).select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    rest = stored(apart.join(tried, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"))
    links = first.unionByName(verified(rest, texts, sets))
    return links if crowded.isEmpty() else links.unionByName(settled(crowded, links, texts, sets))


def keep_first(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """One document of each group (that of the smallest doc_id): groups are joined by five-word similarity of 0.8 and more,
    and by op8's links.

    Texts of equal shingle sets are one group, also those without words (null: empty).  Rows go by id and text, so an id that is
    repeated over several texts stays where it is the first of its group; rows that repeat both stay each.  Rows without an id stay; an empty
    table gives an empty result; all columns are passed on (``_dropped`` and ``_of`` are used here).
    """
    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.xxhash64(text).alias("k"), text.alias("text"))
    own = docs.select("doc_id", F.xxhash64(text).alias("k"), text.alias("text")).mapInArrow(_sketch, f"doc_id {kind}, k long, fp long, same long, bands array<long>")
    own = stored(own)
    sets = stored(own.groupBy(F.col("same").alias("s")).agg(F.min("doc_id").alias("first"), F.min("k").alias("k"), F.first("bands").alias("bands")))
    # Fingerprints linked by op8 join the sets of their texts as a star.
    prints = stored(own.select("fp", "same").distinct())
    roots = components(links(prints.select("fp").distinct()), "a", "b")
    rooted = stored(prints.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("c"), "same").distinct())
    several = rooted.groupBy(F.col("c").alias("of")).agg(F.min("same").alias("a"), F.max("same").alias("last")).filter("a != last")
    stars = rooted.join(stored(several), F.col("c") == F.col("of")).select("a", F.col("same").alias("b"))
    groups = components(alike(texts, sets, small).unionByName(stars), "a", "b")
    members = stored(groups.join(sets.select("s", "first"), F.col("node") == F.col("s")).select("node", "root", "first"))
    kept = members.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    merged = members.join(kept, F.col("root") == F.col("r")).select("node", "least")
    keep = stored(sets.join(merged, F.col("s") == F.col("node"), "left").select(F.col("s").alias("of"), F.coalesce("least", "first").alias("keep")))
    dropped = own.select("doc_id", "k", "same").join(keep, F.col("same") == F.col("of")).filter("doc_id != keep").select(F.col("doc_id").alias("_dropped"), F.col("k").alias("_of")).distinct()
    return docs.join(dropped, (F.col("doc_id") == F.col("_dropped")) & (F.xxhash64(text) == F.col("_of")), "left_anti")
