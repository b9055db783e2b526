"""Exact repeats of long byte strings, within and across documents, by suffix arrays over shards.

Which 400-byte windows may repeat is found first.  Each window has an anchor: its 128-byte part with the least hash
(leftmost at a tie), so equal windows have equal anchors at the same place in them.  Neighbouring windows with one
anchor form a run; runs meet by their anchor's hash.  An anchor that occurs once has no repeats.  Where all runs of an
anchor are equal as a whole, every window of theirs repeats.  The rest is mixed: runs that are equal as a whole to
another repeat, and stand once for all of them; the others go with those to a shard of their anchor.  There, runs are
first cut to what they share with any other run of the anchor; then the shard's suffix array is built by induced
sorting, with the permuted common prefixes, and tells for each window whether another one is equal.

An anchor with more different runs than a shard holds is dealt window by window to hash counts, which is exact as well
and splits the hot group.  Counts are combined before each shuffle; texts move only to rows that are joined by a
document's key, which no two different documents share.

The unit of a window is a byte, or a word: then each word stands as the 32 bits of its hash, so that all of the above
works on these, and passages are the same whatever space is between their words.  Repeats of both units can be looked
for at once: then their runs take the same shuffles, and the lowest bit of an anchor's hash tells which is which.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .suffix import repeated_starts, suffix_array

WINDOW = 400
ANCHOR = 128  # a power of two
#: A passage of over 50 words keeps so many whole ones, wherever its two ends touch other text.
PASSAGE_WORDS = 49
PASSAGE_ANCHOR = 64
#: Bytes that stand for a unit of the text.
UNITS = {"bytes": 1, "words": 4}
VALUES = {"bytes": np.uint8, "words": np.uint32}
#: Runs of a text that are fetched together: those that begin in one stretch of 2**22 bytes.
_STRETCH = 22
#: Windows of one text that are looked at together, and values in one suffix array (plus one anchor's at most).
BLOCK = 1 << 18
SHARD = 1 << 18
#: Units of short texts that are looked at together.
JOINT = 1 << 15
#: An anchor with more different runs goes to hash counts.
CROWDED = 1_500
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
_PLACE = 24


class Kind(NamedTuple):
    """What is looked for: window and anchor in units; the anchor is a power of two."""

    unit: str
    window: int
    anchor: int

    @property
    def size(self) -> int:
        return UNITS[self.unit]


def _scattered(n: int, salt: int) -> np.ndarray:
    """``n`` fixed numbers of 64 bits."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(salt)) * np.uint64(_MIX[0])
    for c in _MIX[1:3]:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(c)
    return x ^ (x >> np.uint64(29))


_LETTERS, _PLACES = _scattered(256, 1 << 20), _scattered(4096, 1 << 30) | np.uint64(1)


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where the words of ``data`` (bytes) begin."""
    inner = (data != 32) & ((data < 9) | (data > 13))
    return np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]]))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32 bits of hash a word: the sum of its bytes' numbers, each times one of its place in the word."""
    out = np.empty(len(starts), dtype=np.uint32)
    ends = np.append(starts[1:], len(data))
    x = 0
    while x < len(starts):  # some 2**15 bytes at a time, or one word
        y = max(x + 1, int(np.searchsorted(ends, starts[x] + (1 << 15), "right")))
        part, own = data[starts[x] : ends[y - 1]], starts[x:y] - starts[x]
        place = np.arange(len(part), dtype=np.int32) - np.repeat(own.astype(np.int32), ends[x:y] - starts[x:y])
        value = _LETTERS.take(part)
        if place.max() > 4095:
            value += (place >> 12).astype(np.uint64) * np.uint64(_MIX[3])
        value *= _PLACES.take(place & 4095)
        value *= (part != 32) & ((part < 9) | (part > 13))
        h = np.add.reduceat(value, own)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX[4])
        out[x:y] = (h >> np.uint64(32)).astype(np.uint32)
        x = y
    return out


def coded(texts: list[str], unit: str) -> tuple[bytes, np.ndarray]:
    """The bytes of texts, or four bytes of hash a word, one text after the other; how many units each has."""
    made = [t.encode() for t in texts]
    sizes = np.array([len(x) for x in made])
    if unit == "bytes":
        return b"".join(made), sizes
    data = np.frombuffer(b"\n".join(made), dtype=np.uint8)
    starts = word_starts(data)
    return word_hashes(data, starts).tobytes(), np.diff(np.searchsorted(starts, np.append(0, np.cumsum(sizes + 1))))


def anchors(data: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window of ``data`` (units) the place of its anchor.  At most 2**24 windows."""
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    for c in _MIX:
        if size == anchor:
            break
        a = h[: len(h) - size] * np.uint64(c)
        a ^= a >> np.uint64(32)
        h = a + h[size:]
        size *= 2
    h *= np.uint64(_MIX[0])
    h ^= h >> np.uint64(31)
    least = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    n, span = window - anchor + 1, 1
    while 2 * span <= n:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    m = len(data) - window + 1
    return (np.minimum(least[:m], least[n - span : n - span + m]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def runs_of(values: np.ndarray, window: int, anchor: int, text: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First windows, numbers of windows and places of the anchors of the runs, block by block.  ``text``: the number of
    the text of each value; windows over two texts are left out."""
    n = len(values) - window + 1
    for at in range(0, n, BLOCK):
        upto = min(at + BLOCK, n)
        place = anchors(values[at : upto + window - 1], window, anchor)
        if text is not None:  # the anchor of a window within a text lies within it too, so no run is in two texts
            place = np.where(text[at:upto] == text[at + window - 1 : upto + window - 1], place, -1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        size, place = np.diff(np.append(first, len(place))), place[first]
        inside = place >= 0
        yield first[inside] + at, size[inside], place[inside] + at


def _joint(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Texts that are looked at together, as ranges: JOINT units at most, or one text."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > JOINT:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _runs(batches: Iterable[pa.RecordBatch], kinds: tuple[Kind, ...]) -> Iterator[pa.RecordBatch]:
    """a: the anchor's hash, c: the hash of the run as a whole, k1, k2: the document, pos: place, windows, anchor."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
        for u, (unit, window, anchor) in enumerate(kinds):
            w = UNITS[unit]
            for i, j in _joint([len(t) // w for t in texts]):
                whole, sizes = coded(texts[i:j], unit)
                starts = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(j - i), sizes)
                for lo, n, place in runs_of(np.frombuffer(whole, dtype=VALUES[unit]), window, anchor, owner if j - i > 1 else None):
                    own = owner[lo]
                    a = np.array([digest(whole[p : p + w * anchor]) for p in (w * place).tolist()], dtype=np.uint64)
                    c = np.array([digest(whole[p:q]) for p, q in zip((w * lo).tolist(), (w * (lo + n + (window - 1))).tolist(), strict=True)], dtype=np.uint64)
                    columns = [(a & np.uint64(2**64 - 2) | np.uint64(u)).view(np.int64), c.view(np.int64), *[k[i:j][own] for k in keys], lo - starts[own] << 24 | n << 12 | place - lo]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "c", "k1", "k2", "pos"])


def _contexts(batches: Iterable[pa.RecordBatch], kinds: tuple[Kind, ...]) -> Iterator[pa.RecordBatch]:
    """What stands before and after the anchor of each listed run."""
    for batch in batches:
        runs, ends = batch.column("runs").flatten(), np.cumsum(batch.column("runs").value_lengths().to_numpy())
        fields = {c: runs.field(c).to_numpy() for c in ("a", "c", "n", "m", "pos")}
        for i in range(batch.num_rows):
            whole, k1, k2 = batch.column("text")[i].as_py(), batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py()
            own = {c: x[ends[i - 1] if i else 0 : ends[i]] for c, x in fields.items()}
            for u in np.unique(own["a"] & 1).tolist():
                (text, _), w, (_, window, anchor) = coded([whole], kinds[u].unit), kinds[u].size, kinds[u]
                a, c, n, m, pos = (x[own["a"] & 1 == u] for x in own.values())
                for at in range(0, len(a), 4096):
                    part = slice(at, at + 4096)
                    lo = pos[part] >> 24
                    place = lo + (pos[part] & 0xFFF)
                    before, after = (w * lo).tolist(), (w * (lo + (pos[part] >> 12 & 0xFFF) + (window - 1))).tolist()
                    middle = (w * place).tolist()
                    sides = [text[p:q] for p, q in zip(before, middle, strict=True)], [text[p + w * anchor : q] for p, q in zip(middle, after, strict=True)]
                    columns = [a[part], c[part], n[part], m[part], np.full(len(lo), k1), np.full(len(lo), k2), place]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], *[pa.array(x, pa.binary()) for x in sides]], names=["a", "c", "n", "m", "k1", "k2", "place", "left", "right"])


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
    return ((differ & -differ).bit_length() - 1) // 8 if differ else n


def shared_parts(runs: list[tuple[bytes, bytes]], size: int) -> list[tuple[int, int]]:
    """How many units of ``size`` bytes of each run's (left, right) agree with any other's, outwards from the anchor: from
    the neighbours in order."""
    out = []
    for sides in ([x[0][::-1] for x in runs], [x[1] for x in runs]):
        most = [0] * len(runs)
        order = sorted(range(len(runs)), key=sides.__getitem__)
        for i, j in zip(order, order[1:]):
            n = _common(sides[i], sides[j]) // size
            most[i], most[j] = max(most[i], n), max(most[j], n)
        out.append(most)
    return list(zip(*out, strict=True))


def shard_spans(groups: list[list[tuple]], kind: Kind) -> Iterator[tuple[int, int, int, int]]:
    """(k1, k2, start, end) of the repeated windows of runs that occur once.  A group: rows of one anchor, with
    (n, k1, k2, place, left, right).  An anchor, which all windows of its runs hold, is one value of the array."""
    parts, owners, w = [], [], kind.size
    unit, window, anchor = kind
    least, top = window - anchor + 1, int(np.iinfo(VALUES[unit]).max) + 3
    for g, rows in enumerate(groups):
        for (n, k1, k2, place, left, right), (l, r) in zip(rows, shared_parts([(x[4], x[5]) for x in rows], w), strict=True):
            if l + r + anchor >= window:
                parts += [left[len(left) - w * l :], right[: w * r]]
                owners.append((l, r, g, n == 1, k1, k2, place))
    if len(owners) < 2:
        return
    l, r, g, alone, k1, k2, place = np.array(owners, dtype=np.int64).T
    at = np.cumsum(l + r + 2) - (l + r + 2)  # a part: what is left of the anchor, the anchor, what is right, an end
    values = np.zeros(at[-1] + l[-1] + r[-1] + 3, dtype=np.int64)
    values[at + l], values[at + l + r + 1] = top + g, 1
    values[:-1][values[:-1] == 0] = np.frombuffer(b"".join(parts), dtype=VALUES[unit]).astype(np.int64) + 2
    if unit != "bytes":  # hashes by their rank, so that the array's buckets are few
        values = np.unique(values, return_inverse=True)[1]
    edges = np.zeros(len(values) + 1, dtype=np.int64)
    edges[at] += 1
    edges[at + np.minimum(l, l + r + 1 - least) + 1] -= 1
    hits = np.flatnonzero(repeated_starts(values, suffix_array(values), np.cumsum(edges)[:-1] > 0, least))
    owner = np.searchsorted(at, hits, "right") - 1
    hits, owner = hits[alone[owner] > 0], owner[alone[owner] > 0]
    if len(hits):
        gaps = np.flatnonzero((np.diff(hits) > 1) | (np.diff(owner) > 0))
        first, last = np.append(0, gaps + 1), np.append(gaps, len(hits) - 1)
        o = owner[first]
        begin = place[o] - l[o] - at[o]
        yield from zip(k1[o].tolist(), k2[o].tolist(), (begin + hits[first]).tolist(), (begin + hits[last] + window).tolist(), strict=True)


def _shards(batches: Iterable[pa.RecordBatch], kinds: tuple[Kind, ...]) -> Iterator[pa.RecordBatch]:
    """From rows in order of kind and anchor: the spans, shard by shard."""
    groups: list[list[tuple]] = []
    size, key, seen = 0, None, set()

    def out(rows: Iterable[tuple], u: int) -> pa.RecordBatch:
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([u] * len(rows), pa.int32()), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]], names=["u", "k1", "k2", "start", "end"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("a", "c", "n", "k1", "k2", "place", "left", "right")], strict=True):
            if row[0] != key:
                if size >= SHARD or (groups and key & 1 != row[0] & 1):
                    yield out(shard_spans(groups, kinds[key & 1]), key & 1)
                    groups, size = [], 0
                key, seen = row[0], set()
                groups.append([])
            if row[1] not in seen:  # once, also where a row of the table repeats
                seen.add(row[1])
                groups[-1].append(row[2:])
                size += (len(row[6]) + len(row[7])) // kinds[key & 1].size + 2
    if groups:
        yield out(shard_spans(groups, kinds[key & 1]), key & 1)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """k1, k2, text: rows with equal keys have equal ids and texts, and get the same spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(doc_id).alias("k1"), F.xxhash64(t).alias("k2"), t.alias("text"))


def _of_kind(kinds: tuple[Kind, ...], field: str) -> Column:
    """That number of the kind of ``a``."""
    return F.get(F.array(*[F.lit(getattr(k, field)) for k in kinds]), F.col("a").bitwiseAND(1).cast("int"))


def crowded_spans(contexts: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Spans of the runs of crowded anchors: each window by its hash, without a suffix array."""
    before, window = F.col("before"), _of_kind(kinds, "window")
    contexts = contexts.withColumns({"w": _of_kind(kinds, "size"), "rest": window - _of_kind(kinds, "anchor")})
    part = F.concat(F.expr("substring(left, length(left) - w * before + 1, w * before)"), F.expr("substring(right, 1, w * (rest - before))"))
    steps = F.sequence(F.expr("greatest(0, rest - length(right) div w)").cast("int"), F.expr("least(length(left) div w, rest)").cast("int"))
    windows = contexts.withColumn("before", F.explode(steps)).select("a", "n", "k1", "k2", "place", "before", F.xxhash64("before", part).alias("h1"), F.xxhash64(F.lit("second"), part).alias("h2"))
    again = windows.groupBy("a", "h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("a").alias("wa"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    hit = windows.filter("n = 1").join(again, (F.col("a") == F.col("wa")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")))
    return hit.select(F.expr("cast(a & 1 as int)").alias("u"), "k1", "k2", (F.col("place") - before).alias("start"), (F.col("place") - before + window).alias("end"))


def repeated_spans(keys: DataFrame, kinds: tuple[Kind, ...], crowded: int = CROWDED) -> DataFrame:
    """u, k1, k2, start, end (units of the coded text): spans that cover the repeated windows of each document, by the
    place of their kind in ``kinds`` (two at most); they may overlap.

    ``keys``: from keyed().
    """
    least = min(k.window if k.unit == "bytes" else 2 * k.window - 1 for k in kinds)
    runs = keys.filter(F.octet_length("text") >= least).mapInArrow(functools.partial(_runs, kinds=kinds), "a long, c long, k1 long, k2 long, pos long")
    often = runs.groupBy("a").agg(F.count(F.lit(1)).alias("times"), (F.min("c") == F.max("c")).alias("same")).filter("times > 1").select(F.col("a").alias("oa"), "same")
    often = cut(often)  # so that the join has a shuffle on both sides, whose hot anchors Spark may split
    met = cut(runs.join(often, F.col("a") == F.col("oa")).drop("oa"))
    u, lo, size = F.expr("cast(a & 1 as int)"), F.expr("shiftright(pos, 24)"), F.expr("shiftright(pos, 12) & 4095")
    span = lambda df: df.select(u.alias("u"), "k1", "k2", lo.alias("start"), (lo + size - 1 + _of_kind(kinds, "window")).alias("end"))
    mixed = met.filter("not same")
    kinds_of = mixed.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one"))
    groups = kinds_of.groupBy(F.col("a").alias("ga")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("alone"))
    kinds_of = cut(kinds_of.join(groups, F.col("a") == F.col("ga")).drop("ga"))
    copied = kinds_of.filter("n > 1").select(F.col("a").alias("ca"), F.col("c").alias("cc"))
    copies = span(mixed.join(copied, (F.col("a") == F.col("ca")) & (F.col("c") == F.col("cc"))))
    # The runs of a stretch of a text: some 30,000 at most.
    asked = kinds_of.filter("alone > 0").groupBy(F.col("one.k1").alias("r1"), F.col("one.k2").alias("r2"), F.shiftright("one.pos", 24 + _STRETCH).alias("stretch")).agg(F.collect_list(F.struct("a", "c", "n", "m", "one.pos")).alias("runs"))
    fetched = keys.join(asked, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))).select("k1", "k2", "text", "runs")
    contexts = fetched.mapInArrow(functools.partial(_contexts, kinds=kinds), "a long, c long, n long, m long, k1 long, k2 long, place long, left binary, right binary")
    contexts = cut(contexts)
    sharded = contexts.filter(F.col("m") <= crowded).drop("m").repartition("a").sortWithinPartitions(F.expr("a & 1"), "a", "c")
    found = sharded.mapInArrow(functools.partial(_shards, kinds=kinds), "u int, k1 long, k2 long, start long, end long")
    rest = crowded_spans(contexts.filter(F.col("m") > crowded).dropDuplicates(["a", "c"]), kinds)
    return span(met.filter("same")).unionByName(copies).unionByName(found).unionByName(rest)


def _in_text(text: bytes, spans: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    """Spans of units as spans of the text's bytes.  A word goes with the space behind it."""
    if unit == "bytes" or not spans:
        return spans
    starts = np.append(word_starts(np.frombuffer(text, dtype=np.uint8)), len(text))
    return [tuple(x) for x in starts[np.array(spans)].tolist()]


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that ``spans`` cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[e for r in runs for e in r], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removed(batches: Iterable[pa.RecordBatch], as_text: bool, kinds: tuple[Kind, ...]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), _SPANS, pa.string() if as_text else pa.binary(), _SPANS, pa.string())[: 3 if len(kinds) == 1 else 5]
    for batch in batches:
        start, rows, size = 0, [], 0
        texts, spans = batch.column("_r_text"), batch.column("_r_spans")
        names = [c for c in batch.schema.names if c not in ("_r_text", "_r_spans")]
        for i in range(batch.num_rows):
            text = texts[i].as_py().encode()
            own: list[list[tuple[int, int]]] = [[] for _ in kinds]
            for x in spans[i].as_py() or ():
                own[x["u"]].append((x["start"], x["end"]))
            runs = [_merged(_in_text(text, _merged(s), k.unit)) for s, k in zip(own, kinds, strict=True)]
            listed = [[{"start": a, "end": b} for a, b in r] for r in runs]
            kept = _without(text, runs[0])
            row = (len(text), listed[0], kept.decode("utf-8", "ignore") if as_text else kept)
            if len(kinds) > 1:
                row += (listed[1], (_without(text, _merged(runs[0] + runs[1])) if runs[1] else kept).decode("utf-8", "ignore"))
            rows.append(row)
            size += len(kept)
            if size > 8 << 20 or i == batch.num_rows - 1:
                part = batch.slice(start, len(rows))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *[pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=[*names, "_r_bytes", "_r_runs", "_r_kept", "_r_passages", "_r_rest"][: len(names) + len(types)])
                start, rows, size = i + 1, [], 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, crowded: int = CROWDED, as_text: bool = False, unit: str = "bytes", passages: int = 0, passage_anchor: int = PASSAGE_ANCHOR) -> DataFrame:
    """The other columns of ``docs`` with n_bytes (long), removed (array of maximal runs: start, end) and kept (the
    remaining bytes, which may cut a character in two; ``as_text``: a string without characters that were cut).

    Each byte of a ``window``-byte string that begins anywhere else too, in any text, is removed; strings are judged on
    the input.  With ``unit`` "words", each word of ``window`` words that follow each other anywhere else too is removed
    with the space behind it (``removed`` counts bytes all the same).  ``anchor``: bytes, or quarters of words, of the
    part of a window by which windows meet.  Null texts count as empty, rows that repeat another (id and text) count each, so a repeated row's text
    goes if it has a window; an empty table gives an empty result; input columns named as the added ones are replaced, and
    ``_r_*`` names are used here.

    With ``passages``, a number of words, windows of so many words are looked for in the same go, also judged on the
    input, with two more columns: passages (their maximal runs, in bytes) and rest (a string: the text without these and
    without ``removed``).
    """
    docs = docs.drop("n_bytes", "removed", "kept", *(("passages", "rest") if passages else ()))
    keys, kinds = keyed(docs, doc_id, text), (Kind(unit, window, anchor // UNITS[unit]),)
    if passages:
        kinds += (Kind("words", passages, passage_anchor // UNITS["words"]),)
    spans = repeated_spans(keys, kinds, crowded).groupBy(F.col("k1").alias("_r_s1"), F.col("k2").alias("_r_s2")).agg(F.collect_list(F.struct("u", "start", "end")).alias("_r_spans"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"_r_1": F.xxhash64(doc_id), "_r_2": F.xxhash64(t), "_r_text": t}).drop(text)
    joined = rows.join(spans, (F.col("_r_1") == F.col("_r_s1")) & (F.col("_r_2") == F.col("_r_s2")), "left").drop("_r_1", "_r_2", "_r_s1", "_r_s2")
    others = [f for f in joined.schema.fields if f.name not in ("_r_text", "_r_spans")]
    places = "array<struct<start:long,end:long>>"
    made = [f"_r_bytes long, _r_runs {places}, _r_kept " + ("string" if as_text else "binary")] + [f"_r_passages {places}, _r_rest string"] * bool(passages)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + made)
    out = joined.mapInArrow(functools.partial(_removed, as_text=as_text, kinds=kinds), schema).withColumnsRenamed({"_r_bytes": "n_bytes", "_r_runs": "removed", "_r_kept": "kept"})
    return out.withColumnsRenamed({"_r_passages": "passages", "_r_rest": "rest"}) if passages else out


def without_repeats(docs: DataFrame, words: int = PASSAGE_WORDS, anchor: int = PASSAGE_ANCHOR) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and any other columns) without each text's passages of ``words`` and more words that
    occur elsewhere too; n_chars is counted anew.

    Null texts stay null; a text of nothing but repeats is empty.
    """
    inner = docs.withColumnsRenamed({c: f"_r_in_{c}" for c in docs.columns if c not in ("doc_id", "text")}).withColumn("_r_null", F.col("text").isNull())
    out = remove_repeats(inner, window=words, anchor=anchor, as_text=True, unit="words").withColumn("text", F.when(~F.col("_r_null"), F.col("kept")))
    counted = F.length("text").cast("long").alias("n_chars")
    return out.select(*[F.col(c) if c in ("doc_id", "text") else counted if c == "n_chars" else F.col(f"_r_in_{c}").alias(c) for c in docs.columns])
