"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  If two fingerprints differ in two bits at most,
then either A is free of errors (and B has two at most), or B is (and C has one at most), or C is (and A and B have
one each).  So one of three families finds them: exact A with fuzzy B, exact B with fuzzy C, exact C with fuzzy A.
The fuzzy key is an index of a codeword of the perfect binary Golay code (23,12,7): a segment and each of its one-bit
neighbours are decoded to their nearest codewords, one or six different ones; two segments that differ in two bits have
a neighbour in common, so they share an index.  Keys are joined and every candidate pair is verified.

A key's candidates are compared in pairs while they are few.  Fingerprints under a crowded key are linked another way
that is exact too: two of them differ in two bits at most just when some value lies within one bit of both; so each
is dealt to its 65 such values, none of which has more than 65 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

SHINGLE = 3
SEED = 42
SEGMENTS = (22, 21, 21)
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR = 0xC75
#: A key with more different fingerprints is crowded.
PAIRED = 16

_tables: dict = {}


def golay_index() -> np.ndarray:
    """For each 23-bit value the index of its nearest codeword."""
    if "index" not in _tables:
        words = np.arange(4096, dtype=np.int64)
        code = np.zeros(4096, dtype=np.int64)
        for i in range(12):
            code ^= np.where(words >> i & 1, GENERATOR << i, 0)
        bits = [1 << i for i in range(23)]
        errors = np.array([0, *bits, *[a | b for i, a in enumerate(bits) for b in bits[:i]], *[a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]], dtype=np.int64)
        index = np.empty(1 << 23, dtype=np.int16)
        for e in errors:
            index[code ^ e] = words
        _tables["index"] = index
    return _tables["index"]


def fuzzy_keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the different codeword indices of each segment and its one-bit neighbours."""
    near = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(golay_index()[segment[:, None] ^ near[None, :]], axis=1)
    new = np.concatenate([np.ones((len(found), 1), dtype=bool), found[:, 1:] != found[:, :-1]], axis=1)
    rows, columns = np.nonzero(new)
    return rows, found[rows, columns].astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority over the XXH64 values of all word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[: -shingle] + 1).tolist()]
        hash64 = xxhash.xxh64_intdigest
        hashes = [hash64(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long: the 64 bits) of every row.  Null texts count as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            bits = np.array([fingerprint(column[i].as_py() or "", shingle) for i in range(batch.num_rows)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, c = SEGMENTS
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            seg = [fp & ((1 << a) - 1), (fp >> a) & ((1 << b) - 1), (fp >> (a + b)) & ((1 << c) - 1)]
            keys, rows = [], []
            for family in range(3):
                other = (family + 1) % 3
                row, index = fuzzy_keys(seg[other], SEGMENTS[other])
                keys.append(np.int64(family) << 40 | seg[family][row] << 12 | index)
                rows.append(fp[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows))], names=["key", "fp"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key: verified pairs (a, b) of a key's first fingerprints; a row (fp, null) for each
    fingerprint of a crowded key.  Holds PAIRED fingerprints at most."""
    key, held, crowded = None, [], False
    for batch in batches:
        out: list[tuple] = []
        for k, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                key, held, crowded = k, [], False
            if not crowded and len(held) == PAIRED:
                crowded = True
                out += [(x, None) for x in held]
            if crowded:
                out.append((fp, None))
                continue
            out += [(x, fp) for x in held if ((x ^ fp) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2]
            held.append(fp)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """a, b: edges whose components are those of all pairs of different fingerprints (``fp``) at two bits or fewer."""
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    found = cut(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_pairs, "a long, b long"))
    near: list[Column] = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {i})")) for i in range(64)]]
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct().withColumn("near", F.explode(F.array(*near)))
    stars = crowded.groupBy("near").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
    return found.filter("b is not null").unionByName(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of every row.

    Equal fingerprints are linked, also those of texts without words.  Null texts count as empty ones, a null id is
    never the smallest (null if there is no other), rows that repeat an id are kept, an empty table gives an empty
    result and other columns are not read.  Fingerprints are computed for whole texts, one row at a time.
    """
    own = cut(fingerprints(docs, doc_id, text, shingle))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return own.join(classes, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
