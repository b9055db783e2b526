"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the different hashes of its words, word pairs, and pairs with one word between (presence, not
counts, so that a long text weighs as a short one).  Labelled rows are dealt to a few shards; each learns by FTRL with
per-coordinate rates and L1, whose weights are mostly zero, and the shards' weights are averaged.  What is left fits
into one small broadcast, with which all texts are scored in a single pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash space; the dense form of the broadcast weights has 4 bytes for each.
BITS = 20
ALPHA, BETA, L1, L2 = 1.5, 1.0, 32.0, 1.0
EPOCHS = 6
#: A toxic row counts so many times in learning.
TOXIC_WEIGHT = 8.0
#: Slots that fewer rows of a shard have are left out: they say nothing about other texts.
MIN_ROWS = 2
#: The fit takes so many shards of so many labelled rows at most.
SHARD_ROWS = 4_000
MAX_SHARDS = 4
THRESHOLD = 0.7
CACHE_SIZE = 400_000
CACHE_CHARS = 100

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACES = str.maketrans(dict.fromkeys("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", " "))
_words: dict[str, int] = {}


def _ids(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in lower case and without ASCII punctuation around or inside (it separates words)."""
    words = text.lower().translate(_SPACES).split()
    found = list(map(_words.get, words))
    if None in found:
        if len(_words) > CACHE_SIZE:
            _words.clear()
        for k, n in enumerate(found):
            if n is None:
                w = words[k]
                found[k] = n = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                if len(w) <= CACHE_CHARS:
                    _words[w] = n
    return np.array(found, dtype=np.uint64)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Hash slots of the text's words, pairs and skip-pairs; may repeat."""
    w = _ids(text)
    with np.errstate(over="ignore"):
        odd = w * _SKIP
        parts = [w, (w[:-1] * _PAIR) ^ odd[1:], ((w[:-2] ^ _SKIP) * _PAIR) ^ odd[2:]]
        h = np.concatenate(parts)
        h ^= h >> np.uint64(29)
        h *= _PAIR
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def learn(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (different slots, label) rows; the last weight is the bias, which has no L1."""
    n_slots = (1 << bits) + 1
    common = np.bincount(np.concatenate([f for f, _ in rows] or [np.zeros(0, dtype=np.int64)]), minlength=1 << bits) >= MIN_ROWS
    rows = [(f[common[f]], label) for f, label in rows]
    z, n = np.zeros(n_slots), np.zeros(n_slots)
    l1 = np.full(n_slots, L1)
    l1[-1] = 0.0

    def weights(slots: np.ndarray) -> np.ndarray:
        s = z[slots]
        return np.where(np.abs(s) <= l1[slots], 0.0, (np.sign(s) * l1[slots] - s) / ((BETA + np.sqrt(n[slots])) / ALPHA + L2))

    for _ in range(epochs):
        for slots, label in rows:
            slots = np.append(slots, n_slots - 1)
            w = weights(slots)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - label) * (TOXIC_WEIGHT if label else 1.0)
            rate = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - rate * w
            n[slots] += g * g
    return weights(np.arange(n_slots))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = BITS) -> DataFrame:
    """slot, weight of the averaged model, without zeros; slot 2**bits is the bias.

    ``labels``: doc_id and label of the rows to learn from, of which those with the smallest hashes of their ids are
    taken, MAX_SHARDS * SHARD_ROWS at most; their ids are so few that they are sent to the texts, of which only these
    are shuffled.  Null ids and labels are left out, null texts count as empty.  Rows are learned in order of their ids'
    hashes, so reruns agree.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"), F.xxhash64(doc_id).alias("order"))
    marked = marked.orderBy("order", "id", "label").limit(MAX_SHARDS * SHARD_ROWS)
    shards = max(1, min(MAX_SHARDS, marked.count() // SHARD_ROWS))
    marked = marked.withColumn("shard", F.pmod(F.shiftright("order", 8), F.lit(shards)).cast("int"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marked), F.col("doc_id") == F.col("id"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "doc_id", "text"])
        w = learn([(np.unique(features(t or "", bits)), int(y)) for t, y in zip(frame["text"], frame["label"], strict=True)], bits)
        slots = np.flatnonzero(w)
        return pd.DataFrame({"slot": slots, "weight": w[slots]})

    learned = rows.repartition(shards, "shard").groupBy("shard").applyInPandas(one, "slot long, weight double")
    return learned.groupBy("slot").agg((F.sum("weight") / F.lit(shards)).alias("weight")).filter("weight != 0")


def score(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row; one pass, no shuffle.  Null and empty texts get the bias alone;
    repeated rows repeat; an empty table gives an empty result; other columns are not read.  The model has 2**bits
    weights at most."""
    rows = model.toArrow()
    weights = np.zeros((1 << bits) + 1, dtype=np.float32)
    weights[rows["slot"].to_numpy()] = rows["weight"].to_numpy()
    slots = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((slots, weights[slots]))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1, dtype=np.float64)
        dense[shared.value[0]] = shared.value[1]
        used = dense != 0
        for batch in batches:
            column, out = batch.column(1), np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                slots = features(column[i].as_py() or "", bits)
                out[i] = dense[np.unique(slots[used[slots]])].sum() + dense[-1]
            p = 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[doc_id, "score", "predicted"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double, predicted int")
