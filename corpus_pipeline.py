"""From documents to packed training sequences: quality rules, near-duplicates, repeats, mixing, packing.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as Parquet and read again as the next one's
docs, so a lost executor repeats parts of one stage at most.  All but the last return the columns of documents; rows
of documents repeat from the mixing stage on.  Extra columns of documents, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import mixing, packing, quality, repeats, shingles
from tallyforge.llm.common import spread, stored, table, word_count
from tallyforge.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their source's limits go."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: linked fingerprints (op8), and a five-word similarity of 0.8 and more."""
    return shingles.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur elsewhere too are cut out; the rest of each document stays."""
    return repeats.without_repeats(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    own = [c for c in docs.columns if c not in ("doc_id", "source")]
    inner = docs.withColumn("_words", word_count(F.col("text"))).withColumnsRenamed({c: f"_in_{k}" for k, c in enumerate(own)})
    mixed = mixing.mix(inner, "_words").filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return mixed.select(*[F.col(f"_in_{own.index(c)}").alias(c) if c in own else c for c in docs.columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source weights", source_weights),
    ("packing", packed_sequences),
]

#: Fingerprints, suffix arrays and tokenizers are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Tables between stages lie in the shared checkpoint folder."""
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
