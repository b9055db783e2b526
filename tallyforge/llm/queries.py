"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, licenses, mixing, packing, quality, repeats, shuffled, simhash, tokens, toxicity, transport, urls, whitening
from .common import cut, spread, table, word_count

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: The block list of the query: hosts of known junk, each with all its pages, and whole URLs (see listed_urls).
JUNK_HOSTS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [(f"{name}.example.{top}", "", "block") for name in JUNK_HOSTS for top in ("com", "net", "org")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.score_documents(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def document_path() -> Column:
    """Documents have no paths; the query lays them out: source / language / 64 documents / 8 documents.  The first of
    64 is the LICENSE of the outer directory, the first of 8 that of the inner one."""
    outer, inner = F.expr("cast(doc_id div 64 as string)"), F.expr("cast(doc_id div 8 as string)")
    name = F.when(F.expr("doc_id % 64 = 0"), F.concat_ws("/", outer, F.lit("LICENSE"))).when(F.expr("doc_id % 8 = 0"), F.concat_ws("/", outer, inner, F.lit("LICENSE")))
    return F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(name, F.concat_ws("/", outer, inner, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spread(table(spark, sf_dir, "documents")).select("doc_id", document_path().alias("path"), "text")
    return licenses.scan_licences(files).select("doc_id", "path", "license", "score", "license_from")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The whole URLs of the query's block list: those of ``pages`` whose MD5 ends in 0, one of 16, as another list would
    write them (host in capitals and with a port, a '/' behind the path, a tracking parameter)."""
    host, path = urls.host_path(F.col("url"))
    asked = F.concat_ws("&", F.nullif(F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1), F.lit("")), F.lit("utm_source=list"))
    rows = pages.filter(F.md5("url").endswith("0")).select(host.alias("host"), F.concat(path, F.lit("/?"), asked).alias("path")).filter("host <> ''")
    return rows.select(F.concat(F.upper("host"), F.when(F.col("host").contains(":"), "").otherwise(":80")).alias("host"), "path", F.lit("block").alias("verdict")).distinct()


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, pages = "host string, path string, verdict string", table(spark, sf_dir, "pages").select("page_id", "url")
    listed = cut(spark.createDataFrame(LISTED, schema).unionByName(listed_urls(pages)))
    df = urls.judge_urls(pages, spark.createDataFrame(RULES, schema), listed)
    return df.select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), tokenizer_path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    df = mixing.mix(docs, "size")
    return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(spread(table(spark, sf_dir, "documents")), tokenizer_path("piece_bpe_32k.model"))


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), transport.padded(F.col("text")).alias("payload"))
    df = transport.read_streams(transport.store_streams(docs, "payload"))
    points = F.filter("units", lambda u: u["random_access"])
    feature = F.format_string(
        "ts:packets=%d;units=%d;points=%d;first=%d;last=%d;errors=%d",
        "n_packets", F.size("units"), F.size(points), F.element_at("units", 1)["pts"], F.element_at("units", -1)["pts"], F.col("cc_errors") + F.col("lost_sync"),
    )
    return df.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    fold = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(3))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(fold("doc_id") != 1)))
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the strings of 400 bytes, passages of over 50 words (many are shorter than that): rest is without both."""
    df = repeats.remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), passages=repeats.PASSAGE_WORDS)
    return df.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("passage_bytes"),
        "rest",
    )


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return balls.cluster_vectors(vectors).withColumnRenamed("id", "vec_id")


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: counts differ by one at most, whatever texts are equal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    df = shuffled.shard_rows(cut(docs), "doc_id", 40)
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return whitening.whiten(vectors).withColumnRenamed("id", "vec_id")


ALL = (op1_quality_rules, op2_license_scan, op3_url_filter, op4_packing, op5_source_mixing, op6_token_counts, op7_transport_streams, op8_simhash_golay, op9_toxicity, op10_suffix_dedup, op11_ball_clusters, op12_feistel_shards, op13_whitened_embeddings)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from .sql import oracle

    return oracle()
