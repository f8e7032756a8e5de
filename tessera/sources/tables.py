"""The driver's tables seen as the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus records: doc_id as text, the text under one of several names, a page for some."""
    docs = table(spark, sf_dir, "documents")
    kind = F.pmod("doc_id", F.lit(4))
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.when(kind == 0, F.col("text")).when(kind == 1, F.lit(" \n\t ")).alias("markdown"),
        F.when(kind == 1, F.col("text")).when(kind == 2, F.lit("")).alias("text"),
        F.when(kind == 2, F.col("text")).alias("content"),
        F.when((kind == 3) & (F.pmod("doc_id", F.lit(8)) == 3), F.col("text")).alias("query"),
        F.when((kind == 3) & (F.pmod("doc_id", F.lit(8)) == 7), F.col("text")).alias("answer"),
        F.when(kind == 3, F.lit("")).when(kind == 2, F.col("source")).alias("source"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.pmod("doc_id", F.lit(11))).alias("page"),
        F.col("lang").alias("split"),
        "n_chars",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: labels 0 to 2 stand for images."""
    return table(spark, sf_dir, "embeddings").select(F.format_string("v%d", "vec_id").alias("chunk_id"), F.when(F.col("label") < 3, "image").otherwise("text").alias("modality"), "embedding")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches' queries: every embedding whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as prompt segments: the assistant's turns are what was retrieved."""
    retrieved = F.when(F.pmod("turn", F.lit(3)) == 0, "retrieved_visual").otherwise("retrieved_text")
    role = F.when(F.col("role") == "assistant", retrieved).otherwise(F.col("role"))
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_index"), role.alias("role"), F.when(role == "retrieved_visual", "image").otherwise("text").alias("modality"), F.when(F.col("role") == "assistant", F.format_string("conv%d", "conv_id")).otherwise(F.col("role")).alias("source"), F.col("text"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a conversation: its first user text, an image path for some, and its chunks.

    A request's chunks are the turns of one conversation, so the array is as long as a prompt.
    """
    conv = table(spark, sf_dir, "conversations")
    image = F.pmod("turn", F.lit(3)) == 0
    chunk = F.struct(
        F.when(F.pmod("turn", F.lit(5)) == 1, F.lit(None)).otherwise(F.col("turn")).cast("int").alias("retrieval_rank"),
        F.format_string("c%d-%d", "conv_id", "turn").alias("chunk_id"),
        F.when(image, "image").otherwise("text").alias("modality"),
        F.format_string("conv%d", "conv_id").alias("source"),
        F.when(image, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(image & (F.col("turn") > 0), F.format_string("img/%d.png", "turn")).alias("image_path"),
    )
    grouped = conv.groupBy("conv_id").agg(
        F.min_by(F.col("text"), F.when(F.col("role") == "user", F.col("turn"))).alias("query"),
        F.collect_list(F.when(F.col("role") == "assistant", chunk)).alias("chunks"),
    )
    path = F.when(F.pmod("conv_id", F.lit(3)) == 0, "").when(F.pmod("conv_id", F.lit(3)) == 2, F.format_string("req/%d.png", "conv_id"))
    return grouped.select(F.col("conv_id").alias("request_id"), F.coalesce("query", F.lit("")).alias("query"), path.alias("image_path"), "chunks")


def trace(spark: SparkSession, sf_dir: str, caches: int = 16) -> DataFrame:
    """Events as block accesses in order of seq, (ts, event_id); a cache for each share of the users.

    seq is the time in microseconds with the lowest bits of the id behind it, which orders events of
    the same microsecond; ids differ by less than 2**10 there.
    """
    events = table(spark, sf_dir, "events")
    modality = F.when(F.col("event_type").isin("view", "click"), "visual").otherwise("text")
    seq = F.unix_micros(F.col("ts").cast("timestamp")) * 1024 + F.pmod("event_id", F.lit(1024))
    block = F.substring(F.sha2(F.concat(modality, F.lit(":"), F.col("user_id").cast("string")), 256), 1, 32)
    return events.select(F.pmod("user_id", F.lit(caches)).alias("cache_id"), seq.alias("seq"), "ts", "event_id", modality.alias("modality"), block.alias("block_id"), "user_id", "event_type", "value")


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as benchmark rows: two variants, hits and misses by event type."""
    events = table(spark, sf_dir, "events")
    one = lambda *kinds: F.col("event_type").isin(*kinds).cast("long")
    return events.select(
        F.when(F.pmod("user_id", F.lit(2)) == 0, "baseline").otherwise("eviction_only").alias("variant"),
        F.col("event_id").alias("query_id"),
        F.col("value").alias("ttft_ms"),
        (F.col("value") * 1.25).alias("total_latency_ms"),
        one("purchase", "signup").alias("cache_hits_text"),
        one("error").alias("cache_misses_text"),
        one("view").alias("cache_hits_visual"),
        one("click").alias("cache_misses_visual"),
        F.greatest(F.col("value"), F.col("user_id").cast("double")).alias("gpu_memory_mib"),
    )
