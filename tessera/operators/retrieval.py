"""Retrieval: exact top-k by cosine similarity under the two stacks' rules.

chunks: chunk_id, modality, embedding; queries: query_id, embedding, a table of any number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vector_index import VectorIndex


def top_scores(chunks: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Rows (query_id, chunk_id, modality, score) that hold each query's k best of all chunks, or of each value of ``by``."""
    return VectorIndex.build(chunks, by).search(queries, k).drop("group_")


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query's k best chunks; ties by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return top_scores(chunks, queries, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve_a(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """4k candidates of each modality, merged and ranked by (-score, chunk_id, modality), not cut to k."""
    pool = 4 * max(1, k)
    per = Window.partitionBy("query_id", "modality").orderBy(F.desc("score"), "chunk_id")
    cut_ = top_scores(chunks, queries, pool, by="modality").withColumn("place_", F.row_number().over(per)).where(F.col("place_") <= pool)
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "modality")
    return cut_.withColumn("retrieval_rank", F.row_number().over(merged)).drop("place_")


def retrieve_b(chunks: DataFrame, queries: DataFrame, k: int, boost: float, force_visual: bool = False) -> DataFrame:
    """3k candidates by plain score; visual scores boosted; the first k by boosted score.

    With force_visual the last of the k becomes the best visual candidate if there is none among
    them, whatever its score.
    """
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    pool = top_scores(chunks, queries, 3 * k).withColumn("first_", F.row_number().over(first)).where(F.col("first_") <= 3 * k)
    pool = pool.withColumn("score", F.when(F.col("modality") == "image", F.col("score") * boost).otherwise(F.col("score")))
    second = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_")
    ranked = pool.withColumn("rank", F.row_number().over(second))
    if not force_visual:
        return ranked.where(F.col("rank") <= k).drop("first_")
    everyone = Window.partitionBy("query_id")
    visual = F.col("modality") == "image"
    judged = ranked.withColumns({"has_": F.max((visual & (F.col("rank") <= k)).cast("int")).over(everyone), "best_": F.min(F.when(visual, F.col("rank"))).over(everyone), "size_": F.least(F.max("rank").over(everyone), F.lit(k))})
    swap = (F.col("has_") == 0) & F.col("best_").isNotNull()
    kept = judged.where(F.when(swap, (F.col("rank") < F.col("size_")) | (F.col("rank") == F.col("best_"))).otherwise(F.col("rank") <= k))
    return kept.withColumn("rank", F.when(swap & (F.col("rank") == F.col("best_")), F.col("size_")).otherwise(F.col("rank"))).drop("first_", "has_", "best_", "size_")
