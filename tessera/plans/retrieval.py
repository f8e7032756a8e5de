"""Queries over retrieval: exact top-k, the two stacks' rules, late payloads, mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.vector import hash_embedding, l2_normalize, norm, term_embedding
from tessera.operators import retrieval as R
from tessera.session import table
from tessera.sources import tables as S

TERMS = ["the", "que", "er"]


def _asked(spark, sf_dir: str, search) -> DataFrame:
    """What search(chunks, queries) finds for all queries."""
    return search(S.chunks(spark, sf_dir), S.search_queries(spark, sf_dir))


def _top(spark, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, lambda chunks, queries: R.dense_topk(chunks, queries, 10))


def dense_topk(spark, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def topk_payload_join(spark, sf_dir: str) -> DataFrame:
    """Payloads join after the cut, so only k rows a query are shuffled with them."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("v%d", "doc_id").alias("chunk_id"), "lang", "n_chars")
    return _top(spark, sf_dir).join(docs, "chunk_id").select("query_id", "chunk_id", "lang", "n_chars", F.round("score", 6).alias("score"))


def retrieve_a(spark, sf_dir: str) -> DataFrame:
    found = _asked(spark, sf_dir, lambda chunks, queries: R.retrieve_a(chunks, queries, 3))
    return found.select("query_id", "chunk_id", "modality", F.round("score", 6).alias("score"), F.col("retrieval_rank").cast("long").alias("retrieval_rank"))


def _stack_b(spark, sf_dir: str, force: bool) -> DataFrame:
    k, boost = (3, 0.25) if force else (5, 1.2)
    return _asked(spark, sf_dir, lambda chunks, queries: R.retrieve_b(chunks, queries, k, boost, force))


def retrieve_b(spark, sf_dir: str) -> DataFrame:
    return _stack_b(spark, sf_dir, False).select("query_id", "chunk_id", "modality", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def retrieve_force_visual(spark, sf_dir: str) -> DataFrame:
    return _stack_b(spark, sf_dir, True).select("query_id", "chunk_id", "modality", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def retrieval_mix(spark, sf_dir: str) -> DataFrame:
    visual = F.count_if(F.col("modality") == "image")
    return _stack_b(spark, sf_dir, False).groupBy("query_id").agg(visual.alias("visual_count"), (F.count("*") - visual).alias("text_count"))


def effective_topk(spark, sf_dir: str) -> DataFrame:
    asked = F.when(F.pmod("item_id", F.lit(3)) != 0, F.pmod("item_id", F.lit(8)) - 1)
    return table(spark, sf_dir, "benchmark").select("item_id", X.effective_top_k(asked, 5).cast("long").alias("k"))


def l2_normalized(spark, sf_dir: str) -> DataFrame:
    unit = l2_normalize("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm("embedding"), 6).alias("norm"), F.round(norm(unit), 6).alias("unit_norm"), F.round(unit[0], 6).alias("first"))


def term_embeddings(spark, sf_dir: str) -> DataFrame:
    v = term_embedding("text", TERMS)
    return table(spark, sf_dir, "documents").select("doc_id", *(v[k].alias(f"n_{t}") for k, t in enumerate(TERMS)))


def hash_embeddings(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", hash_embedding("text").alias("vector"))


_SCORES = """
u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, 'v' || c.vec_id AS chunk_id, CASE WHEN c.label < 3 THEN 'image' ELSE 'text' END AS modality, list_dot_product(c.e, q.e) AS score
  FROM u c, u q WHERE q.vec_id % 100 = 0)"""
_POOL_B = """,
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS f FROM s QUALIFY f <= 3 * {k}),
b AS (SELECT query_id, chunk_id, modality, CASE WHEN modality = 'image' THEN score * {boost} ELSE score END AS score, f FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS rank FROM b)"""

QUERIES = {
    "dense_topk": dense_topk,
    "topk_payload_join": topk_payload_join,
    "retrieve_a": retrieve_a,
    "retrieve_b": retrieve_b,
    "retrieve_force_visual": retrieve_force_visual,
    "retrieval_mix": retrieval_mix,
    "effective_topk": effective_topk,
    "l2_normalize": l2_normalized,
    "term_embedding": term_embeddings,
    "hash_embedding": hash_embeddings,
}
ORACLES = {
    "dense_topk": "WITH" + _SCORES + " SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10",
    "topk_payload_join": "WITH" + _SCORES + ", k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10) SELECT query_id, chunk_id, lang, n_chars, round(score, 6) AS score FROM k JOIN documents d ON chunk_id = 'v' || d.doc_id",
    "retrieve_a": "WITH" + _SCORES + ", c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, chunk_id) <= 12) SELECT query_id, chunk_id, modality, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY c.score DESC, chunk_id, modality) AS retrieval_rank FROM c",
    "retrieve_b": "WITH" + _SCORES + _POOL_B.format(k=5, boost=1.2) + " SELECT query_id, chunk_id, modality, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    "retrieve_force_visual": "WITH" + _SCORES + _POOL_B.format(k=3, boost=0.25) + """,
j AS (SELECT *, max(CASE WHEN modality = 'image' AND rank <= 3 THEN 1 ELSE 0 END) OVER w AS has, min(CASE WHEN modality = 'image' THEN rank END) OVER w AS best FROM r WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, modality, round(score, 6) AS score, CASE WHEN has = 0 AND rank = best THEN 3 ELSE rank END AS rank FROM j
WHERE CASE WHEN has = 0 AND best IS NOT NULL THEN rank < 3 OR rank = best ELSE rank <= 3 END""",
    "retrieval_mix": "WITH" + _SCORES + _POOL_B.format(k=5, boost=1.2) + " SELECT query_id, count(*) FILTER (WHERE modality = 'image') AS visual_count, count(*) FILTER (WHERE modality <> 'image') AS text_count FROM r WHERE rank <= 5 GROUP BY query_id",
    "effective_topk": "SELECT item_id, greatest(1, coalesce(nullif(CASE WHEN item_id % 3 <> 0 THEN item_id % 8 - 1 END, 0), 5)) AS k FROM benchmark",
    "l2_normalize": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS unit_norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6) AS first FROM embeddings",
    "term_embedding": "SELECT doc_id, " + ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})::BIGINT AS n_{t}" for t in TERMS) + " FROM documents",
}
