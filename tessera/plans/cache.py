"""Queries over the block cache and token pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import pruning as G
from tessera.operators import tiered_cache as K
from tessera.operators.ranking import last_wins
from tessera.operators.stack_distance import lru_hits
from tessera.session import table
from tessera.sources import tables as S

CACHES, CAPACITY = 16, 4
GPU, CPU = 4, 6


def lru_stack_distance(spark, sf_dir: str) -> DataFrame:
    return lru_hits(S.trace(spark, sf_dir, CACHES), CAPACITY)


def cache_trace(spark, sf_dir: str) -> DataFrame:
    return K.replay(S.trace(spark, sf_dir, CACHES), GPU, CPU)


def cache_trace_plain_lru(spark, sf_dir: str) -> DataFrame:
    return K.replay(S.trace(spark, sf_dir, CACHES), GPU, CPU, policy="lru")


def cache_metrics(spark, sf_dir: str) -> DataFrame:
    """Labelled counters: hits and evictions by tier and modality, misses of all; the replay is read once."""
    said = lambda metric, tier, modality: F.struct(metric.alias("metric"), tier.alias("tier"), modality.alias("modality"))
    miss = F.col("outcome") == "miss"
    looked = F.when(miss, said(F.lit("misses"), F.lit("all"), F.lit("unknown"))).otherwise(said(F.lit("hits"), F.col("outcome"), F.col("modality")))
    evicted = F.transform("evictions", lambda e: said(F.lit("evictions"), e["tier"], e["modality"]))
    counters = cache_trace(spark, sf_dir).select(F.inline(F.concat(F.array(looked), evicted)))
    return counters.groupBy("metric", "tier", "modality").count()


def tier_distribution(spark, sf_dir: str) -> DataFrame:
    share = lambda tier: (100.0 * F.count_if(F.col("outcome") == tier) / F.count("*")).alias(f"{tier}_pct")
    return cache_trace(spark, sf_dir).groupBy("modality").agg(*(share(t) for t in ("gpu", "cpu", "ssd", "miss")))


def request_hits(spark, sf_dir: str) -> DataFrame:
    """Hits and misses by modality for each request, here an hour of a cache, looked up as a whole; all but text is visual."""
    hour = F.floor(F.col("seq") / (1024 * 3_600_000_000))
    trace = K.replay(S.trace(spark, sf_dir, CACHES).withColumn("request_id", hour), GPU, CPU)
    hit, text = F.col("outcome") != "miss", F.col("modality") == "text"
    return trace.groupBy("cache_id", hour.alias("hour")).agg(F.count_if(hit & text).alias("hits_text"), F.count_if(hit & ~text).alias("hits_visual"), F.count_if(~hit & text).alias("misses_text"), F.count_if(~hit & ~text).alias("misses_visual"))


def hit_by_modality(spark, sf_dir: str) -> DataFrame:
    """Accesses that find their block in an unbounded cache, by modality: all but a block's first."""
    per = S.trace(spark, sf_dir, CACHES).groupBy("cache_id", "block_id", "modality").agg(F.count("*").alias("n"))
    return per.groupBy("modality").agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"))


def block_dedup(spark, sf_dir: str) -> DataFrame:
    rows = S.trace(spark, sf_dir, CACHES).select("block_id", "seq", "event_id", "event_type")
    return last_wins(rows, ["block_id"], F.struct("seq", "event_id")).select("block_id", "event_id", "event_type")


def _tiers(spark, sf_dir: str) -> DataFrame:
    """A snapshot: where each block is, by how often it was used."""
    used = S.trace(spark, sf_dir, CACHES).groupBy("block_id").agg(F.count("*").alias("n"))
    return used


def tier_lookup(spark, sf_dir: str) -> DataFrame:
    """Each block in the first tier that has it; tiers overlap."""
    used = _tiers(spark, sf_dir)
    tiers = {"gpu": used.where("n >= 50"), "cpu": used.where("n between 30 and 60"), "ssd": used.where("n < 40")}
    out = used.select("block_id")
    for name, held in tiers.items():
        out = out.join(held.select("block_id", F.lit(name).alias(name)), "block_id", "left")
    return out.select("block_id", F.coalesce("gpu", "cpu", "ssd", F.lit("miss")).alias("tier"))


def cache_hits_semi(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "n_chars")


def cache_misses_anti(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "n_chars")


def block_usage(spark, sf_dir: str) -> DataFrame:
    """Bytes of the blocks built from each source's texts."""
    size = F.greatest(F.lit(1), X.token_count("text")) * 256
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(size).alias("bytes"), F.count("*").alias("blocks"))


def center_crop_mask(spark, sf_dir: str) -> DataFrame:
    sides = spark.createDataFrame([(4,), (8,), (11,), (24,)], "side int")
    return G.crop_mask(sides, 0.3).select(*(F.col(c).cast("long").alias(c) for c in ("side", "patch_row", "patch_col")), "kept")


def prune_tokens(spark, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), X.token_count("text").cast("int")).alias("n"))
    pruned = G.prune_ids(sized.withColumn("ids", F.sequence(F.lit(0), F.col("n") - 1)), "ids", 0.3)
    return pruned.select("doc_id", F.col("n").cast("long").alias("num_tokens"), F.size("kept_ids").cast("long").alias("kept"), F.md5(X.ids_text(F.col("kept_ids"))).alias("ids_md5"))


def mask_combine(spark, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 masks of their label's image; patches of 2 x 2 pixels."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image"), F.col("vec_id").alias("mask"), (F.pmod("vec_id", F.lit(10)) / 10.0).alias("iou"), F.posexplode("embedding").alias("pixel", "v"))
    pixels = vectors.select("image", "mask", "pixel", (F.col("v") > 0.1).alias("inside"), "iou")
    patch = (F.floor(F.col("pixel") / 16) * 4 + F.floor(F.pmod("pixel", F.lit(8)) / 2)).cast("long")
    return G.patch_mask(G.combine_masks(pixels), patch, 0.85).select("image", "patch", F.round("mean", 6).alias("mean"), "kept")


_TRACE = """t AS (SELECT user_id % 16 AS cache_id, substr(sha256(m || ':' || user_id), 1, 32) AS block_id, m AS modality, ts, event_id, event_type, epoch_us(ts) * 1024 + event_id % 1024 AS seq
 FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'visual' ELSE 'text' END AS m FROM events))"""
_CROP = "sqrt((r - side / 2.0) ** 2 + (c - side / 2.0) ** 2) / sqrt(2 * (side / 2.0) ** 2) <= 1.0 - 0.3"

QUERIES = {
    f.__name__: f
    for f in (lru_stack_distance, cache_trace, cache_trace_plain_lru, cache_metrics, tier_distribution, request_hits, hit_by_modality, block_dedup, tier_lookup, cache_hits_semi, cache_misses_anti, block_usage, center_crop_mask, prune_tokens, mask_combine)
}
ORACLES = {
    "lru_stack_distance": f"""WITH {_TRACE}, n AS (SELECT cache_id, block_id, row_number() OVER (PARTITION BY cache_id ORDER BY seq) AS i FROM t),
 p AS (SELECT *, lag(i) OVER w AS prev, lead(i) OVER w AS next FROM n WINDOW w AS (PARTITION BY cache_id, block_id ORDER BY i)),
 d AS (SELECT a.cache_id, a.i, count(x.i) AS distance FROM p a LEFT JOIN p x ON x.cache_id = a.cache_id AND x.i > a.prev AND x.i < a.i AND (x.next IS NULL OR x.next > a.i) WHERE a.prev IS NOT NULL GROUP BY ALL)
SELECT cache_id, count(*) AS accesses, count(DISTINCT block_id) AS blocks, coalesce((SELECT count(*) FROM d WHERE d.cache_id = p.cache_id AND distance < 4), 0) AS hits FROM p GROUP BY cache_id""",
    "hit_by_modality": f"WITH {_TRACE} SELECT modality, count(*) - count(DISTINCT (cache_id, block_id)) AS hits, count(DISTINCT (cache_id, block_id)) AS misses FROM t GROUP BY modality",
    "block_dedup": f"WITH {_TRACE} SELECT block_id, event_id, event_type FROM t QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY seq DESC, event_id DESC) = 1",
    "tier_lookup": f"WITH {_TRACE} SELECT block_id, CASE WHEN count(*) >= 50 THEN 'gpu' WHEN count(*) BETWEEN 30 AND 60 THEN 'cpu' WHEN count(*) < 40 THEN 'ssd' ELSE 'miss' END AS tier FROM t GROUP BY block_id",
    "cache_hits_semi": "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "cache_misses_anti": "SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "block_usage": "SELECT source, sum(greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) * 256)::BIGINT AS bytes, count(*) AS blocks FROM documents GROUP BY source",
    "center_crop_mask": f"SELECT side, r AS patch_row, c AS patch_col, {_CROP} AS kept FROM (SELECT side, r, unnest(range(side)) AS c FROM (SELECT side, unnest(range(side)) AS r FROM (VALUES (4::BIGINT), (8), (11), (24)) v(side)))",
    "prune_tokens": f"""WITH d AS (SELECT doc_id, greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')))::BIGINT AS n FROM documents),
 s AS (SELECT *, greatest(1, floor(sqrt(n)))::BIGINT AS side FROM d), e AS (SELECT doc_id, n, side, unnest(range(side * side)) AS i FROM s),
 k AS (SELECT doc_id, list(i ORDER BY i) AS ids FROM (SELECT *, i // side AS r, i % side AS c FROM e) WHERE {_CROP} GROUP BY doc_id)
SELECT doc_id, n AS num_tokens, len(x)::BIGINT AS kept, md5(array_to_string(x, ',')) AS ids_md5 FROM (SELECT doc_id, n, CASE WHEN ids IS NULL OR len(ids) = n THEN range(n) ELSE ids END AS x FROM s LEFT JOIN k USING (doc_id))""",
    "mask_combine": """WITH px AS (SELECT label::BIGINT AS image, vec_id AS mask, (vec_id % 10) / 10.0::DOUBLE AS iou, unnest(range(64)) AS pixel, unnest(embedding) > 0.1 AS inside FROM embeddings),
 sh AS (SELECT image, mask, avg(inside::INT) AS share FROM px GROUP BY ALL), cb AS (SELECT image, pixel, max(CASE WHEN inside AND share < 0.8 THEN iou ELSE 0 END) AS value FROM px JOIN sh USING (image, mask) GROUP BY ALL),
 pm AS (SELECT image, (pixel // 16) * 4 + (pixel % 8) // 2 AS patch, avg(value) AS mean FROM cb GROUP BY ALL)
SELECT image, patch, round(mean, 6) AS mean, (SELECT max(value) FROM cb WHERE cb.image = pm.image) < 1e-6 OR mean >= 0.85 AS kept FROM pm""",
}
