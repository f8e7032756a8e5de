"""Queries over benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import benchmarks as B
from tessera.session import table
from tessera.sources import tables as S

WARM_UP = 5


def _rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep))


def bench_summary(spark, sf_dir: str) -> DataFrame:
    return _rounded(B.summary(S.bench_rows(spark, sf_dir), ["variant"]), ["variant"])


def bench_percentiles(spark, sf_dir: str) -> DataFrame:
    return B.percentiles(S.bench_rows(spark, sf_dir), ["variant"])


def compare_runs(spark, sf_dir: str) -> DataFrame:
    rows = S.bench_rows(spark, sf_dir)
    both = B.summary(rows, ["variant"]).join(B.percentiles(rows, ["variant"]), "variant")
    return _rounded(B.compare(both, "variant", "baseline", "eviction_only"), ["label", "kind"])


def warmup_analysis(spark, sf_dir: str) -> DataFrame:
    """Each run's first-5 and last-20 means; its cold overhead and QPS ratio against the baseline.

    The overhead sets the first queries of a run against those of the baseline, the ratio the
    baseline's mean time to a run's. The bounded ranks let Spark keep so many rows a task before the shuffle.
    """
    rows = S.bench_rows(spark, sf_dir).select("variant", "query_id", "ttft_ms")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("variant").orderBy("query_id"))).where("r <= 5").groupBy("variant").agg(F.avg("ttft_ms").alias("first5_mean"))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("query_id")))).where("r <= 20").groupBy("variant").agg(F.avg("ttft_ms").alias("last20_mean"))
    runs = first.join(last, "variant").join(rows.groupBy("variant").agg(F.avg("ttft_ms").alias("mean_")), "variant")
    base = runs.where("variant = 'baseline'").select(F.col("first5_mean").alias("base_first_"), F.col("mean_").alias("base_mean_"))
    against = runs.join(base, how="left")  # one row
    return _rounded(against.select("variant", "first5_mean", "last20_mean", ((F.col("first5_mean") / F.col("base_first_") - 1) * 100).alias("cold_overhead_pct"), (F.col("base_mean_") / F.col("mean_")).alias("qps_ratio")), ["variant"])


def warmup_trace(spark, sf_dir: str) -> DataFrame:
    """The first queries run once unmeasured, then all of them."""
    queries = table(spark, sf_dir, "benchmark").select("item_id")
    warm = queries.orderBy("item_id").limit(WARM_UP).select("item_id", F.lit("warmup").alias("phase"))
    return warm.unionByName(queries.select("item_id", F.lit("measured").alias("phase")))


_B = """b AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'eviction_only' END AS variant, event_id AS query_id, value AS ttft_ms, value * 1.25 AS lat, (event_type IN ('purchase', 'signup'))::INT AS ht, (event_type = 'error')::INT AS mt, (event_type = 'view')::INT AS hv, (event_type = 'click')::INT AS mv, greatest(value, user_id::DOUBLE) AS mem FROM events)"""
_SUM = "s AS (SELECT variant, avg(ttft_ms) AS mean_ttft_ms, avg(lat) AS mean_latency_ms, CASE WHEN sum(ht) + sum(mt) > 0 THEN sum(ht) / (sum(ht) + sum(mt)) ELSE 0 END AS cache_hit_rate_text, CASE WHEN sum(hv) + sum(mv) > 0 THEN sum(hv) / (sum(hv) + sum(mv)) ELSE 0 END AS cache_hit_rate_visual, avg(mem) AS mean_gpu_memory_mib, count(*) AS total_queries FROM b GROUP BY variant)"
_PCT = "l AS (SELECT variant, list(ttft_ms ORDER BY ttft_ms) AS v FROM b GROUP BY variant), p AS (SELECT variant, v[len(v) // 2 + 1] AS p50_ttft_ms, v[floor(len(v) * 0.99)::BIGINT + 1] AS p99_ttft_ms FROM l)"

QUERIES = {f.__name__: f for f in (bench_summary, bench_percentiles, compare_runs, warmup_analysis, warmup_trace)}
ORACLES = {
    "bench_summary": f"WITH {_B}, {_SUM} SELECT variant, round(mean_ttft_ms, 6) AS mean_ttft_ms, round(mean_latency_ms, 6) AS mean_latency_ms, round(cache_hit_rate_text, 6) AS cache_hit_rate_text, round(cache_hit_rate_visual, 6) AS cache_hit_rate_visual, round(mean_gpu_memory_mib, 6) AS mean_gpu_memory_mib, total_queries FROM s",
    "bench_percentiles": f"WITH {_B}, {_PCT} SELECT * FROM p",
    "compare_runs": f"""WITH {_B}, {_SUM}, {_PCT}, j AS (SELECT * FROM s JOIN p USING (variant)), u AS ({' UNION ALL '.join(f"SELECT variant, '{label}' AS label, '{kind}' AS kind, {key} AS v FROM j" for label, key, kind in B.METRICS)}),
 g AS (SELECT label, kind, coalesce(max(v) FILTER (WHERE variant = 'baseline'), 0) AS a, coalesce(max(v) FILTER (WHERE variant = 'eviction_only'), 0) AS b FROM u GROUP BY ALL)
SELECT label, kind, round(a, 6) AS value_a, round(b, 6) AS value_b, round(CASE WHEN kind = 'rate' THEN (b - a) * 100 WHEN a <> 0 THEN (b - a) / a * 100 END, 6) AS delta FROM g""",
    "warmup_analysis": f"WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY query_id) AS f, row_number() OVER (PARTITION BY variant ORDER BY query_id DESC) AS l FROM b), m AS (SELECT variant, avg(ttft_ms) FILTER (WHERE f <= 5) AS x, avg(ttft_ms) FILTER (WHERE l <= 20) AS y, avg(ttft_ms) AS z FROM r GROUP BY variant), a AS (SELECT x AS ax, z AS az FROM m WHERE variant = 'baseline') SELECT variant, round(x, 6) AS first5_mean, round(y, 6) AS last20_mean, round((x / ax - 1) * 100, 6) AS cold_overhead_pct, round(az / z, 6) AS qps_ratio FROM m LEFT JOIN a ON true",
    "warmup_trace": "(SELECT item_id, 'warmup' AS phase FROM benchmark ORDER BY item_id LIMIT 5) UNION ALL SELECT item_id, 'measured' FROM benchmark",
}
