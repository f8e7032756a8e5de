"""Summaries of benchmark runs and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import order_statistic

# Labels, keys and kinds of the compared metrics, in order.
METRICS = (
    ("Mean TTFT (ms)", "mean_ttft_ms", "latency"),
    ("P50 TTFT (ms)", "p50_ttft_ms", "latency"),
    ("P99 TTFT (ms)", "p99_ttft_ms", "latency"),
    ("Mean Latency (ms)", "mean_latency_ms", "latency"),
    ("Cache Hit Rate (text)", "cache_hit_rate_text", "rate"),
    ("Cache Hit Rate (visual)", "cache_hit_rate_visual", "rate"),
    ("Mean GPU Memory (MiB)", "mean_gpu_memory_mib", "latency"),
)


def _rate(hits: str, misses: str) -> Column:
    total = F.sum(hits) + F.sum(misses)
    return F.when(total > 0, F.sum(hits) / total).otherwise(F.lit(0.0))


def summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """Means and hit rates of each run; a run without rows has no summary."""
    return rows.groupBy(*group).agg(
        F.avg("ttft_ms").alias("mean_ttft_ms"),
        F.avg("total_latency_ms").alias("mean_latency_ms"),
        _rate("cache_hits_text", "cache_misses_text").alias("cache_hit_rate_text"),
        _rate("cache_hits_visual", "cache_misses_visual").alias("cache_hit_rate_visual"),
        F.avg("gpu_memory_mib").alias("mean_gpu_memory_mib"),
        F.count("*").alias("total_queries"),
    )


def percentiles(rows: DataFrame, group: list[str]) -> DataFrame:
    """The upper median and the 99th percentile as order statistics: places n // 2 and int(0.99 n)."""
    places = {"p50_ttft_ms": F.floor(F.col("n") / 2), "p99_ttft_ms": F.floor(F.col("n") * F.lit(0.99))}
    return order_statistic(rows, "ttft_ms", places, group)


def unpivot(summaries: DataFrame, group: list[str]) -> DataFrame:
    """label, kind and value of each metric of each run."""
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col(key).cast("double").alias("value")) for label, key, kind in METRICS))
    return summaries.select(*group, F.inline(rows))


def compare(summaries: DataFrame, variant: str, a: str, b: str) -> DataFrame:
    """Both runs' values of each metric, missing ones 0; rates differ by points, others by percent."""
    each = unpivot(summaries, [variant])
    side = lambda name: F.coalesce(F.max(F.when(F.col(variant) == name, F.col("value"))), F.lit(0.0))
    both = each.groupBy("label", "kind").agg(side(a).alias("value_a"), side(b).alias("value_b"))
    change = F.when(F.col("kind") == "rate", (F.col("value_b") - F.col("value_a")) * 100).when(F.col("value_a") != 0, (F.col("value_b") - F.col("value_a")) / F.col("value_a") * 100)
    return both.withColumn("delta", change)


def table_text(head: list[str], rows: list[list[str]], widths: list[int]) -> str:
    """A Markdown table: the first column to the left, the others to the right."""

    def padded(cells: list[str]) -> str:
        return "".join(f"| {c.ljust(w) if k == 0 else c.rjust(w)} " for k, (c, w) in enumerate(zip(cells, widths, strict=True))) + "|"

    rule = "".join("|".ljust(w + 3, "-") for w in widths) + "|"
    return "\n".join([padded(head), rule, *map(padded, rows)])


def shown(compared: DataFrame) -> DataFrame:
    """label with the values and the change as they are printed; rates are percentages."""
    rate = F.col("kind") == "rate"
    value = lambda c: F.when(rate, F.format_string("%.1f%%", F.col(c) * 100)).otherwise(F.format_string("%.2f", c))
    change = F.when(rate, F.format_string("%+.1f%% pp", "delta")).otherwise(F.coalesce(F.format_string("%+.1f%%", "delta"), F.lit("N/A")))
    change = F.when(~rate & F.col("delta").isNull(), F.lit("N/A")).otherwise(change)
    return compared.select("label", value("value_a").alias("a"), value("value_b").alias("b"), change.alias("change"))


def markdown(compared: DataFrame, name_a: str, name_b: str) -> str:
    """The comparison as a Markdown table, a row a metric."""
    told = {r["label"]: list(r) for r in shown(compared).collect()}
    order = [label for label, _, _ in METRICS if label in told]
    return table_text(["Metric", name_a, name_b, "Delta"], [told[label] for label in order], [30, max(12, len(name_a)), max(12, len(name_b)), 10])
