"""Connected components by DataFrame joins; links never come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, settings


def connected_components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it is linked with over any path, of links (a, b).

    Each round takes the smallest label among neighbours, then follows the labels one step further,
    so labels travel twice as far as in the round before; it ends when no label changes. The
    minimum is combined before the shuffle. A round is one job, planned once: its rows are two names
    each, and planning them anew after each shuffle would cost the driver more than it saves.
    """
    with settings(links.sparkSession, spark__sql__adaptive__enabled="false"):
        return _components(links)


def _components(links: DataFrame) -> DataFrame:
    both = cut(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "low").alias("low"))
        step = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        moved = cut(lower.join(step, "low").select("node", F.col("root").alias("old"), F.least("low", "far").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return labels
