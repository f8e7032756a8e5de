"""LRU stack distances of a trace, by time ranges that are counted apart and joined by their links.

A block's stack distance at an access is the number of other blocks since its access before. The
trace is dealt to ranges of accesses in order of (cache, seq). Inside a range, distances are
positions less inversions: with p the place of the block's access before i, of the i - p - 1
accesses between, each whose own access before comes after p repeats a block. A block's first access
in a range R is linked to its last one in an earlier range P. Between them lie

    the blocks met in R before it,
    those last seen in P after it that don't return before R,
    those of the ranges between: blocks of each range, less links from one of them to another,
    less the blocks of R before it whose own link starts later, as these were counted twice.

So only a row for each block and range is shuffled, no task holds more than a range, or BAND columns
of the ranges' matrix, and a cache that has all accesses is spread like many small ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut, shuffle_partitions

#: Accesses of a range, about.
RANGE_ROWS = 1 << 18
#: Columns of the ranges' matrix of links that one task sums up.
BAND = 16


def greater_before(values: np.ndarray) -> np.ndarray:
    """For each value how many before it are greater; equal ones aren't. Merges of growing width."""
    n = len(values)
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    found, by_rank, width = np.zeros(n, dtype=np.int64), np.argsort(rank), 1
    while width < n:
        pair = by_rank // (2 * width)
        order = by_rank[np.argsort(pair, kind="stable")]  # by pair of halves, then by rank
        left = order % (2 * width) < width
        met = np.cumsum(left)
        pair = order // (2 * width)
        ends = np.flatnonzero(np.r_[np.diff(pair) > 0, True])
        inside = met[ends][np.searchsorted(pair[ends], pair)]  # halves to the left, up to this pair's end
        found[order[~left]] += (inside - met)[~left]
        width *= 2
    return found


def _range_rows(schema: T.StructType):
    """A range's accesses in order: its number, place, distance where the access before is in the range, blocks met before, and, at a block's first access, the place of its last."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        n, (caches, _), (blocks, names) = len(rows), pd.factorize(rows["cache_id"], use_na_sentinel=False), pd.factorize(rows["block_id"], use_na_sentinel=False)
        key, _ = pd.factorize(caches.astype(np.int64) * max(1, len(names)) + blocks)
        order = np.argsort(key, kind="stable")
        same = np.r_[False, key[order][1:] == key[order][:-1]]
        before = np.full(n, -1, dtype=np.int64)
        before[order[same]] = order[np.flatnonzero(same) - 1]
        again = np.flatnonzero(before >= 0)
        distance = np.full(n, -1, dtype=np.int64)
        distance[again] = again - before[again] - 1 - greater_before(before[again])
        first = before < 0
        last = np.zeros(n, dtype=np.int64)
        last[key] = np.arange(n)  # of each key the last assignment stays
        yield rows.assign(
            place_=np.arange(n),
            distance=pd.Series(distance, dtype="Int64").where(~first),
            met_=np.cumsum(first) - first,
            last_=pd.Series(last[key], dtype="Int64").where(first),
        )[schema.names]

    return count


def _after_in_range(links: pd.DataFrame) -> pd.DataFrame:
    """Rows of one range as the earlier one: blocks last seen after, that don't return before the next."""
    links = links.sort_values("last_", ascending=False, ignore_index=True)
    n = len(links)
    back = links["next_range_"].to_numpy(dtype=np.float64, na_value=np.inf)
    _, rank = np.unique(back, return_inverse=True)
    # of equal ranges the one met earlier counts as greater
    links["after_"] = greater_before(rank.astype(np.int64) * n + (n - 1 - np.arange(n)))
    return links


def _twice_in_range(links: pd.DataFrame) -> pd.DataFrame:
    """Rows of one range as the later one: blocks met before whose own link starts later."""
    links = links.sort_values("next_place_", ignore_index=True)
    order = np.lexsort((links["last_"].to_numpy(), links["range_"].to_numpy()))
    rank = np.empty(len(links), dtype=np.int64)
    rank[order] = np.arange(len(links))
    links["twice_"] = greater_before(rank)
    return links


_BETWEEN = T.StructType([T.StructField("range_", T.LongType()), T.StructField("next_range_", T.LongType()), T.StructField("nested_", T.LongType())])


def _nested(band: pd.DataFrame, wide: int) -> pd.DataFrame:
    """Links from and to the ranges between those of each cell, for some columns of the matrix."""
    cells, carried = band[band["column_"].notna()], band[band["column_"].isna()]
    first = int(band["band_"].iloc[0]) * wide
    rows = np.unique(band["row_"].to_numpy(dtype=np.int64))  # rows without links add nothing
    at = lambda part: np.searchsorted(rows, part["row_"].to_numpy(dtype=np.int64))
    matrix = np.zeros((len(rows) + 1, wide + 1), dtype=np.int64)
    np.add.at(matrix, (at(carried), 0), carried["links_"].to_numpy(dtype=np.int64))
    columns = cells["column_"].to_numpy(dtype=np.int64) - first
    np.add.at(matrix, (at(cells), columns + 1), cells["links_"].to_numpy(dtype=np.int64))
    ending = np.cumsum(matrix, axis=1)  # links of a row that end before a column
    below = np.cumsum(ending[::-1], axis=0)[::-1]  # of this row and later ones
    return pd.DataFrame({"range_": cells["row_"].astype("int64"), "next_range_": cells["column_"].astype("int64"), "nested_": below[at(cells) + 1, columns]})


def _between(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """range_, next_range_ and between_: the distinct blocks of the ranges between, for each pair that has a link."""
    cells = links.groupBy(F.col("range_").alias("row_"), F.col("next_range_").alias("column_")).agg(F.count("*").alias("links_"))
    wide = BAND
    cells = cut(cells.withColumn("band_", F.floor(F.col("column_") / wide)))
    bands = cells.agg(F.max("band_")).first()[0]
    if bands is None:
        return links.sparkSession.createDataFrame([], "range_ long, next_range_ long, between_ long")
    sums = cells.groupBy("row_", "band_").agg(F.sum("links_").alias("sum_"))
    row = Window.partitionBy("row_").orderBy("band_")
    running = sums.select("row_", F.sum("sum_").over(row).alias("links_"), (F.col("band_") + 1).alias("from_"), F.coalesce(F.lead("band_").over(row), F.lit(bands)).alias("to_"))
    carried = running.where("from_ <= to_").select("row_", F.lit(None).cast("long").alias("column_"), "links_", F.explode(F.sequence("from_", "to_")).alias("band_"))
    nested = carried.unionByName(cells).groupBy("band_").applyInPandas(lambda band: _nested(band, wide), _BETWEEN)
    # a few numbers a range
    total = blocks.withColumn("upto_", F.sum("blocks_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, 0)))
    start = total.select("range_", F.col("upto_").alias("start_"))
    end = total.select(F.col("range_").alias("next_range_"), (F.col("upto_") - F.col("blocks_")).alias("end_"))
    return nested.join(start, "range_").join(end, "next_range_").select("range_", "next_range_", (F.col("end_") - F.col("start_") - F.col("nested_")).alias("between_"))


def stack_distances(trace: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """cache_id, seq, block_id and distance, null at a block's first access, of each access of trace.

    Accesses of one cache and seq are taken in order of their block_id. An empty trace gives an
    empty result; null ids are ids of their own.
    """
    rows = trace.select("cache_id", "seq", "block_id")
    n = rows.count()
    ranges = max(-(-n // range_rows), min(shuffle_partitions(rows.sparkSession), n // 1000 + 1), 1)
    order = ("cache_id", "seq", "block_id")
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("range_", F.spark_partition_id().cast("long")))
    numbers = [T.StructField(c, T.LongType()) for c in ("place_", "distance", "met_", "last_")]
    schema = T.StructType([*dealt.schema.fields, *numbers])
    counted = dealt.mapInPandas(_range_rows(schema), schema)
    block = Window.partitionBy("cache_id", "block_id").orderBy("range_")  # a row a range
    ahead = {f"next_{c}": F.lead(c).over(block) for c in ("range_", "place_", "met_", "seq")}
    seen = cut(counted.where("last_ is not null").withColumns({**ahead, "earlier_": F.lag("range_").over(block)}).drop("distance"))
    blocks = seen.groupBy("range_").agg(F.count("*").alias("blocks_"))
    kinds = lambda *added: T.StructType([*seen.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    links = seen.groupBy("range_").applyInPandas(_after_in_range, kinds("after_")).where("next_range_ is not null")
    links = links.groupBy("next_range_").applyInPandas(_twice_in_range, kinds("after_", "twice_"))
    linked = links.join(_between(seen.where("next_range_ is not null"), blocks), ["range_", "next_range_"])
    distance = F.col("next_met_") + F.col("after_") + F.col("between_") - F.col("twice_")
    across = linked.select("cache_id", F.col("next_seq").alias("seq"), "block_id", distance.alias("distance"))
    first = seen.where("earlier_ is null").select("cache_id", "seq", "block_id", F.lit(None).cast("long").alias("distance"))
    inside = counted.where("last_ is null").select("cache_id", "seq", "block_id", "distance")
    return inside.unionByName(across).unionByName(first)


def lru_hits(trace: DataFrame, capacity: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per cache_id: accesses, distinct blocks and hits of one LRU tier of ``capacity`` blocks."""
    told = stack_distances(trace, range_rows)
    return told.groupBy("cache_id").agg(F.count("*").alias("accesses"), F.count_if(F.col("distance").isNull()).alias("blocks"), F.count_if(F.col("distance") < capacity).alias("hits"))
