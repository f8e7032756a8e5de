"""Ranks over all rows, and order statistics of groups, without one task that holds them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut, shuffle_partitions

#: Steps of a quantile summary, values of a bracket that isn't narrowed further, and brackets that are shipped.
GRID = 1024
BRACKET = 100_000
BROADCAST_BRACKETS = 10_000


def ordered_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with the 1-based place of each row in the given order.

    Rows are dealt by ranges of the order, sorted in their partition and written once; a place is the
    one in the partition and the rows of those before, whose counts are a number a partition.
    """
    parts = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    dealt = cut(parts.withColumn("part_", F.spark_partition_id()))
    starts, total, columns = {}, 0, df.columns
    for part, n in sorted(map(tuple, dealt.groupBy("part_").count().collect())):
        starts[part], total = total, total + n

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows:
                at = starts[batch.column("part_")[0].as_py()] if at is None else at
                places = pa.array(range(at + 1, at + 1 + batch.num_rows), pa.int64())
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), places], names=[*columns, name])

    return dealt.mapInArrow(number, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def order_statistic(df: DataFrame, value: str, places: dict[str, Column], group: list[str]) -> DataFrame:
    """For each group the values at 0-based places, given as columns over n, the group's values that aren't null.

    No row is sorted. A quantile summary of each group, combined before the shuffle, gives two values
    that a place lies between; an exact count tells how many values are below, equal to either and
    between. Brackets with more than BRACKET values between are narrowed by a summary of these. In the
    last one, values with their counts are added up, so a value that most rows have is one row.
    """
    keys = [f"g{k}_" for k in range(len(group))]
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True)), F.col(value).alias("v_")).where("v_ is not null")
    kind = rows.schema["v_"].dataType
    v, lo, hi, place = (F.col(c) for c in ("v_", "lo_", "hi_", "place_"))
    summary = lambda x: F.percentile_approx(x, [k / GRID for k in range(GRID + 1)], 8 * GRID)
    unless = lambda test, otherwise: F.coalesce(test, F.lit(otherwise))  # noqa: E731  a missing bound is open
    whole = rows.groupBy(*keys).agg(F.count("v_").alias("n"), summary(v).alias("q_"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name_"), at.cast("long").alias("place_")) for name, at in places.items()))
    state = whole.select(*keys, F.inline(wanted), *(F.lit(None).cast(kind).alias(c) for c in ("lo_", "hi_")), F.lit(0).cast("long").alias("below_"), F.lit(0).cast("long").alias("first_"), F.col("n").alias("between_"), "q_")
    state = cut(state.where("place_ between 0 and between_ - 1"))
    while True:
        wide = F.col("between_") > BRACKET
        if state.where(wide).isEmpty():
            break
        at = (place - F.col("first_")) / F.col("between_") * GRID
        narrow = state.where(wide).select(*keys, "name_", "place_", F.coalesce(F.get("q_", F.floor(at).cast("int") - 1), lo).alias("lo_"), F.coalesce(F.get("q_", F.ceil(at).cast("int") + 1), hi).alias("hi_"))
        between = unless(v > lo, True) & unless(v < hi, True)
        counted = _met(rows, narrow, keys).groupBy(*narrow.columns).agg(F.count_if(unless(v < lo, False)).alias("below_"), F.count_if(unless(v <= lo, False)).alias("first_"), F.count_if(between).alias("between_"), F.count_if(unless(v <= hi, True)).alias("upto_"), summary(F.when(between, v)).alias("q_"))
        # a place at a bound is found; were a summary further off than it promises, the side it missed is opened
        early, late = place < F.col("below_"), place >= F.col("upto_")
        found = (place < F.col("first_")) | (place >= F.col("first_") + F.col("between_"))
        counted = counted.withColumns({"lo_": F.when(~early, lo), "hi_": F.when(~late, hi), "between_": F.when(early | late, F.lit(1 << 62)).when(found, 0).otherwise(F.col("between_")), "q_": F.when(~(early | late), F.col("q_"))})
        state = cut(state.where(~wide).unionByName(counted.select(state.columns)))
    held = _met(rows, state.select(*keys, "name_", "place_", "lo_", "hi_", "below_"), keys).where(unless(v >= lo, True) & unless(v <= hi, True))
    held = held.groupBy(*keys, "name_", "place_", "below_", "v_").agg(F.count("*").alias("times_"))
    upto = F.sum("times_").over(Window.partitionBy(*keys, "name_").orderBy("v_")) + F.col("below_")
    chosen = held.withColumn("upto_", upto).where((F.col("upto_") > place) & (F.col("upto_") - F.col("times_") <= place))
    told = {name: F.max(F.when(F.col("name_") == name, v)).alias(name) for name in places}
    return chosen.groupBy(*keys).agg(*told.values()).select(*(F.col(k).alias(g) for g, k in zip(group, keys, strict=True)), *places)


def _met(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the brackets of their group; these are shipped if they are few, else both are shuffled."""
    few = state.count() <= BROADCAST_BRACKETS
    named = state.select(*(F.col(k).alias(f"s{k}") for k in keys), *(c for c in state.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys] or [F.lit(True)]
    return rows.join(F.broadcast(named) if few else named, same).drop(*(f"s{k}" for k in keys))


def last_wins(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row a key, the last in order; combined before the shuffle, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last_")).select(*key, "last_.*")
