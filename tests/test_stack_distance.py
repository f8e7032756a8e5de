"""Stack distances by ranges against the list that LRU keeps."""

import random

import numpy as np
import pytest

from tessera.operators import stack_distance as D
from tessera.operators.stack_distance import greater_before, lru_hits, stack_distances


def brute(rows):
    """A list a cache, the latest block last."""
    lists, out = {}, []
    for cache, seq, block in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "")):
        held = lists.setdefault(cache, [])
        distance = len(held) - 1 - held.index(block) if block in held else None
        if distance is not None:
            held.remove(block)
        held.append(block)
        out.append((cache, seq, block, distance))
    return out


def test_greater_before():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 64, 100):
        values = [rng.randrange(max(1, n // 2)) for _ in range(n)]
        assert greater_before(np.array(values, dtype=np.int64)).tolist() == [sum(v > values[i] for v in values[:i]) for i in range(n)]


@pytest.mark.parametrize("caches,blocks,n,band", [(1, 12, 400, 16), (1, 150, 600, 2), (5, 6, 400, 3)])
def test_distances_equal_a_list(spark, monkeypatch, caches, blocks, n, band):
    monkeypatch.setattr(D, "BAND", band)
    rng = random.Random(n + caches)
    skewed = lambda: f"b{min(rng.randrange(blocks), rng.randrange(blocks))}"
    rows = [(rng.randrange(caches), k, skewed() if k % 3 else "hot", "clash", 1) for k in range(n)]
    rng.shuffle(rows)
    trace = spark.createDataFrame(rows, "cache_id long, seq long, block_id string, range_ string, last_ long")
    got = stack_distances(trace, 40).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute([r[:3] for r in rows])))


def test_nulls_ties_and_no_rows(spark):
    rows = [(None, 1, "a"), (None, 2, None), (None, 3, "a"), (0, 1, None), (0, 1, "a"), (0, 1, "a"), (0, 2, None), (0, 2, "a")] * 2
    trace = spark.createDataFrame(rows, "cache_id long, seq long, block_id string")
    for size in (3, 100):
        assert sorted(map(repr, map(tuple, stack_distances(trace, size).collect()))) == sorted(map(repr, brute(rows)))
    assert stack_distances(trace.limit(0)).count() == 0 and lru_hits(trace.limit(0), 4).count() == 0


def test_ranges_grow_with_the_rows(spark):
    trace = spark.range(5000).selectExpr("0L as cache_id", "id as seq", "concat('b', id % 7) as block_id")
    assert [tuple(r) for r in lru_hits(trace, 7, 400).collect()] == [(0, 5000, 7, 4993)]
    assert lru_hits(trace, 6, 400).first()["hits"] == 0
