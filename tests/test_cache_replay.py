"""Replays of the cache: requests as a whole, labels, policies, and the goldens of FIXTURES.md."""

from collections import Counter, OrderedDict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators.tiered_cache import TOLD, PlainLru, TieredCache, policy_of, replay, serve, told
from tessera.sources import tables as S


def test_a_request_looks_up_before_it_puts():
    cache = TieredCache(4, 4)
    assert [x[0] for x in serve(cache, [("a", False), ("a", False), ("v", True)])] == ["miss", "miss", "miss"]
    assert [x[0] for x in serve(cache, [("a", False), ("v", True), ("a", False)])] == ["gpu", "cpu", "gpu"]
    assert cache.touches == {"a": 2}


def test_evictions_name_their_modality():
    cache = TieredCache(1, 1)
    told = [y for x in ([("a", False)], [("b", False)], [("v", True)]) for y in serve(cache, x)]
    assert told[1][1] == [{"block_id": "a", "tier": "gpu", "dropped": False, "modality": "text"}]
    assert told[2][1] == [{"block_id": "a", "tier": "cpu", "dropped": False, "modality": "text"}]


def test_requests_of_a_trace(spark):
    rows = [(0, 1, "a", "text", 7), (0, 2, "a", "text", 7), (0, 3, "a", "text", 8), (1, 1, "a", "text", 7)]
    trace = spark.createDataFrame(rows, "cache_id long, seq long, block_id string, modality string, request_id long")
    outcomes = lambda df: {(r["cache_id"], r["seq"]): r["outcome"] for r in df.collect()}
    assert outcomes(replay(trace, 4, 4)) == {(0, 1): "miss", (0, 2): "miss", (0, 3): "gpu", (1, 1): "miss"}
    assert outcomes(replay(trace.drop("request_id"), 4, 4))[(0, 2)] == "gpu"
    assert replay(trace.limit(0), 4, 4).count() == 0


def test_policies_can_be_brought(spark):
    class Newest:
        """Evicts what came last."""

        def __init__(self):
            self.order = OrderedDict()

        def place(self, block, visual, tier):
            self.order[block] = None

        def touch(self, block):
            pass

        def victim(self, tier):
            return self.order.popitem()[0] if self.order else None

    assert policy_of("whatever") is PlainLru
    rows = [(0, k, b, "text") for k, b in enumerate("abc")]
    trace = spark.createDataFrame(rows, "cache_id long, seq long, block_id string, modality string")
    told = {r["block_id"]: [e["block_id"] for e in r["evictions"]] for r in replay(trace, 2, 9, policy=Newest).collect()}
    assert told == {"a": [], "b": [], "c": ["b"]}


GOLDENS = [
    ("0.01", "modality_aware_lru", {"text": (1210, 1390, 3262, 150), "visual": (13, 802, 3023, 150)}),
    ("0.01", "lru", {"text": (5606, 203, 53, 150), "visual": (3370, 406, 62, 150)}),
    ("0.001", "modality_aware_lru", {"text": (587, 0, 0, 15), "visual": (368, 15, 0, 15)}),
]


@pytest.mark.parametrize("size,policy,wanted", GOLDENS)
def test_trace_goldens(spark, sf, size, policy, wanted):
    trace = S.trace(spark, sf.replace("0.001", size), 1)
    told = replay(trace, 32, 64, policy=policy)
    counts = Counter((r["modality"], r["outcome"]) for r in told.select("modality", "outcome").collect())
    assert {m: tuple(counts[m, t] for t in ("gpu", "cpu", "ssd", "miss")) for m in ("text", "visual")} == wanted
    if size == "0.01" and policy == "lru":
        assert told.agg(F.max("gpu_size")).first()[0] == 295


def test_accesses_pass_through_the_fold():
    taken = []

    def batches():
        for k in range(40):
            taken.append(k)
            yield pa.RecordBatch.from_pylist([{"c": k // 20, "s": i, "b": f"b{i % 7}", "m": "text", "r": {"id": i // 5}} for i in range(1000 * (k % 20), 1000 * (k % 20) + 1000)])

    out, n = told(batches(), lambda: TieredCache(4, 6)), 0
    for batch in out:
        n += batch.num_rows
        assert len(taken) * 1000 - n <= TOLD + 1000
    assert n == 40_000


def test_a_replay_holds_no_cache_whole(spark, sf):
    for trace in (S.trace(spark, sf), S.trace(spark, sf).withColumn("request_id", F.lit(1))):
        plan = replay(trace, 4, 6)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_requests_that_cross_follow_their_first_access(spark):
    rows = [(0, 1, "a", "text", 9), (0, 2, "b", "text", 3), (0, 3, "b", "text", 9), (0, 4, "a", "text", 3), (0, 4, "c", "text", 3), (None, 1, "a", "text", 9)]
    trace = spark.createDataFrame(rows, "cache_id long, seq long, block_id string, modality string, request_id long")
    got = {(r["cache_id"], r["seq"], r["block_id"]): r["outcome"] for r in replay(trace, 4, 4).collect()}
    assert got == {(0, 1, "a"): "miss", (0, 3, "b"): "miss", (0, 2, "b"): "gpu", (0, 4, "a"): "gpu", (0, 4, "c"): "miss", (None, 1, "a"): "miss"}
