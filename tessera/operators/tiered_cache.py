"""The three-tier block cache as an ordered fold over an access trace, one fold a cache instance.

A cache has a fast tier (gpu), a middle tier (cpu) and a disk tier (ssd). Text enters at the fast
tier, images at the middle one. Replayed rules, faults included: a full tier evicts one block before
a block enters it, and takes the block even if nothing could be evicted; eviction demotes by one
tier; a hit below the fast tier promotes to it, making room first; disk copies stay after promotion;
only hits in the fast tier count as touches; plain LRU keeps one order for all tiers and may name a
block that isn't in the tier at hand.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import shuffle_partitions


class Policy(Protocol):
    """What a user-defined eviction policy provides."""

    def place(self, block: str, visual: bool, tier: str) -> None: ...
    def touch(self, block: str) -> None: ...
    def victim(self, tier: str) -> str | None: ...


class PlainLru:
    """One order over all tiers."""

    def __init__(self) -> None:
        self.order: OrderedDict[str, None] = OrderedDict()

    def place(self, block: str, visual: bool, tier: str) -> None:
        self.order.pop(block, None)
        self.order[block] = None

    def touch(self, block: str) -> None:
        if block in self.order:
            self.order.move_to_end(block)

    def victim(self, tier: str) -> str | None:
        return self.order.popitem(last=False)[0] if self.order else None


class ModalityAwareLru:
    """An order for each tier; in the fast tier images go before text."""

    def __init__(self) -> None:
        self.queues: dict[str, OrderedDict[str, None]] = {q: OrderedDict() for q in ("image", "text", "cpu", "ssd")}
        self.queue_of: dict[str, str] = {}

    def place(self, block: str, visual: bool, tier: str) -> None:
        if block in self.queue_of:
            self.queues[self.queue_of[block]].pop(block, None)
        name = ("image" if visual else "text") if tier == "gpu" else tier
        self.queues[name][block] = None
        self.queue_of[block] = name

    def touch(self, block: str) -> None:
        name = self.queue_of.get(block)
        if name:
            self.queues[name].move_to_end(block)

    def victim(self, tier: str) -> str | None:
        for name in ("image", "text") if tier == "gpu" else (tier,):
            if self.queues[name]:
                block = self.queues[name].popitem(last=False)[0]
                del self.queue_of[block]
                return block
        return None


@dataclass
class TieredCache:
    gpu_blocks: int
    cpu_blocks: int
    ssd_blocks: int | None = None
    policy: Policy = field(default_factory=ModalityAwareLru)
    gpu: dict[str, bool] = field(default_factory=dict)
    cpu: dict[str, bool] = field(default_factory=dict)
    ssd: dict[str, bool] = field(default_factory=dict)
    evicted: list[tuple[str, str, bool, bool]] = field(default_factory=list)  # block, tier, whether it is dropped, whether it is visual
    touches: dict[str, int] = field(default_factory=dict)  # hits in the fast tier, which alone count

    def _make_room(self, tier: str) -> None:
        held, most = (self.gpu, self.gpu_blocks) if tier == "gpu" else (self.cpu, self.cpu_blocks)
        if len(held) < most:
            return
        block = self.policy.victim(tier)
        if block is None or block not in held:
            return
        visual = held.pop(block)
        dropped = False
        if tier == "gpu":
            self._make_room("cpu")
            self.cpu[block] = visual
            self.policy.place(block, visual, "cpu")
        elif self.ssd_blocks is None or len(self.ssd) < self.ssd_blocks:
            self.ssd[block] = visual
            self.policy.place(block, visual, "ssd")
        else:
            dropped = True
        self.evicted.append((block, tier, dropped, visual))

    def get(self, block: str) -> str:
        """The tier that has the block, or miss; a block found below the fast tier moves there."""
        if block in self.gpu:
            self.policy.touch(block)
            self.touches[block] = self.touches.get(block, 0) + 1
            return "gpu"
        found = "cpu" if block in self.cpu else "ssd" if block in self.ssd else "miss"
        if found == "miss":
            return found
        visual = self.cpu[block] if found == "cpu" else self.ssd[block]
        if found == "ssd":
            self._make_room("cpu")
            self.cpu[block] = visual
            self.policy.place(block, visual, "cpu")
        self._make_room("gpu")
        self.gpu[block] = visual
        self.cpu.pop(block, None)
        self.policy.place(block, visual, "gpu")
        return found

    def put(self, block: str, visual: bool) -> None:
        tier = "cpu" if visual else "gpu"
        self._make_room(tier)
        (self.cpu if visual else self.gpu)[block] = visual
        self.policy.place(block, visual, tier)


TRACE = T.StructType(
    [
        T.StructField("cache_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("evictions", T.ArrayType(T.StructType([T.StructField("block_id", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("dropped", T.BooleanType()), T.StructField("modality", T.StringType())]))),
        T.StructField("gpu_size", T.IntegerType()),
        T.StructField("cpu_size", T.IntegerType()),
        T.StructField("ssd_size", T.IntegerType()),
        T.StructField("touches", T.LongType()),
    ]
)


POLICIES: dict[str, Callable[[], Policy]] = {"modality_aware_lru": ModalityAwareLru}


def policy_of(policy: str | Callable[[], Policy]) -> Callable[[], Policy]:
    """A maker of policies, by name or as it is; any name that isn't known means plain LRU."""
    return POLICIES.get(policy, PlainLru) if isinstance(policy, str) else policy


def serve(cache: TieredCache, accesses: list[tuple[str, bool]]) -> Iterator[tuple]:
    """A request: all its blocks are looked up, then those that were missed are put, repeated ones again.

    Of each access: outcome, evictions, sizes of the tiers once it is looked up (and put), touches.
    """
    looked = []
    for block, _ in accesses:
        cache.evicted = []
        looked.append((cache.get(block), cache.evicted))
    for (block, visual), (outcome, evicted) in zip(accesses, looked, strict=True):
        if outcome == "miss":
            cache.evicted = evicted
            cache.put(block, visual)
        yield outcome, [{"block_id": b, "tier": t, "dropped": d, "modality": "visual" if v else "text"} for b, t, d, v in evicted], len(cache.gpu), len(cache.cpu), len(cache.ssd), cache.touches.get(block, 0)


#: Accesses that a task replays before it passes them on.
TOLD = 5_000


def told(batches: Iterable[pa.RecordBatch], made: Callable[[], TieredCache]) -> Iterator[pa.RecordBatch]:
    """Accesses (columns of TRACE, then request, null where an access is one) that come by cache and in order, as served.

    What is held: the cache at hand, one request, and TOLD accesses that are served.
    """
    schema = to_arrow_schema(TRACE)
    out: list[tuple] = []
    request: list[tuple] = []
    cache = at = None

    def serve_request() -> None:
        served = serve(cache, [(row[2], row[3] == "visual") for row in request])
        out.extend((*row[:4], *said) for row, said in zip(request, served, strict=True))
        request.clear()

    def passed_on() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if request and (row[0] != at or row[4] is None or row[4] != request[-1][4]):
                serve_request()
                if len(out) >= TOLD:
                    yield passed_on()
            if cache is None or row[0] != at:
                cache, at = made(), row[0]
            request.append(row)
    if request:
        serve_request()
    if out:
        yield passed_on()


def replay(trace: DataFrame, gpu_blocks: int, cpu_blocks: int, ssd_blocks: int | None = None, policy: str | Callable[[], Policy] = "modality_aware_lru") -> DataFrame:
    """Outcome and evictions of each access of trace (cache_id, seq, block_id, modality, maybe request_id).

    A request's accesses are looked up together and its misses put afterwards; without request_id
    every access is a request of its own. Requests follow each other by their first access, accesses
    of one seq by their block. A cache's accesses are a sequence by nature, so the number of caches
    is the parallelism; Spark sorts them, and they pass through a fold that holds a cache's blocks
    and a request, not its accesses.
    """
    make = policy_of(policy)
    rows = trace.repartition(shuffle_partitions(trace.sparkSession), "cache_id")
    known = [F.col(c).cast(TRACE[c].dataType).alias(c) for c in ("cache_id", "seq", "block_id", "modality")]
    if "request_id" in trace.columns:
        first = F.min(F.struct("seq", "block_id")).over(Window.partitionBy("cache_id", "request_id"))
        ordered = rows.select(*known, F.struct(first.alias("first"), "request_id").alias("request_")).sortWithinPartitions("cache_id", "request_", "seq", "block_id", "modality")
        rows = ordered.select(*TRACE.names[:4], F.struct("request_.request_id").alias("request_"))
    else:
        rows = rows.select(*known, F.lit(None).cast("string").alias("request_")).sortWithinPartitions("cache_id", "seq", "block_id", "modality")
    return rows.mapInArrow(lambda batches: told(batches, lambda: TieredCache(gpu_blocks, cpu_blocks, ssd_blocks, make())), TRACE)
