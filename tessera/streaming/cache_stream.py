"""The tiered cache over a stream of accesses, its tiers kept as state by cache_id."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.tiered_cache import TieredCache, policy_of

OUT = "cache_id long, seq long, block_id string, modality string, outcome string"


def replay_stream(accesses: DataFrame, gpu_blocks: int, cpu_blocks: int, policy: str = "modality_aware_lru") -> DataFrame:
    """Outcome of each access of a stream (cache_id, seq, block_id, modality).

    A cache's accesses of one micro-batch are replayed in order of seq; batches come in order. The
    state of a cache is as large as its tiers, which are bounded but for the disk tier's ids.
    """
    make = policy_of(policy)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = pickle.loads(state.get[0]) if state.exists else TieredCache(gpu_blocks, cpu_blocks, None, make())
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for seq, block, modality in rows[["seq", "block_id", "modality"]].itertuples(index=False):
            cache.evicted = []
            outcome = cache.get(block)
            if outcome == "miss":
                cache.put(block, modality == "visual")
            out.append((key[0], seq, block, modality, outcome))
        state.update((pickle.dumps(cache),))
        yield pd.DataFrame(out, columns=["cache_id", "seq", "block_id", "modality", "outcome"])

    return accesses.groupBy("cache_id").applyInPandasWithState(fold, OUT, "cache binary", "append", GroupStateTimeout.NoTimeout)
