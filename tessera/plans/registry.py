"""Names of the queries over the reference's operators, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import benchmarks, cache, corpus, prompts, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (retrieval, corpus, prompts, cache, benchmarks):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
