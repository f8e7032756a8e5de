"""The index against asking every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.vector import unit_rows
from tessera.operators import retrieval as R
from tessera.operators import vector_index
from tessera.operators.vector_index import VectorIndex

ROWS = "chunk_id string, modality string, embedding array<float>"


def made(spark, seed, n, d=6, clustered=True):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, d)) * 4
    vectors = (middle[rng.integers(0, 8, n)] if clustered else 0) + rng.normal(size=(n, d))
    vectors[: n // 3] = vectors[0]  # a hot vector: ties by name
    vectors[n // 3] = 0
    rows = [(f"c{k}", "image" if k % 5 == 0 else "text", v.astype(np.float32).tolist()) for k, v in enumerate(vectors)]
    queries = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(rng.normal(size=(12, d)) * 3)] + [(100, rows[0][2]), (101, [0.0] * d)]
    return rows, queries


def brute(rows, queries, k, group=lambda r: ""):
    out = []
    unit = lambda v: unit_rows(np.array([v], dtype=np.float64))[0]
    for q, v in queries:
        scored = [(round(float(unit(r[2]) @ unit(v)), 9), r[0], group(r)) for r in rows]
        for g in {s[2] for s in scored}:
            out += [(q, name, score) for score, name, x in sorted((s for s in scored if s[2] == g), key=lambda s: (-s[0], s[1]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("clustered,k,by", [(True, 3, None), (False, 40, None), (True, 5, "modality"), (True, 500, "modality")])
def test_search_equals_asking_every_row(spark, monkeypatch, clustered, k, by):
    monkeypatch.setattr(vector_index, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(vector_index, "PART_ROWS", 50)
    monkeypatch.setattr(vector_index, "PART_QUERIES", 5)
    rows, queries = made(spark, k, 400, clustered=clustered)
    chunks = spark.createDataFrame([*rows, ("null", "text", None), ("nan", "text", [float("nan")] * 6), ("inf", "text", [float("inf")] * 6), ("hole", "text", [1.0, None] * 3)], ROWS).repartition(3)
    asked = spark.createDataFrame([*queries, (102, None), (103, [float("nan")] * 6)], "query_id long, embedding array<float>")
    index = VectorIndex.build(chunks, by)
    assert len(index.centres) > 1 and sum(c.rows for c in index.cells) == len(rows)
    order = "row_number() over (partition by query_id, group_ order by round(score, 9) desc, chunk_id)"
    found = index.search(asked, k).withColumn("place", F.expr(order)).where(F.col("place") <= k).collect()
    assert sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in found) == brute(rows, queries, k, (lambda r: r[1]) if by else (lambda r: ""))


def test_cells_that_hold_nothing_better_are_not_asked(spark):
    rows, _ = made(spark, 1, 900)
    index = VectorIndex.build(spark.createDataFrame(rows, ROWS))
    asked = spark.createDataFrame([(0, rows[500][2])], "query_id long, embedding array<float>")
    met = index.search(asked, 2).select("chunk_id").distinct().count()
    assert met < 2 * len(index.cells)  # two a cell if all were asked


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], ROWS)
    some = spark.createDataFrame([("a", "text", [1.0, 0.0])], ROWS)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert R.dense_topk(none, asked, 3).count() == R.dense_topk(some, asked.limit(0), 3).count() == 0
    assert [tuple(r) for r in R.dense_topk(some, asked, 3).select("chunk_id", "score", "rank").collect()] == [("a", 1.0, 1)]
    assert "toLocalIterator" not in open(R.__file__).read()
