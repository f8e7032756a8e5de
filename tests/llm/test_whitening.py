"""Whitening against NumPy over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening
from tessera.llm.whitening import op11, whitened_rows


def brute(vectors, components=8):
    x = [[math.floor(float(c) * 1024) + 100_000 for c in v] for v in vectors]
    n, totals = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, totals, strict=True)) for row in x]
    away = np.array([[(n * c - s) / n for c, s in zip(row, totals, strict=True)] for row in x])
    values, found = np.linalg.eigh(away.T @ away / n)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    return deviation, away @ found / np.sqrt(values), values / np.trace(away.T @ away / n)


def table_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"key_ long, v_ array<{kind}>, vec_id string, n int, component int").repartition(5)


def compare(got, ids, vectors, components=8):
    deviation, wanted, explained = brute(vectors, components)
    rows = got.orderBy("vec_id", "deviation", "component").collect()
    k = wanted.shape[1]
    assert len(rows) == k * len(vectors)
    assert sorted((r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1) == sorted(zip(ids, deviation, strict=True))
    assert {r["n"] for r in rows} == {len(vectors)} and rows[0]["identity_error"] < 1e-9
    at = {i: j for j, i in enumerate(ids)}
    told = np.zeros_like(wanted)
    for r in rows:
        told[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-9
    signs = np.sign((told * wanted).sum(axis=0))
    assert np.abs(told * signs - wanted).max() < 1e-7


@pytest.mark.parametrize("d,n", [(1, 40), (31, 90), (32, 90), (70, 300)])
def test_rows_equal_brute_force(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + 1).astype(np.float32)
    rows = [(k, v.tolist(), "clash", -1, -1) for k, v in enumerate(vectors)]
    bad = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [float("-inf")] * (d + 2)]
    got = whitened_rows(table_of(spark, rows + [(1000 + k, v, None, None, None) for k, v in enumerate(bad)]))
    compare(got, list(range(n)), vectors)


def test_repeated_rows_and_null_ids_stay(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20, 4))
    rows = [(k, v.tolist(), "", 0, 0) for k, v in enumerate(vectors)]
    rows += [(0, vectors[0].tolist(), "", 0, 0), (None, vectors[1].tolist(), "", 0, 0), (None, None, "", 0, 0)]
    got = whitened_rows(table_of(spark, rows, "double"), 3)
    assert got.count() == 22 * 3 and got.where("vec_id is null").count() == 3 and got.where("vec_id = 0").select("whitened").distinct().count() == 3


def test_table_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compare(op11(spark, sf), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_no_variance_and_no_rows(spark):
    same = whitened_rows(table_of(spark, [(k, [1.0, 2.0], "", 0, 0) for k in range(3)])).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, None, 0)}
    flat = whitened_rows(table_of(spark, [(k, [float(k), 2.0], "", 0, 0) for k in range(3)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True} and flat[0]["identity_error"] < 1e-12
    assert whitened_rows(table_of(spark, [])).count() == whitened_rows(table_of(spark, [(1, [], "", 0, 0), (2, None, "", 0, 0)])).count() == 0


def test_ragged_and_huge_are_errors(spark):
    for rows in ([(1, [1.0], "", 0, 0), (2, [1.0, 2.0], "", 0, 0)], [(1, [2.0**51], "", 0, 0)]):
        with pytest.raises(Exception, match="vectors of different lengths|an entry of"):
            whitened_rows(table_of(spark, rows)).collect()


def test_deviation_is_exact_beyond_longs(spark):
    vectors = [[2.0**30, 0.0], [-(2.0**30), 1.0], [5.5, 7.25]]
    fitted = whitening.fit(table_of(spark, [(k, v, "", 0, 0) for k, v in enumerate(vectors)], "double"))
    wide = whitening.whiten(table_of(spark, [(k, v, "", 0, 0) for k, v in enumerate(vectors)], "double"), fitted)
    assert {r["key_"]: int(r["deviation"]) for r in wide.collect()} == dict(enumerate(brute(vectors)[0]))
    rows = whitened_rows(table_of(spark, [(k, v, "", 0, 0) for k, v in enumerate(vectors)], "double"))
    assert rows.where(F.col("deviation").isNull()).count() == sum(2 for v in brute(vectors)[0] if v >= 2**63)


def test_blocks_are_tiles_of_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    vectors = np.random.default_rng(1).normal(size=(50, 33))
    compare(whitened_rows(table_of(spark, [(k, v.tolist(), "", 0, 0) for k, v in enumerate(vectors)], "double")), list(range(50)), vectors)
