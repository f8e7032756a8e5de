"""Vectors: normalising, embedding by hash and by terms."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOOR = 1e-12


def norm(vector: str | Column) -> Column:
    squares = F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return F.sqrt(squares)


def l2_normalize(vector: str | Column) -> Column:
    """The vector by its norm, the norm being at least FLOOR; a zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(FLOOR))
    return F.transform(vector, lambda x: x.cast("double") / length)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), FLOOR)


def hash_vector(text: str | None, size: int = 768) -> list[float]:
    """A fixed pseudo-random vector of a text, of nearly unit length."""
    seed = int.from_bytes(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()[:4], "big")
    v = np.random.RandomState(seed).randn(size)
    return (v / (np.linalg.norm(v) + 1e-8)).astype(np.float32).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    return texts.map(hash_vector, na_action=None)


def term_embedding(text: str | Column, terms: list[str]) -> Column:
    """How often each term stands in the lower-cased text, without overlaps."""
    low = F.lower(text)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms)).cast("array<long>")
