"""Embedding whitening: a covariance from tiles of dimension pairs, and its leading components.

Vectors become integers x = floor(1024 c) + 100000, so sums are exact. Rows are cut into row-blocks
and dimensions into column blocks of TILE; column blocks are shuffled by their row-block, where
each pair of them is centred and multiplied. A task adds its products up for each tile, the tiles
are summed over tasks, and the driver assembles the matrix, whose size is that of the dimensions
squared whatever the number of rows, and takes its eigenvectors.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; all
others are fitted on and returned, repeated ones and those with a null or repeated id for
themselves; vectors of different lengths, and entries of 2**50 or more, are an error; a component
without variance (an eigenvalue within rounding of 0, as for a single row) has a null whitened
value and takes no part in the identity error; explained is null where there is no variance at
all; a deviation too large for a long is null; extra columns stay out; no usable rows, or vectors
without entries, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import small_batches
from tessera.session import settings

SCALE, OFFSET = 1024, 100_000
#: Dimensions of a column block, and rows of a row-block.
TILE = 32
BLOCK_ROWS = 1024
#: Row-blocks' pairs of an Arrow batch; each is two blocks of up to BLOCK_ROWS x TILE numbers.
PAIRS = 16
COMPONENTS = 8
LARGEST = 2.0**50


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have a vector of finite entries, and these as integers x."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)  # null entries are NaN
    entries = np.maximum(sizes, 0)
    owner = np.repeat(np.arange(len(sizes)), entries)
    kept = (sizes >= 0) & (np.bincount(owner, weights=~np.isfinite(flat), minlength=len(sizes)) == 0)
    lengths = np.unique(sizes[kept])
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    flat = flat[np.repeat(kept, entries)]
    if (np.abs(flat) >= LARGEST).any():
        raise ValueError("an entry of 2**50 or more")
    return kept, (np.floor(flat * SCALE).astype(np.int64) + OFFSET).reshape(int(kept.sum()), int(lengths[0]) if len(lengths) else 0)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of usable rows of vectors (v_) and the sum of x in each dimension."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            _, x = usable(batch.column("v_"))
            n, before = totals.get(x.shape[1], (0, 0))
            totals[x.shape[1]] = (n + len(x), before + x.sum(axis=0))
        rows = [(d, n, s.tolist()) for d, (n, s) in totals.items() if n]
        yield pa.RecordBatch.from_pydict({"size": [r[0] for r in rows], "n": [r[1] for r in rows], "sums": [r[2] for r in rows]}, schema=pa.schema([("size", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    with small_batches(vectors.sparkSession):
        parts = vectors.mapInArrow(add, "size int, n long, sums array<long>").select("size", "n", F.posexplode_outer("sums").alias("at", "part"))
        rows = parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    if len({r["size"] for r in rows}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({r['size'] for r in rows})}")
    found = {r["at"]: int(r["total"]) for r in rows if r["at"] is not None}
    return (rows[0]["n"] if rows else 0), [found[k] for k in range(len(found))]


def centred(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """x less the mean, exact up to the last rounding."""
    whole = np.array([s // n for s in totals], dtype=np.int64)
    return (x - whole) - np.array([(s % n) / n for s in totals])


def column_blocks(vectors: DataFrame) -> DataFrame:
    """row_block, col_block and the integers of each, row by row."""

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, schema = TaskContext.get().partitionId() << 33, pa.schema([("row_block", pa.int64()), ("col_block", pa.int32()), ("block", pa.binary())])
        for batch in batches:
            _, x = usable(batch.column("v_"))
            for at in range(0, len(x), BLOCK_ROWS):
                parts = [x[at : at + BLOCK_ROWS, k : k + TILE] for k in range(0, x.shape[1], TILE)]
                small = [p.astype("<i4") if np.abs(p).max() < 2**31 else p.astype("<i8") for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(small), pa.int64()), pa.array(range(len(small)), pa.int32()), pa.array([(b"4" if p.itemsize == 4 else b"8") + p.tobytes() for p in small], pa.binary())], schema=schema)
                block += 1

    return vectors.mapInArrow(cut_up, "row_block long, col_block int, block binary")


def covariance(vectors: DataFrame, n: int, totals: list[int]) -> np.ndarray:
    """The covariance of x over all usable rows, divisor n, centred before multiplying."""
    d = len(totals)
    width = lambda k: min(TILE, d - k * TILE)

    def opened(block: bytes, k: int) -> np.ndarray:
        x = np.frombuffer(block, dtype="<i4" if block[:1] == b"4" else "<i8", offset=1).reshape(-1, width(k))
        return centred(x.astype(np.int64), n, totals[k * TILE : k * TILE + width(k)])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "a", "b")), strict=True):
                product = opened(a, i).T @ opened(b, j)
                tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product
        keys = sorted(tiles)
        yield pa.RecordBatch.from_pydict({"i": [k[0] for k in keys], "j": [k[1] for k in keys], "tile": [tiles[k].ravel().tolist() for k in keys]}, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("tile", pa.list_(pa.float64()))]))

    with small_batches(vectors.sparkSession), settings(vectors.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(PAIRS)):
        left = column_blocks(vectors).select("row_block", F.col("col_block").alias("i"), F.col("block").alias("a"))
        right = left.select("row_block", F.col("i").alias("j"), F.col("a").alias("b"))
        pairs = left.join(right, "row_block").where("i <= j").select("i", "j", "a", "b")
        tiles = pairs.mapInArrow(multiply, "i int, j int, tile array<double>").select("i", "j", F.posexplode("tile").alias("at", "part"))
        rows = tiles.groupBy("i", "j", "at").agg(F.sum("part").alias("total")).collect()  # as many as there are pairs of dimensions
    out = np.zeros((d, d))
    for i, j, at, total in rows:
        r, c = i * TILE + at // width(j), j * TILE + at % width(j)
        out[r, c] = out[c, r] = total / n
    return out


@dataclass(frozen=True)
class Whitening:
    """What is fitted: counts and sums, the leading components with their eigenvalues, and the trace."""

    n: int
    totals: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def known(self) -> int:
        """Components whose variance is more than rounding."""
        return int((self.values > len(self.totals) * np.finfo(float).eps * max(self.trace, 0.0)).sum())

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of x on the known components, with unit variance."""
        return centred(x, self.n, self.totals) @ self.components[:, : self.known] / np.sqrt(self.values[: self.known])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)**2, exact for numbers of any size."""
        whole, rest = ([f(s, self.n) for s in self.totals] for f in (int.__floordiv__, int.__mod__))
        away = x - np.array(whole, dtype=np.int64)
        most = (self.n * int(np.abs(away).max(initial=0)) + self.n) ** 2 * max(1, len(whole))
        kind = np.int64 if most < 2**63 else object
        scaled = away.astype(kind) * self.n - np.array(rest, dtype=kind)
        return [int(v) for v in (scaled * scaled).sum(axis=1)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable rows of vectors (v_); None if there are none, or no dimensions."""
    n, totals = sums(vectors)
    if not n or not totals:
        return None
    v = covariance(vectors, n, totals)
    values, found = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    return Whitening(n, totals, found[:, order], values[order], float(np.trace(v)))


def identity_error(vectors: DataFrame, fitted: Whitening) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, measured on all rows.

    A batch is centred on its own mean before multiplying; batches are put together by their means.
    """
    k = fitted.known
    if not k:
        return None

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = usable(batch.column("v_"))
            if not len(x):
                continue
            y = fitted.project(x)
            own = y.mean(axis=0)
            off, both = own - mean, n + len(y)
            spread += (y - own).T @ (y - own) + np.outer(off, off) * (n * len(y) / both)
            n, mean = both, mean + off * (len(y) / both)
        rows = np.concatenate([(n * mean), (spread + n * np.outer(mean, mean)).ravel()]) if n else np.array([])
        yield pa.RecordBatch.from_pydict({"at": list(range(len(rows))), "part": rows.tolist()}, schema=pa.schema([("at", pa.int32()), ("part", pa.float64())]))

    with small_batches(vectors.sparkSession):
        rows = vectors.mapInArrow(measure, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).collect()
    told = np.zeros(k + k * k)
    for at, total in rows:
        told[at] = total / fitted.n
    mean, second = told[:k], told[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


def whiten(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """key_, deviation and whitened, an entry a component, of each usable row of vectors (key_, v_)."""
    missing = [None] * (len(fitted.values) - fitted.known)
    key = vectors.schema["key_"].dataType

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = usable(batch.column("v_"))
            if not len(x):
                continue
            rows = [[*y, *missing] for y in fitted.project(x).tolist()]
            told = [Decimal(v) if v < 10**38 else None for v in fitted.deviation(x)]
            yield pa.RecordBatch.from_arrays([batch.column("key_").filter(pa.array(kept)), pa.array(told, pa.decimal128(38, 0)), pa.array(rows, pa.list_(pa.float64()))], names=["key_", *WHITENED.names])

    return vectors.select("key_", "v_").mapInArrow(put, T.StructType([T.StructField("key_", key), *WHITENED.fields]))


def op11(spark, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    from tessera.session import table

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key_"), F.col("embedding").alias("v_"))
    return whitened_rows(vectors)


def whitened_rows(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The rows of op11 for vectors (key_, v_)."""
    fitted = fit(vectors, components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, fitted)
    each = whiten(vectors, fitted).select("key_", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*(F.lit(e).cast("double") for e in fitted.explained))
    return each.select(F.col("key_").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened", share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
