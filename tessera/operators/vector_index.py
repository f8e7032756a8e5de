"""An inverted-file index that finds exact best rows by cosine similarity.

Cells are fitted on a bounded sample; every row goes to the cell of its nearest centre, and a cell
keeps how near and how far its rows are. A query first asks the cells nearest to it that hold k rows;
its k-th best score there bounds how far a better row can be, and by the triangle inequality it
then asks all cells that can hold one. So the results are those of asking every row.

Queries and rows are two tables that meet by cell: a cell's rows are dealt to parts of PART_ROWS and
the queries that visit it to parts of PART_QUERIES, so a task holds one part of each, however many
there are and however many fall into one cell. Shipped are only the centres and a few numbers a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vector import unit_rows
from tessera.session import cut

#: Rows that centres are fitted on, chosen by a hash of their name, and the most cells.
SAMPLE_ROWS = 8192
CELLS = 256
#: Rows and queries that a task holds.
PART_ROWS = 16_384
PART_QUERIES = 4096
#: What rounding may make of a distance or a score.
SLACK = 1e-9

_FOUND = pa.schema([("query_id", pa.int64()), ("group_", pa.string()), ("chunk_id", pa.string()), ("modality", pa.string()), ("score", pa.float64())])
FOUND = "query_id long, group_ string, chunk_id string, modality string, score double"


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors without nulls as the rows of a matrix, at unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), dtype=np.float64)
    return unit_rows(flat.reshape(n, len(flat) // n if n else 0))


def has_numbers(vector: str) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def centres_of(sample: np.ndarray, cells: int = CELLS, turns: int = 8) -> np.ndarray:
    """Lloyd's centres of a sample, begun at rows spread over it; empty cells go."""
    if not len(sample):
        return sample
    k = max(1, min(cells, len(sample) // 32))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(turns):
        cell = distances(sample, centres).argmin(axis=1)
        used, cell = np.unique(cell, return_inverse=True)
        sums = np.zeros((len(used), sample.shape[1]))
        np.add.at(sums, cell, sample)
        centres = sums / np.bincount(cell)[:, None]
    return centres


def best_rows(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Each query's k best of these rows by (-score, chunk_id).

    A matrix product picks rows that may be among them; their scores are worked out again one by one,
    so that a pair's score is the same wherever it is computed.
    """
    if not left.num_rows or not right.num_rows:
        return _FOUND.empty_table()
    rows, asked = matrix_of(left["embedding"]), matrix_of(right["vector"])
    names, kinds = left["chunk_id"].to_numpy(), left["modality"].to_numpy()
    groups, ids = right["group_"].to_pylist(), right["query_id"].to_pylist()
    out: list[list] = [[], [], [], [], []]
    for at in range(0, len(asked), 256):
        part = asked[at : at + 256]
        rough = part @ rows.T
        least = np.partition(rough, -k, axis=1)[:, -k] if k < len(rows) else np.full(len(part), -np.inf)
        for j, vector in enumerate(part):
            near = np.flatnonzero(rough[j] >= least[j] - SLACK)
            scores = np.einsum("ij,j->i", rows[near], vector)
            order = np.lexsort((names[near].astype(str), -scores))[:k]
            out[0] += [ids[at + j]] * len(order)
            out[1] += [groups[at + j]] * len(order)
            out[2] += names[near[order]].tolist()
            out[3] += kinds[near[order]].tolist()
            out[4] += scores[order].tolist()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)


@dataclass(frozen=True)
class Cell:
    """Rows of one cell and group: how many, and how near and far from the centre."""

    cell: int
    group: str
    rows: int
    near: float
    far: float


@dataclass(frozen=True)
class VectorIndex:
    """centres, the cells with their numbers, and the rows: cell, group_, number_, chunk_id, modality, embedding."""

    centres: np.ndarray
    cells: list[Cell]
    rows: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, by: str | None = None, cells: int = CELLS) -> VectorIndex:
        """Index chunks (chunk_id, modality, embedding), each value of ``by`` for itself; vectors that are null or hold null or non-finite entries are left out."""
        group = F.coalesce(F.col(by), F.lit("")) if by else F.lit("")
        known = chunks.where(has_numbers("embedding")).select("chunk_id", "modality", "embedding", group.alias("group_"))
        sample = known.select("embedding", F.xxhash64("chunk_id").alias("h_"), "chunk_id").orderBy("h_", "chunk_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
        centres = centres_of(matrix_of(sample["embedding"])) if cells == CELLS else centres_of(matrix_of(sample["embedding"]), cells)

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = 0
            for batch in batches:
                away = distances(matrix_of(batch.column("embedding")), centres)
                cell = away.argmin(axis=1) if batch.num_rows else np.zeros(0)
                added = [pa.array(cell, pa.int32()), pa.array(away.min(axis=1) if batch.num_rows else np.zeros(0), pa.float64()), pa.array(np.arange(at, at + batch.num_rows), pa.int64())]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "cell", "away", "number_"])

        element = known.schema["embedding"].dataType.simpleString()
        rows = cut(known.mapInArrow(assign, f"chunk_id string, modality string, embedding {element}, group_ string, cell int, away double, number_ long"))
        told = rows.groupBy("cell", "group_").agg(F.count("*").alias("rows"), F.min("away").alias("near"), F.max("away").alias("far")).collect()
        return cls(centres, sorted((Cell(*r) for r in told), key=lambda c: (c.cell, c.group)), rows)

    def _visits(self, queries: DataFrame, cells_of: Callable[[np.ndarray, np.ndarray, list], list[list[int]]], extra: list[str]) -> DataFrame:
        """query_id, vector and each cell and group it asks."""
        cells, centres = self.cells, self.centres

        def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = matrix_of(batch.column("vector"))
                asked = cells_of(vectors, distances(vectors, centres), [batch.column(c).to_pylist() for c in extra])
                owner = np.repeat(np.arange(batch.num_rows), [len(a) for a in asked])
                to = [cells[c] for a in asked for c in a]
                taken = [batch.column(c).take(pa.array(owner)) for c in ("query_id", "vector")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array([c.cell for c in to], pa.int32()), pa.array([c.group for c in to], pa.string())], names=["query_id", "vector", "cell", "group_"])

        element = queries.schema["vector"].dataType.simpleString()
        return queries.select("query_id", "vector", *extra).mapInArrow(visit, f"query_id long, vector {element}, cell int, group_ string")

    def _scan(self, visits: DataFrame, k: int) -> DataFrame:
        """Each query's k best rows of every part of the cells it visits.

        A cell's rows meet each part of the queries that visit it, so rows go out as often as their own
        cell has such parts; cells that nobody visits stay where they are.
        """
        spark, visits = self.rows.sparkSession, cut(visits)
        asked = {(r["cell"], r["group_"]): -(-r["n"] // PART_QUERIES) for r in visits.groupBy("cell", "group_").agg(F.count("*").alias("n")).collect()}  # as many as there are cells
        sizes = [(c.cell, c.group, -(-c.rows // PART_ROWS), asked[c.cell, c.group]) for c in self.cells if (c.cell, c.group) in asked]
        parts = F.broadcast(spark.createDataFrame(sizes, "cell int, group_ string, parts int, blocks int"))
        number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        key = ("cell", "group_", "part_", "block_")
        rows = self.rows.join(parts, ["cell", "group_"]).withColumn("part_", F.pmod("number_", F.col("parts")).cast("int")).withColumn("block_", number("blocks"))
        queries = visits.join(parts, ["cell", "group_"]).withColumn("block_", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part_", number("parts"))
        left = rows.select(*key, "chunk_id", "modality", "embedding").groupBy(*key)
        right = queries.select(*key, "query_id", "vector").groupBy(*key)
        return left.cogroup(right).applyInArrow(lambda a, b: best_rows(a, b, k), FOUND)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, group_, chunk_id, modality and score: for each query (query_id, embedding) rows that hold its k best of each group.

        query_ids are distinct; queries without a vector of numbers find nothing.
        """
        spark = self.rows.sparkSession
        queries = queries.where(has_numbers("embedding")).select("query_id", F.col("embedding").alias("vector"))
        groups = sorted({c.group for c in self.cells})
        if not groups:
            return spark.createDataFrame([], FOUND)
        cells, of_group = self.cells, {g: [i for i, c in enumerate(self.cells) if c.group == g] for g in groups}

        def nearest(away: np.ndarray, group: str) -> list[int]:
            """The nearest cells that hold k rows, or all."""
            chosen, held = [], 0
            for i in sorted(of_group[group], key=lambda i: (away[cells[i].cell], i)):
                chosen.append(i)
                held += cells[i].rows
                if held >= k:
                    break
            return chosen

        def first(vectors: np.ndarray, away: np.ndarray, _: list) -> list[list[int]]:
            return [[i for g in groups for i in nearest(a, g)] for a in away]

        def others(vectors: np.ndarray, away: np.ndarray, extra: list) -> list[list[int]]:
            out = []
            for v, a, group, score in zip(vectors, away, *extra, strict=True):
                reach = np.inf if score is None else np.sqrt(max(0.0, float(v @ v) + 1 - 2 * score)) + SLACK
                asked = set(nearest(a, group))
                out.append([i for i in of_group[group] if i not in asked and max(a[cells[i].cell] - cells[i].far, cells[i].near - a[cells[i].cell]) <= reach])
            return out

        begun = cut(self._scan(self._visits(queries, first, []), k))
        place = Window.partitionBy("query_id", "group_").orderBy(F.desc("score"), "chunk_id")
        kth = begun.withColumn("place_", F.row_number().over(place)).where(F.col("place_") <= k)
        bound = kth.groupBy("query_id", "group_").agg(F.min(F.when(F.col("place_") == k, F.col("score"))).alias("bound_"))
        rest = self._visits(queries.join(bound, "query_id"), others, ["group_", "bound_"])
        return begun.unionByName(self._scan(rest, k))
