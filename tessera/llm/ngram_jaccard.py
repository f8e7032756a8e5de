"""N-gram Jaccard join with several global token orders.

Documents are sets of shingles (SHINGLE words each). Two link when their Jaccard similarity is at
least 4 / 5; the exact join is carried out so that no pair of linked texts is lost:

1. texts are hashed in batches; equal sets of a batch are one class, named by a 128-bit signature.
   Each token (a shingle's hash) is dealt to a part once a batch, and hears how many batches and
   sets have it. The overlap of a link is at least 4 / 5 of either set, so classes in which fewer
   tokens are met elsewhere are done;
2. three global orders put the rarest tokens first and break ties by different hashes. What is left
   of a set beyond the least overlap, and one more, is its prefix; linked sets share a token in
   their prefixes under every order. Candidates by the first order must share prefix tokens under
   the two others before their sets are fetched and counted. Each is a necessary condition;
3. groups of near copies are joined first, each set with a pivot of those that share its least token
   under GROUPINGS hashes, then a prefix token, so that a group isn't expanded into its pairs; once
   the components of these links are known, candidates are pairs of different components.

Nothing gathers what shares a token: a batch sends a token once, however many of its sets have it,
with their number; its sets are told in the batch's own part.

Defined results: texts of fewer than SHINGLE words are one shingle, the whole sequence; null texts
and texts without words have no shingles and link with nothing, their component is their own
doc_id; rows with equal ids are rows of their own; a component's id is its smallest doc_id, null
only if all are null; very long texts are whole; extra columns stay out; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches, tidy
from tessera.llm.files import delete
from tessera.llm.graph import connected_components
from tessera.session import cut, freed_shuffles, only_shuffles, shared_dir, shuffle_partitions

SHINGLE = 5
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles in a part, about; bytes of text for a shingle, at least, by which parts are counted.
PART_SHINGLES = 2_000_000
SHINGLE_BYTES = 4
#: Shingles and sets in a batch of a map task, and entries in a packed row.
BATCH_SHINGLES = 1_000_000
BATCH_SETS = 65_535
ROW_ENTRIES = 4_000_000
#: Seeds of the three orders, and of the hashes that group near copies.
ORDERS = (0x5851F42D4C957F2D, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
GROUPINGS = (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xD6E8FEB86659FD93)#: Bytes of text that are hashed at once.
PIECE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S32
    return h


def _power(base: int, n: int) -> np.ndarray:
    """The powers of a base modulo 2**64, from 0 to n - 1."""
    if len(_powers.get(base, ())) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data (bytes with white space last) begins, and its 64-bit hash.

    A word's hash is its polynomial in the base, taken from running sums over all bytes, divided by
    the power at its begin (the base is odd, so it has an inverse), then mixed.
    """
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    return begin, _mix((total[end] - total[begin]) * _power(_INVERSE, n)[begin])


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    raw, held = [], 0
    for text in texts:
        raw.append(text.encode("utf-8", "surrogatepass") if text else b"")
        held += len(raw[-1])
        if held >= PIECE_BYTES:
            yield from _piece_sets(raw)
            raw, held = [], 0
    if raw:
        yield from _piece_sets(raw)


def _piece_sets(raw: list[bytes]) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(r) + 1 for r in raw])
    begin, words = word_hashes(np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8))
    cuts = np.searchsorted(begin, ends)
    full = words + np.uint64(SHINGLE)
    for k in range(1, SHINGLE):
        full = full[: len(full) - 1] if len(full) > max(0, len(words) - k) else full
        full = full * _M1
        full ^= full >> _S29
        full = full + words[k : k + len(full)]
    full = _mix(full)
    low = 0
    for high in cuts.tolist():
        n = high - low
        yield np.unique(full[low : high - SHINGLE + 1]) if n >= SHINGLE else _short(words[low:high])
        low = high


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle; none without words."""
    if not len(words):
        return words
    h = words[:1] + np.uint64(len(words))
    for k in range(1, len(words)):
        h = h * _M1
        h ^= h >> _S29
        h = h + words[k]
    return _mix(h)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums of different mixes, as signed integers; they don't depend on the order."""
    a, b = _mix(tokens, 0x5851F42D4C957F2D).sum(dtype=np.uint64), _mix(tokens, 0x14057B7EF767814F).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def least_overlap(total: int) -> int:
    """The least intersection of two linked sets with ``total`` elements together."""
    return -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


# Packed rows: what a batch sends to a part of the tokens, or to its own part, its home.
PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("source", pa.int32()), ("owners", pa.binary()), ("tokens", pa.binary()), ("levels", pa.binary())])
PACKED_DDL = "part int, kind int, batch long, source int, owners binary, tokens binary, levels binary"
#: A batch's sets and its documents; its tokens of one set, of several, and the latter with their sets; replies to the first two.
SETS, ROWS, ONE, MANY, OWNED, ONE_SAYS, MANY_SAYS = range(7)
SET = np.dtype([("sig", "<i8"), ("sig2", "<i8"), ("n", "<i8")])
ROW = np.dtype([("owner", "<i4"), ("null", "u1"), ("doc_id", "<i8"), ("key_a", "<i8"), ("key_b", "<i8")])
FOUND_DDL = "is_set boolean, doc_id long, key_a long, key_b long, id binary, batch long, n long, shared int, score double, tokens array<long>, first array<long>, second array<int>, third array<int>, groups array<long>"
LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
FOUND = pa.schema(
    [("is_set", pa.bool_()), *((c, pa.int64()) for c in ("doc_id", "key_a", "key_b")), ("id", pa.binary()), ("batch", pa.int64()), ("n", pa.int64()), ("shared", pa.int32()), ("score", pa.float64())]
    + [("tokens", LONGS), ("first", LONGS), ("second", INTS), ("third", INTS), ("groups", LONGS)]
)


def _tokens(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Tokens of which the part, and six bytes beyond it, are all there is; the hashes from 65,536 parts on."""
    return hashes % np.uint64(parts << 48) if parts < 1 << 16 else hashes


def _six(tokens: np.ndarray, parts: int) -> bytes:
    return (tokens // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _row(part: int, kind: int, batch: int, source: int = 0, owners: bytes = b"", tokens: bytes = b"", levels: bytes = b"") -> dict:
    return {"part": part, "kind": kind, "batch": batch, "source": source, "owners": owners, "tokens": tokens, "levels": levels}


def _spans(n: int) -> Iterator[slice]:
    """Rows of at most ROW_ENTRIES entries."""
    return (slice(k, min(k + ROW_ENTRIES, n)) for k in range(0, n, ROW_ENTRIES))


def _by_part(tokens: np.ndarray, parts: int, others: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts with their tokens and what else there is of each, in the order of the latter."""
    if not len(tokens):
        return
    part = (tokens % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((others, part))
    part, tokens, others = part[order], tokens[order], others[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
    for begin, end in zip(edges, [*edges[1:], len(part)], strict=True):
        for span in _spans(end - begin):
            yield int(part[begin]), tokens[begin:end][span], others[begin:end][span]


class _Batch:
    """Documents of a map task and their distinct sets."""

    def __init__(self, number: int) -> None:
        self.number, self.owners, self.sets, self.rows, self.held = number, {}, [], [], 0

    def add(self, tokens: np.ndarray, doc_id: int | None, key_a: int, key_b: int) -> None:
        owner = -1
        if len(tokens):
            owner = self.owners.setdefault(signature(tokens), len(self.sets))
            if owner == len(self.sets):
                self.sets.append(tokens)
                self.held += len(tokens)
        self.rows.append((owner, doc_id is None, doc_id or 0, key_a, key_b))

    @property
    def full(self) -> bool:
        return self.held >= BATCH_SHINGLES or len(self.rows) >= BATCH_SETS

    def packed(self, parts: int) -> Iterator[dict]:
        table = np.zeros(len(self.sets), dtype=SET)
        for k, ((sig, sig2), tokens) in enumerate(zip(self.owners, self.sets, strict=True)):
            table[k] = sig, sig2, len(tokens)
        # a task that runs again on other rows gives other names, which _gather would notice
        name = int(np.bitwise_xor.reduce(_mix(table["sig"].view(np.uint64), self.number), initial=_mix(np.array([self.number], dtype=np.uint64))[0]).astype(np.int64))
        home = name % parts
        yield _row(home, SETS, name, tokens=table.tobytes())
        for span in _spans(len(self.rows)):
            yield _row(home, ROWS, name, tokens=np.array(self.rows[span], dtype=ROW).tobytes())
        if not self.sets:
            return
        tokens = _tokens(np.concatenate(self.sets), parts)
        owner = np.repeat(np.arange(len(table), dtype=np.uint16), table["n"])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        times = np.diff(np.r_[starts, len(tokens)]).astype(np.uint32)
        many = np.repeat(times > 1, times)  # in several sets of this batch, as a set has a token once
        for part, some, whose in _by_part(tokens[~many], parts, owner[~many]):
            yield _row(part, ONE, name, owners=whose.tobytes(), tokens=_six(some, parts))
        for part, some, counts in _by_part(tokens[starts[times > 1]], parts, times[times > 1]):
            yield _row(part, MANY, name, owners=counts.tobytes(), tokens=_six(some, parts))
        tokens, owner = tokens[many], owner[many]
        for span in _spans(len(tokens)):
            yield _row(home, OWNED, name, owners=owner[span].tobytes(), tokens=tokens[span].tobytes())


def _deal(parts: int):
    """Map tasks: texts with doc_id and keys, packed batch by batch."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held = _Batch(task << 24)
        for batch in batches:
            texts, *rest = (c.to_pylist() for c in batch.columns)
            for tokens, *row in zip(shingle_sets(texts), *rest, strict=True):
                held.add(tokens, *row)
                if held.full:
                    yield pa.RecordBatch.from_pylist(list(held.packed(parts)), schema=PACKED)
                    number += 1
                    held = _Batch((task << 24) + number)
        if held.rows:
            yield pa.RecordBatch.from_pylist(list(held.packed(parts)), schema=PACKED)
        del held
        tidy()

    return deal


def _levels(times: np.ndarray) -> np.ndarray:
    """How frequent a token is, in quarters of powers of two; 0 for what is met once."""
    return np.floor(4 * np.log2(np.maximum(times, 1))).clip(max=255).astype(np.uint8)


def _tell(parts: int):
    """For a part of the tokens: replies to the batches, a level for each token that is met twice or more."""

    def tell(rows: pa.Table) -> pa.Table:
        kinds = rows.column("kind").to_numpy()
        asked = rows.filter(pa.array((kinds == ONE) | (kinds == MANY)))
        passed = rows.filter(pa.array((kinds != ONE) & (kinds != MANY)))
        if not len(asked):
            return passed
        kinds, names = asked.column("kind").to_pylist(), asked.column("batch").to_pylist()
        raw = asked.column("tokens").to_pylist()
        said = asked.column("owners").to_pylist()
        part = asked.column("part")[0].as_py()
        tokens = np.concatenate([_from_six(t) for t in raw])
        times = np.concatenate([np.frombuffer(o, dtype=np.uint32) if k == MANY else np.ones(len(t) // 6, dtype=np.uint32) for k, o, t in zip(kinds, said, raw, strict=True)])
        order = np.argsort(tokens, kind="stable")
        starts = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[0]] ^ np.uint64(1)))
        found = _levels(np.add.reduceat(times[order].astype(np.int64), starts))
        level = np.empty(len(tokens), dtype=np.uint8)
        level[order] = np.repeat(found, np.diff(np.r_[starts, len(tokens)]))
        out, at = [], 0
        for kind, name, owners, six in zip(kinds, names, said, raw, strict=True):
            some = level[at : at + len(six) // 6]
            keep = some > 0
            at += len(some)
            if keep.any():
                whose = np.frombuffer(owners, dtype=np.uint16)[keep].tobytes() if kind == ONE else b""
                kept = np.frombuffer(six, dtype=np.uint8).reshape(-1, 6)[keep].tobytes()
                out.append(_row(name % parts, ONE_SAYS if kind == ONE else MANY_SAYS, name, part, whose, kept, some[keep].tobytes()))
        del tokens, times, order, level
        tidy()
        return pa.concat_tables([passed, pa.Table.from_pylist(out, schema=PACKED)])

    return tell


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.ListType) -> pa.ListArray:
    """Lists of n owners, whose numbers values are sorted by."""
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
    whole = values.view(np.int64) if kind == LONGS else (values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole, kind.value_type))


def _names(table: np.ndarray) -> pa.Array:
    """Both halves of the signature, as bytes."""
    raw = np.ascontiguousarray(np.stack([table["sig"], table["sig2"]], axis=1)).tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(table), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _found(rows: int, /, **columns) -> pa.Table:
    return pa.table({f.name: columns.get(f.name, pa.nulls(rows, f.type)) for f in FOUND}, schema=FOUND)


def _home(name: int, rows: pa.Table, parts: int) -> Iterator[pa.Table]:
    """A batch's documents, and of its sets those that enough of is met elsewhere, with their prefixes."""
    by_kind: dict[int, list[dict]] = {}
    for row in rows.to_pylist():
        by_kind.setdefault(row["kind"], []).append(row)
    if SETS not in by_kind:
        raise RuntimeError("a task that ran again got other rows; write the documents to a table first")
    table = np.frombuffer(by_kind[SETS][0]["tokens"], dtype=SET)
    names = _names(table)
    for row in by_kind.get(ROWS, ()):
        docs = np.frombuffer(row["tokens"], dtype=ROW)
        none = docs["owner"] < 0
        n = np.where(none, 0, table["n"][docs["owner"]] if len(table) else 0)
        ids = names.take(pa.array(docs["owner"], pa.int32(), mask=none))
        yield _found(len(docs), is_set=pa.array(np.zeros(len(docs), dtype=bool)), doc_id=pa.array(docs["doc_id"], mask=docs["null"] > 0), key_a=pa.array(docs["key_a"]), key_b=pa.array(docs["key_b"]), id=ids, n=pa.array(n, pa.int64()))

    whole = lambda r: _from_six(r["tokens"]) * np.uint64(parts) + np.uint64(r["source"])
    join = lambda arrays, kind: np.concatenate([np.array([], dtype=kind), *arrays])
    read = lambda kind, field, to: join([np.frombuffer(r[field], dtype=to) for r in by_kind.get(kind, ())], to)
    tokens, owner, level = join(map(whole, by_kind.get(ONE_SAYS, ())), np.uint64), read(ONE_SAYS, "owners", np.uint16), read(ONE_SAYS, "levels", np.uint8)
    owned, whose = read(OWNED, "tokens", np.uint64), read(OWNED, "owners", np.uint16)
    if len(owned):
        told, said = join(map(whole, by_kind.get(MANY_SAYS, ())), np.uint64), read(MANY_SAYS, "levels", np.uint8)
        order = np.argsort(told)
        tokens, owner, level = np.r_[tokens, owned], np.r_[owner, whose], np.r_[level, said[order][np.searchsorted(told[order], owned)]]
    shared = np.bincount(owner, minlength=len(table))
    enough = (shared > 0) & (DENOMINATOR * shared >= NUMERATOR * table["n"])
    if not enough.any():
        return
    number = np.cumsum(enough) - 1
    keep = enough[owner]
    tokens, owner, level = tokens[keep], number[owner[keep]], level[keep]
    table, shared, m = table[enough], shared[enough], int(enough.sum())
    order = np.argsort(owner, kind="stable")
    tokens, owner, level = tokens[order], owner[order], level[order]
    starts = np.r_[0, np.cumsum(shared)]
    most = shared - (-(-NUMERATOR * table["n"] // DENOMINATOR)) + 1  # words of the prefix
    prefixes = []
    for seed in ORDERS:
        order = np.lexsort((_mix(tokens, seed), level, owner))
        inside = np.arange(len(owner)) - starts[owner] < most[owner]  # owner is sorted, in any order of its tokens
        prefixes.append(_lists(tokens[order][inside], owner[inside], m, LONGS if seed == ORDERS[0] else INTS))
    least = np.stack([np.minimum.reduceat(_mix(tokens, seed), starts[:-1]) for seed in GROUPINGS], axis=1)
    yield _found(
        m,
        is_set=pa.array(np.ones(m, dtype=bool)),
        id=names.filter(pa.array(enough)),
        batch=pa.array(np.full(m, name, dtype=np.int64)),
        n=pa.array(table["n"], pa.int64()),
        shared=pa.array(shared, pa.int32()),
        score=pa.array(np.add.reduceat(level.astype(np.float64), starts[:-1]) / table["n"]),
        tokens=_lists(tokens, owner, m, LONGS),
        first=prefixes[0],
        second=prefixes[1],
        third=prefixes[2],
        groups=_lists(least.ravel(), np.repeat(np.arange(m), len(GROUPINGS)), m, LONGS),
    )


def _gather(parts: int):
    """For a part of the batches: each batch's documents and sets."""

    def gather(rows: pa.Table) -> pa.Table:
        names = rows.column("batch").to_numpy()
        out = [t for name in np.unique(names).tolist() for t in _home(name, rows.filter(pa.array(names == name)), parts)]
        tidy()
        return pa.concat_tables(out)

    return gather


def found_sets(docs: DataFrame, folder: str) -> DataFrame:
    """The documents of docs (text, doc_id, key_a, key_b), and the sets that may link, from a table in folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(shuffle_partitions(spark), size // (SHINGLE_BYTES * PART_SHINGLES) + 1))
    dealt = docs.select("text", "doc_id", "key_a", "key_b").mapInArrow(_deal(parts), PACKED_DDL).repartitionById(parts, F.col("part"))
    told = dealt.groupBy("part").applyInArrow(_tell(parts), PACKED_DDL).repartitionById(parts, F.col("part"))
    told.groupBy("part").applyInArrow(_gather(parts), FOUND_DDL).write.parquet(folder)
    return spark.read.schema(FOUND_DDL).parquet(folder)


def _alike(a: str, b: str) -> Column:
    """Whether sets of these sizes can link."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def linked(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """The links (a, b), with more columns, among pairs: a and b, each the id and the batch of a set."""

    def fetched(rows: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            known = sets.select(F.col("id").alias(f"{side}_id"), F.col("batch").alias(f"{side}_batch"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
            rows = rows.join(known, [f"{side}_id", f"{side}_batch"])
        return rows

    named = pairs.select(F.col("a.id").alias("a_id"), F.col("a.batch").alias("a_batch"), F.col("b.id").alias("b_id"), F.col("b.batch").alias("b_batch"), *more)
    under_all = F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")
    candidates = fetched(named, "second", "third").where(under_all).select(named.columns)
    overlap = F.size(F.array_intersect("a_tokens", "b_tokens"))
    links = fetched(candidates, "n", "tokens").where((NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (F.col("a_n") + F.col("b_n")))
    return links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *more)


def stars(members: DataFrame, *scores: Column) -> DataFrame:
    """pairs of the members (id, batch, n, root, token) of each token with its pivots, those of the highest scores, if their roots differ."""
    best = [F.max(F.struct(score.alias("score"), "id", "batch", "n", "root")).dropFields("score") for score in scores]
    pivots = members.groupBy("token").agg(F.array_distinct(F.array(*best)).alias("pivots"))
    met = members.join(pivots, "token").select("*", F.explode("pivots").alias("p")).where((F.col("root") != F.col("p.root")) & _alike("n", "p.n"))
    return met.groupBy(F.col("id").alias("x"), F.col("p.id").alias("y")).agg(F.max(F.struct("id", "batch")).alias("a"), F.max(F.struct("p.id", "p.batch")).alias("b"))


def cross_pairs(members: DataFrame) -> DataFrame:
    """All pairs of the members of a token whose roots differ, and that the first order's positions allow."""
    x, y = members.alias("x"), members.alias("y")
    least = F.ceil((F.col("x.n") + F.col("y.n")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    in_prefixes = (F.col("x.at") <= F.col("x.shared") - least) & (F.col("y.at") <= F.col("y.shared") - least)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & _alike("x.n", "y.n") & in_prefixes)
    best = F.max(F.struct("x.id", "x.batch")).alias("a"), F.max(F.struct("y.id", "y.batch")).alias("b")
    return pairs.groupBy(F.col("x.id"), F.col("y.id")).agg(*best, F.max("x.root").alias("a_root"), F.max("y.root").alias("b_root"))


def _open(places: DataFrame, roots: DataFrame) -> DataFrame:
    """The places of tokens that sets of different roots (id, root) have."""
    placed = places.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return cut(placed.join(mixed, "token"))


def class_roots(sets: DataFrame) -> DataFrame:
    """id and root, the name of its component, of the sets that link with another one.

    Sets that share their least token under a grouping hash meet its pivot first, the most central
    of them, whose tokens are the most frequent on average: the text that near copies derive from.
    Then the members of each prefix token of the first order meet that token's most central one and
    another, if their pivots so far differ. This joins a group's sets by few links; what is in different components then, and shares
    a prefix token, is compared pair by pair. Equal sets of several batches have one id; the largest
    batch stands for them.
    """
    keys = sets.select("id", "batch", "n", "score", F.col("id").alias("root"), F.explode("groups").alias("token"))
    near = cut(linked(stars(keys, F.col("score")), sets).distinct())
    places = cut(sets.select("id", "batch", "n", "shared", "score", F.posexplode("first").alias("at", "token")))
    pivots = near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    links = near.unionByName(linked(stars(_open(places, pivots), F.col("score"), F.xxhash64("id", "token")), sets))
    roots = cut(connected_components(links).withColumnRenamed("node", "id"))
    # links left over are those of components, of which there are few
    rest = cross_pairs(_open(places, roots))
    named = rest.select("a", "b", F.col("a_root"), F.col("b_root"))
    late = cut(linked(named, sets, "a_root", "b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    if late.isEmpty():
        return roots
    higher = connected_components(late).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = roots.unionByName(late.select(F.col("a").alias("id"), F.col("a").alias("root"))).unionByName(late.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
    return every.join(higher, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits of a row's id and text, by which it is found again without its text."""
    known = (F.coalesce(doc_id, F.lit(-1)), F.col(doc_id).isNull(), F.coalesce(text, F.lit("")), F.col(text).isNull())
    return [F.xxhash64(*known, F.lit(seed)) for seed in (7, 11)]


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, group, key_a and key_b of every row of docs (doc_id, text).

    group names a component whatever the ids are; it is null for rows that link with nothing for
    want of words. The keys are those of row_keys. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/sets-{uuid.uuid4().hex}"
    key_a, key_b = row_keys()
    with small_batches(spark), freed_shuffles(spark), only_shuffles(spark):
        found = found_sets(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), key_a.alias("key_a"), key_b.alias("key_b")), folder)
        roots = class_roots(found.where("is_set"))
        rows = found.where("not is_set").select("doc_id", "n", "id", "key_a", "key_b")
        smallest = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("low"))
        grouped = smallest.join(roots, "id", "left").select("id", "low", F.coalesce("root", "id").alias("root"))
        named = cut(grouped.join(grouped.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("id", "root", "component_id"))
        out = cut(rows.join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("root").alias("group"), "key_a", "key_b"))
    delete(spark, folder)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one document, that of the smallest id, of each component.

    Rows without words all stay, but for repeated rows with the same id and text.
    """
    found = components(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key_a", "key_b")).alias("best")
    chosen = found.where("group is not null").groupBy("group").agg(best).select("best.key_a", "best.key_b")
    chosen = chosen.unionByName(found.where("group is null").select("key_a", "key_b").distinct())
    # no name of docs is used beside the keys', so that none can clash
    key_a, key_b = row_keys()
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row_"), key_a.alias("key_a"), key_b.alias("key_b"))
    return whole.join(chosen, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"]).select("row_.*")


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    from tessera.session import table

    return components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
