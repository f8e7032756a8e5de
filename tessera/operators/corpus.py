"""Chunking and vocabulary over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators.ranking import ordered_rank
from tessera.session import cut, freed_shuffles, shuffle_partitions


def word_chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, chunk_index, chunk_id, content and ids (positions of the words) of each window of words."""
    words = docs.select(key, X.words(text).alias("words_"))
    parts = words.select(key, F.posexplode(X.windows(F.col("words_"), size)).alias("chunk_index", "part_"))
    first = F.col("chunk_index") * size
    return parts.select(
        key,
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.format_string("%s_chunk%d", F.col(key).cast("string"), "chunk_index").alias("chunk_id"),
        F.array_join("part_", " ").alias("content"),
        F.sequence(first, first + F.size("part_") - 1).alias("ids"),
    )


#: Pieces that a task's dictionary holds before it is passed on, and tokens of a text that come to it in one row.
DICTIONARY_PIECES = 100_000
ROW_TOKENS = 64


def _coded(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, list[str], list[tuple]]:
    """A batch (key_, index_, pieces) in order, null keys first; codes of its pieces, and the piece and first place of each code."""
    order = pc.sort_indices(pa.Table.from_batches([batch.select(["key_", "index_"])]), [("key_", "ascending"), ("index_", "ascending")], null_placement="at_start")
    batch = batch.take(order)
    lists = batch.column("pieces")
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    known, first = np.unique(codes, return_index=True)  # the first in this order
    row = np.searchsorted(ends, first, side="right")
    keys, index = (batch.column(c).take(pa.array(row)).to_pylist() for c in ("key_", "index_"))
    places = zip([k is not None for k in keys], keys, index, (first - np.r_[0, ends[:-1]][row]).tolist(), strict=True)
    return batch, codes, coded.dictionary.take(pa.array(known)).to_pylist(), list(places)


def _dictionary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pieces of each part with the least (key, index, pos) that each stands at, null keys first; a piece may come more than once."""
    known: dict[str, tuple] = {}
    part, schema = None, None

    def told() -> pa.RecordBatch:
        _, keys, index, pos = zip(*known.values(), strict=True)
        out = pa.RecordBatch.from_arrays([pa.array([part] * len(known), pa.int64()), pa.array(known, pa.string()), pa.array(keys, schema.field("key_").type), pa.array(index, pa.int64()), pa.array(pos, pa.int64())], names=["part_", "piece", "key_", "index_", "pos"])
        known.clear()
        return out

    for whole in batches:
        schema = whole.schema
        for of in whole.column("part_").unique().to_pylist():
            batch = whole.filter(pc.equal(whole.column("part_"), of))
            if known and of != part:
                yield told()
            part = of
            _, _, pieces, places = _coded(batch)
            for piece, place in zip(pieces, places, strict=True):
                if piece not in known or place < known[piece]:
                    known[piece] = place
                if len(known) >= DICTIONARY_PIECES:
                    yield told()
    if known:
        yield told()


def _dictionaries(pieces: DataFrame) -> DataFrame:
    """part_, piece, and key_, index_ and pos of its first place, for each part of pieces (part_, key_, index_, pieces)."""
    kind = pieces.schema["key_"].dataType
    return pieces.mapInArrow(_dictionary, T.StructType([T.StructField("part_", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("key_", kind), T.StructField("index_", T.LongType()), T.StructField("pos", T.LongType())]))


def _numbers(dictionaries: DataFrame) -> DataFrame:
    """piece and token_id, from 1 on in order of first places."""
    first = dictionaries.groupBy("piece").agg(F.min(F.struct("key_", "index_", "pos")).alias("first_"))
    return ordered_rank(first, ["first_"], name="token_id").select("piece", "token_id")


def vocabulary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """piece and token_id, numbered from 1 by first appearance in order of (key, position), null keys first.

    Texts come in rows of few tokens, so a batch is small whatever its texts are. Each partition makes
    dictionaries of its own, which are merged to the first places.
    """
    tokens = docs.select(F.col(key).alias("key_"), X.tokens(text).alias("tokens_"))
    rows = tokens.select("key_", F.posexplode(X.windows(F.col("tokens_"), ROW_TOKENS)).alias("index_", "pieces"), F.lit(0).cast("long").alias("part_"))
    return _numbers(_dictionaries(rows.withColumn("index_", F.col("index_").cast("long"))))


def token_chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, chunk_index, content and pieces of each window of tokens that isn't blank."""
    tokens = docs.select(key, X.tokens(text).alias("tokens_"))
    parts = F.filter(X.windows(F.col("tokens_"), size), lambda w: F.trim(F.array_join(w, " ")) != "")
    return tokens.select(key, F.posexplode(parts).alias("chunk_index", "pieces")).select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join("pieces", " ").alias("content"), "pieces")


#: Chunks of a partition that make a part, unless their pieces fill a dictionary before.
PART_CHUNKS = 1 << 14
#: Chunks that are coded at once, so few pieces come to a dictionary before it is seen to be full.
CODED_CHUNKS = 1 << 11
#: Words of a part that are unpacked into one batch.
BATCH_WORDS = 1 << 14


def _parted(chunks: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts of at most so many chunks (key_, index_, pieces), a row each: its chunks' pieces as packed codes, and its packed words by code."""

    def parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[str, int] = {}
        first: list[tuple] = []
        held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]] = []  # keys and places, sizes, codes

        def told() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches([b for b, _, _ in held])
            sizes = pa.concat_arrays([s for _, s, _ in held])
            codes = pa.compress(np.concatenate([c for _, _, c in held]).tobytes(), codec="zstd", asbytes=True)
            _, keys, index, pos = zip(*first, strict=True) if first else ((),) * 4
            kind = rows.schema.field("key_").type
            words = pa.RecordBatch.from_arrays([pa.array(known, pa.string()), pa.array(keys, kind), pa.array(index, pa.int64()), pa.array(pos, pa.int64())], names=["piece", "key_", "index_", "pos"])
            packed = pa.BufferOutputStream()
            with pa.ipc.new_stream(packed, words.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(words)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            lists = [one(pa.concat_arrays(rows[c].chunks)) for c in ("key_", "index_")]
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, one(sizes), pa.array([codes], pa.binary()), pa.array([packed.getvalue().to_pybytes()], pa.binary())], names=["part_", "keys", "indexes", "sizes", "codes", "words"])
            number += 1
            for x in (known, first, held):
                x.clear()
            return out

        n = 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch, codes, pieces, places = _coded(whole.slice(at, min(chunks - n, CODED_CHUNKS)))
                at, n = at + batch.num_rows, n + batch.num_rows
                for piece, place in zip(pieces, places, strict=True):
                    code = known.setdefault(piece, len(known))
                    if code == len(first):
                        first.append(place)
                    elif place < first[code]:
                        first[code] = place
                sizes = pc.fill_null(pc.list_value_length(batch.column("pieces")), 0)
                held.append((batch.select(["key_", "index_"]), sizes, np.array([known[p] for p in pieces], np.int32)[codes]))
                if n >= chunks or len(known) >= DICTIONARY_PIECES:
                    yield told()
                    n = 0
        if held:
            yield told()

    return parted


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part_, code, piece and its first place in the part, of parts (part_, words)."""
    for batch in batches:
        for part, packed in zip(batch.column("part_"), batch.column("words"), strict=True):
            with pa.ipc.open_stream(packed.as_buffer()) as stream:
                words = stream.read_all()
            codes = pa.array(np.arange(words.num_rows), pa.int32())
            for some in words.add_column(0, "code", codes).add_column(0, "part_", pa.repeat(part, words.num_rows)).to_batches(BATCH_WORDS):
                yield some


def _numbered(chunks: pa.Table, words: pa.Table) -> pa.Table:
    """A part's chunks with the ids of their pieces, looked up by code in the part's own words."""
    names = ["key_", "index_", "token_ids"]
    made = []
    for part in chunks.to_batches():
        keys, index, sizes = (part.column(c).flatten() for c in ("keys", "indexes", "sizes"))
        ends = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))]
        packed = part.column("codes")[0].as_buffer()
        codes = np.frombuffer(pa.decompress(packed, decompressed_size=int(ends[-1]) * 4, codec="zstd"), np.int32)
        by_code = pc.index_in(pa.array(np.arange(codes.max(initial=-1) + 1), pa.int32()), value_set=words["code"].combine_chunks())
        ids = words["token_id"].combine_chunks().take(by_code).take(pa.array(codes))
        made.append(pa.RecordBatch.from_arrays([keys, index, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=names))
    key = chunks.schema.field("keys").type.value_type
    return pa.Table.from_batches(made, pa.schema(list(zip(names, (key, pa.int64(), pa.list_(pa.int64())), strict=True))))


def with_token_ids(chunks: DataFrame, key: str, vocab: DataFrame | None = None) -> DataFrame:
    """key, chunk_index and token_ids of chunks (key, chunk_index, pieces).

    Chunks are written once, where they are made, as parts: a part is a row with PART_CHUNKS of a
    partition's chunks, the pieces as codes of the part's own dictionary, so it takes less room than the
    texts. The dictionaries meet the vocabulary given, or that of all parts; then ids are put in by whole
    columns from the part's dictionary. So a common piece is looked up once a part, no text is shuffled
    and no document is gathered.
    """
    of = chunks.schema[key].dataType
    word = T.StructType([T.StructField("part_", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("key_", of), T.StructField("index_", T.LongType()), T.StructField("pos", T.LongType())])
    kind = T.StructType([T.StructField("part_", T.LongType()), T.StructField("keys", T.ArrayType(of)), T.StructField("indexes", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("words", T.BinaryType())])
    parts = cut(chunks.select(F.col(key).alias("key_"), F.col("chunk_index").cast("long").alias("index_"), "pieces").mapInArrow(_parted(PART_CHUNKS), kind))
    words = parts.select("part_", "words").mapInArrow(_words, word)
    if vocab is None:
        with freed_shuffles(chunks.sparkSession):
            vocab = _numbers(words)
    own = words.select("part_", "code", "piece").join(vocab.select("piece", "token_id"), "piece")
    own = own.select(F.col("part_").alias("of_"), "code", F.col("token_id").cast("long").alias("token_id"))
    kind = T.StructType([T.StructField("key_", of), T.StructField("index_", T.LongType()), T.StructField("token_ids", T.ArrayType(T.LongType()))])
    dealt = parts.drop("words").repartition(shuffle_partitions(chunks.sparkSession), "part_")  # few bytes, but much to do
    found = dealt.groupBy("part_").cogroup(own.groupBy("of_")).applyInArrow(_numbered, kind)
    return found.withColumnsRenamed({"key_": key, "index_": "chunk_index"})


def image_chunks(pages: DataFrame, source: Column, path: Column, text: Column, image: Column) -> DataFrame:
    """Records that have an image as chunks without tokens; a blank text is replaced by a description."""
    said = F.trim(text)
    return pages.where(image.isNotNull()).select(
        X.image_chunk_id(source, path).alias("chunk_id"),
        F.coalesce(F.nullif(said, F.lit("")), F.concat(F.lit("Retrieved image from "), source)).alias("text"),
        source.alias("source"),
        F.lit("image").alias("modality"),
        path.alias("image_path"),
        F.lit(0).cast("long").alias("chunk_index"),
    )


def first_queries(load: Callable[[], DataFrame], order: str, n: int, fallback: DataFrame | None = None) -> DataFrame:
    """The first n queries that load gives, in order; all of the fallback's where loading or reading fails, if one is given."""
    try:
        first = load().orderBy(order).limit(n)
        if fallback is not None:
            first.isEmpty()  # a source that can't be read fails here
        return first
    except Exception:
        if fallback is None:
            raise
        return fallback
