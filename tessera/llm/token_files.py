"""Token-id files: fixed-size blocks of ids, transposed to byte planes, zstandard, a chunk index.

File ``*.tpk`` (all integers little-endian)::

    b"TPK1"                                      magic
    blocks: the planes of each block, one zstandard frame a plane
    documents: one zstandard frame of int64 n_tokens, in document order
    keys: one zstandard frame of int64 doc ids and one byte each for null
    index: per block uint64 offset, uint32 ids, PLANES x uint32 frame length
    footer: uint64 offset of documents, keys, index; uint32 blocks; uint64 documents, ids; b"TPK1"

A block holds BLOCK_IDS ids (the last of a file fewer). Its ids as unsigned 32-bit integers are
transposed to four byte planes, so the high planes, nearly constant, compress to almost nothing;
any block can be read alone through the index.

Documents are dealt to files by ranges of doc_id, so files in order and documents in each are in
ascending doc_id order. Files go to the shared folder under a name of the attempt; the listing that
the writing job returns names the files that count, so a lost or repeated task leaves only strays.

Defined results: a null or empty text has only the end id; null doc ids come first; rows with equal
doc_id are ordered by their text and all kept; very long texts span blocks; extra columns don't
matter; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import small_batches, tidy
from tessera.llm.files import delete, open_input, open_output
from tessera.session import cut, planned_bytes, shared_dir, shuffle_partitions

MAGIC = b"TPK1"
PLANES = 4
BLOCK_IDS = 1 << 17
FOOTER = struct.Struct("<QQQIQQ4s")
ENTRY = struct.Struct(f"<QI{PLANES}I")
END_ID = 2
#: Bytes of a file's texts, about, by the plan's own estimate.
FILE_BYTES = 128 << 20
#: Pre-tokens that each worker keeps with their ids.
MEMO_PIECES = 250_000


#: The pre-tokens of a byte-level BPE for texts of letters, decimal digits, white space and what is none of these.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CONTROLS = frozenset("\x1c\x1d\x1e\x1f")


class _Unsure(Exception):
    """A pre-token holds characters that re may class otherwise than the library does."""


def _unsure(piece: str) -> bool:
    """Whether a pre-token holds such a character: separators, numbers that are no decimal digits, unassigned ones."""
    if piece.isascii():
        return not _CONTROLS.isdisjoint(piece)
    return any(c in _CONTROLS or (c.isalnum() and not c.isalpha() and not c.isdecimal()) or unicodedata.category(c) == "Cn" for c in piece)


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level BPE: printable ones stand for themselves, the rest
    take code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Memo(dict):
    """The ids of pre-tokens, each encoded when it is first met; none that is unsure is ever kept."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if _unsure(piece):
            raise _Unsure
        ids = [t.id for t in self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < MEMO_PIECES:
            self[piece] = packed
        return packed


class Encoder:
    """The tokenizers library, with each distinct pre-token of a worker encoded once by its model.

    A byte-level BPE never merges across pre-tokens, so the ids of a text are those of its
    pre-tokens, joined. Texts with an unsure pre-token, or with the name of a special token, which the
    library gives an id of its own, are encoded by the library as they are. What a text's ids are
    depends on nothing but the text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.named = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = _Memo(self.tokenizer.model)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, ids_of, named = [], self.memo.__getitem__, self.named
        for text in texts:
            try:
                if not text:
                    out.append(b"")
                elif any(name in text for name in named):
                    out.append(self._plain(text))
                else:
                    out.append(b"".join(map(ids_of, _FAST.findall(text))))
            except _Unsure:
                out.append(self._plain(text))
        return out


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(name if "/" in name else public_tokenizers.path(name))


def pack(ids: np.ndarray) -> list[bytes]:
    """The planes of one block, each a zstandard frame."""
    planes = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, PLANES).T)
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(p.tobytes()) for p in planes]


def unpack(frames: list[bytes], n: int) -> np.ndarray:
    opened = zstandard.ZstdDecompressor()
    planes = [np.frombuffer(opened.decompress(f, max_output_size=n), dtype=np.uint8) for f in frames]
    return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()


class Writer:
    """Streams documents into one file; holds at most a block of ids and a number per document."""

    def __init__(self, out, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.block_ids = out, block_ids
        self.at = out.write(MAGIC)
        self.held: list[bytes] = []
        self.held_ids = 0
        self.index: list[tuple] = []
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ids = 0

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        at = self.at
        self.index.append((at, len(ids), *(self._put(f) for f in pack(ids))))

    def add(self, keys: list[int | None], encoded: list[bytes]) -> None:
        self.sizes.append(np.array([len(e) // 4 for e in encoded], dtype="<i8"))
        self.keys.append(np.array([0 if k is None else k for k in keys], dtype="<i8"))
        self.nulls.append(np.array([k is None for k in keys], dtype=np.uint8))
        for e in encoded:
            self.held.append(e)
            self.held_ids += len(e) // 4
            if self.held_ids >= self.block_ids:
                ids = np.frombuffer(b"".join(self.held), dtype="<u4")
                full = len(ids) // self.block_ids * self.block_ids
                for k in range(0, full, self.block_ids):
                    self._block(ids[k : k + self.block_ids])
                self.held, self.held_ids = [ids[full:].tobytes()], len(ids) - full
        self.ids += int(self.sizes[-1].sum())

    def finish(self) -> None:
        if self.held_ids:
            self._block(np.frombuffer(b"".join(self.held), dtype="<u4"))
        squeeze = zstandard.ZstdCompressor(level=1)
        join = lambda parts, kind: (np.concatenate(parts) if parts else np.array([], dtype=kind)).tobytes()
        docs_at = self.at
        self._put(squeeze.compress(join(self.sizes, "<i8")))
        keys_at = self.at
        self._put(squeeze.compress(join(self.keys, "<i8") + join(self.nulls, np.uint8)))
        index_at = self.at
        self._put(b"".join(ENTRY.pack(*e) for e in self.index))
        self._put(FOOTER.pack(docs_at, keys_at, index_at, len(self.index), sum(map(len, self.sizes)), self.ids, MAGIC))
        self.out.close()


class Reader:
    """Reads a file by its index; a block at a time."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(source.size() - FOOTER.size)
        docs_at, keys_at, index_at, blocks, self.documents, self.ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        opened = zstandard.ZstdDecompressor()
        sizes = opened.decompress(self._at(docs_at, keys_at - docs_at), max_output_size=8 * self.documents + 1)
        keys = opened.decompress(self._at(keys_at, index_at - keys_at), max_output_size=9 * self.documents + 1)
        self.sizes = np.frombuffer(sizes, dtype="<i8")
        self.keys = np.frombuffer(keys[: 8 * self.documents], dtype="<i8")
        self.nulls = np.frombuffer(keys[8 * self.documents :], dtype=np.uint8)
        raw = self._at(index_at, blocks * ENTRY.size)
        self.index = [ENTRY.unpack_from(raw, k * ENTRY.size) for k in range(blocks)]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        offset, n, *lengths = self.index[k]
        raw, frames, at = self._at(offset, sum(lengths)), [], 0
        for length in lengths:
            frames.append(raw[at : at + length])
            at += length
        return unpack(frames, n)

    def documents_ids(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Key, size and the pieces of each document's ids; the pieces must be taken in turn."""
        held, at, k = np.array([], dtype="<u4"), 0, 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal held, at, k
            while n:
                if at == len(held):
                    held, at, k = self.block(k), 0, k + 1
                part = held[at : at + n]
                at += len(part)
                n -= len(part)
                yield part

        for key, null, size in zip(self.keys.tolist(), self.nulls.tolist(), self.sizes.tolist(), strict=True):
            yield None if null else key, size, pieces(size)


LISTING = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("ids", T.LongType())])
DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", block_ids: int = BLOCK_IDS, files: int | None = None) -> list[tuple]:
    """Encode docs (doc_id, text) and write their files; the listing (shard, path, documents, ids).

    The listing has one entry a file, so its size is that of the partitioning, not of the data.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        shard, writer, path = context.partitionId(), None, ""
        known = encoder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                if writer is None:
                    path = f"{folder}/ids-{shard:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tpk"
                    writer = Writer(open_output(path), block_ids)
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                writer.add([None if n else int(k) for k, n in zip(part["doc_id"], part["null_"], strict=True)], [e + end for e in known.encode(texts)])
        if writer is not None:
            writer.finish()
            tidy()
            yield pd.DataFrame([(shard, path, sum(map(len, writer.sizes)), writer.ids)], columns=LISTING.names)

    n = files or max(shuffle_partitions(docs.sparkSession), planned_bytes(docs) // FILE_BYTES + 1)
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("null_"), "text")
    order = (F.desc("null_"), F.asc("doc_id"), F.xxhash64("text"), F.asc("text"))
    dealt = rows.repartitionByRange(n, *order[:3]).sortWithinPartitions(*order)
    with small_batches(docs.sparkSession):
        return sorted(tuple(r) for r in dealt.mapInPandas(write, LISTING).collect())


def read_files(spark, listing: list[tuple]) -> DataFrame:
    """Digest of every document, from the files alone; a task a file."""
    if not listing:
        return spark.createDataFrame([], DIGEST)
    # a few numbers a file, of which there is one for FILE_BYTES of text
    rows, start = [], 0
    for _, path, _, ids in sorted(listing):
        rows.append((path, start))
        start += ids

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, at in zip(batch["path"], batch["start"], strict=True):
                with open_input(path) as source:
                    out, begin = [], int(at)
                    for key, size, pieces in Reader(source).documents_ids():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece.tobytes(), crc)
                        out.append((key, begin, size, crc & 0xFFFFFFFF))
                        begin += size
                        if len(out) == 20_000:
                            yield _frame(out)
                            out = []
                    yield _frame(out)

    listed = spark.sparkContext.parallelize(rows, len(rows)).toDF("path string, start long")
    return listed.mapInPandas(read, DIGEST)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=DIGEST.names)
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def token_digest(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the files of docs to the shared folder and return the digest read back from them.

    The files go once they are read; write_files keeps them for whoever wants the ids.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    out = cut(read_files(spark, write_files(docs, folder, vocabulary)))
    delete(spark, folder)
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its token files."""
    from tessera.session import table

    return token_digest(table(spark, sf_dir, "documents"))
