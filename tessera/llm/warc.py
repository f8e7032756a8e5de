"""WARC archives: a writer of gzip members and a Python data source that reads them.

The data source plans one partition a file, reads each record's headers first, applies pushed-down
predicates on the record type and on named headers to them, and only then decodes the payload, if
it is wanted at all. Members written here carry their length in gzip's extra field (subfield ``sl``:
compressed and plain length, little-endian), so the payload of a record that isn't wanted is not
even decompressed; members of other writers are read through.

Equal payloads are stored once: the record with the largest page_id is the response, the others are
revisit records that name it, with the payload's digest and, in their HTTP header, its length.

Defined results: a null html has an empty payload; a null page_id or url leaves its header out and
reads back as null; rows that share payload and the largest page_id are all responses, since any of
them holds the payload; where all page_ids of a payload are null, all are responses; very long
payloads are one record each; an archive that ends within a record is an error that names its byte;
an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tessera.llm.files import delete, listing, open_input, open_output
from tessera.session import cut, shared_dir

DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
SUBFIELD = struct.Struct("<2sHII")
HEAD = struct.Struct("<4sIBBH")
#: Read from a file at once.
CHUNK = 1 << 20
#: Bytes at which a file is closed.
FILE_BYTES = 128 << 20

SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
# Columns and the WARC headers that they show.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(block: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length in the extra field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(block) + squeeze.flush()
    extra = SUBFIELD.size
    whole = HEAD.size + extra + len(body) + 8
    return HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, extra) + SUBFIELD.pack(b"sl", 8, whole & 0xFFFFFFFF, len(block) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """A header value on one line; what would break the line is percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "\r\n") else value


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, full_digest: str) -> bytes:
    """A response record, or a revisit record if refers_to names the response."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = f"{URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{full_digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Members:
    """Walks a file record by record: headers, then a call that takes or skips the block."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size, self.at = source, size, 0
        self.held, self.held_at = b"", 0

    def _bytes(self, at: int, n: int) -> bytes:
        if not (self.held_at <= at and at + n <= self.held_at + len(self.held)):
            self.source.seek(at)
            self.held, self.held_at = self.source.read(max(n, CHUNK)), at
        return self.held[at - self.held_at : at - self.held_at + n]

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while self.at < self.size:
            gz = self._bytes(self.at, 2) == b"\x1f\x8b"
            plain = self._inflate() if gz else self._plain()
            head = b""
            for part in plain:
                head += part
                if b"\r\n\r\n" in head:
                    break
            head, _, rest = head.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                if not head.strip():
                    return
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length, start = int(headers["content-length"]), self.at

            def block(rest=rest, plain=plain, length=length, start=start):
                part, left = rest, length
                while True:
                    yield part[:left]
                    left -= len(part[:left])
                    if left <= 0:
                        return
                    part = next(plain, None)
                    if part is None:
                        raise ValueError(f"an archive ends within the record at byte {start}")

            taken = block()
            yield headers, taken
            if gz:
                if self.known:
                    self.at = start + self.known
                else:
                    for _ in plain:
                        pass
                    self.at = self.end
            else:
                self.at = start + len(head) + 4 + length + 4

    def _plain(self) -> Iterator[bytes]:
        at = self.at
        while at < self.size:
            part = self._bytes(at, min(CHUNK // 16, self.size - at))
            at += len(part)
            yield part

    def _inflate(self) -> Iterator[bytes]:
        """Decompress one member bit by bit; its end goes to self.end, a told length to self.known."""
        self.known = 0
        fixed = self._bytes(self.at, min(HEAD.size + SUBFIELD.size, self.size - self.at))
        if len(fixed) == HEAD.size + SUBFIELD.size and fixed[3] & 4 and fixed[12:14] == b"sl":
            self.known = SUBFIELD.unpack(fixed[HEAD.size :])[2]

        def parts() -> Iterator[bytes]:
            opened, at, step = zlib.decompressobj(31), self.at, 2048
            while at < self.size and not opened.eof:
                part = self._bytes(at, min(step, self.size - at))
                at += len(part)
                step = CHUNK // 4
                out = opened.decompress(part, step)
                while out or opened.unconsumed_tail:
                    yield out
                    out = opened.decompress(opened.unconsumed_tail, step) if opened.unconsumed_tail else b""
            self.end = at - len(opened.unused_data)

        return parts()


class _File(InputPartition):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, set]] = []

    def pushFilters(self, filters: list) -> Iterable:
        """Takes equality and membership on columns that show headers; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, EqualTo) and name in HEADERS:
                self.tests.append((name, {f.value}))
            elif isinstance(f, In) and name in HEADERS:
                self.tests.append((name, set(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(path, size) for path, size in listing(self.path, (".warc", ".warc.gz"))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        with open_input(partition.path) as source:
            for headers, block in _Members(source, partition.size):
                row = [headers.get(HEADERS[c]) for c in HEADERS]
                row[1], row[5] = (v.strip("<>") if v else v for v in (row[1], row[5]))
                if row[4]:
                    row[4] = row[4].removeprefix("sha1:")
                if not all(row[list(HEADERS).index(c)] in allowed for c, allowed in self.tests):
                    continue
                n, payload = self._payload(headers, block)
                held.append((*row, n, payload))
                weight += len(payload or b"") + 200
                if weight > 4 << 20:
                    yield _batch(held)
                    held, weight = [], 0
        if held:
            yield _batch(held)

    def _payload(self, headers: dict[str, str], block: Iterator[bytes]) -> tuple[int | None, bytes | None]:
        """Length from the HTTP header of the block, and the payload if it is wanted and there."""
        if not headers.get("content-type", "").startswith("application/http"):
            n = int(headers["content-length"])
            return n, b"".join(block) if self.payload else None
        head, parts = b"", []
        for part in block:
            head += part
            if b"\r\n\r\n" in head:
                break
        head, _, rest = head.partition(b"\r\n\r\n")
        lengths = [x.partition(b":")[2] for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        n = int(lengths[0]) if lengths else int(headers["content-length"]) - len(head) - 4
        if not self.payload or headers.get("warc-type") == "revisit":
            return n, None
        parts = [rest, *block]
        return n, b"".join(parts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if f.name == "payload_length" else pa.binary() if f.name == "payload" else pa.string() for f in SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SCHEMA.names)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option payload=false leaves payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives; filters on record type and headers are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])


def write(pages: DataFrame, folder: str) -> int:
    """Write pages (page_id, url, html) as archives into folder; the number of records.

    Only digests and ids are grouped, and digests met twice written; pages join them by a plain
    shuffle on both sides, which AQE splits where one payload is very common. A file is closed at
    FILE_BYTES and another begun, so files, and the partitions that read them, stay alike. Files are
    first written under a hidden name of the attempt, and renamed by the driver once the job has
    ended, so strays are never read.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("hex", F.sha1("body"))
    twice = rows.groupBy("hex").agg(F.max("page_id").alias("response"), F.count("*").alias("times")).where("times > 1").drop("times")
    refers = F.when(F.col("page_id") == F.col("response"), F.lit(None).cast("long")).otherwise(F.col("response"))
    bodies = rows.join(cut(twice), "hex", "left").select("page_id", "url", "body", "hex", refers.alias("refers"))
    limit = FILE_BYTES

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, path, n, weight = TaskContext.get(), None, "", 0, 0
        told = lambda: pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
        for batch in batches:
            for page_id, url, body, code, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, weight = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                    out = open_output(path + ".part")
                whole = member(record(page_id, url, body, refers, base64.b32encode(bytes.fromhex(code)).decode()))
                out.write(whole)
                n, weight = n + 1, weight + len(whole)
                if weight >= limit:
                    out.close()
                    out = None
                    yield told()
        if out is not None:
            out.close()
            yield told()

    listed = bodies.mapInArrow(put, LISTING).collect()  # a row a file
    rename([r["path"] + ".part" for r in listed])
    return sum(r["records"] for r in listed)


def rename(paths: list[str]) -> None:
    from tessera.llm.files import _store

    for path in paths:
        store, inside = _store(path)
        store.move(inside, inside.removesuffix(".part"))


@F.pandas_udf(T.StringType())
def payload_digest(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: None if p is None else digest(bytes(p)), na_action=None)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of pages to the shared folder and return what they say, read back.

    Responses are measured by their decoded payload; revisits tell digest and length themselves.
    The archives go once they are read; write keeps them for whoever wants the records.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])
    if not write(pages, folder):
        return spark.createDataFrame([], out)
    got = read(spark, folder)
    number = lambda c: F.when(F.col(c).startswith(URN), F.substring(c, len(URN) + 1, 20).cast("long"))
    response = F.col("record_type") == "response"
    told = got.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, payload_digest("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
    told = cut(told)
    delete(spark, folder)
    return told


def op8(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page."""
    from tessera.session import table

    return round_trip(table(spark, sf_dir, "pages"))
