"""A sink of image files: each under its name, written only where it isn't there yet.

A file is written under a hidden name and renamed, so tasks that are repeated, or run twice at once,
leave whole files only; what they rename over each other is the same image. What a write finds is counted
before its tasks begin, so files of an attempt that failed count as made. Files are looked up, read and
removed by their names in tasks; the driver lists no folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.session import settings, shuffle_partitions
from tessera.sources import stores

#: Told in it, under a hidden name: images that came to a write.
REPORT = ".written-"
#: Images that come to a writing task at once, and files that it writes at once, as it mostly waits for the store.
BATCH_ROWS = 1024
AT_ONCE = 8
#: Images that a reading task gives on at once.
READ_ROWS = 64
#: Bytes that opening a file counts as where Spark reads files: some 2,000 small ones make a task, by its default 32.
OPEN_COST = 64 << 10


@dataclass(frozen=True)
class Stored(WriterCommitMessage):
    images: int


def _is_there(store: fs.FileSystem, file: str) -> bool:
    return store.get_file_info(file).type == fs.FileType.File


def _remove(store: fs.FileSystem, file: str) -> bool:
    try:
        store.delete_file(file)
    except FileNotFoundError:
        return False
    return True


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, report: str) -> None:
        self.path, self.report = path, report

    def write(self, batches: Iterator[pa.RecordBatch]) -> Stored:
        images = 0
        store, folder = stores.store_of(self.path)
        store.create_dir(folder, recursive=True)

        def put(name: pa.StringScalar, image: pa.BinaryScalar) -> None:
            file = f"{folder}/{name.as_py()}"
            if not _is_there(store, file):
                stores.put_hidden(store, file, image.as_buffer())

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                images += len(list(pool.map(put, batch.column("file_name"), batch.column("image"))))
        return Stored(images)

    def commit(self, messages: list[Stored | None]) -> None:
        stores.put_whole(f"{self.path}/{self.report}", json.dumps({"images": sum(m.images for m in messages if m)}).encode())

    def abort(self, messages: list[Stored | None]) -> None:
        """Files that were made are whole and stay; a later write finds them."""


class ImageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_sink"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("file_name", T.StringType()), T.StructField("image", T.BinaryType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["report"])


def write_images(images: DataFrame, path: str, order: str | Column | None = None) -> tuple[int, int]:
    """Write images (file_name, image) to a folder; how many files were made, and how many found there.

    Rows without an image make none. Of rows with one name the first in order counts, or the one with
    the least bytes of content if no order is given.
    """
    spark = images.sparkSession
    spark.dataSource.register(ImageSink)
    by = F.col("image") if order is None else F.col(order) if isinstance(order, str) else order
    there = images.where("image is not null and file_name is not null")
    found = 0
    if not stores.is_missing(path):
        names, found = _asked(there, path, _is_there).agg(F.count("*"), F.count_if("yes")).first()
        if names == found:
            return 0, found
    chosen = there.groupBy("file_name").agg(F.min_by("image", by).alias("image"))
    report = f"{REPORT}{uuid.uuid4().hex}"
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        chosen.write.format("image_sink").option("report", report).mode("append").save(path)
    told = json.loads(stores.read_bytes(f"{path}/{report}"))
    stores.remove(f"{path}/{report}")
    return told["images"] - found, found


def many_files(spark: SparkSession):
    """Plans that run inside read many small files in a task, where Spark lists and reads them."""
    return settings(spark, spark__sql__files__openCostInBytes=str(OPEN_COST))


def _named(names: DataFrame) -> DataFrame:
    """Distinct names, dealt to as many tasks as a shuffle has, since each stands for a file."""
    parts = shuffle_partitions(names.sparkSession)
    return names.select("file_name").where("file_name is not null").distinct().repartition(parts, "file_name")


def _asked(names: DataFrame, path: str, ask: Callable[[fs.FileSystem, str], bool]) -> DataFrame:
    """Distinct names, and whether what is asked of their files in a folder holds (yes)."""

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = stores.store_of(path)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                yes = pool.map(lambda name: ask(store, f"{folder}/{name}"), batch.column("file_name").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("file_name"), pa.array(list(yes), pa.bool_())], names=["file_name", "yes"])

    return _named(names).mapInArrow(asked, "file_name string, yes boolean")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Names of the images in a folder; a task passes them on as its store tells them."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (n for _ in batches for n in stores.file_names(path) if n.endswith(".png") and n[0] not in "._")
        while some := list(islice(names, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["file_name"])

    return spark.range(1, numPartitions=1).mapInArrow(listed, "file_name string")


def read_images(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """file_name and image of the files of a folder, or of those of the names (file_name) given that are there.

    With names nothing is listed; without, one task lists the folder and passes on the names alone.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = stores.store_of(path)

        def get(name: str) -> bytes | None:
            try:
                with store.open_input_file(f"{folder}/{name}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, READ_ROWS):
                    some = batch.column("file_name").slice(at, READ_ROWS)
                    images = pa.array(list(pool.map(get, some.to_pylist())), pa.binary())
                    yield pa.RecordBatch.from_arrays([some, images], names=["file_name", "image"]).filter(images.is_valid())

    return _named(_listed(spark, path) if names is None else names).mapInArrow(read, "file_name string, image binary")


def remove_images(names: DataFrame, path: str) -> int:
    """Remove the files of names (file_name) from a folder in tasks; how many were there."""
    return _asked(names, path, _remove).agg(F.count_if("yes")).first()[0]
