"""Saved dataset directories: Arrow shards with marker files, one folder a split if there are several.

``spark.read.format("dataset_dir").load(path)`` reads one partition a shard, splits in order of
their names, shards in the order that their split lists them. With a schema given, only its columns
are read from a shard. Writing makes a shard of each split in each task; a split's listing and the
markers are written once all tasks have committed, so shards of lost or repeated tasks don't count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tessera.session import settings
from tessera.sources import stores

# Files that mark a saved dataset, and the keys of its listings.
MARKERS = ("dataset_info.json", "dataset_dict.json", "state.json")
SPLITS, FILES, NAME = "splits", "_data_files", "filename"
#: The column that tells the split, and the split of a dataset that has only one.
SPLIT, ONLY = "split", "train"
#: What a null split is saved as.
UNNAMED = "unnamed"
#: Rows that come to a writing task at once, and bytes of them that are parted by split and saved at once.
BATCH_ROWS = 1024
SLICE_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of SLICE_BYTES by the mean of its rows, or of a row."""
    step = max(1, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def is_dataset_dir(path: str) -> bool:
    """Whether any marker file stands in a folder."""
    return any(stores.exists(f"{path}/{m}") for m in MARKERS)


@dataclass(frozen=True)
class Shard(InputPartition):
    split: str
    path: str


def shards(path: str) -> list[Shard]:
    """The shards of a saved dataset, in order of splits; an error if no marker file is there."""
    if not is_dataset_dir(path):
        raise FileNotFoundError(f"no saved dataset in {path}")
    if stores.exists(f"{path}/dataset_dict.json"):
        told = sorted(json.loads(stores.read_bytes(f"{path}/dataset_dict.json"))[SPLITS])
        parts = [(name, f"{path}/{name}") for name in told]
    else:
        parts = [(ONLY, path)]
    out = []
    for name, folder in parts:
        state = json.loads(stores.read_bytes(f"{folder}/state.json"))
        out += [Shard(unquote(name), f"{folder}/{f[NAME]}") for f in state[FILES]]
    return out


def _opened(path: str) -> pa.RecordBatchReader:
    """The batches of a shard, which is a stream, or a file, of Arrow's."""
    store, inside = stores.store_of(path)
    source = store.open_input_file(inside)
    try:
        return pa.ipc.open_stream(source)
    except pa.ArrowInvalid:
        source.seek(0)
        opened = pa.ipc.open_file(source)
        return pa.RecordBatchReader.from_batches(opened.schema, (opened.get_batch(k) for k in range(opened.num_record_batches)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, to_arrow_schema(schema)

    def partitions(self) -> list[Shard]:
        return shards(self.path)

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        for batch in _opened(shard.path):
            columns = []
            for f in self.schema:
                if f.name == SPLIT and SPLIT not in batch.schema.names:
                    columns.append(pa.array([shard.split] * batch.num_rows, pa.string()))
                elif f.name in batch.schema.names:
                    columns.append(batch.column(f.name).cast(f.type))
                else:
                    columns.append(pa.nulls(batch.num_rows, f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        open_: dict[str, tuple] = {}
        for part in (part for batch in batches for part in _slices(batch)):
            rows = pa.Table.from_batches([part])
            names = rows[SPLIT].fill_null(UNNAMED)
            rest = rows.drop_columns([SPLIT])
            for name in names.unique().to_pylist():
                if name not in open_:
                    file = f"data-{uuid.uuid4().hex}.arrow"
                    sink = stores.open_new(f"{self.path}/{quote(name, safe='')}/{file}")
                    open_[name] = (file, sink, pa.ipc.new_stream(sink, rest.schema))
                open_[name][2].write_table(rest.filter(pc.equal(names, name)))
        for _, sink, stream in open_.values():
            stream.close()
            sink.close()
        return Written(tuple(sorted((name, file) for name, (file, _, _) in open_.items())))

    def commit(self, messages: list[Written | None]) -> None:
        listed: dict[str, list[str]] = {}
        for m in messages:
            for name, file in m.files if m else ():
                listed.setdefault(quote(name, safe=""), []).append(file)
        for name, files in listed.items():
            stores.put_whole(f"{self.path}/{name}/state.json", json.dumps({FILES: [{NAME: f} for f in files]}).encode())
            stores.put_whole(f"{self.path}/{name}/dataset_info.json", b"{}")
        stores.put_whole(f"{self.path}/dataset_dict.json", json.dumps({SPLITS: sorted(listed)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name, file in m.files if m else ():
                stores.remove(f"{self.path}/{quote(name, safe='')}/{file}")


class DatasetDirSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dataset_dir"

    def schema(self) -> T.StructType:
        """The columns of all splits, in the order in which they are first met, and the split."""
        fields: dict[str, T.StructField] = {}
        met: set[str] = set()
        for shard in shards(self.options["path"]):
            if shard.split not in met:
                met.add(shard.split)
                for f in from_arrow_schema(_opened(shard.path).schema):
                    fields.setdefault(f.name, f)
        fields.setdefault(SPLIT, T.StructField(SPLIT, T.StringType()))
        return T.StructType(list(fields.values()))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a saved dataset, with their split; of columns that are named, only these are read."""
    spark.dataSource.register(DatasetDirSource)
    whole = spark.read.format("dataset_dir").load(path)
    if columns is None:
        return whole
    return spark.read.format("dataset_dir").schema(T.StructType([whole.schema[c] for c in columns])).load(path)


def write_dataset(df: DataFrame, path: str, force: bool = False) -> bool:
    """Save df, whose column split names the splits; nothing is done where the folder holds anything, unless forced."""
    if not (force or stores.is_empty(path)):
        return False
    df.sparkSession.dataSource.register(DatasetDirSource)
    with settings(df.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        df.withColumn(SPLIT, F.col(SPLIT).cast("string")).write.format("dataset_dir").mode("append").save(path)
    return True
