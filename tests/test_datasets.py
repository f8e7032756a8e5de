"""Saved datasets and the image sink."""

import json
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.plans import corpus
from tessera.sources import dataset_dir
from tessera.sources.dataset_dir import is_dataset_dir, read_dataset, shards, write_dataset
from tessera.sources.image_sink import OPEN_COST, many_files, read_images, remove_images, write_images


def saved(folder, *tables):
    """A split as other tools save it."""
    os.makedirs(folder)
    names = []
    for k, table in enumerate(tables):
        names.append(f"data-{k:05d}-of-{len(tables):05d}.arrow")
        with pa.OSFile(f"{folder}/{names[-1]}", "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
    (folder / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names], "_split": None}))
    (folder / "dataset_info.json").write_text("{}")


def test_single_split(spark, tmp_path):
    saved(tmp_path / "d", pa.table({"doc_id": ["a", "b"], "page": [1, None]}), pa.table({"doc_id": ["c"], "page": [3]}))
    (tmp_path / "d/data-stray.arrow").write_bytes(b"none")
    rows = read_dataset(spark, str(tmp_path / "d"))
    assert rows.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in rows.collect()] == [("a", 1, "train"), ("b", None, "train"), ("c", 3, "train")]


def test_splits_in_order_with_columns_of_their_own(spark, tmp_path):
    saved(tmp_path / "d/test", pa.table({"doc_id": ["t"], "image": [b"x"]}))
    saved(tmp_path / "d/dev", pa.table({"doc_id": ["d"], "markdown": ["m"]}))
    (tmp_path / "d/dataset_dict.json").write_text(json.dumps({"splits": ["test", "dev"]}))
    rows = read_dataset(spark, str(tmp_path / "d"))
    assert rows.columns == ["doc_id", "markdown", "image", "split"]
    assert [(r["doc_id"], r["markdown"], r["image"], r["split"]) for r in rows.collect()] == [("d", "m", None, "dev"), ("t", None, b"x", "test")]
    pruned = read_dataset(spark, str(tmp_path / "d"), ["split", "markdown"])
    assert [tuple(r) for r in pruned.collect()] == [("dev", "m"), ("test", None)]


def test_folders_without_markers(spark, tmp_path):
    assert not is_dataset_dir(str(tmp_path)) and not is_dataset_dir(str(tmp_path / "missing"))
    with pytest.raises(FileNotFoundError):
        shards(str(tmp_path))
    with pytest.raises(Exception, match="no saved dataset"):
        read_dataset(spark, str(tmp_path))


def test_round_trip_and_skip(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(k, f"text {k}", None if k == 3 else ["a/b", "en"][k % 2], [k]) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, split string, ids array<int>").repartition(3)
    assert write_dataset(df, path)
    got = read_dataset(spark, path)
    assert sorted((r["id"], r["text"], r["split"], r["ids"]) for r in got.collect()) == [(i, t, s or "unnamed", x) for i, t, s, x in rows]
    assert [s.split for s in shards(path)] == sorted(s.split for s in shards(path))
    before = sorted(os.listdir(f"{path}/en"))
    assert not write_dataset(df, path) and sorted(os.listdir(f"{path}/en")) == before
    assert write_dataset(df.where("id < 2"), path, force=True) and read_dataset(spark, path).count() == 2


def test_images_are_written_once(spark, tmp_path):
    path = str(tmp_path / "images")
    rows = [("a.png", b"1", 2), ("b.png", b"2", 1), ("c.png", None, 1), ("a.png", b"9", 1), (None, b"3", 1)]
    images = spark.createDataFrame(rows, "file_name string, image binary, place int").repartition(4)
    assert write_images(images, path, "place") == (2, 0)
    assert sorted(os.listdir(path)) == ["a.png", "b.png"]
    times = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path)}
    more = images.unionByName(spark.createDataFrame([("d.png", b"4", 1)], images.schema)).withColumn("image", F.when(F.col("image").isNotNull(), F.concat("image", F.lit(b"x"))))
    assert write_images(more, path) == (1, 2)
    assert {n: os.stat(f"{path}/{n}").st_mtime_ns for n in times} == times
    assert sorted((r["file_name"], bytes(r["image"])) for r in read_images(spark, path).collect()) == [("a.png", b"9"), ("b.png", b"2"), ("d.png", b"4x")]
    assert write_images(images.limit(0), path) == (0, 0)


def test_a_shard_is_saved_in_small_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    df = spark.range(3000).select("id", F.lit("en").alias("split")).coalesce(1)
    assert write_dataset(df, path)
    with pa.ipc.open_stream(shards(path)[0].path) as told:
        sizes = [b.num_rows for b in told]
    assert sum(sizes) == 3000 and max(sizes) <= dataset_dir.BATCH_ROWS
    monkeypatch.setattr(dataset_dir, "SLICE_BYTES", 100)
    batch = pa.RecordBatch.from_pylist([{"text": "x" * 60}] * 9)
    assert [p.num_rows for p in dataset_dir._slices(batch)] == [1] * 9 and list(dataset_dir._slices(batch.slice(0, 0))) == []


def test_many_images_are_read_in_few_tasks(spark, tmp_path):
    path = str(tmp_path / "images")
    images = spark.range(300).select(F.format_string("%d.png", "id").alias("file_name"), F.col("id").cast("string").cast("binary").alias("image"))
    assert write_images(images, path) == (300, 0) and write_images(images, path) == (0, 300)
    with many_files(spark):
        read = read_images(spark, path)
        assert read.rdd.getNumPartitions() <= 6
        assert sorted((r["file_name"], bytes(r["image"])) for r in read.collect()) == sorted((f"{k}.png", str(k).encode()) for k in range(300))
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(OPEN_COST) and not [n for n in os.listdir(path) if n.startswith(".") and n.endswith(".png")]


def test_images_of_odd_documents_equal_their_sql(spark, tmp_path):
    """Texts of no bytes make files that are read back; ids below zero have pages below zero."""
    rows = [(1, ""), (2, "b"), (3, None), (-3, "n"), (-12, ""), (-10, "five"), (None, "x"), (9, "p")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in corpus.image_sink(spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(got) == sorted(con.execute(corpus.ORACLES["image_sink"]).fetchall()) and len(got) == 5


def test_images_of_a_failed_attempt_count_as_made(spark, tmp_path):
    """While a write runs, a file appears as one that an earlier attempt of its task made."""
    path = str(tmp_path / "images")

    @F.udf("binary")
    def attempted(name):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "wb") as f:
            f.write(b"1")
        return b"1"

    images = spark.createDataFrame([("a.png",), ("b.png",)], "file_name string").withColumn("image", attempted("file_name"))
    assert write_images(images, path) == (2, 0) and write_images(images, path) == (0, 2)


def test_images_are_read_and_removed_by_their_names(spark, tmp_path):
    path = str(tmp_path / "images")
    images = spark.createDataFrame([("a.png", b""), ("b.png", b"2"), ("c.png", b"3")], "file_name string, image binary")
    assert write_images(images, path) == (3, 0)
    (tmp_path / "images/.hidden.png").write_bytes(b"x")
    names = spark.createDataFrame([("a.png",), ("c.png",), ("c.png",), ("none.png",), (None,)], "file_name string")
    for read, told in ((read_images(spark, path, names), [("a.png", b""), ("c.png", b"3")]), (read_images(spark, path), [("a.png", b""), ("b.png", b"2"), ("c.png", b"3")])):
        assert read.inputFiles() == []  # none was listed to plan it
        assert sorted((r["file_name"], bytes(r["image"])) for r in read.collect()) == told
    assert remove_images(names, path) == 2 and sorted(os.listdir(path)) == [".hidden.png", "b.png"]
