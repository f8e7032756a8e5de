"""Folders, stores, settings and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.corpus import vocabulary
from tessera.operators.tiered_cache import replay
from tessera.sources.files import BlockStore, Settings, mixed_files, read_results, text_records, write_results
from tessera.sources.tables import trace
from tessera.streaming.cache_stream import replay_stream


def test_text_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "doc_a.txt").write_text("cache text")
    (tmp_path / "in" / "doc.b.txt").write_text("image\ntext")
    (tmp_path / "no.md").write_text("x")
    assert sorted((r["doc_id"], r["markdown"]) for r in text_records(spark, str(tmp_path)).collect()) == [("doc.b", "image\ntext"), ("doc_a", "cache text")]
    ids = vocabulary(text_records(spark, str(tmp_path)), "source", "markdown")
    assert {r["piece"]: r["token_id"] for r in ids.collect()} == {"cache": 1, "text": 2, "image": 3}
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    with pytest.raises(Exception, match="INVALID_UTF8"):
        text_records(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text_records(spark, str(tmp_path / "missing"))


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.MD").write_bytes(b"ok \xff end")
    (tmp_path / "b.PNG").write_bytes(b"123")
    (tmp_path / "c.pdf").write_bytes(b"123")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["length"], r["text"]) for r in mixed_files(spark, str(tmp_path)).collect()}
    assert got["b.PNG"] == ("image", 3, None) and got["a.MD"] == ("text", 8, "ok  end") and set(got) == {"a.MD", "b.PNG"}


def test_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"config_name": "a", "results": [{"query_id": 1, "ttft_ms": 2.0}, {"query_id": 2, "ttft_ms": 3.0}]}))
    rows = read_results(spark, str(tmp_path / "r.json"))
    assert [(r["config_name"], r["query_id"]) for r in rows.orderBy("query_id").collect()] == [("a", 1), ("a", 2)]
    write_results(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_block_store(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "blocks"), 300)
    rows = spark.createDataFrame([("a", "text", [1, 2], 2, 256)], store.SCHEMA)
    assert store.usage_bytes() == 0 and store.load("a").count() == 0
    assert store.store(rows) and store.usage_bytes() == 256
    assert store.store(rows.withColumn("num_tokens", F.lit(3))) and store.load("a").first()["num_tokens"] == 3
    assert store.store(rows.withColumn("block_id", F.lit("b"))) and not store.store(rows)
    store.delete(spark.createDataFrame([("a",)], "block_id string"))
    assert [r["block_id"] for r in store.blocks().collect()] == ["b"]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"cache": {"gpu_blocks": 2, "other": 1}, "model": {"name": "m"}, "more": {}}')
    got = Settings.load(str(tmp_path / "s.json"))
    assert (got.cache.gpu_blocks, got.cache.cpu_blocks, got.rag.top_k, got.model.dtype) == (2, 8192, 5, "float16")
    with pytest.raises(FileNotFoundError):
        Settings.load(str(tmp_path / "missing.json"))
    (tmp_path / "s.yaml").write_text("model:\n  name: m\nrag:\n  top_k: '7'\neval:\n  batch_sizes: [1, 2]\npruning:\n")
    pytest.importorskip("yaml")
    got = Settings.load(str(tmp_path / "s.yaml"))
    assert (got.rag.top_k, got.eval.batch_sizes, got.pruning.backend, got.serving.port) == (7, [1, 2], "mobilesam", 8000)
    assert (got.variant(False, True).cache.enabled, got.variant(False, True).pruning.enabled, got.cache.enabled) == (False, True, True)
    for text, wrong in (("rag: {top_k: 1}", "model.name"), ("model: {name: m}\nrag: {top_k: x}", "rag.top_k"), ("", "model.name")):
        (tmp_path / "s.yaml").write_text(text)
        with pytest.raises(ValueError, match=wrong):
            Settings.load(str(tmp_path / "s.yaml"))


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = trace(spark, sf, 4).select("cache_id", "seq", "block_id", "modality")
    middle = rows.selectExpr("percentile(seq, 0.5)").first()[0]
    for k, part in enumerate((rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = replay_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3, 5)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out")).select("cache_id", "seq", "outcome")
    wanted = replay(rows, 3, 5).select("cache_id", "seq", "outcome")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
