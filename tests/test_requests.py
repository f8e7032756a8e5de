"""Fields that may be missing."""

import json

from pyspark.sql import functions as F

from tessera.functions.requests import page_number, request_messages, sampling


def test_page_number(spark):
    both = spark.createDataFrame([(None, 4), (2, 5)], "page_number_in_doc int, page_number int")
    assert [r["p"] for r in both.select(page_number(both).alias("p")).collect()] == [None, 2]
    one = both.select("page_number")
    assert [r["p"] for r in one.select(page_number(one).alias("p")).collect()] == [4, 5]
    other = spark.createDataFrame([("3",)], "page_number string")
    assert other.select(page_number(other).alias("p")).first()["p"] is None


def test_sampling(spark):
    got = sampling(spark.createDataFrame([(9, None), (None, 0.5)], "max_tokens int, top_p double")).collect()
    assert [(r["max_tokens"], r["temperature"], r["top_p"]) for r in got] == [(9, 0.2, 0.95), (256, 0.2, 0.5)]


def test_messages(spark):
    rows = ["plain words", '{"messages": [{"role": "user"}]}', '{"prompt": "p"}', '{"prompt": "p", "image_path": "a.png"}']
    got = [json.loads(r["m"]) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(request_messages(F.col("x")).alias("m")).collect()]
    assert got[0] == [{"role": "user", "content": [{"type": "text", "text": "plain words"}]}]
    assert got[1] == [{"role": "user"}]
    assert got[2][0]["content"] == [{"type": "text", "text": "p"}]
    assert got[3][0]["content"][1] == {"type": "image_url", "image_url": {"url": "file://a.png"}}
