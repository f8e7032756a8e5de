"""Requests through parts that tests bring."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import generation as G
from tessera.operators import prompts as P
from tessera.operators import retrieval as R

CHUNK = "struct<retrieval_rank:int,chunk_id:string,modality:string,source:string,text:string,image_path:string>"
REQUESTS = f"request_id long, query string, image_path string, chunks array<{CHUNK}>"


class Output:
    def __init__(self, text):
        self.outputs = [type("O", (), {"text": text})()]


def counting(path):
    """A maker of engines that count themselves in a file; defined here, as workers don't know this module."""

    class Engine:
        def __init__(self):
            with open(path, "a") as f:
                f.write("made\n")

        def generate(self, payload, max_tokens, temperature, top_p):
            if "bad" in payload["prompt"]:
                raise RuntimeError("no answer")
            return {"text": f"{payload['prompt']}/{max_tokens}/{top_p}", "generation_seconds": 1.5}

    return Engine


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(1, "a b", None, [(1, "c1", "text", "s", "t one", None), (None, "c2", "image", "s2", "", "p.png")]), (2, "bad", "x.png", []), (3, "", "", [])]
    return spark.createDataFrame(rows, REQUESTS)


def test_one_engine_a_worker_and_failures_by_row(spark, tmp_path):
    path = str(tmp_path / "made")
    texts = spark.createDataFrame([(k, "bad" if k % 5 == 0 else f"q{k}") for k in range(200)] + [(-1, None)], "k long, text string").coalesce(1)
    rows = texts.select("k", G.generated("text", counting(path), "none", max_tokens=9).alias("g")).select("k", "g.*").collect()
    told = {r["k"]: r for r in rows}
    assert told[1]["generated_text"] == "q1/9/0.95" and json.loads(told[1]["timing"]) == {"generation_seconds": 1.5} and told[1]["error"] is None
    assert {(told[k]["generated_text"], told[k]["error"]) for k in range(0, 200, 5)} == {("none", "RuntimeError: no answer")}
    assert tuple(told[-1])[1:] == (None, None, None)
    assert open(path).read().count("made") == 1


def test_an_engine_that_cannot_be_made_fails_by_row(spark):
    def broken():
        raise OSError("no weights")

    got = spark.range(3).select(G.generated(F.lit("q"), broken, "sorry").alias("g")).select("g.*").collect()
    assert {(r["generated_text"], r["error"]) for r in got} == {("sorry", "OSError: no weights")}
    got = spark.range(1).select(G.generated(F.lit("q"), object).alias("g")).select("g.error").first()
    assert got["error"].startswith("AttributeError")


@pytest.mark.parametrize("response,text", [("x", "x"), ({"generated_text": 1, "text": "t", "answer_text": "a"}, "t"), ({"answer_text": "a"}, "a"), ([{"text": "l"}], "l"), ([Output("o"), Output("p")], "o"), (Output("o"), "o"), ([], ""), (None, ""), ({}, ""), ([3], "")])
def test_text_of_responses(response, text):
    assert G.text_of(response) == text


def test_timings_of_responses():
    assert G.timing_of({"timing": {"a": 1}}, 5) == {"a": 1}
    assert G.timing_of({"generation_seconds": 2}, 5) == {"generation_seconds": 2}
    assert G.timing_of("x", 5) == {"generation_seconds": 5}


def test_arguments_that_are_not_named_are_left_out():
    assert G.with_known_arguments(lambda a: a, {"a": 1, "b": 2}) == 1
    assert G.with_known_arguments(lambda **k: k, {"a": 1, "b": 2}) == {"a": 1, "b": 2}


def test_responses_with_own_parts(spark, requests):
    class Builder:
        def build_prompt(self, query, chunks):
            return {"segments": P.segments(query, F.lit(""), chunks), "request_payload": F.concat(F.lit("say "), query), "metadata": F.create_map(F.lit("n"), F.lit("7"), F.lit("num_retrieved_chunks"), F.lit("theirs"))}

    class Helper:
        def summarize_prompt(self, segments, config):
            return {"roles": [s["role"] for s in segments], "config": config, "num_retrieved_chunks": 0}

    class Engine:
        def generate(self, payload, **_):
            return payload["prompt"].upper()

    rows = {r["request_id"]: r for r in G.respond(requests, Engine, Builder(), Helper()).collect()}
    assert rows[1]["answer_text"] == "SAY A B" and rows[1]["retrieved_chunk_ids"] == ["c1", "c2"]
    assert json.loads(rows[1]["token_summary"]) == {"roles": ["system", "user", "retrieved_text", "retrieved_visual"], "config": None, "num_retrieved_chunks": 0}
    assert json.loads(rows[1]["prompt_summary"])["num_retrieved_chunks"] == "theirs" and json.loads(rows[1]["prompt_summary"])["n"] == "7"
    assert "generation_seconds" in json.loads(rows[1]["timing_summary"])


def test_a_failing_helper_gives_way(spark, requests):
    def fails(segments):
        raise KeyError("x")

    def odd(segments):
        return 5

    own = [r["s"] for r in G.built(requests).select(G.summarized("segments").alias("s")).collect()]
    for helper in (fails, odd):
        assert [r["s"] for r in G.built(requests).select(G.summarized("segments", helper).alias("s")).collect()] == own
    assert json.loads(own[0]) == {"total_prompt_tokens": 7 + 2 + 2 + 3, "retrieved_text_token_count": 2, "visual_input_present": True, "num_retrieved_chunks": 2, "ordered_segment_roles": ["system", "user", "retrieved_text", "retrieved_visual"]}


def test_builder_of_a_tuple(spark, requests):
    made = G.built(requests, lambda query, image_path, chunks: (F.array(), query, F.create_map().cast("map<string,string>")))
    assert [(r["segments"], r["payload"], r["segment_metadata"]) for r in made.collect()] == [([], q, {}) for q in ("a b", "bad", "")]


def test_retrievers(spark):
    chunks = spark.createDataFrame([("a", "text", [1.0, 0.0]), ("b", "text", [0.0, 1.0])], "chunk_id string, modality string, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, embedding array<float>")

    class Own:
        def retrieve(self, requests, chunks):
            return R.dense_topk(chunks, requests, 1)

    assert [r["chunk_id"] for r in G.retrieved(asked, chunks, Own()).collect()] == ["a"]
    assert G.retrieved(asked, chunks, lambda q, c: c.limit(0)).count() == 0


def test_chunks_of_any_shape(spark):
    rows = ['{"chunk_id":"a","score":null,"metadata":{"score":0.5}}', '{"metadata":{"score":0.5}}', '{"score":2,"metadata":{"score":0.5},"retrieval_rank":4}', "[1]", None, "no json", '{"metadata":7,"modality":"image"}']
    got = spark.createDataFrame([(r,) for r in rows], "j string").coalesce(1).select(P.normalize_chunk(F.col("j")).alias("c")).select("c.*").collect()
    assert [r["score"] for r in got] == [None, 0.5, 2.0, None, None, None, None]
    assert [r["metadata"] for r in got] == ['{"score":0.5}', '{"score":0.5}', '{"score":0.5}', "{}", "{}", "{}", "{}"]
    assert [r["modality"] for r in got] == ["text"] * 6 + ["image"] and got[2]["retrieval_rank"] == 4


def test_merged_objects(spark):
    row = spark.range(1).select(P.merged_json(F.lit('{"b":1,"a":null}'), F.lit('{"b":[null,"x]:"]}'), F.lit("no")).alias("m")).first()
    assert row["m"] == '{"a":null,"b":[null,"x]:"]}'
    row = spark.range(1).select(P.log_event("e", F.lit('{"event":"no","k":1}'), F.lit('{"k":2}')).alias("m")).first()
    assert row["m"] == '{"event":"e","k":2}'
