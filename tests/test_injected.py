"""Parts that callers bring: counters, tokenizers, embedders, and what stands in for them."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import injected as I


def test_counters_are_chosen_in_order(spark):
    class Halves:
        """A tokenizer of pairs of characters that knows no special tokens."""

        def encode(self, text):
            return [text[k : k + 2] for k in range(0, len(text), 2)]

    docs = spark.createDataFrame([(1, "ab cd e"), (2, "  "), (3, None)], "k int, t string")
    counts = lambda **given: [r["n"] for r in docs.orderBy("k").select(I.counted_tokens("t", **given).alias("n")).collect()]
    assert counts() == [3, 0, 0]
    assert counts(tokenizer=Halves()) == [4, 0, 0]
    assert counts(counter=len, tokenizer=Halves()) == [7, 2, 0]
    assert counts(settings={"model": {"name": "m"}}, load={"m": Halves()}.get) == [4, 0, 0]
    assert counts(settings={"model": {"name": "m"}}, load={}.get) == [3, 0, 0]


def test_tokenizer_names():
    assert I.tokenizer_name({"tokenizer_name": "a", "model": {"name": "b"}}) == "a"
    assert I.tokenizer_name({"tokenizer_name": "", "model": {"name": "b"}}) == "b"
    assert I.tokenizer_name({"rag": {"embedding_model": "c"}, "embedding_model": "d"}) == "c"
    assert I.tokenizer_name({"embedding_model": "d"}) == "d"
    assert I.tokenizer_name({}) is None


def test_embedder_of_lists(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "abc")], "k int, t string")
    made = docs.select("k", I.embedded("t", lambda texts: [[len(t), 1] for t in texts]).alias("v"))
    assert {r["k"]: r["v"] for r in made.collect()} == {1: [1.0, 1.0], 2: None, 3: [3.0, 1.0]}
    assert [r.tolist() for r in I.as_rows(np.array([1, 2]))] == [[1.0, 2.0]]
    nested = spark.sql("SELECT array(array(1, 2), array(3)) AS v")
    assert nested.select(I.as_vector("v", nested=True).alias("v")).first()["v"] == [1.0, 2.0, 3.0]


def test_unknown_ids_are_skipped(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "piece string, token_id long")
    ids = spark.createDataFrame([(1, [2, 9, 1, 2]), (2, [9]), (3, [])], "k int, ids array<long>")
    assert {r["k"]: r["decoded"] for r in I.decoded(ids, "k", vocab).collect()} == {1: "b a b", 2: "", 3: ""}


def test_masks(spark):
    assert I.mask_backend("mobilesam") == I.mask_backend("other", print) == "center_crop"
    assert I.mask_backend("mobilesam", print) == "mobilesam"
    row = spark.sql("SELECT array(true, false, true, true) AS m, CAST(array() AS array<boolean>) AS e")
    got = row.select(I.kept_share("m").alias("m"), I.kept_share("e").alias("e")).first()
    assert tuple(got["m"]) == (3, 0.75) and tuple(got["e"]) == (0, 0.0)
    assert row.select(F.size("m")).first()[0] == 4
