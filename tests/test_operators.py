"""Goldens and small cases of the operators."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.vector import hash_vector
from tessera.operators import benchmarks as B
from tessera.operators import corpus as C
from tessera.operators import prompts as P
from tessera.operators import pruning as G
from tessera.operators import ranking
from tessera.operators import retrieval as R
from tessera.operators.ranking import last_wins, order_statistic, ordered_rank
from tessera.operators.tiered_cache import ModalityAwareLru, PlainLru, TieredCache
from tessera.plans import corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_block_hash_goldens(spark):
    ids = F.array(*(F.lit(i) for i in (1, 2, 3)))
    assert one(spark, X.block_hash(F.lit("text"), ids)) == "7a5906eff5db07eab40c7d06aadb7989"
    assert one(spark, X.block_hash(F.lit("visual"), ids)) == "0b47983aa01eb9ef9634d14f9a68758e"
    assert one(spark, X.block_hash(F.lit("text"), F.sequence(F.lit(0), F.lit(127)))) == "efb4b310e606183a5943ce18f0885604"
    assert one(spark, X.chunk_id(F.lit("cache.txt"), F.lit(0), F.array(F.lit(1), F.lit(2)))) == "3ddbd1c52d34ef1af5ebb49b63207f26"


def test_vocabulary_and_chunks(spark):
    docs = spark.createDataFrame([("a", "cache text cache text image"), ("b", "image context text cache"), ("c", None), ("d", "")], "doc string, body string")
    vocab = C.vocabulary(docs, "doc", "body")
    assert {r["piece"]: r["token_id"] for r in vocab.collect()} == {"cache": 1, "text": 2, "image": 3, "context": 4}
    cut = C.token_chunks(docs, "doc", "body", 2)
    for chunks in (C.with_token_ids(cut, "doc", vocab), C.with_token_ids(cut, "doc")):
        assert {(r["doc"], r["chunk_index"]): r["token_ids"] for r in chunks.collect()} == {("a", 0): [1, 2], ("a", 1): [1, 2], ("a", 2): [3], ("b", 0): [3, 4], ("b", 1): [2, 1]}
    assert C.with_token_ids(cut.limit(0), "doc").count() == 0


def test_ids_follow_keys_and_places(spark, monkeypatch):
    monkeypatch.setattr(C, "DICTIONARY_PIECES", 3)
    rng = random.Random(8)
    rows = [(k if k % 9 else None, " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(k % 13))) for k in range(1, 80)]
    docs = spark.createDataFrame(rows, "doc long, body string").repartition(5)
    wanted = {}
    for key in sorted({k for k, _ in rows}, key=lambda k: (k is not None, k or 0)):
        at = {}
        for k, text in rows:
            if k == key:
                for pos, w in enumerate(text.split()):
                    at[w] = min(pos, at.get(w, pos))
        for w in sorted((w for w in at if w not in wanted), key=at.get):
            wanted[w] = at[w], len(wanted) + 1
    got = {r["piece"]: r["token_id"] for r in C.vocabulary(docs, "doc", "body").collect()}
    assert got.keys() == wanted.keys() and sorted(got.values()) == list(range(1, len(got) + 1))
    known = [w for w in wanted if w in {x for k, t in rows if k for x in t.split()} - {x for k, t in rows if not k for x in t.split()}]
    assert sorted(known, key=got.get) == sorted(known, key=lambda w: wanted[w][1])


def test_blank_texts_have_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc int, body string")
    assert [r["n"] for r in docs.select(X.token_count("body").alias("n")).collect()] == [0, 0, 0]
    assert C.word_chunks(docs, "doc", "body", 4).count() == 0


def asked(spark, *vectors):
    return spark.createDataFrame(list(enumerate(map(list, vectors))), "query_id long, embedding array<float>")


def test_retrieve_a_keeps_candidates_beyond_k(spark):
    chunks = spark.createDataFrame([("image-red", "image", [0.0, 0.0, 0.0]), ("text-cache", "text", [1.0, 0.0, 0.0]), ("text-mixed", "text", [1.0, 1.0, 1.0])], "chunk_id string, modality string, embedding array<float>")
    rows = R.retrieve_a(chunks, asked(spark, [0.0, 1.0, 0.0]), 2).orderBy("retrieval_rank").collect()
    assert [(r["chunk_id"], round(r["score"], 5)) for r in rows] == [("text-mixed", 0.57735), ("image-red", 0.0), ("text-cache", 0.0)]


def test_forced_visual_takes_the_last_place(spark):
    chunks = spark.createDataFrame([("a", "text", [1.0, 0.0]), ("b", "text", [1.0, 0.1]), ("v", "image", [0.2, 1.0])], "chunk_id string, modality string, embedding array<float>")
    rows = R.retrieve_b(chunks, asked(spark, [1.0, 0.0]), 2, 1.0, force_visual=True).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "v"]
    assert R.retrieve_b(chunks, asked(spark, [1.0, 0.0]), 2, 1.0).count() == 2


def test_hash_vector_is_fixed():
    assert hash_vector("a") == hash_vector("a") != hash_vector("b")
    assert abs(sum(x * x for x in hash_vector("a")) - 1) < 1e-4


def test_ranks_over_all_rows(spark):
    values = [random.Random(3).randrange(50) for _ in range(500)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int")
    got = [r["k"] for r in ordered_rank(df, ["v", "k"]).orderBy("rank").collect()]
    assert got == [k for _, k in sorted((v, k) for k, v in enumerate(values))]


def test_order_statistics(spark):
    df = spark.range(80).select(F.lit("run").alias("variant"), F.col("id").cast("double").alias("ttft_ms"))
    assert B.percentiles(df, ["variant"]).first().asDict() == {"variant": "run", "p50_ttft_ms": 40.0, "p99_ttft_ms": 79.0}
    assert order_statistic(df.limit(0), "ttft_ms", {"x": F.lit(0)}, ["variant"]).count() == 0


@pytest.mark.parametrize("bracket,shipped", [(100_000, 10_000), (5, 10_000), (5, 0)])
def test_order_statistics_of_skewed_values(spark, monkeypatch, bracket, shipped):
    monkeypatch.setattr(ranking, "BRACKET", bracket)
    monkeypatch.setattr(ranking, "BROADCAST_BRACKETS", shipped)
    monkeypatch.setattr(ranking, "GRID", 16)
    rng = random.Random(bracket)
    groups = {"hot": [7.5] * 900 + [rng.uniform(0, 20) for _ in range(100)], "wide": [rng.gauss(0, 9) for _ in range(700)], None: [1.0, 1.0, 2.0], "one": [float("nan")]}
    rows = [(g, v, -1) for g, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, x double, place_ int")
    places = {f"p{k}": F.floor(F.col("n") * F.lit(k / 100)) for k in (0, 3, 5, 50, 94, 95, 99)}
    got = {r["kind"]: r for r in order_statistic(df, "x", places, ["kind"]).collect()}
    for g, vs in groups.items():
        assert repr([got[g][f"p{k}"] for k in (0, 3, 5, 50, 94, 95, 99)]) == repr([sorted(vs)[len(vs) * k // 100] for k in (0, 3, 5, 50, 94, 95, 99)])
    whole = order_statistic(df.where("kind = 'hot'"), "x", {"last": F.col("n") - 1, "none": F.col("n")}, [])
    assert [tuple(r) for r in whole.collect()] == [(max(groups["hot"]), None)]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert {r["k"]: r["v"] for r in last_wins(df, ["k"], F.col("seq")).collect()} == {"a": "y", "b": None}


def test_policies():
    lru = PlainLru()
    lru.place("a", False, "gpu")
    lru.place("b", False, "gpu")
    lru.touch("a")
    assert lru.victim("gpu") == "b"
    aware = ModalityAwareLru()
    for block, visual in (("t1", False), ("t2", False), ("v1", True)):
        aware.place(block, visual, "gpu")
    aware.touch("t1")
    assert aware.victim("gpu") == "v1"


def test_cache_flows():
    cache = TieredCache(2, 2)
    cache.put("v", True)
    assert (set(cache.gpu), set(cache.cpu)) == (set(), {"v"})
    cache = TieredCache(1, 2)
    cache.put("b1", False)
    cache.put("b2", False)
    assert (set(cache.gpu), set(cache.cpu)) == ({"b2"}, {"b1"})
    cache = TieredCache(0, 1)
    cache.put("v1", True)
    cache.put("v2", True)
    assert (set(cache.cpu), set(cache.ssd)) == ({"v2"}, {"v1"})
    cache = TieredCache(1, 1)
    cache.put("v1", True)
    assert cache.get("v1") == "cpu"
    cache.put("t2", False)
    assert (set(cache.gpu), set(cache.cpu)) == ({"t2"}, {"v1"})
    cache = TieredCache(1, 2)
    for block in "abc":
        cache.put(block, False)
    assert cache.get("b") == "cpu"
    assert (set(cache.gpu), set(cache.cpu), set(cache.ssd)) == ({"b"}, {"c"}, {"a"})


def test_crop_keeps(spark):
    sides = spark.createDataFrame([(4,), (8,), (11,), (24,)], "side int")
    kept = G.crop_mask(sides, 0.3).where("kept").groupBy("side").count().collect()
    assert {r["side"]: r["count"] for r in kept} == {4: 9, 8: 45, 11: 88, 24: 437}


def test_pruning_without_effect_keeps_all(spark):
    df = spark.createDataFrame([([7],), ([],)], "ids array<int>")
    assert [r["kept_ids"] for r in G.prune_ids(df, "ids", 0.9).collect()] == [[7], []]


def test_prompt_order_and_segments(spark):
    df = spark.sql("""select 'q' as query, '' as image_path, array(
        named_struct('retrieval_rank', cast(null as int), 'chunk_id', 'z', 'modality', 'text', 'source', 's', 'text', 't0', 'image_path', cast(null as string)),
        named_struct('retrieval_rank', 2, 'chunk_id', 'b', 'modality', 'image', 'source', 's2', 'text', '', 'image_path', 'p.png'),
        named_struct('retrieval_rank', 1, 'chunk_id', 'a', 'modality', 'text', 'source', 's1', 'text', 't1', 'image_path', cast(null as string))) as chunks""")
    df = df.withColumn("chunks", P.ordered_chunks(F.col("chunks")))
    row = df.select(P.segments(F.col("query"), F.col("image_path"), F.col("chunks")).alias("s"), P.user_text_block(F.col("query"), F.col("chunks")).alias("b")).first()
    assert [(s["role"], s["text"]) for s in row["s"]][2:] == [("retrieved_text", "t1"), ("retrieved_visual", "retrieved image: s2"), ("retrieved_text", "t0")]
    assert row["b"] == "User query:\nq\n\nRetrieved context:\n\n[1] s1\nt1\n\n[unranked] s\nt0\n\nRetrieved visual context:\n\n[2] s2\nImage from s2"


def test_comparison_as_markdown(spark):
    rows = spark.createDataFrame([("a", 10.0, 10.0, 1, 1, 0, 0, 1.0), ("b", 5.0, 5.0, 2, 0, 0, 0, 1.0)], "variant string, ttft_ms double, total_latency_ms double, cache_hits_text int, cache_misses_text int, cache_hits_visual int, cache_misses_visual int, gpu_memory_mib double")
    both = B.summary(rows, ["variant"]).join(B.percentiles(rows, ["variant"]), "variant")
    table = B.markdown(B.compare(both, "variant", "a", "b"), "a", "b")
    assert "-50.0%" in table and "+50.0% pp" in table and len(table.splitlines()) == 9


def test_union_splits_keeps_every_lang(spark, tmp_path):
    rows = [(1, "fr", "a", 3), (2, None, "b", 4), (3, "xx", None, 5), (4, "de", "c", 6), (5, "", "d", None), (None, "en", "e", 7), (2, None, "b", 4)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in corpus.union_splits(spark, str(tmp_path)).select("doc_id", "split", "source", "n_chars").collect()]
    assert sorted(got, key=repr) == sorted(((d, lang, None if lang == "de" else s, n) for d, lang, s, n in rows), key=repr)


def test_first_queries_fall_back(spark, tmp_path):
    own = spark.createDataFrame([(9, "own")], "item_id long, text string")
    some = spark.createDataFrame([(k, f"q{k}") for k in (3, 1, 2)], "item_id long, text string")
    assert [r["item_id"] for r in C.first_queries(lambda: some, "item_id", 2, own).collect()] == [1, 2]
    (tmp_path / "broken.parquet").write_bytes(b"no parquet")
    for load in (lambda: spark.read.parquet(str(tmp_path / "missing")), lambda: spark.read.schema(own.schema).parquet(str(tmp_path / "broken.parquet"))):
        assert [r["text"] for r in C.first_queries(load, "item_id", 2, own).collect()] == ["own"]
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE"):
            C.first_queries(load, "item_id", 2).collect()


def test_every_page_is_an_image_chunk(spark, tmp_path):
    rows = [(k, None if k == 1 else f"http://a/{k}", None if k == 2 else f"<title> t{k} </title>") for k in range(15)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    told = sorted((r["source"] or "", r["text"]) for r in corpus.image_chunks(spark, str(tmp_path)).collect())
    blank = [k for k in range(15) if k % 3 == 0 or k == 2]
    assert told == sorted(("" if k == 1 else f"http://a/{k}", f"Retrieved image from http://a/{k}" if k in blank else f"t{k}") for k in range(15))


def test_a_dictionary_is_passed_on_within_a_batch(spark, monkeypatch):
    monkeypatch.setattr(C, "DICTIONARY_PIECES", 10)
    rows = [{"key_": k, "index_": 0, "pieces": [f"p{i}" for i in range(k, k + 12)], "part_": k // 3} for k in range(6)]
    told = list(C._dictionary([pa.RecordBatch.from_pylist(rows)]))
    assert max(b.num_rows for b in told) <= 10 and all(len(set(b["part_"].to_pylist())) == 1 for b in told)
    first = {}
    for b in told:
        for r in b.to_pylist():
            place = (r["key_"], r["index_"], r["pos"])
            first[r["part_"], r["piece"]] = min(place, first.get((r["part_"], r["piece"]), place))
    assert first == {(part, f"p{i}"): (max(part * 3, i - 11), 0, i - max(part * 3, i - 11)) for part in (0, 1) for i in range(part * 3, part * 3 + 14)}


def test_vocabulary_takes_a_long_text_in_short_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "_dictionaries", lambda pieces: seen.append(pieces.select(F.max(F.size("pieces"))).first()[0]) or pieces)
    monkeypatch.setattr(C, "_numbers", lambda found: found)
    C.vocabulary(spark.createDataFrame([(1, "a b c " * 1000)], "doc long, body string"), "doc", "body")
    assert seen == [C.ROW_TOKENS]


def test_ids_are_put_into_few_chunks_at_once(spark, monkeypatch):
    number = C._numbered

    def checked(chunks, words):
        assert chunks.num_rows <= 3, chunks.num_rows
        return number(chunks, words)

    monkeypatch.setattr(C, "PART_CHUNKS", 3)
    monkeypatch.setattr(C, "_numbered", checked)
    docs = spark.range(40).select("id", F.expr("concat('a b c d w', id, ' x', id % 7)").alias("body"))
    vocab = {r["piece"]: r["token_id"] for r in C.vocabulary(docs, "id", "body").collect()}
    got = {(r["id"], r["chunk_index"]): r["token_ids"] for r in C.with_token_ids(C.token_chunks(docs, "id", "body", 2), "id").collect()}
    words = {k: ["a", "b", "c", "d", f"w{k}", f"x{k % 7}"] for k in range(40)}
    assert got == {(k, i): [vocab[w] for w in words[k][2 * i : 2 * i + 2]] for k in words for i in range(3)}


def test_numbered_chunks_are_kept_in_less_room_than_their_texts(spark, monkeypatch):
    """What is written between the two readings of the pieces; with parts of many chunks and of few, and keys that are null."""
    sizes, cut = [], C.cut

    def weighed(df):
        out = cut(df)
        shown = (F.length(c) if kind == "binary" else F.length(F.to_json(F.struct(c))) for c, kind in out.dtypes)
        sizes.append(out.select(F.sum(sum(shown, F.lit(0)))).first()[0])
        return out

    monkeypatch.setattr(C, "cut", weighed)
    docs = spark.range(400).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.expr("repeat(concat('letters and words of w', id % 9, ' again '), 64)").alias("body"))
    chunks = C.token_chunks(docs, "id", "body", 64)
    vocab = {r["piece"]: r["token_id"] for r in C.vocabulary(docs, "id", "body").collect()}
    wanted = {(r["id"], r["chunk_index"]): [vocab[p] for p in r["pieces"]] for r in chunks.collect()}
    for most in (1 << 14, 7):
        monkeypatch.setattr(C, "PART_CHUNKS", most)
        got = C.with_token_ids(chunks, "id").collect()
        assert len(got) == len(wanted) and {(r["id"], r["chunk_index"]): r["token_ids"] for r in got} == wanted
    texts = docs.select(F.sum(F.length("body"))).first()[0]
    assert sizes[0] < texts / 4, (sizes, texts)
