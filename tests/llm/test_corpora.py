"""Operators over whole corpora, against brute force: joins, tiling, mixing, token files, archives, pipeline."""

import base64
import hashlib
import random
import re
import unicodedata
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontaminate, mixing, ngram_jaccard, token_files, warc
from tessera.llm.graph import connected_components
from tessera.session import shared_dir, table


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in members.items()}
    return [(rows[k][0], len(sets[k]), low[find(k)]) for k in range(len(rows))]


def test_jaccard_equals_brute_force(docs, doc_rows, no_docs):
    got = ngram_jaccard.components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components([(r[0], r[1]) for r in doc_rows]))
    assert ngram_jaccard.components(no_docs).count() == 0


def test_jaccard_at_the_threshold(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(base[: 40 - k] + [f"x{k}{j}" for j in range(k)])) for k in range(10)]
    rows += [(100 + k, " ".join(base[k:])) for k in range(1, 20)]
    random.Random(2).shuffle(rows)
    got = ngram_jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_jaccard_of_a_loose_group(spark):
    """A group that no pivot links as a whole, over several tasks, with a passage that all texts share."""
    rng = random.Random(11)
    base, common = [f"w{k}" for k in range(70)], " ".join(f"c{k}" for k in range(30))
    rows = []
    for k in range(240):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(70)] = f"e{rng.randrange(9)}"
        rows.append((k, " ".join(words) + " " + common))
    rows += [(1000 + k, " ".join(f"z{k}x{j}" for j in range(5 + k % 40)) + " " + common) for k in range(100)] + [(2000 + k, rows[k][1]) for k in range(0, 240, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = ngram_jaccard.components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_jaccard_rows_keep_clashing_columns(spark, docs):
    clash = docs.select("*", F.lit("x").alias("key_a"), F.lit(5).alias("key_b"), F.lit(1).alias("group"), F.lit(2).alias("row_"), F.lit(True).alias("is_set"))
    kept = ngram_jaccard.keep_one(clash)
    assert kept.columns == clash.columns and {tuple(r) for r in kept.select("key_a", "key_b", "group", "row_", "is_set").collect()} == {("x", 5, 1, 2, True)}
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and {tuple(r) for r in mixed.select("key_a", "key_b", "group", "row_").collect()} == {("x", 5, 1, 2)}


def test_one_of_each_component_stays(docs, doc_rows):
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = {c for _, n, c in brute_components([(r[0], r[1]) for r in doc_rows]) if n}
    assert sorted(r["doc_id"] for r in kept.collect() if (r["text"] or "").split()) == sorted(wanted)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_tiles(pattern, text, least):
    p, t, out = [False] * len(pattern), [False] * len(text), 0
    while True:
        best = 0, 0, 0
        for i in range(len(pattern)):
            for j in range(len(text)):
                n = 0
                while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] != 0 and not p[i + n] and not t[j + n]:
                    n += 1
                if n > best[0]:
                    best = n, i, j
        if best[0] < least:
            return out
        for k in range(best[0]):
            p[best[1] + k] = t[best[2] + k] = True
        out += best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(0, 4), max_size=18))
def test_tiles_equal_brute_force(pattern, text):
    found = decontaminate.tiles(np.array(pattern, dtype=np.uint64), np.array(text, dtype=np.uint64), 3)
    assert sum(n for _, _, n in found) == brute_tiles(pattern, text, 3)
    assert all(pattern[a : a + n] == text[b : b + n] for a, b, n in found)
    assert len({a + k for a, _, n in found for k in range(n)}) == sum(n for _, _, n in found)


def test_leaks_are_found_in_any_order(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    parts = item.split()
    leaks = [(1000, "Before. " + item + " after"), (1001, " ".join(parts[8:] + ["x"] + parts[:8])), (1002, item.upper().replace(" ", ",\n")), (1003, " ".join(parts[:5])), (1004, " ".join(x for w in parts for x in (w, "y")))]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "alpha beta"), (5, item)], "item_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaks, "doc_id long, text string"))
    found = decontaminate.contamination(all_docs, items)
    assert found.count() == all_docs.count()
    hits = {(r["doc_id"], r["h"]["item_id"]): r["h"]["coverage"] for r in found.select("row.doc_id", F.explode("hits").alias("h")).collect()}
    assert hits == {(d, i): 1.0 for d in (1000, 1001, 1002) for i in (1, 5)} | {(d, 4): 1.0 for d in (1000, 1001, 1002, 1003)}
    by_join = decontaminate.hits_by_join(all_docs, items)
    assert by_join.select(F.explode("hits")).count() == len(hits)
    order = lambda df, c: {tuple(h["item_id"] for h in r[c]) for r in df.collect()} - {()}
    assert order(by_join, "hits") == order(found, "hits") == {(1, 4, 5), (4,)}
    assert decontaminate.contamination(docs, items.limit(0)).where("size(hits) > 0").count() == 0


def test_short_items_are_found_where_their_words_stand_together(spark):
    items = spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (3, "beta alpha beta"), (4, "of the four words"), (None, "Gamma")], "item_id long, text string")
    texts = ["x alpha beta y", "beta, ALPHA beta", "alphabet", "alpha x beta", "gamma", "", None, "of the four words"]
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, hits string")
    wanted = {0: [1, 2], 1: [1, 2, 3], 3: [1], 4: [None], 7: [4]}
    found = decontaminate.contamination(docs, items).select("row.*", F.transform("hits", lambda h: h.item_id).alias("i")).collect()
    assert {r["doc_id"]: r["i"] for r in found if r["i"]} == wanted and {r["hits"] for r in found} == {"mine"}
    joined = decontaminate.hits_by_join(docs, items).select("text", F.transform("hits", lambda h: h.item_id).alias("i")).collect()
    assert {texts.index(r["text"]): r["i"] for r in joined} == wanted


def test_join_finds_the_same_leaks(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    shipped = decontaminate.contamination(docs, items).where("size(hits) > 0").select("row.doc_id", F.transform("hits", lambda h: h.item_id).alias("i"))
    joined = docs.join(decontaminate.hits_by_join(docs, items), "text").select("doc_id", F.transform("hits", lambda h: h.item_id).alias("i"))
    assert sorted(map(repr, shipped.collect())) == sorted(map(repr, joined.collect()))


def brute_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: left * weight[s] / w for s in free}
        above = [s for s in free if now[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return fixed | now
        fixed |= {s: 3.0 * sizes[s] for s in above}


def test_mix_meets_targets(docs, doc_rows, no_docs):
    narrow = docs.select("doc_id", "source", mixing.word_count("text").alias("size")).cache()
    for block in (16, 2048):
        got = mixing.mix(narrow, block_words=block).collect()
        assert len(got) == len(doc_rows)
        sizes = defaultdict(int)
        for r in narrow.collect():
            sizes[r["source"]] += r["size"]
        wanted = brute_targets(dict(sizes))
        taken = defaultdict(int)
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
        assert taken == {(sizes[s], round(t, 6)): round(t) for s, t in wanted.items()}
        # whole epochs of every document of a source, one more of some, and a part of one at most
        for s, target in wanted.items():
            of = [(r["size"], r["taken"]) for r in got if (r["source_size"], round(r["target"], 6)) == (sizes[s], round(target, 6))]
            epochs, rest = divmod(round(target), max(1, sizes[s]))
            more = [(size, taken - epochs * size) for size, taken in of]
            assert sum(m for _, m in more) == rest and sum(0 < m < size for size, m in more) <= 1 and all(0 <= m <= size for size, m in more)
    assert mixing.mix(no_docs.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count() == 0
    assert sorted(map(repr, mixing.mix(narrow).collect())) == sorted(map(repr, mixing.mix(narrow.repartition(5)).collect()))


def test_mix_with_clashing_names_and_without_ids(spark):
    rows = [(None, "s", 5, k, "n", 1.5) for k in range(300)] + [(7, None, 3, 1, "m", 2.5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, text_key long, number string, target double").withColumn("at_", F.lit("mine"))
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "text_key", "number", "at_"]
    assert Counter(r["number"] for r in got.collect()) == {"n": 300, "m": 3} and {r["at_"] for r in got.collect()} == {"mine"}
    numbered = docs.withColumn("number", F.when(F.col("source").isNull(), 2).otherwise(1))
    assert mixing.stream_positions(numbered.where("number = 1"), 64).select("at_").distinct().count() == 300


def test_excess_is_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 3, "z": 0}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    wanted = {"a": 30.0, "b": 964.0, "c": 15.0, None: 9.0, "z": 0.0}
    assert {r["source"]: r["target"] for r in got.collect()} == wanted


def test_schedule_spreads_sources(spark):
    goals = mixing.plan(spark.createDataFrame([("a", 60_000), ("b", 30_000), ("c", 10_000)], "source string, source_size long"), block_words=10)
    total = goals.agg(F.sum("need")).first()[0]
    need = {r["number"]: r["need"] for r in goals.collect()}
    slots = mixing.schedule(goals.select("number", "need", "from_", "upto_"), total).orderBy("slot").collect()
    assert Counter(s["number"] for s in slots) == need
    first = Counter(s["number"] for s in slots[: total // 10])
    assert all(abs(first[n] - need[n] / 10) < 8 for n in need)
    for n in need:
        assert [s["rank"] for s in slots if s["number"] == n] == list(range(need[n]))


def test_word_count(docs):
    for r in docs.select("text", mixing.word_count("text").alias("n")).collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from([*" \n\t\r 　'st.,\x1c\x85²½_|<>"]), st.characters(codec="utf-8")), max_size=40), max_size=3), st.integers(0, 2))
def test_memo_encodes_as_the_library(texts, names):
    texts = texts + ["<|endoftext|>".join(texts)] * names
    got = [np.frombuffer(e, dtype="<u4").tolist() for e in token_files.encoder("byte_bpe_50k.json").encode(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


ODD = ["\x1c", "\n\x1c", "'s", "\u1c89", "\U00013460", "\U000143fa", "\U00010d40", "²", "½", "Ⅷ", "é", "a", " ", "\n", "1", "_", "\u0301", "\U00032400", "\u0378", "'ll", "\x85", "٣"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from(ODD), max_size=6).map("".join), max_size=4), max_size=5))
def test_ids_do_not_hang_on_what_came_before(batches):
    one = token_files.Encoder(token_files.encoder("byte_bpe_50k.json").path)
    for texts in batches:
        got = [np.frombuffer(e, dtype="<u4").tolist() for e in one.encode(texts)]
        assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_character_before_a_contraction():
    """Of each code point, as the one before a contraction and after a letter."""
    one = token_files.encoder("byte_bpe_50k.json")
    texts = [f"a{chr(c)}'s {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or unicodedata.category(chr(c)) != "Cn" and c % 7 == 0 or 0x10D40 <= c < 0x10D90 or 0x13460 <= c < 0x14400 or 0x16100 <= c < 0x16200)]
    got = [np.frombuffer(e, dtype="<u4").tolist() for e in one.encode(texts)]
    assert got == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_a_full_memo_changes_no_ids(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_PIECES", 3)
    one = token_files.Encoder(token_files.encoder("byte_bpe_50k.json").path)
    texts = ["one two three four", "five six one", "\x1c's two", "two seven"]
    assert [np.frombuffer(e, dtype="<u4").tolist() for e in one.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(one.memo) == 3


def test_special_names_have_their_ids():
    got = token_files.encoder("byte_bpe_50k.json").encode(["a", "a <|endoftext|> b", None, "b"])
    assert [np.frombuffer(e, dtype="<u4").tolist() for e in got] == [[64], [64, 220, 50256, 275], [], [65]]


def test_token_files_round_trip(docs, doc_rows, no_docs):
    got = list(map(tuple, token_files.token_digest(docs).orderBy("start").collect()))
    ids = {(r[0], r[1]): LIBRARY.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in doc_rows}
    assert [g[0] for g in got] == sorted((r[0] for r in doc_rows), key=lambda k: (k is not None, k or 0))
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((r[0], len(ids[r[:2]]), zlib.crc32(np.array(ids[r[:2]], dtype="<u4").tobytes())) for r in doc_rows)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert token_files.token_digest(no_docs).count() == 0


def test_blocks_and_index(tmp_path):
    from tessera.llm.files import open_input, open_output

    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50_257, n, dtype=np.uint32).astype("<u4") for n in (0, 5, 1000, 1, 70)]
    writer = token_files.Writer(open_output(str(tmp_path / "x.tpk")), block_ids=64)
    writer.add([3, None, 5, 5, 9], [t.tobytes() for t in texts])
    writer.finish()
    with open_input(str(tmp_path / "x.tpk")) as source:
        reader = token_files.Reader(source)
        assert [e[1] for e in reader.index] == [64] * 16 + [1076 - 64 * 16]
        assert reader.block(3).tolist() == np.concatenate(texts)[192:256].tolist()
        for (key, size, pieces), text, wanted in zip(reader.documents_ids(), texts, [3, None, 5, 5, 9], strict=True):
            assert key == wanted and size == len(text) and np.concatenate([*pieces, np.array([], dtype="<u4")]).tolist() == text.tolist()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u\n", "x" * 3_000_000), (2, None, "x" * 3_000_000), (None, "v", None), (4, "w", ""), (5, "z", "é" * 10), (5, "z", "é" * 10), (3, "http://a/b?c", "<p>1</p>")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark, pages):
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = Counter(map(tuple, warc.round_trip(pages).collect()))
    x, e = "x" * 3_000_000, "é" * 10
    assert got == Counter([(1, 3_000_000, b32(x), "revisit", 2), (2, 3_000_000, b32(x), "response", None), (None, 0, b32(""), "revisit", 4), (4, 0, b32(""), "response", None), (5, 20, b32(e), "response", None), (5, 20, b32(e), "response", None), (3, 8, b32("<p>1</p>"), "response", None)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_of_the_table_equal_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)  # many files a task
    rows = [(r["page_id"], r["url"], r["html"]) for r in table(spark, sf, "pages").collect()]
    rows += [(10_000 + k, "hot", "<p>one very common page</p>") for k in range(300)] + [(20_000 + k, "u", rows[0][2]) for k in range(2)]
    largest = {}
    for page_id, _, html in rows:
        largest[html or ""] = max(page_id, largest.get(html or "", page_id))
    wanted = Counter()
    for page_id, _, html in rows:
        body, first = (html or "").encode(), largest[html or ""]
        wanted[page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if page_id == first else "revisit", None if page_id == first else first] += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert Counter(map(tuple, warc.round_trip(pages).collect())) == wanted
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    assert warc.write(pages, folder) == len(rows) and warc.read(spark, folder).rdd.getNumPartitions() > 5


def test_archive_filters_are_pushed_down(spark, pages):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, folder)
    revisits = warc.read(spark, folder).where("record_type = 'revisit'")
    assert "record_type = revisit" not in revisits._jdf.queryExecution().executedPlan().toString()
    assert revisits.count() == 2
    found = warc.read(spark, folder, payload=False).where(F.col("target_uri").isin("w", "z")).collect()
    assert {(r["record_id"], r["payload"], r["payload_length"]) for r in found} == {("urn:page:4", None, 0), ("urn:page:5", None, 20)}


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_truncated_archives_are_named(spark, tmp_path, name):
    whole = warc.record(7, "u", bytes(range(256)) * 9000, None, "D")
    whole = warc.member(whole) if name.endswith("gz") else whole
    (tmp_path / name).write_bytes(whole[: len(whole) * 2 // 3])
    with pytest.raises(Exception, match="ends within the record at byte 0"):
        warc.read(spark, str(tmp_path)).collect()


def test_foreign_archives_are_read(spark, tmp_path):
    import gzip

    plain = warc.record(7, "u", b"abc", None, "D") + warc.record(8, "v", b"", 7, "D")
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.record(9, "u", b"q" * 5000, None, "D")) + gzip.compress(warc.record(10, "u", b"r", None, "D")))
    got = warc.read(spark, str(tmp_path)).orderBy("record_id").collect()
    assert {(r["record_id"], r["record_type"], r["payload_length"], r["payload"] and len(r["payload"])) for r in got} == {("urn:page:7", "response", 3, 3), ("urn:page:8", "revisit", 0, None), ("urn:page:9", "response", 5000, 5000), ("urn:page:10", "response", 1, 1)}


def test_pipeline_equals_its_stages(spark, sf):
    docs = table(spark, sf, "documents")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, docs, sf)
    assert good.columns == docs.columns
    once = stage["n-gram Jaccard join"](spark, good, sf)
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({c for _, _, c in brute_components(rows)})
    clean = stage["benchmark decontamination"](spark, once, sf)
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in table(spark, sf, "benchmark").collect()]
    leaks = {r["doc_id"] for r in once.collect() if any(i in " ".join(re.findall(r"\w+", r["text"].lower())) for i in items)}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in once.collect()} - leaks
    mixed = stage["mixing sources to target weights"](spark, clean, sf)
    assert mixed.columns == docs.columns and all(left[r["doc_id"]] == r["text"] for r in mixed.collect())
    out = corpus_pipeline.run(spark, sf)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path, docs):
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, hits string, kept string, number string, target string"
    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, rows in (("empty", []), ("odd", [(None, None, None, None, None, "r", "h", "k", "n", "t"), (1, "", "en", None, 0, "r", "h", "k", "n", "t"), *[(k, " ".join(f"w{k}x{j}" for j in range(90)), "en", "s", 1, "r", "h", "k", "n", "t") for k in (2, 3)]])):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], items).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()) == [2, 3]
    left = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, f"{tmp_path}/odd")
        assert left.columns == columns.replace(" long", "").replace(" string", "").split(", "), name
        assert {r["hits"] for r in left.collect()} == {"h"}
