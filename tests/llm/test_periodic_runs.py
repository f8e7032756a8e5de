"""Runs against the definition, period by period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.periodic_runs import SuffixTree, op13, periodic_runs, repeated_windows, report, runs_of
from tessera.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, exponent=3):
    """Stretches that keep each period, of which the smallest counts."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        k = 0
        while k + q < n:
            e = k
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - k + q >= max(least, exponent * q):
                found.setdefault((k, e - k + q), q)
            k = max(e, k) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 12)), max_size=8), st.sampled_from([(24, 3), (6, 3), (4, 2)]))
def test_runs_equal_brute_force(parts, sizes):
    words = list("".join(x * k for x, k in parts))
    assert runs_of(words, *sizes) == brute_runs(words, *sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_tree_is_the_suffix_tree(symbols):
    text = [*symbols, 9]
    tree = SuffixTree(np.array(text))
    assert tree.suffixes.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    nodes = {tuple(text[tree.suffixes[edges[0]] :][:depth]): edges[-1] - edges[0] for depth, edges in tree.nodes}
    wanted = {}
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            w = tuple(text[i:j])
            at = [k for k in range(len(text)) if tuple(text[k : k + len(w)]) == w]
            if len({text[k + len(w)] for k in at if k + len(w) < len(text)}) > 1:
                wanted[w] = len(at)
    assert nodes == wanted
    start, period = tree.branching_repeats()
    repeats = {(i, d) for i in range(len(text)) for d in range(1, (len(text) - i) // 2 + 1) if text[i : i + d] == text[i + d : i + 2 * d] and (i + 2 * d == len(text) or text[i + d] != text[i + 2 * d])}
    assert set(zip(start.tolist(), period.tolist(), strict=True)) == repeats


def test_words_of_runs_stand_in_repeated_windows():
    rng = random.Random(3)
    for _ in range(40):
        words = [rng.randrange(4) for _ in range(rng.randrange(60))]
        words += [words[k % min(7, len(words))] if words else 0 for k in range(rng.randrange(50))] + [rng.randrange(4) for _ in range(30)]
        grams = [tuple(words[k : k + 16]) for k in range(len(words) - 15)]
        wanted = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(16)}
        assert set(np.flatnonzero(repeated_windows(np.array(words, dtype=np.int64), 16)).tolist()) == wanted


def brute_report(text, doc_id=None):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "a " * 23, "a " * 24, "a b " * 12 + "a", "x\x1cy " * 30, "é ü\v" * 40 + "z " * 40, "a b c d e f g h i j " * 3, "a a b " * 9 + "a a a " * 9])
def test_reports_of_texts(text):
    assert report(text)[:7] == brute_report(text)


def test_table_equals_brute_force(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:8] for r in op13(spark, sf).collect()}
    docs = [r for r in table(spark, sf, "documents").collect() if len(r["text"]) < 12_000]
    assert len(docs) > 150 and sum(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in docs) > 5
    for r in docs:
        assert got[r["doc_id"]] == brute_report(r["text"], r["doc_id"])


def test_rows_of_a_table(spark, docs, doc_rows, no_docs):
    got = docs.withColumn("start", F.lit(1)).select("*", periodic_runs("text").alias("r")).collect()
    assert len(got) == len(doc_rows) and all(r["start"] == 1 for r in got)
    for r in got:
        assert tuple(r["r"])[:7] == (brute_report(r["text"]) if len(r["text"] or "") < 12_000 else tuple(r["r"])[:7])
    assert no_docs.select(periodic_runs("text")).count() == 0


def test_long_texts_are_whole():
    same = report("word " * 300_000)
    assert same[:5] == (1, 0, 300_000, 1, 300_000_000) and same[8] == 1
    part = " ".join(f"w{k}" for k in range(60_000))
    assert report(f"begin {part} {part} {part} w0 end")[:5] == (1, 1, 180_001, 60_000, 3000)
