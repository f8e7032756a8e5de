"""A small table of documents with nulls, empty, repeated and near texts, and clashing columns."""

import random

import pytest

WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "in") for b in ("ou", "ing", "ed", "st", "ly", "es", "tion")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, sig long"


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def near(rng, text, edits):
    parts = text.split(" ")
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = "changed" + str(rng.randrange(99))
    return " ".join(parts)


@pytest.fixture(scope="session")
def doc_rows():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(40, 120)) for _ in range(12)]
    texts = [None, "", " \n\t", "one two", "One  TWO", "a b c d e", *base]
    texts += [base[0]] * 5 + [base[1].upper(), base[2].replace(" ", "\n")]
    texts += [near(rng, base[3], k % 5) for k in range(25)] + [near(rng, base[4], 1) for _ in range(6)]
    texts += [" ".join(base[:3]), "again and again " * 60, words(rng, 6000), base[5] + "\nReleased under the MIT License."]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 4}", len(t or ""), -1, None, 3) for k, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, base[6], "en", "s1", 1, 0, True, 0), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
