"""Personal data against plain regular expressions and the bootstrap's definition."""

import hashlib
import re
from collections import Counter, defaultdict

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import contextual_pii as P
from tessera.llm.contextual_pii import op12, personal_data
from tessera.session import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def brute_base(text):
    found = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                found.append((m.start(), place, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(found)]


def brute_added(texts):
    """Spans that the bootstrap adds to each text."""
    met, base = [], [brute_base(t) for t in texts]
    word = lambda t: re.findall(r"[^\W]+", t.lower())
    for row, text in enumerate(texts):
        matches = list(regex.finditer(P._ANY.replace(r"\z", r"\Z"), text or ""))
        ends = [0, *(m.end() for m in matches)]
        for k, m in enumerate(matches):
            before = word(text[max(ends[k], m.start() - P.CONTEXT_CHARS) : m.start()])
            after = word(text[m.end() : min(m.end() + P.CONTEXT_CHARS, matches[k + 1].start() if k + 1 < len(matches) else len(text))])
            patterns = [("1", before[-1])] if before else []
            patterns += [("2", *before[-2:])] if len(before) > 1 else []
            patterns += [("3", before[-1], after[0])] if before and after else []
            met.append((row, m.start(), m.end(), m[0].lower(), patterns))
    seeds = {i for row, s, e, i, _ in met if any((s, e) == (a, b) for a, _, b in base[row])}
    edges = Counter((p, i) for *_, i, patterns in met for p in patterns)
    places = Counter()
    for t in texts:
        w = word(t or "")
        places.update([("1", a) for a in w] + [("2", *x) for x in zip(w, w[1:], strict=False)] + [("3", *x) for x in zip(w, w[2:], strict=False)])
    own = Counter()
    for (p, _), n in edges.items():
        own[p] += n
    known, before = dict.fromkeys(seeds, 1.0), None
    found = {}
    for _ in range(P.TURNS):
        score, support = Counter(), Counter()
        for (p, i), n in edges.items():
            if i in known:
                score[p] += n * known[i]
                support[p] += 1
        accepted = {p: score[p] / max(places[p], own[p]) for p in score if support[p] >= P.SUPPORT and score[p] / max(places[p], own[p]) >= P.CONFIDENCE}
        doubt = defaultdict(lambda: 1.0)
        for p, i in edges:
            if p in accepted and i not in seeds:
                doubt[i] *= max(1 - accepted[p], 2.061153622438558e-09)
        found = {i: 1 - d for i, d in doubt.items() if 1 - d >= P.CONFIDENCE}
        if len(found) in (before, 0):
            break
        before, known = len(found), dict.fromkeys(seeds, 1.0) | found
    out = [[] for _ in texts]
    for row, s, e, i, _ in met:
        if i in found and not any(a < e and b > s for a, _, b in base[row]) and not any((s, e) == (a, b) for a, _, b in base[row]):
            out[row].append((s, P.ADDED, e))
    return out


def judged(spark, texts):
    rows = [(k, t, "clash", 1, "clash") for k, t in enumerate(texts)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string, kind string, row long, value string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    return [[tuple(s) for s in by[k]["base"]] for k in range(len(rows))], [[tuple(s) for s in by[k]["added"]] for k in range(len(rows))]


EDGES = [
    None,
    "",
    " ",
    "a@b.c",
    "a@b@c.d",
    "x.a@b.c..d e@f.g. h@i.j-",
    "a@b.c_d@e.f%g@h.i",
    "é ü a.b+c@d-e.fg.hi, 1.2.3.4.5.6.7.8",
    "300.1.1.1.1 0.00.000.255 1.2.3 256.1.1.1",
    "4111 1111 1111 1111",
    "4111-1111-1111-1111 5",
    "44785380592391139 4785380592391139",
    "1-2 3 4--5 6",
    "+1 (743) 555-3824 +1(2)3 ++49 30 1234567 +1234567890123456",
    "+1 (743) 555-3824, 4111111111111111, 1.1.1.1 a@1.1.1.1",
    "0" * 40,
    "x" * 3000 + "@y",
    "a@b" + ".c" * 20_000 + ".",
    "12.34." * 3000,
    "𝒳𝒴 a@b.c",
]


def test_base_spans_equal_plain_expressions(spark):
    got, _ = judged(spark, EDGES)
    for text, found in zip(EDGES, got, strict=True):
        assert found == brute_base(text), text


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("a1 9.@-+(%_é0", max_size=60), min_size=40, max_size=40))
def test_base_spans_of_any_text(spark, texts):
    got, added = judged(spark, texts)
    assert got == [brute_base(t) for t in texts]
    assert added == brute_added(texts)


PLANTED = [
    *(f"Some words. Please write to user{k}@mail{k}.example.com today or never." for k in range(5)),
    "Nothing else here. Please write to jane_doe_77 today or never.",
    "Others call jane_doe_77 at night, and bob-4711x at noon.",
    *(f"The account of holder {n} is closed." for n in ("jane_doe_77", "bob-4711x", "eve.1999.k")),
    "Please write to bob-4711x today. Please write to eve.1999.k today.",
    "The account of holder mallory#5150z is closed. In version 12345 nothing changed.",
    "the word 10.0.0.1 and the word 10.0.0.2 and the word 10.0.0.3 and the word release-2.0.1 and " + "the word alone and " * 40,
]


def test_contexts_find_what_has_no_form(spark):
    base, added = judged(spark, PLANTED)
    assert added == brute_added(PLANTED)
    told = {PLANTED[k][s:e] for k, spans in enumerate(added) for s, _, e in spans}
    assert told == {"jane_doe_77", "bob-4711x", "eve.1999.k", "mallory#5150z"}  # the last in a later turn
    assert [len(x) for x in base] == [1] * 5 + [0] * 7 + [3]


def test_query_equals_plain_expressions(spark, sf):
    rows = op12(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    added = dict(zip(docs, brute_added(list(docs.values())), strict=True))
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute_base(docs[r["doc_id"]])
        told = lambda x: ",".join(f"{k}:{s}:{e}" for s, k, e in x)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[1] == k for x in spans) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(told(spans).encode()).hexdigest()
        assert r["spans"] == told(sorted(spans + added[r["doc_id"]])) and r["n_context"] == len(added[r["doc_id"]])


def test_rows_of_a_table(spark, docs, doc_rows, no_docs):
    assert personal_data(docs).count() == len(doc_rows)
    assert personal_data(no_docs).count() == 0


def test_no_python_in_the_plan(docs):
    plan = personal_data(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
