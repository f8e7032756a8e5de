"""License scans: template markup compiled to token automata, run wherever a template can start.

A template is wording with ``<<beginOptional>> ... <<endOptional>>`` regions, which may be missing,
and ``<<var;max=N>>`` regions, which stand for up to N words of any kind. Each is compiled to a
nondeterministic automaton over words, whose sets of states are turned into a deterministic one as
texts need them; a text is labelled where an automaton accepts, so where all mandatory wording
stands exactly and in order. An automaton runs from every word that its template can start with, to
its acceptance or to the first word that no state can take; nothing else ends it.

Defined results: a null or empty text has no words, no places, empty labels and score 0; texts of
any length are read whole; score is the largest share of a template's mandatory words that the text
has in order from some word on, at least 0.5 with a base phrase, and 1 where one accepts; ties and
repeated rows are judged each for itself; only the text column is read, so extra columns can't
clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence wording with template markup.
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var;max=2>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var;max=2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_AS_IS = """the <<var;max=4>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<beginOptional>>non infringement<<endOptional>> <<beginOptional>>noninfringement<<endOptional>> in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the <<var;max=4>> or the use or other dealings in the <<var;max=4>>"""
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the <<var;max=4>> to deal in the <<var;max=4>> without restriction including without limitation the rights to use copy modify merge publish distribute <<beginOptional>>sublicense<<endOptional>> and or sell copies of the <<var;max=4>> and to permit persons to whom the <<var;max=4>> is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the <<var;max=4>>"""
TEMPLATES = (
    ("mit", "<<beginOptional>>this work is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", _MIT),
    ("mit", f"{_MIT} {_AS_IS}"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", """licensed under the apache license version 2 0 the license you may not use <<var;max=4>> except in compliance with the license you may obtain a copy of the license at <<var;max=12>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied <<beginOptional>>see the license for the specific language governing permissions and limitations under the license<<endOptional>>"""),
    ("gpl", "licensed under the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> <<var;max=2>>"),
    ("gpl", """is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license as published by the free software foundation <<beginOptional>>either<<endOptional>> version <<var;max=3>> <<beginOptional>>of the license or at your option any later version<<endOptional>>"""),
    ("bsd", _BSD),
    ("bsd", f"""{_BSD} <<beginOptional>><<var;max=2>> neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>> this software is provided by the <<var;max=8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;max=6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"""),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc <<var;max=1>> 4 0"),
    ("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution <<var;max=1>> international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial <<var;max=3>> international license"),
    ("mpl", "subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"),
    ("mit", "spdx license identifier mit"),
    ("apache", "spdx license identifier apache 2 0"),
    ("gpl", "spdx license identifier <<beginOptional>>l<<endOptional>> <<beginOptional>>a<<endOptional>> gpl <<var;max=4>>"),
)

_CLASSES = bytearray(b" " * 256)
_CLASSES[0x30:0x3A] = b"0123456789"
_CLASSES[0x41:0x5B] = _CLASSES[0x61:0x7B] = b"abcdefghijklmnopqrstuvwxyz"
_CLASSES[0x80:] = bytes(range(0x80, 0x100))
_CLASSES = bytes(_CLASSES)


def words_of(text: str | None) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, then runs of digits, a-z and what isn't ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLASSES).split()


@dataclass
class State:
    """A set of (item, words taken by it), what it says, and where words lead."""

    places: frozenset[tuple[int, int]]
    accepts: bool
    matched: int
    after: dict[bytes | None, State | None] = field(default_factory=dict)


@dataclass
class Automaton:
    """Items are words, ('open', index after its end), ('close',) and ('var', most words)."""

    label: str
    items: list = field(default_factory=list)
    mandatory: list[int] = field(default_factory=list)  # mandatory words before each item
    known: dict[frozenset, State] = field(default_factory=dict)
    start: State | None = None

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        out, opened, n = cls(label), [], 0

        def put(item, count=False):
            nonlocal n
            out.items.append(item)
            out.mandatory.append(n)
            n += count

        rest = template
        while rest:
            plain, _, rest = rest.partition("<<")
            for w in words_of(plain):
                put(w, count=not opened)
            mark, _, rest = rest.partition(">>")
            if mark == "beginOptional":
                opened.append(len(out.items))
                put(["open", None])
            elif mark == "endOptional":
                put(["close"])
                out.items[opened.pop()][1] = len(out.items)
            elif mark.startswith("var;max="):
                put(["var", int(mark.removeprefix("var;max="))])
            elif mark:
                raise ValueError(f"unknown markup <<{mark}>>")
        if opened:
            raise ValueError("an optional region isn't ended")
        out.mandatory.append(n)
        out.start = out._state({(0, 0)})
        if out.start.accepts or any(k < len(out.items) and out.items[k][0] == "var" for k, _ in out.start.places):
            raise ValueError("a template must start with a word of its own")
        return out

    def _state(self, places: set[tuple[int, int]]) -> State:
        """The state of these places and all that are reached from them without a word."""
        todo, seen, end = list(places), set(places), len(self.items)
        while todo:
            k, _ = todo.pop()
            if k >= end or isinstance(self.items[k], bytes):
                continue
            for to in (k + 1, self.items[k][1]) if self.items[k][0] == "open" else (k + 1,):
                if (to, 0) not in seen:
                    seen.add((to, 0))
                    todo.append((to, 0))
        key = frozenset(seen)
        if key not in self.known:
            self.known[key] = State(key, any(k == end for k, _ in key), max(self.mandatory[k] for k, _ in key))
        return self.known[key]

    def _next(self, state: State, word: bytes | None) -> State | None:
        after = set()
        for k, used in state.places:
            item = self.items[k] if k < len(self.items) else None
            if item is not None and item == word:
                after.add((k + 1, 0))
            elif isinstance(item, list) and item[0] == "var" and used < item[1]:
                after.add((k, used + 1))
        return self._state(after) if after else None

    def first_words(self) -> set[bytes]:
        return {self.items[k] for k, _ in self.start.places if isinstance(self.items[k], bytes)}

    def run(self, words: list[bytes], at: int) -> tuple[bool, float]:
        """Whether it accepts from word ``at``, and the share of mandatory words matched at best."""
        state, best, own = self.start, 0, self.own
        for k in range(at, len(words)):
            word = words[k] if words[k] in own else None
            if word in state.after:
                state = state.after[word]
            else:
                state.after[word] = state = self._next(state, word)
            if state is None:
                break
            if state.accepts:
                return True, 1.0
            best = max(best, state.matched)
        return False, best / max(1, self.mandatory[-1])

    @property
    def own(self) -> frozenset[bytes]:
        if not hasattr(self, "_own"):
            self._own = frozenset(i for i in self.items if isinstance(i, bytes))
        return self._own


AUTOMATA = [Automaton.compile(label, template) for label, template in TEMPLATES]
STARTS: dict[bytes, list[Automaton]] = {}
for _a in AUTOMATA:
    for _w in _a.first_words():
        STARTS.setdefault(_w, []).append(_a)
_PHRASES = [(phrase.encode().split(), label) for phrase, label in PHRASES]
_FIRST = frozenset(STARTS).union(p[0] for p, _ in _PHRASES)

FIELDS = (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))


def scan(text: str | None) -> tuple:
    """FIELDS of one text."""
    words = words_of(text)
    places, base, found, score = [], set(), set(), 0.0
    for k in [k for k, w in enumerate(words) if w in _FIRST]:
        w = words[k]
        for phrase, label in _PHRASES:
            if w == phrase[0] and words[k : k + len(phrase)] == phrase:
                places.append(k)
                base.add(label)
        for automaton in STARTS.get(w, ()):
            accepts, share = automaton.run(words, k)
            score = max(score, share)
            if accepts:
                found.add(automaton.label)
    if places:
        score = max(score, 0.5)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


@F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in FIELDS]))
def license_scan(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([scan(t) for t in texts], columns=[n for n, _ in FIELDS])
    return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id with the scan of every whole text of documents."""
    from tessera.session import table

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", license_scan("text").alias("s")).select("doc_id", "s.*")
