"""Periodic runs: branching tandem repeats of a suffix tree, rotated and merged to maximal runs.

Of each document's words a suffix tree is built: suffixes are sorted by doubling, and the tree's
inner nodes are the intervals of suffixes with a common prefix. As Stoye and Gusfield do, every node
lists the leaves of all children but its largest; a leaf p of a node of depth D makes a branching
tandem repeat with p + D or p - D if that leaf is in the node and in another child. A leaf is listed
at most log n times. Every maximal run of period q ends in exactly one branching repeat of period q;
it is rotated to the left as far as the period holds, and repeats that come to the same stretch are
merged, the smallest period counting.

Only stretches of words that can stand in a run get a tree: a run of at least LEAST words and EXPONENT
periods holds two equal windows of LEAST - LEAST // EXPONENT words around each of its words, so words
outside all windows that a text has twice are in no run (an exact filter; equal hashes of different
windows only add words to the trees).

Defined results: a null or empty text has no words and no run; runs are found in whole texts of any
length, in memory in proportion to it; a null doc_id alters nothing; repeated rows are each judged
for themselves; extra columns stay as they are, since the result is one struct; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least so many words, and so many periods.
LEAST, EXPONENT = 24, 3
#: Leaves that are looked at together.
LEAVES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def repeated_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Which words stand in a window of ``width`` words that occurs at least twice."""
    n = len(codes)
    inside = np.zeros(n, dtype=bool)
    if n <= width:
        return inside
    prints = codes.astype(np.uint64) * _MIX
    prints = (prints ^ (prints >> np.uint64(32))) * _MIX
    prints, step, left = prints ^ (prints >> np.uint64(29)), 1, width - 1
    while left:  # windows of 2, 4, ... words, the last step being what is left
        move = min(step, left)
        prints = (prints[:-move] ^ (prints[:-move] >> np.uint64(29))) * _MIX + prints[move:]
        step, left = step + move, left - move
    ordered = np.sort(prints)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        starts = np.flatnonzero(np.isin(prints, twice))
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + width, -1)
        inside = np.cumsum(edges)[:n] > 0
    return inside


class SuffixTree:
    """Suffixes of a text whose last symbol stands nowhere else, and its inner nodes."""

    def __init__(self, text: np.ndarray) -> None:
        self.text, n = text, len(text)
        #: classes[k][p]: the place in order of the 2**k symbols from p on, equal for equal ones.
        self.classes = [np.unique(text, return_inverse=True)[1]]
        while (last := self.classes[-1]).max() < n - 1:
            step = 1 << (len(self.classes) - 1)
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = last[step:] + 1
            self.classes.append(np.unique(last * (n + 1) + after, return_inverse=True)[1])
        self.rank = self.classes.pop()  # all different
        self.suffixes = np.empty(n, dtype=np.int64)
        self.suffixes[self.rank] = np.arange(n)
        self.nodes = self._nodes(self._common(self.suffixes[:-1], self.suffixes[1:]).tolist())

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common prefix of each two suffixes."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.classes))):
            length += (self.classes[k][a + length] == self.classes[k][b + length]).astype(np.int64) << k
        return length

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a and before b are equal, one by one."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.classes))):
            at, to = a - length - (1 << k), b - length - (1 << k)
            there = (at >= 0) & (to >= 0)
            length += (there & (self.classes[k][np.where(there, at, 0)] == self.classes[k][np.where(there, to, 0)])).astype(np.int64) << k
        return length

    @staticmethod
    def _nodes(common: list[int]) -> list[tuple[int, list[int]]]:
        """Depth of each inner node but the root, and where its children begin and the last one ends, in order of suffixes."""
        found: list[tuple[int, list[int]]] = []
        open_: list[tuple[int, list[int]]] = [(0, [0])]
        for i, depth in enumerate([*common, 0], 1):
            begin = i - 1
            while depth < open_[-1][0]:
                node = open_.pop()
                node[1].append(i)
                found.append(node)
                begin = node[1][0]
            if depth > open_[-1][0]:
                open_.append((depth, [begin, i]))
            elif depth:
                open_[-1][1].append(i)
        return found

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of every branching tandem repeat."""
        starts, periods, held, weight = [], [], [], 0
        for node in self.nodes:
            held.append(node)
            weight += node[1][-1] - node[1][0]
            if weight >= LEAVES:
                self._listed(held, starts, periods)
                held, weight = [], 0
        if held:
            self._listed(held, starts, periods)
        return np.concatenate([np.zeros(0, dtype=np.int64), *starts]), np.concatenate([np.zeros(0, dtype=np.int64), *periods])

    def _listed(self, nodes: list[tuple[int, list[int]]], starts: list, periods: list) -> None:
        counts = np.array([len(edges) - 1 for _, edges in nodes])
        edges = np.concatenate([np.array(e) for _, e in nodes])
        ends = np.cumsum(counts + 1) - 1
        child = np.delete(np.arange(len(edges)), ends)  # an edge that begins a child
        size = edges[child + 1] - edges[child]
        of = np.repeat(np.arange(len(nodes)), counts)
        first = np.cumsum(counts) - counts
        largest = np.lexsort((-np.arange(len(size)), size, of))[np.cumsum(counts) - 1]  # the last of each node in order of size
        size[largest] = 0
        low, high, depth = edges[child[first]], edges[ends] - 1, np.array([d for d, _ in nodes])
        leaf = np.arange(size.sum()) + np.repeat(edges[child] - (np.cumsum(size) - size), size)
        node = np.repeat(of, size)
        low, high, depth, p, n = low[node], high[node], depth[node], self.suffixes[leaf], len(self.text)
        for to, first_of_pair in ((p + depth, p), (p - depth, p - depth)):
            there = (to >= 0) & (to < n)
            rank = self.rank[np.where(there, to, 0)]
            there &= (rank >= low) & (rank <= high)
            i, d = first_of_pair[there], depth[there]
            branches = self.text[i + d] != self.text[i + 2 * d]
            starts.append(i[branches])
            periods.append(d[branches])


def runs_of(words: Sequence, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of the maximal runs of max(least, exponent * period) words, by start and period."""
    return _runs(words, np.fromiter(map(hash, words), dtype=np.int64, count=len(words)), least, exponent)


def _runs(words: Sequence, codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    inside = repeated_windows(codes, least - least // exponent)
    if not inside.any():
        return []
    at = np.flatnonzero(inside)
    number: dict = {}
    ids = np.fromiter((number.setdefault(words[k], len(number)) for k in at.tolist()), dtype=np.int64, count=len(at))
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    # a symbol of its own behind each stretch
    text = np.insert(np.append(ids, len(number)), breaks, len(number) + 1 + np.arange(len(breaks)))
    place = np.insert(np.append(at, -1), breaks, -1)
    tree = SuffixTree(text)
    start, period = tree.branching_repeats()
    back = tree.before(start, start + period)
    length = back + 2 * period
    start = start - back
    kept = length >= np.maximum(least, exponent * period)
    best: dict[tuple[int, int], int] = {}
    for s, n, q in zip(start[kept].tolist(), length[kept].tolist(), period[kept].tolist(), strict=True):
        best[s, n] = min(q, best.get((s, n), q))
    return sorted(((int(place[s]), n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def outside(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if every run is left with its first period."""
    kept = np.ones(n, dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exponent; the first of equal ones."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def altered(doc_id: str, n: int) -> np.ndarray | None:
    """Which word stands at each place once a tenth of the documents, by their id, repeat a part; None for the others."""
    g, rest = divmod(zlib.crc32(doc_id.encode()), 10)
    if rest or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


RUNS = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
        *(T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_kept", T.LongType()),
    ]
)


def report(text: str | None, doc_id: str | None = None) -> tuple:
    """RUNS of a text, altered by its id if one is given."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    if doc_id is not None and (source := altered(doc_id, len(words))) is not None:
        words, codes = [words[k] for k in source.tolist()], codes[source]
    runs = _runs(words, codes)
    top = strongest(runs)
    told = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    left = [words[k] for k in np.flatnonzero(outside(len(words), runs)).tolist()] if runs else words
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest(), len(words), len(left))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=RUNS.names)
    return out.astype({f.name: "Int64" for f in RUNS if f.dataType == T.LongType()})


@F.pandas_udf(RUNS)
def _altered_runs(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
    return _frame([report(t, i) for i, t in zip(ids, texts, strict=True)])


@F.pandas_udf(RUNS)
def _text_runs(texts: pd.Series) -> pd.DataFrame:
    return _frame([report(t) for t in texts])


def periodic_runs(text: str | Column) -> Column:
    """The runs of each text and what is left of it, as a struct (RUNS)."""
    return _text_runs(text)


def op13(spark, sf_dir: str) -> DataFrame:
    """doc_id and RUNS of every document, a tenth of them altered to repeat a part."""
    from tessera.session import table

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", _altered_runs(F.col("doc_id").cast("string"), "text").alias("r")).select("doc_id", "r.*")
