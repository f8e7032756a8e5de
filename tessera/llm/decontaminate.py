"""Benchmark decontamination: greedy string tiling of benchmark items over documents.

Seeds, runs of MIN_MATCH words in common, join documents with items. For each pair the longest
matches are marked first, again and again, each word at most once, by Karp-Rabin fingerprints of
all unmarked runs; the share of the item's words inside the tiles is its coverage. Tiles may stand
in any order, so reordered passages are covered too.

An item of fewer words has no such seed: it is one tile itself, and covered where its words stand
one after another. The item index is shipped to the executors if it has at most BROADCAST_SEEDS
seeds; beyond that, seeds are joined by a shuffle. Both give the same hits, in order of items.

Defined results: words are runs of letters, digits and underscores, lower-cased; null and empty
texts and items match nothing; equal items are each
reported; repeated rows are each reported; null ids are kept; very long texts are whole (only the
words inside seeds are tiled); columns of any name stay, in one struct; without items or documents nothing is found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import tidy
from tessera.session import cut

MIN_MATCH = 4
#: Share of an item's words in tiles from which a document counts as contaminated.
COVERAGE = 0.6
#: Largest item index, in seeds, that is shipped to every executor (about 100 bytes a seed).
BROADCAST_SEEDS = 1_000_000

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.LongType()), T.StructField("longest", T.LongType())]))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def fingerprints(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin fingerprints, modulo 2**64, of all runs of ``width`` ids."""
    out = np.zeros(max(0, len(ids) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = out * _BASE + ids[k : k + len(out)]
    return out


class _Rolling:
    """Fingerprints of runs of any width from one pass of prefix fingerprints."""

    def __init__(self, ids: np.ndarray) -> None:
        prefix, powers, h, p = [0], [1], 0, 1
        base, mask = int(_BASE), (1 << 64) - 1
        for x in ids.tolist():
            h, p = (h * base + x) & mask, (p * base) & mask
            prefix.append(h)
            powers.append(p)
        self.prefix, self.powers = np.array(prefix, dtype=np.uint64), np.array(powers, dtype=np.uint64)

    def of(self, width: int) -> np.ndarray:
        return self.prefix[width:] - self.prefix[:-width] * self.powers[width]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Where a run of ``width`` begins without a marked word."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[width:] == total[:-width]


def tiles(pattern: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(pattern position, text position, length) of the tiles, longest first; id 0 never matches."""
    longest = min(len(pattern), len(text))
    if longest < min_match:
        return []
    p, t = _Rolling(pattern), _Rolling(text)
    p_marked, t_marked = pattern == 0, text == 0
    out: list[tuple[int, int, int]] = []
    for width in range(longest, min_match - 1, -1):
        ps, ts = np.flatnonzero(_free(p_marked, width)), np.flatnonzero(_free(t_marked, width))
        if not len(ps) or not len(ts):
            continue
        p_prints, t_prints = p.of(width)[ps], t.of(width)[ts]
        common = np.isin(p_prints, t_prints)
        if not common.any():
            continue
        where: dict[int, list[int]] = defaultdict(list)
        for at, print_ in zip(ts.tolist(), t_prints.tolist(), strict=True):
            where[print_].append(at)
        for at, print_ in zip(ps[common].tolist(), p_prints[common].tolist(), strict=True):
            if p_marked[at : at + width].any():
                continue
            for to in where[print_]:
                if not t_marked[to : to + width].any() and np.array_equal(pattern[at : at + width], text[to : to + width]):
                    p_marked[at : at + width] = t_marked[to : to + width] = True
                    out.append((at, to, width))
                    break
    return out


@dataclass
class ItemIndex:
    """Items as word ids, and the items of each seed."""

    min_match: int = MIN_MATCH
    number: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int | None, np.ndarray]] = field(default_factory=list)
    seeds: np.ndarray = field(default_factory=lambda: np.array([], dtype=np.uint64))
    owners: list[list[int]] = field(default_factory=list)
    short: dict[tuple[int, ...], list[int]] = field(default_factory=dict)  # items that are no longer than a seed's part

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], min_match: int = MIN_MATCH) -> ItemIndex:
        out, by_seed = cls(min_match), defaultdict(list)
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([out.number.setdefault(w, len(out.number) + 1) for w in words], dtype=np.uint64)
            if len(words) < min_match:
                out.short.setdefault(tuple(ids.tolist()), []).append(len(out.items))
            for seed in np.unique(fingerprints(ids, min_match)).tolist():
                by_seed[seed].append(len(out.items))
            out.items.append((item_id, ids))
        out.seeds = np.array(sorted(by_seed), dtype=np.uint64)
        out.owners = [by_seed[s] for s in out.seeds.tolist()]
        return out

    def hits(self, text: str | None, coverage: float) -> list[dict]:
        """The items that a text covers to at least ``coverage``."""
        if not text or not self.items:
            return []
        get = self.number.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.uint64)
        by_item: dict[int, list[int]] = defaultdict(list)
        if len(ids) >= self.min_match and len(self.seeds):
            prints = fingerprints(ids, self.min_match)
            place = np.minimum(np.searchsorted(self.seeds, prints), len(self.seeds) - 1)
            at = np.flatnonzero(self.seeds[place] == prints)
            for k, seed in zip(at.tolist(), place[at].tolist(), strict=True):
                for item in self.owners[seed]:
                    by_item[item].append(k)
        contained = {item for words in self._contained(ids) for item in self.short[words]}
        out = []
        for item, starts in sorted((by_item | dict.fromkeys(contained, [])).items()):
            if item in contained:
                n = len(self.items[item][1])
                out.append({"item_id": self.items[item][0], "coverage": 1.0, "tiles": 1, "longest": n})
                continue
            item_id, pattern = self.items[item]
            found = self._tile(pattern, ids, np.array(starts))
            covered = sum(n for _, _, n in found)
            if covered >= coverage * len(pattern):
                out.append({"item_id": item_id, "coverage": covered / len(pattern), "tiles": len(found), "longest": max(n for _, _, n in found)})
        return out

    def _contained(self, ids: np.ndarray) -> set[tuple[int, ...]]:
        """The short items' words that stand one after another."""
        found = set()
        for width in {len(w) for w in self.short}:
            known = np.flatnonzero(_free(ids == 0, width)) if len(ids) >= width else []
            found |= {w for k in known if (w := tuple(ids[k : k + width].tolist())) in self.short}
        return found

    def _tile(self, pattern: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """Tiles over the words inside this item's seeds; a match of MIN_MATCH words has no others."""
        inside = np.zeros(len(ids) + 1, dtype=bool)
        for k in range(self.min_match):
            inside[starts + k] = True
        kept = inside | np.r_[False, inside[:-1]]  # one word after each zone, blanked, parts the zones
        zone = np.where(inside[:-1], ids, np.uint64(0))[kept[:-1]]
        return tiles(pattern, zone, self.min_match)


def hits_column(items: DataFrame, text: str | Column, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> Column | None:
    """The hits of each text as an array, with a shipped index; None if the index is too large to ship."""
    n = F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+"))
    if (items.agg(F.sum(F.coalesce(n, F.lit(0)))).first()[0] or 0) > BROADCAST_SEEDS:
        return None
    index = ItemIndex.build(sorted(((r[0], r[1]) for r in items.select("item_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), min_match)
    shipped = items.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shipped.value
        for texts in batches:
            yield pd.Series([known.hits(t, coverage) for t in texts], dtype=object)
            tidy()

    return find(text)


def _seeds(text: str, width: str) -> Column:
    """Distinct seeds of each text, by hashes of its words: runs of so many words as a column says."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series, widths: pd.Series) -> pd.Series:
        import xxhash

        def seeds(text, width):
            ids = np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(text)], dtype=np.uint64)
            return np.unique(fingerprints(ids, width) ^ np.uint64(width)).astype(np.int64) if len(ids) >= width else []

        return pd.Series([None if t is None else seeds(t, w) for t, w in zip(texts, widths, strict=True)], dtype=object)

    return of(text, width)


def hits_by_join(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """text and hits of each distinct text with hits, by a shuffle join of seeds.

    Seeds are MIN_MATCH words, or all of an item that has fewer; texts have seeds of the widths that
    items have, of which there are at most MIN_MATCH.
    """
    texts = docs.where("text is not null").select(docs["text"].alias("text"), F.sha2("text", 256).alias("key")).dropDuplicates(["key"])
    width = F.least(F.regexp_count("item_text", F.lit(r"[\p{L}\p{N}_]+")), F.lit(MIN_MATCH))
    named = items.where("text is not null").select("item_id", F.col("text").alias("item_text")).withColumn("width", width).where("width > 0")
    named = cut(named.withColumn("place", F.monotonically_increasing_id()))
    widths = [r["width"] for r in named.select("width").distinct().collect()]
    item_seeds = named.select("place", F.explode(_seeds("item_text", "width")).alias("seed"))
    text_seeds = texts.select("key", "text", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")).alias("width")).select("key", F.explode(_seeds("text", "width")).alias("seed"))
    common = text_seeds.join(cut(item_seeds), "seed").select("key", "place").distinct()
    pairs = common.join(named, "place").join(texts, "key").select("key", "text", "item_id", "item_text")

    @F.pandas_udf(HITS)
    def tile(texts_: pd.Series, ids: pd.Series, item_texts: pd.Series) -> pd.Series:
        return pd.Series([ItemIndex.build([(None if pd.isna(i) else int(i), x)]).hits(t, coverage) for t, i, x in zip(texts_, ids, item_texts, strict=True)], dtype=object)

    found = pairs.select("key", F.explode(tile("text", "item_id", "item_text")).alias("hit"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("hit.item_id").isNotNull().alias("known"), F.col("hit.item_id").alias("item"), "hit")))
    return texts.join(found.groupBy("key").agg(F.transform(ordered, lambda h: h.hit).alias("hits")), "key").select("text", "hits")


def contamination(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """row, a struct of the columns of docs (text, ...), and hits, the array of the items that each text covers."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    column = hits_column(items, "text", coverage)
    if column is not None:
        return rows.select("row", column.alias("hits"))
    found = hits_by_join(rows, items, coverage).select(F.sha2("text", 256).alias("key"), "hits")
    joined = rows.withColumn("key", F.sha2("text", 256)).join(found, "key", "left")
    return joined.select("row", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def op4(spark, sf_dir: str) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, coverage, tiles, longest."""
    from tessera.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("row.doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
