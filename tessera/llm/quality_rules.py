"""Quality rules: decision lists learned by sequential covering from labelled statistics.

Every whole text is measured once (``text_statistics``); a list of threshold conjunctions is grown
and pruned on labelled rows and turned into one ordered Spark conditional expression.

Defined results: a null or empty text has all counts 0 and fails the base rule; texts of any length
are measured whole; repeated rows are judged alike, each for itself; columns of any name stay,
since a row's own are in one struct and the measures in another; empty tables give empty
results; without usable labels the list is empty and keeps all that passes the base rule; a null
label or doc_id labels nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import small_batches, tidy

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_exclaim", "n_digits")
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_per_word": ("n_exclaim", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
}
FEATURES = ("n_words", *RATIOS)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
DIGITS = "0123456789"
UPPER_ASCII = bytes(range(65, 91))
#: The documented bound of the labelled sample that the list is fitted on.
SAMPLE_ROWS = 20_000


def repeated_words(ids: np.ndarray, n_distinct: int, width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur at least twice, the first one included."""
    if len(ids) <= width:
        return 0
    if n_distinct < 2_000_000:
        codes = ids[: len(ids) - width + 1].copy()
        for k in range(1, width):
            codes = codes * n_distinct + ids[k : len(ids) - width + 1 + k]
        _, inverse, times = np.unique(codes, return_inverse=True, return_counts=True)
    else:
        rows = np.lib.stride_tricks.sliding_window_view(ids, width)
        _, inverse, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[inverse.ravel()] >= 2)
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        inside[starts + k] = True
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        dup,
        repeated_words(ids, len(number)),
        lines,
        len(number),
        len(raw) - len(raw.translate(None, UPPER_ASCII)),
        text.count("!"),
        sum(text.count(c) for c in DIGITS),
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_statistics(texts: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([measure(t) for t in texts], columns=list(COUNTS), dtype="int64")
    tidy()
    return out


def feature(stats: str, name: str) -> Column:
    """A feature as a column over the struct of counts; 0 where its denominator is 0."""
    if name not in RATIOS:
        return F.col(f"{stats}.{name}").cast("double")
    top, below = (F.col(f"{stats}.{c}") for c in RATIOS[name])
    return F.when(below > 0, top / below).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.at_least else v <= self.threshold

    def column(self, stats: str) -> Column:
        v = feature(stats, self.feature)
        return v >= F.lit(self.threshold) if self.at_least else v <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """A conjunction; documents that it covers are rejected."""

    conditions: tuple[Condition, ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.at_least else '<='} {c.threshold:.4g}" for c in self.conditions)


def _candidates(x: np.ndarray, cuts: int) -> list[Condition]:
    """Threshold conditions between neighbouring quantiles of each feature."""
    out = []
    for j, name in enumerate(FEATURES):
        levels = np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts)))
        for t in (levels[:-1] + levels[1:]) / 2:
            out += [Condition(name, True, float(t)), Condition(name, False, float(t))]
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Add the condition with the largest FOIL gain until no good row is covered."""
    inside, chosen = np.ones(len(x), dtype=bool), []
    while len(chosen) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for c in _candidates(x[inside], cuts):
            now = inside & c.holds(x)
            p, n = (now & bad).sum(), (now & ~bad).sum()
            gain = p * (np.log2(p / (p + n)) - base) if p else 0.0
            if gain > best[0]:
                best = (gain, c, now)
        if best[1] is None:
            break
        chosen.append(best[1])
        inside = best[2]
    return Rule(tuple(chosen))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop final conditions while (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(r: Rule) -> float:
        hit = r.covers(x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, cuts: int = 40, precision: float = 0.9) -> list[Rule]:
    """Sequential covering: two thirds of the rows grow a rule, one third prunes and admits it.

    A rule is admitted if at least ``precision`` of the pruning rows it covers are bad; then the
    rows that it covers leave, and the next rule is learned from the rest.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    pruning = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules:
        g, h = left & ~pruning, left & pruning
        if (bad & g).sum() < 3 or not (~bad & g).any():
            break
        rule = _grow(x[g], bad[g], most_conditions, cuts)
        if not rule.conditions:
            break
        rule = _prune(rule, x[h], bad[h]) if h.any() else rule
        hit = rule.covers(x[h])
        if hit.sum() == 0 or bad[h][hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def verdict(rules: list[Rule], stats: str) -> Column:
    """The list as one ordered conditional: false at the first rule that fits, else true."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for c in rule.conditions:
            fits = fits & c.column(stats)
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: str) -> Column:
    return (F.col(f"{stats}.n_words") < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * F.col(f"{stats}.n_words"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn the list from at most ``sample_rows`` labelled documents, chosen by a hash of the id.

    The sample of labels is bounded, and so small enough to be broadcast; only its documents are
    measured here.
    """
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("label_")).orderBy(order, "doc_id", "label_").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label_", text_statistics("text").alias("s_"))
    # the base rule is applied after the limit: as a filter Spark would move it, with the measuring, below the join
    rows = rows.select(order.alias("h_"), "label_", base_failed("s_").alias("failed_"), *(feature("s_", f).alias(f) for f in FEATURES))
    with small_batches(docs.sparkSession):
        got = rows.orderBy("h_", "label_", *FEATURES).limit(sample_rows).toPandas()
    got = got[~got["failed_"].astype(bool)]
    if got.empty:
        return []
    return learn(got[list(FEATURES)].to_numpy(dtype=float), (got["label_"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """row, a struct of the columns of docs, stats, the struct of counts, base_failed and kept, for each row of docs (text, ...)."""
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text_statistics(docs["text"]).alias("stats"))
    failed = base_failed("stats")
    return out.withColumns({"base_failed": failed, "kept": F.when(failed, F.lit(False)).otherwise(verdict(rules, "stats"))})


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed and kept, for all documents."""
    from tessera.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    out = judge(docs, rules)
    return out.select("row.doc_id", *(f"stats.{c}" for c in COUNTS[:5]), "base_failed", "kept")
