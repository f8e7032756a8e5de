"""URL filters: hosts split into words by unigram Viterbi, then multinomial naive Bayes.

Word counts come from the parts that all URLs write separately: those of paths, and those beside a
hyphen in host names. No name vouches for itself: a whole host label counts for nothing, a path's
part only if its own host does not hold it, a word only if two hosts write it, and one made of seed
words is none. A word's probability mixes its share of all counts with a prior, which is the same
for every size of table: uniform over the seeds, and falling with the length for any other run of
letters. A name of letters is split into the words of highest total probability.

There are no labels for URLs. Those that hold a seed word, written separately or split off, train
``block``, all others ``allow``; naive Bayes learns from all of them which other words go with either,
so that names of such words are caught though no seed word is in them.

Counts, names and weights are tables that grow with the URLs and are joined, not shipped: a name is
exploded into its substrings of the lengths that counted words have, which meet their costs, and its
words are found from those that have one in a pass over its letters. Only the distinct (host, path)
pairs are scored. ``held_out`` measures what the words beside seeds tell: of URLs that trained
nothing, with their seed words hidden.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, score 0, and
is allowed; a rule wins by the length of its text; repeated rows are judged alike; long URLs are read
whole; only page_id and url are read; if no URL holds
a seed word, all undecided ones are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut

# The rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Words that mark URLs as spam, adverts or adult content for training.
SEEDS = tuple("ads adult advert betting bets bonus casino cialis clickbait escort gambling jackpot lottery malware phishing pills poker porn promo spam viagra xxx".split())
SMOOTHING = 0.5
#: Share of the prior in a word's probability, and what each letter of a run that is no counted word costs, in
#: logarithms; runs of fewer than SHORT letters cost as many.
PRIOR = 0.0025
UNKNOWN = 2.6
SHORT = 4
#: Parts of fewer letters, like languages' codes in paths, are no words that names are made of.
CODE = 3


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    named, said = None, None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        named = F.when(fits, h + p) if named is None else named.when(fits, h + p)
        said = F.when(fits, verdict) if said is None else said.when(fits, verdict)
    return named, said


def parts_of(host: Column, path: Column) -> Column:
    """The parts of letters beside a hyphen of the host, and those of the path, lower-cased, that the host does not hold."""
    beside = F.regexp_extract_all(host, F.lit(r"[a-z]+(?=-)|(?<=-)[a-z]+"), 0)
    return F.concat(beside, F.filter(F.regexp_extract_all(F.lower(path), F.lit(r"([a-z]+)"), 1), lambda w: ~F.contains(host, w)))


def names_of(host: Column, path: Column) -> Column:
    """All runs of letters of the host and of the path, lower-cased."""
    return F.regexp_extract_all(F.concat(host, F.lit("/"), F.lower(path)), F.lit("([a-z]+)"), 1)


def word_costs(urls: DataFrame, seeds=SEEDS) -> DataFrame:
    """word and cost, the negative logarithm of its probability, of what URLs (host, path) write separately, and of the seeds."""
    spark = urls.sparkSession
    parts = urls.select("host", F.explode(parts_of(F.col("host"), F.col("path"))).alias("word"))
    counts = parts.groupBy("word").agg(F.count("*").alias("count"), (F.min("host") != F.max("host")).alias("shared")).where("shared").select("word", "count")
    joined = f"^(?:{'|'.join(map(re.escape, seeds))}){{2,}}$"
    own = spark.createDataFrame([(w, 0) for w in seeds], "word string, count long")
    counts = cut(counts.where((F.length("word") >= CODE) & (F.col("word").isin(*seeds) | ~F.col("word").rlike(joined))).unionByName(own).groupBy("word").agg(F.sum("count").alias("count")))
    total = counts.agg(F.sum("count")).first()[0] or 1
    prior = F.when(F.col("word").isin(*seeds), F.lit(PRIOR / len(seeds))).otherwise(F.exp(-UNKNOWN * F.greatest(F.length("word"), F.lit(SHORT))) * PRIOR)
    return cut(counts.select("word", (-F.log(F.lit(1 - PRIOR) * F.col("count") / total + prior)).alias("cost")))


def unknown_cost(length: int) -> float:
    """What a run of letters costs that is no counted word."""
    return UNKNOWN * max(length, SHORT) - math.log(PRIOR)


def best_split(name: str, known: dict[tuple[int, int], float]) -> list[str]:
    """Viterbi: the words of least cost; known has the costs of counted words by begin and length.

    A run that is no counted word grows by a letter at UNKNOWN, so its begin is carried on from letter
    to letter, and the pass is linear in the name and the words known in it.
    """
    n = len(name)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for (at, size), cost in known.items():
        ending[at + size].append((at, cost))
    best, cut_at = [0.0] + [math.inf] * n, [0] * (n + 1)
    long, begun = math.inf, 0  # the least cost that ends in a run of SHORT letters or more, and its begin
    for end in range(1, n + 1):
        options = [(best[at] + cost, at) for at, cost in ending[end]]
        options += [(best[at] + unknown_cost(end - at), at) for at in range(max(0, end - SHORT + 1), end)]
        long += UNKNOWN
        if end >= SHORT and (now := best[end - SHORT] + unknown_cost(SHORT)) < long:
            long, begun = now, end - SHORT
        best[end], cut_at[end] = min([*options, (long, begun)])
    words, end = [], n
    while end:
        words.append(name[cut_at[end] : end])
        end = cut_at[end]
    return words[::-1]


def segmented(names: DataFrame, costs: DataFrame) -> DataFrame:
    """name and words of the distinct names (column name)."""
    sizes = [r["n"] for r in costs.select(F.length("word").alias("n")).distinct().collect()]  # as many as lengths of words
    spots = F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.when(n <= F.length("name"), F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda k: F.struct(k.alias("at"), n.alias("n")))).otherwise(F.array().cast("array<struct<at:int,n:int>>"))))
    pieces = names.select("name", F.explode(spots).alias("s")).select("name", "s", F.substring("name", F.col("s.at"), F.col("s.n")).alias("word"))
    met = pieces.join(costs, "word").groupBy("name").agg(F.collect_list(F.struct("s.at", "s.n", "cost")).alias("known"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batch: pd.Series, known: pd.Series) -> pd.Series:
        found = [{} if k is None else {(x["at"] - 1, x["n"]): x["cost"] for x in k} for k in known]
        return pd.Series([best_split(n, k) for n, k in zip(batch, found, strict=True)], dtype=object)

    return names.join(met, "name", "left").select("name", split("name", "known").alias("words"))


def bayes_weight(allow: Column, block: Column, totals: dict[str, float]) -> Column:
    """Log odds of block against allow of a word with these counts."""
    return F.log((block + SMOOTHING) / totals["block"]) - F.log((allow + SMOOTHING) / totals["allow"])


def url_words(urls: DataFrame, seeds=SEEDS) -> tuple[DataFrame, DataFrame]:
    """The distinct urls (host, path), and their words (host, path, word, and seed, whether it is one or stands in a name that is)."""
    costs = word_costs(urls, seeds)
    distinct = cut(urls.where("host <> ''").select("host", "path").distinct())
    runs = distinct.select("host", "path", F.explode(names_of(F.col("host"), F.col("path"))).alias("name"))
    split = cut(segmented(runs.select("name").distinct(), costs))
    words = runs.join(split, "name").select("host", "path", F.explode("words").alias("word"), F.col("name").isin(*seeds).alias("whole"))
    return distinct, cut(words.select("host", "path", "word", (F.col("whole") | F.col("word").isin(*seeds)).alias("seed")))


def learned(words: DataFrame, labels: DataFrame) -> tuple[DataFrame, float] | None:
    """word and weight, and the prior log odds of block, from words of urls and labels (host, path, block); None if all have one label."""
    by_word = cut(words.join(labels, ["host", "path"]).groupBy("word").agg(F.count_if("block").alias("block"), F.count_if(~F.col("block")).alias("allow")))
    sums = by_word.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    n_block, n_allow = labels.agg(F.count_if("block"), F.count_if(~F.col("block"))).first()
    if not n_block or not n_allow:
        return None
    totals = {"block": sums[0] + SMOOTHING * (sums[2] + 1), "allow": sums[1] + SMOOTHING * (sums[2] + 1)}
    return by_word.select("word", bayes_weight(F.col("allow"), F.col("block"), totals).alias("weight")), math.log(n_block / n_allow)


def scored(distinct: DataFrame, words: DataFrame, weights: DataFrame, odds: float) -> DataFrame:
    summed = words.join(weights, "word").groupBy("host", "path").agg(F.sum(F.col("weight").cast("decimal(24,9)")).cast("double").alias("sum"))
    return distinct.join(summed, ["host", "path"], "left").select("host", "path", (F.coalesce("sum", F.lit(0.0)) + F.lit(odds)).alias("score"))


def url_scores(urls: DataFrame, seeds=SEEDS) -> DataFrame:
    """host, path and score, the log odds of block, of the distinct urls (host, path)."""
    distinct, words = url_words(urls, seeds)
    labels = cut(words.groupBy("host", "path").agg(F.max("seed").alias("block")))
    model = learned(words, labels)
    if model is None:
        return distinct.withColumn("score", F.lit(-1.0 if labels.where("block").isEmpty() else 1.0))
    return scored(distinct, words, *model)


def held_out(urls: DataFrame, seeds=SEEDS, folds: int = 3) -> tuple[int, int, int]:
    """Urls with a seed word that are found, urls without that are blocked, and urls with a seed word that are missed.

    Each fold of URLs is scored by what the others' words teach, with its own seed words hidden.
    """
    _, words = url_words(urls, seeds)
    words = words.withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(folds)))
    labels = cut(words.groupBy("host", "path", "fold").agg(F.max("seed").alias("block")))
    found = wrong = missed = 0
    for k in range(folds):
        model = learned(words.where(F.col("fold") != k).drop("fold"), labels.where(F.col("fold") != k).drop("fold"))
        own = labels.where(F.col("fold") == k)
        said = F.lit(False) if model is None else F.col("score") > 0
        told = own if model is None else own.join(scored(own.select("host", "path"), words.where((F.col("fold") == k) & ~F.col("seed")), *model), ["host", "path"])
        r = told.agg(F.count_if(F.col("block") & said), F.count_if(~F.col("block") & said), F.count_if(F.col("block") & ~said)).first()
        found, wrong, missed = found + r[0], wrong + r[1], missed + r[2]
    return found, wrong, missed


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (page_id, url)."""
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    scores = cut(url_scores(rows, seeds))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    score = F.coalesce(F.round("score", 6), F.lit(0.0))
    return rows.join(scores, ["host", "path"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op9(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every url."""
    from tessera.session import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
