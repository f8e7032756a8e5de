"""Personal data by bootstrapped contexts, in DataFrame functions only.

Entities with a form of their own (e-mail and IP addresses, card and phone numbers) are the seeds.
The words beside them make lexical patterns: the word before, the two words before, the words before
and behind. Identifier-like strings, which have a digit, an @ or such a form, are the instances; a
pattern and an instance met together are an edge of a graph. A pattern's confidence is the share of
its places in the corpus, whatever stands there, that belongs to instances taken for personal so far;
it counts from SUPPORT different instances on. An instance's is 1 for seeds, else that of the
patterns it was met with, together. Both are worked out in turns; instances that end at CONFIDENCE
or above are personal wherever they stand.

Matches have no positions in Spark: a text is split at a pattern, and the lengths of the pieces and
matches are added up by a window. Patterns and instances are named by 64-bit hashes. Places of all
words are counted for patterns with SUPPORT instances only, which a map of MAP_BITS bits, shipped
whatever the data's size, tells from most others before anything is shuffled; the counts are exact.

Defined results: a null or empty text has no spans; texts of any length are read whole; a row is a
document, also with a repeated or null doc_id; an added span never touches a base one; extra columns
stay out; an empty table gives an empty result; without seeds nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Different instances that a pattern needs, the confidence of patterns and instances, and the most turns.
SUPPORT = 3
CONFIDENCE = 0.5
TURNS = 4
#: Characters of the text before a match that its context is taken from.
CONTEXT_CHARS = 80
MAP_BITS = 18

# Each finds what the plain form finds, leftmost and non-overlapping, but starts only where a run of
# its characters does, or where the match before ended, so that long runs take linear time.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_LIKE = r"(?<![A-Za-z0-9_])(?=[A-Za-z_.@/#:-]{0,30}[0-9])[A-Za-z0-9_][A-Za-z0-9_.@/#:-]{3,}[A-Za-z0-9_]"
KINDS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
_ANY = "|".join([*KINDS.values(), _LIKE])
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
_WORD = r"[\p{L}\p{N}_]+"
ADDED = "context"
PARTS = "array<struct<kind:string,at:int,gap:bigint,size:bigint,value:string,before:array<string>,head:string>>"


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass Luhn's check."""
    digits = F.filter(F.split(F.reverse(F.translate(value, " -", "")), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, k: d.cast("int") * (1 + k % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.when(kind == "ip", value.rlike(_OCTETS)).when(kind == "card", _luhn(value)).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True))


def _cut_at(text: Column, kind: str, pattern: str, likely: Column) -> Column:
    """The pieces of a text, each with the match behind it; the last has none."""
    tail = lambda piece: F.regexp_extract_all(F.lower(F.right(piece, F.lit(CONTEXT_CHARS))), F.lit(_WORD), F.lit(0))
    head = lambda piece: F.regexp_extract(F.lower(F.left(piece, F.lit(CONTEXT_CHARS))), _WORD, 0)
    context = kind == "any"
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda piece, found: F.struct(
            F.length(piece).cast("long").alias("gap"),
            F.length(found).cast("long").alias("size"),
            found.alias("value"),
            (F.slice(tail(piece), -2, 2) if context else F.lit(None).cast("array<string>")).alias("before"),
            (head(piece) if context else F.lit(None).cast("string")).alias("head"),
        ),
    )
    parts = F.transform(parts, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("at"), x.gap.alias("gap"), x.size.alias("size"), x.value.alias("value"), x.before.alias("before"), x.head.alias("head")))
    return F.when(likely, parts).otherwise(F.array().cast(PARTS))


def _matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, value, before, behind: a row a match, and one of kind doc for each document.

    Written once, since rows are told apart by a number that they get as they are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = {"email": text.contains("@"), "ip": text.rlike(_IP), "card": text.rlike(_CARD), "phone": text.contains("+")}
    arrays = [_cut_at(F.col("text"), k, p, likely[k]) for k, p in KINDS.items()] + [_cut_at(F.col("text"), "any", _ANY, text.rlike("[0-9@]"))]
    document = F.array(F.struct(F.lit("doc").alias("kind"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("size"), F.lit("").alias("value"), F.lit(None).cast("array<string>").alias("before"), F.lit(None).cast("string").alias("head")))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text.alias("text"))
    parts = numbered.select("row", "doc_id", F.inline(F.concat(document, *arrays))).repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order)
    placed = parts.withColumns({"end": end, "behind": F.lead("head").over(order)}).where("value is not null")
    return cut(placed.select("row", F.when(F.col("kind") == "doc", F.col("doc_id")).alias("doc_id"), "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value", "before", "behind"))


def _contexts(before: Column, behind: Column) -> Column:
    """The patterns around a match, hashed; parts that are missing make none."""
    one, two = F.get(before, F.size(before) - 1), F.get(before, F.size(before) - 2)
    named = F.array(F.when(one.isNotNull(), F.xxhash64(F.lit("1"), one)), F.when(two.isNotNull(), F.xxhash64(F.lit("2"), two, one)), F.when(one.isNotNull() & (behind != ""), F.xxhash64(F.lit("3"), one, behind)))
    return F.filter(named, lambda h: h.isNotNull())


def _places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and places, how often it stands in the corpus whatever stands in it, of each of patterns (pattern)."""
    bit = F.pmod(F.col("pattern"), F.lit(1 << MAP_BITS))
    marks = bytearray(1 << MAP_BITS)
    words = patterns.select(bit.alias("b")).groupBy(F.shiftright("b", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(b % 32)))").alias("bits"))
    for word, bits in words.collect():  # at most 2 ** (MAP_BITS - 5)
        for k in range(32):
            marks[word * 32 + k] = bits >> k & 1
    there = lambda h: F.substring(F.lit(marks), (F.pmod(h, F.lit(1 << MAP_BITS)) + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\1"))
    met = docs.select(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)).alias("w"))
    later = lambda k: F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - k, F.lit(0)))
    pair = lambda tag, k: F.filter(F.zip_with("w", later(k), lambda a, b: F.when(b.isNotNull(), F.xxhash64(F.lit(tag), a, b))), lambda h: h.isNotNull() & there(h))
    single = F.filter(F.transform("w", lambda a: F.xxhash64(F.lit("1"), a)), there)
    return met.where("w is not null").select(F.explode(F.concat(single, pair("2", 1), pair("3", 2))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("places"))


def bootstrap(docs: DataFrame, matches: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Accepted patterns (pattern, confidence) and found instances (instance, confidence); None if no pattern is accepted.

    matches: kind any with instance, before, behind; seeds: instance.
    """
    met = matches.select("instance", F.explode(_contexts(F.col("before"), F.col("behind"))).alias("pattern"))
    edges = met.groupBy("pattern", "instance").agg(F.count("*").alias("times"))
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("times").alias("own")).where(F.col("n") >= SUPPORT)
    wide = cut(wide)
    edges = cut(edges.join(wide.select("pattern"), "pattern"))
    if wide.isEmpty():
        return None
    places = cut(wide.join(_places(docs, wide), "pattern", "left").select("pattern", F.greatest(F.coalesce("places", F.lit(0)), "own").alias("places")))
    personal = cut(seeds.select("instance", F.lit(1.0).alias("confidence")))
    known = personal
    size = -1
    accepted = None
    for _ in range(TURNS):
        met = edges.join(known, "instance").groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("times") * F.col("confidence")).alias("share"))
        accepted = met.where(F.col("n") >= SUPPORT).join(places, "pattern").select("pattern", (F.col("share") / F.col("places")).alias("confidence"))
        accepted = cut(accepted.where(F.col("confidence") >= CONFIDENCE))
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(math.exp(-20))))
        told = edges.join(accepted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(doubt))).alias("confidence"))
        found = cut(told.join(personal, "instance", "left_anti").where(F.col("confidence") >= CONFIDENCE))
        if (now := found.count()) == size:
            break
        size, known = now, personal.unionByName(found)
        if not now:
            break
    return accepted, found


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, base and added, arrays of (start, kind, end)."""
    docs = docs.select("doc_id", "text")
    matches = _matches(docs)
    base = matches.where(F.col("kind").isin(*KINDS) & _valid(F.col("kind"), F.col("value"))).select("row", "start", "end", "kind")
    seeded = base.select("row", "start", "end").distinct().withColumn("seed", F.lit(True))
    named = matches.where("kind = 'any'").select("row", "start", "end", F.xxhash64(F.lower("value")).alias("instance"), "before", "behind")
    named = cut(named.join(seeded, ["row", "start", "end"], "left"))
    spans = matches.where("kind = 'doc'").select("row", "doc_id", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), "kind")
    spans = spans.unionByName(base.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    learned = bootstrap(docs, named, named.where("seed").select("instance").distinct())
    if learned is not None:
        added = named.where("seed is null").join(learned[1], "instance").select("row", "start", "end", F.lit(ADDED).alias("kind"))
        spans = spans.unionByName(added.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
        is_base = F.col("kind").isin(*KINDS)
        ahead, after = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
        touched = (F.max(F.when(is_base, F.col("end"))).over(ahead) > F.col("start")) | (F.min(F.when(is_base, F.col("start"))).over(after) < F.col("end"))
        spans = spans.withColumn("touched", touched).where((F.col("kind") != ADDED) | ~F.coalesce("touched", F.lit(False)))
    number = F.map_from_arrays(F.array(*map(F.lit, (*KINDS, ADDED))), F.array(*map(F.lit, range(len(KINDS) + 1))))
    listed = lambda wanted: F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("start", number[F.col("kind")].alias("place"), "end", "kind")))), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    grouped = spans.groupBy("row").agg(F.max("doc_id").alias("doc_id"), listed(F.col("kind").isin(*KINDS)).alias("base"), listed(F.col("kind") == ADDED).alias("added"), listed(F.col("kind") != "doc").alias("spans"))
    return grouped.drop("row")


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op12(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and n_context of every document."""
    from tessera.session import table

    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base.kind"), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), F.size("added").cast("long").alias(f"n_{ADDED}"))
