"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Targets share out all words by the sources' weights; a source stops at MOST_EPOCHS times its size
and the excess goes to the others by weight. Each source's documents, shuffled by a hash, form a
stream of words that is cut into blocks of BLOCK_WORDS; the source's slots take block after block,
from the start again when the stream ends. Slot k of the schedule has the golden-ratio point
frac(k * phi), which the cumulative targets map to a source, so any run of the schedule holds the
sources in nearly their shares; slots are ranked per source, and rank r takes block r modulo the
number of blocks. The last slot of a source is cut where its target is reached, and slots that the
schedule leaves a source short of follow at its end.

Ranks come from counts per (chunk, source) and ranks inside chunks, and positions of documents from
sizes per (source, bucket), so that neither a source with most of the rows nor a long schedule meets
in one task. Nothing grows with the data on the driver.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; equal rows are kept apart; rows with equal ids are ordered by hashes of
size and text; very long texts span blocks; extra columns stay, but for those named like the result's; an empty table gives an empty result; if no text has words,
all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
BLOCK_WORDS = 2048
#: Golden-ratio step as a 31-bit fraction, odd, so that 2**31 slots have different points.
STEP = 1327217885
RING = 1 << 31
#: Parts of the ring by which slots find the source whose share holds their point.
CELL = 1 << 15
#: Slots ranked in one group.
CHUNK = 1 << 14
#: Documents ordered in one group, about; and groups a source has at least.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 1024

#: Up to so many sources, their table of a few numbers each is broadcast; beyond, it is shuffled.
BROADCAST_SOURCES = 50_000


def word_count(text: str | Column) -> Column:
    """Runs of characters outside \\x20 and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target of each source of sizes (source, source_size).

    Resharing the excess by weight until none is above its limit ends at the level L with
    min(limit, L * weight) for all and all words shared; sources sorted by limit / weight reach
    their limits first, so L follows from running sums. One row a source.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("rank_", F.row_number().over(order))
    choice = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank_") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumns({"weight_": choice, "limit_": F.col("source_size") * F.lit(float(most))}).where("source_size > 0")
    by_ratio = Window.orderBy(F.col("limit_") / F.col("weight_"), "rank_")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    leveled = ranked.withColumns(
        {
            "level_": (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit_").over(before), F.lit(0.0))) / F.sum("weight_").over(rest),
            "ratio_": F.col("limit_") / F.col("weight_"),
        }
    )
    # the first level that its own source does not exceed holds for all that follow
    level = F.min(F.when(F.col("level_") <= F.col("ratio_"), F.struct("ratio_", "rank_", "level_"))).over(everything).getField("level_")
    mixed = leveled.select("source", "source_size", F.least("limit_", F.coalesce(level * F.col("weight_"), F.col("limit_"))).alias("target"))
    empty = sizes.where("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target"))
    return mixed.unionByName(empty)


def stream_positions(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (number, doc_id, size, ...) with at_, the words of its source shuffled before each row."""
    own = [F.col(c) for c in ("text_key",) if c in docs.columns]  # rows without an id, or with the same one, part by it
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.lit(41), "size", *own)
    rows = docs.withColumn("key_", key).withColumn("bucket_", F.pmod("key_", F.lit(buckets)).cast("int"))
    totals = rows.groupBy("number", "bucket_").agg(F.sum("size").alias("words_"))
    above = Window.partitionBy("number").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("number", "bucket_", F.coalesce(F.sum("words_").over(above), F.lit(0)).alias("start_"))
    inside = Window.partitionBy("number", "bucket_").orderBy("key_", F.asc_nulls_first("doc_id"), "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within_", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(starts, ["number", "bucket_"]).withColumn("at_", F.col("within_") + F.col("start_")).drop("key_", "bucket_", "within_", "start_")


def schedule(goals: DataFrame, total_slots: int) -> DataFrame:
    """slot, number and rank of each slot; goals: number, need (slots), from_ and upto_ on the ring.

    Ranks are those of a source's slots in order; ranks at or over need are left out, and missing
    ones follow as slots after the last.
    """
    spark = goals.sparkSession
    cells = goals.where("upto_ > from_").select("number", "from_", "upto_", F.explode(F.sequence(F.floor(F.col("from_") / CELL), F.floor((F.col("upto_") - 1) / CELL))).alias("cell_"))
    point = F.pmod(F.pmod("id", F.lit(RING)) * STEP, F.lit(RING))
    slots = spark.range(total_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk_"), point.alias("point_"), F.floor(point / CELL).alias("cell_"))
    placed = slots.join(cells, "cell_").where("point_ >= from_ and point_ < upto_").select("slot", "chunk_", "number")
    counts = placed.groupBy("number", "chunk_").agg(F.count("*").alias("n_"))
    above = Window.partitionBy("number").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("number", "chunk_", F.coalesce(F.sum("n_").over(above), F.lit(0)).alias("start_"))
    inside = Window.partitionBy("number", "chunk_").orderBy("slot")
    ranked = placed.withColumn("inside_", F.row_number().over(inside) - 1).join(starts, ["number", "chunk_"])
    ranked = ranked.select("slot", "number", (F.col("inside_") + F.col("start_")).alias("rank"))
    kept = ranked.join(goals.select("number", "need"), "number").where("rank < need").select("slot", "number", "rank")
    had = counts.groupBy("number").agg(F.sum("n_").alias("had_"))
    short = goals.select("number", "need").join(had, "number", "left").withColumn("had_", F.coalesce("had_", F.lit(0))).where("had_ < need")
    late = short.select("number", F.explode(F.sequence(F.col("had_"), F.col("need") - 1)).alias("rank"))
    return kept.unionByName(late.select((F.lit(total_slots) + F.col("rank")).alias("slot"), "number", "rank"))


def plan(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row a source: number, source_size, target, words to take, blocks, need in slots, ring share."""
    order = Window.orderBy("number")
    everything = Window.partitionBy()
    size = F.col("source_size")
    goals = targets(sizes, weights, most).withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    goals = goals.withColumns({"words": F.least(F.round("target").cast("long"), size * most), "blocks": F.ceil(size / block_words).cast("long")})
    some = F.when(size > 0, size).otherwise(F.lit(1))
    goals = goals.withColumn("need", (F.floor(F.col("words") / some) * F.col("blocks") + F.ceil(F.pmod(F.col("words"), some) / block_words)).cast("long"))
    total = F.greatest(F.sum("need").over(everything), F.lit(1))
    goals = goals.withColumn("upto_", F.round(F.sum("need").over(order) / total * RING).cast("long"))
    return goals.withColumn("from_", F.coalesce(F.lag("upto_").over(order), F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and all other columns but source, of docs (doc_id, source, size, ...).

    docs must be cheap to read again: a table of ids and sizes, not of texts. A column text_key, if
    there is one, parts rows of one id. Other columns stay, but for those named like the result's.
    """
    known_names = ("doc_id", "source", "size", "text_key")
    extra = [c for c in docs.columns if c not in known_names]
    mine = [c for c in known_names if c in docs.columns]
    packed = docs.select(*mine, F.struct(F.lit(0).alias("none_"), *(docs[c].alias(f"c{k}") for k, c in enumerate(extra))).alias("own_"))
    mixed = _mix(packed, weights, most, block_words)
    result = ("doc_id", "size", "source_size", "target", "taken", "text_key")
    return mixed.select(*(c for c in result if c in mixed.columns), *(F.col(f"own_.c{k}").alias(c) for k, c in enumerate(extra) if c not in result))


def _mix(docs: DataFrame, weights, most: int, block_words: int) -> DataFrame:
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows_"))
    goals = cut(plan(sizes, weights, most, block_words))
    n_docs = sizes.agg(F.sum("rows_")).first()[0] or 0
    n_sources, total_slots = goals.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, 1 << int(n_docs // BUCKET_ROWS).bit_length())

    # every slot takes its source's next block; only a source's last slot can be cut short
    slots = schedule(goals.select("number", "need", "from_", "upto_"), total_slots).join(goals.select("number", "source_size", "blocks", "words"), "number")
    epoch, block = F.floor(F.col("rank") / F.col("blocks")), F.pmod(F.col("rank"), F.col("blocks"))
    length = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    left = F.col("words") - epoch * F.col("source_size") - block * block_words
    slots = slots.select("number", block.alias("block"), length.alias("length_"), F.least(length, left).alias("used_"))
    uses = slots.groupBy("number", "block").agg(F.count_if(F.col("used_") == F.col("length_")).alias("full_"), F.max(F.when(F.col("used_") < F.col("length_"), F.col("used_")).otherwise(0)).alias("cut_"))

    known = goals.select(F.col("source").alias("source_"), "source_size", "target", "number")
    known = F.broadcast(known) if n_sources <= BROADCAST_SOURCES else known
    rows = docs.join(known, F.col("source").eqNullSafe(F.col("source_"))).drop("source", "source_")
    none = rows.where("size = 0").drop("number").withColumn("taken", F.lit(0).cast("long"))
    placed = stream_positions(rows.where("size > 0"), buckets)
    begin, end = F.col("at_"), F.col("at_") + F.col("size")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words))))
    lo, hi = F.greatest(begin - F.col("block") * block_words, F.lit(0)), F.least(end - F.col("block") * block_words, F.lit(block_words))
    joined = pieces.join(uses, ["number", "block"], "left")
    took = F.coalesce("full_", F.lit(0)) * (hi - lo) + F.greatest(F.least(F.coalesce("cut_", F.lit(0)), hi) - lo, F.lit(0))
    rest = [c for c in rows.columns if c != "number"]
    # a document's place in its source's stream is its own, as it has words
    taken = joined.withColumn("took_", took).groupBy("number", "at_").agg(*(F.first(c).alias(c) for c in rest), F.sum("took_").cast("long").alias("taken"))
    return taken.select(*rest, "taken").unionByName(none)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...) that the mix takes, each as often as it takes them.

    A source's last document may be taken in part; it comes whole. Texts are shuffled once, to meet
    the number of their copies.
    """
    from tessera.llm.ngram_jaccard import row_keys

    key_a, key_b = row_keys()
    narrow = cut(docs.select("doc_id", "source", word_count("text").alias("size"), key_a.alias("key_a"), key_b.alias("key_b")))
    taken = mix(narrow.withColumnRenamed("key_a", "text_key"), weights, most).where("taken > 0")
    copies = taken.groupBy(F.col("text_key").alias("key_a"), "key_b").agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies_"))
    # no name of docs is used beside the keys', so that none can clash
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row_"), key_a.alias("key_a"), key_b.alias("key_b"))
    once = whole.join(copies, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    return once.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies_"))).alias("copy_")).select("row_.*")


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    from tessera.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_key"))
    return mix(cut(docs)).select("doc_id", "size", "source_size", "target", "taken")
