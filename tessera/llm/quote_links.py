"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that start with ``>`` marks are quotations; the number of marks is their level. Each quoted
line, normalised and hashed, is joined to the latest earlier message of its conversation that wrote
it; a message replies to the one that most characters of its outermost linked level come from.
A level of which some line is not found may have been wrapped at another width: its paragraphs, lines
joined, are linked in the same way by runs of RUN_WORDS words, or whole if they are no longer. What
lines and runs tell is weighed together; a run weighs its first word, the last of a paragraph all.
Threads follow from replies, and the text is returned without quotations and the attribution lines
above them. Sorted by (conv_id, thread, turn), every reply follows the message it answers.

The latest earlier message is found by turns in buckets of BUCKET_TURNS: inside a bucket by a window
over at most so many turns, before it by a running maximum over buckets, so that a line that a
whole conversation repeats makes neither pairs nor a large group.

Defined results: a null text stays null and quotes nothing; an empty one, or one of quotations
only, becomes empty; a re-wrapped passage of fewer than RUN_WORDS words links only as a whole
paragraph; rows that share conv_id and turn are one message for linking, and each is returned; rows
with null conv_id or turn link with nothing; blank quoted lines link with nothing; very long texts
are read whole; extra columns stay out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

BUCKET_TURNS = 64
RUN_WORDS = 6
MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)(?:wrote|writes|said|schrieb|écrit|escribió)[ ]?:[ \t\r]*$"
EDGES = r"^[ \t\r\n]+|[ \t\r\n]+$"


def line_level(line: Column) -> Column:
    """The number of quotation marks that a line starts with."""
    marks = F.regexp_extract(line, f"({MARKS})", 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def normal_line(line: Column) -> Column:
    """A line without marks, in lower case, its white space squeezed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[ \t\r]+", " ")))


def is_written(x: Column) -> Column:
    """Whether a line of ``leveled_lines`` is neither a quotation nor the attribution above one."""
    return (x.level == 0) & ~((x.below > 0) & F.regexp_like(x.line, F.lit(ATTRIBUTION)))


def leveled_lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, all_ (level, line and the level below of each line), passages_."""
    # a step for each column that later ones read more than once, so that none is worked out twice
    split = messages.select("conv_id", "turn", "role", F.split("text", "\n", -1).alias("split_"))
    leveled = split.withColumn("levels_", F.transform("split_", line_level))
    none = F.array(F.lit(0))
    below = F.concat(F.slice("levels_", 2, F.size("levels_")), none)
    lines = F.zip_with(F.arrays_zip("split_", "levels_"), below, lambda x, after: F.struct(x["levels_"].alias("level"), x["split_"].alias("line"), after.alias("below")))
    runs = F.zip_with("levels_", F.concat(none, "levels_"), lambda here, before: (here > 0) & (here != before))
    return leveled.select("conv_id", "turn", "role", lines.alias("all_"), F.greatest(F.size(F.filter(runs, lambda begins: begins)), F.lit(0)).cast("long").alias("passages_"))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_ (text without quotations), written_ and quoted_ lines, passages_."""
    with_lines = leveled_lines(messages)
    parted = with_lines.select("conv_id", "turn", "role", F.filter("all_", is_written).alias("written_"), F.filter("all_", lambda x: x.level > 0).alias("quoted_"), "passages_")
    own = F.regexp_replace(F.array_join("written_.line", "\n"), EDGES, "")
    return parted.select("conv_id", "turn", "role", own.alias("own_"), "written_", "quoted_", "passages_")


def latest_writers(written: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv_id, h, turn and from_ of the distinct quoted (conv_id, h, turn): the latest earlier turn
    of written (conv_id, h, turn) with the same conversation and hash; rows without one are left out."""
    key = ["conv_id", "h"]
    bucket = F.floor(F.col("turn") / BUCKET_TURNS).alias("bucket_")
    both = written.select(*key, "turn", bucket, F.lit(1).alias("writes")).unionByName(quoted.select(*key, "turn", bucket, F.lit(0).alias("writes"))).distinct()
    wrote = F.when(F.col("writes") == 1, F.col("turn"))
    inside = Window.partitionBy(*key, "bucket_").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near_", F.max(wrote).over(inside)).where("writes = 0")
    by_bucket = both.groupBy(*key, "bucket_").agg(F.max(wrote).alias("last_"))
    above = Window.partitionBy(*key).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select(*key, "bucket_", F.max("last_").over(above).alias("far_"))
    joined = found.join(before, [*key, "bucket_"]).select(*key, "turn", F.coalesce("near_", "far_").alias("from_"))
    return joined.where("from_ is not null")


def runs(rows: DataFrame, inside) -> DataFrame:
    """conv_id, turn, level, h and chars of the word runs of paragraphs, whose lines are those inside() holds of."""
    lines = F.transform("all_", lambda x: F.when(inside(x), normal_line(x.line)).otherwise(""))
    parts = F.split(F.array_join(lines, "\n"), "\n\n+", -1)
    texts = rows.select("conv_id", "turn", "level", F.explode(parts).alias("text")).select("conv_id", "turn", "level", F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text")).where("text <> ''")
    words = texts.select("conv_id", "turn", "level", F.split("text", " ", -1).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - RUN_WORDS + 1, F.lit(1)))
    run = lambda k: F.array_join(F.slice("words", k, RUN_WORDS), " ")
    weight = lambda k: F.when(k + RUN_WORDS > F.size("words"), F.length(run(k))).otherwise(F.length(F.get("words", k - 1)) + 1)
    each = F.inline(F.transform(starts, lambda k: F.struct(F.xxhash64(run(k)).alias("h"), weight(k).alias("chars"))))
    return words.select("conv_id", "turn", "level", each)


def rewrapped(messages: DataFrame, unlinked: DataFrame) -> DataFrame:
    """conv_id, turn, level, from_ and chars of unlinked (conv_id, turn, level) by word runs."""
    lines = leveled_lines(messages).where("turn is not null").join(unlinked.select("conv_id").distinct(), "conv_id", "left_semi")
    levels = lines.where("passages_ > 0").join(unlinked, ["conv_id", "turn"])
    quoted = cut(runs(levels, lambda x: x.level == F.col("level")))
    written = runs(lines.withColumn("level", F.lit(0)), is_written).select("conv_id", "h", "turn").join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").distinct()
    found = latest_writers(written, quoted.select("conv_id", "h", "turn").distinct())
    return quoted.join(found, ["conv_id", "h", "turn"]).groupBy("conv_id", "turn", "level", "from_").agg(F.sum("chars").alias("chars"))


def replies(parsed: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, turn and reply_to of the messages that quote an earlier one."""
    named = parsed.where("conv_id is not null and turn is not null")

    def each(rows: DataFrame, lines: str) -> DataFrame:
        out = rows.select("conv_id", "turn", F.explode(lines).alias("x")).select("conv_id", "turn", F.col("x.level").alias("level"), normal_line(F.col("x.line")).alias("line"))
        return out.where("line <> ''").select("conv_id", "turn", "level", F.xxhash64("line").alias("h"), F.length("line").alias("chars"))

    quoted = cut(each(named.where("passages_ > 0"), "quoted_"))
    # hashes are shuffled, not lines; of them only those stay that are quoted somewhere
    written = each(named, "written_").select("conv_id", "h", "turn").join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").distinct()
    found = latest_writers(written, quoted.select("conv_id", "h", "turn").distinct())
    sums = cut(quoted.join(found, ["conv_id", "h", "turn"]).groupBy("conv_id", "turn", "level", "from_").agg(F.sum("chars").alias("chars")))
    key = ["conv_id", "turn", "level"]
    unlinked = cut(quoted.join(found, ["conv_id", "h", "turn"], "left_anti").select(*key).distinct())
    if not unlinked.isEmpty():
        sums = sums.unionByName(rewrapped(messages, unlinked)).groupBy(*key, "from_").agg(F.sum("chars").alias("chars"))
    best = F.min(F.struct("level", -F.col("chars"), -F.col("from_"), "from_")).getField("from_")
    return sums.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """links with thread, the first message's turn, and depth, the number of replies up to it.

    Each round doubles how far a message looks up, so a chain of n replies takes log2(n) rounds.
    """
    state = cut(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open_")))
    while not state.where("open_").isEmpty():
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up_"), F.col("depth").alias("more_"))
        state = cut(state.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", "reply_to", F.coalesce("up_", "thread").alias("thread"), (F.col("depth") + F.coalesce("more_", F.lit(0))).alias("depth"), F.col("up_").isNotNull().alias("open_")))
    return state.drop("open_")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotations, n_passages, reply_to, thread and depth."""
    parsed = parse(messages)
    linked = threads(replies(parsed, messages))
    out = parsed.drop("written_", "quoted_").join(linked, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.col("own_").alias("text"), F.col("passages_").alias("n_passages"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every message of conversations without quotations, with its place among the replies."""
    from tessera.session import table

    return link_quotes(table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
WITH RECURSIVE msgs AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
lines AS (
  SELECT id, conv_id, turn, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT id, conv_id, turn, string_split(text, chr(10)) AS l FROM msgs WHERE text IS NOT NULL)),
leveled AS (
  SELECT *, length(regexp_extract(line, '^(?:[ \t]*>)+')) - length(replace(regexp_extract(line, '^(?:[ \t]*>)+'), '>', '')) AS level,
    lower(trim(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '[ \t\r]+', ' ', 'g'))) AS norm
  FROM lines),
placed AS (
  SELECT *, lead(level, 1, 0) OVER w AS after, lag(level, 1, 0) OVER w AS before FROM leveled WINDOW w AS (PARTITION BY id ORDER BY pos)),
marked AS (
  SELECT *, level = 0 AND NOT (after > 0 AND regexp_matches(line, '(?i)(?:wrote|writes|said|schrieb|écrit|escribió)[ ]?:[ \t\r]*$')) AS own FROM placed),
texts AS (
  SELECT id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE own), '') AS own_text, count(*) FILTER (WHERE level > 0 AND before <> level) AS n_passages
  FROM marked GROUP BY id),
quoted AS (SELECT conv_id, turn, level, norm FROM marked WHERE level > 0 AND norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
matched AS (
  SELECT q.conv_id, q.turn, q.level, q.norm, (SELECT max(o.turn) FROM marked o WHERE o.own AND o.conv_id = q.conv_id AND o.norm = q.norm AND o.turn < q.turn) AS src FROM quoted q),
unlinked AS (SELECT DISTINCT conv_id, turn, level AS lv FROM matched WHERE src IS NULL),
levels AS (
  SELECT DISTINCT m.id, u.lv FROM marked m JOIN unlinked u ON u.conv_id = m.conv_id AND u.turn = m.turn AND u.lv = m.level
  UNION ALL SELECT id, 0 FROM msgs WHERE turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM unlinked)),
paras AS (
  SELECT conv_id, turn, lv, trim(replace(unnest(string_split_regex(string_agg(CASE WHEN CASE lv WHEN 0 THEN own ELSE level = lv END THEN norm ELSE '' END, chr(10) ORDER BY pos), '\n\n+')), chr(10), ' ')) AS para
  FROM marked JOIN levels USING (id) GROUP BY id, conv_id, turn, lv),
worded AS (SELECT conv_id, turn, lv, string_split(para, ' ') AS w FROM paras WHERE para <> ''),
placed_runs AS (SELECT *, unnest(range(1, greatest(len(w) - 5, 1) + 1)) AS k FROM worded),
runs AS (
  SELECT conv_id, turn, lv, array_to_string(w[k:k + 5], ' ') AS run, CASE WHEN k + 6 > len(w) THEN length(array_to_string(w[k:k + 5], ' ')) ELSE length(w[k]) + 1 END AS chars FROM placed_runs),
matched_runs AS (
  SELECT q.conv_id, q.turn, q.lv AS level, q.chars, (SELECT max(o.turn) FROM runs o WHERE o.lv = 0 AND o.conv_id = q.conv_id AND o.run = q.run AND o.turn < q.turn) AS src FROM runs q WHERE q.lv > 0),
sums AS (
  SELECT conv_id, turn, level, src, sum(chars) AS chars
  FROM (SELECT conv_id, turn, level, src, length(norm) AS chars FROM matched UNION ALL SELECT conv_id, turn, level, src, chars FROM matched_runs) WHERE src IS NOT NULL GROUP BY ALL),
links AS (
  SELECT conv_id, turn, src AS reply_to FROM sums QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, src DESC) = 1),
up AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
  UNION ALL SELECT u.conv_id, u.turn, l.reply_to, u.depth + 1 FROM up u JOIN links l ON l.conv_id = u.conv_id AND l.turn = u.thread),
tops AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role,
  CASE WHEN m.text IS NOT NULL THEN regexp_replace(x.own_text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') END AS text,
  coalesce(x.n_passages, 0) AS n_passages, l.reply_to, coalesce(t.thread, m.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth
FROM msgs m LEFT JOIN texts x USING (id) LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN tops t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
