"""Prompt assembly and summaries as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

# The system text, and the headings of a prompt's sections.
SYSTEM = "You are a helpful multimodal RAG assistant."


def ordered_chunks(chunks: Column) -> Column:
    """A prompt's chunks: ranked ones first by rank, then by chunk_id."""
    keyed = F.transform(
        F.coalesce(chunks, F.array()),
        lambda c: F.struct(c.retrieval_rank.isNull().alias("unranked"), F.coalesce(c.retrieval_rank, F.lit(0)).alias("rank"), c.chunk_id.alias("chunk_id"), c.alias("chunk")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k.chunk)


def _segment(role, modality, source, text, rank=None) -> Column:
    return F.struct(
        F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"),
        F.lit(modality).alias("modality") if isinstance(modality, str) else modality.alias("modality"),
        source.alias("source"),
        text.alias("text"),
        F.length(text).cast("long").alias("text_length"),
        (F.lit(None) if rank is None else rank).cast("long").alias("retrieval_rank"),
    )


def segments(query: Column, image_path: Column, chunks: Column) -> Column:
    """system, user, what was retrieved in order, and the request's image if its path isn't empty."""
    image = lambda c: c.modality == "image"
    retrieved = F.transform(
        chunks,
        lambda c: _segment(
            F.when(image(c), "retrieved_visual").otherwise("retrieved_text"),
            F.when(image(c), "image").otherwise("text"),
            c.source,
            F.when(image(c) & (F.coalesce(c.text, F.lit("")) == ""), F.concat(F.lit("retrieved image: "), c.source)).otherwise(c.text),
            c.retrieval_rank,
        ),
    )
    own = F.array(_segment("system", "text", F.lit("system"), F.lit(SYSTEM)), _segment("user", "text", F.lit("user"), query))
    attached = _segment("visual_context", "image", image_path, F.concat(F.lit("image attached: "), image_path))
    return F.concat(own, retrieved, F.when(F.coalesce(image_path, F.lit("")) != "", F.array(attached)).otherwise(F.slice(F.array(attached), 1, 0)))


def user_text_block(query: Column, chunks: Column) -> Column:
    """The query, and the texts and images retrieved, under their headings."""
    image = lambda c: c.modality == "image"
    rank = lambda c: F.coalesce(c.retrieval_rank.cast("string"), F.lit("unranked"))
    entry = lambda c, said: F.concat(F.lit("["), rank(c), F.lit("] "), c.source, F.lit("\n"), said)
    texts = F.transform(F.filter(chunks, lambda c: ~image(c)), lambda c: entry(c, c.text))
    images = F.transform(F.filter(chunks, image), lambda c: entry(c, F.when(F.coalesce(c.text, F.lit("")) == "", F.concat(F.lit("Image from "), c.source)).otherwise(c.text)))
    headed = lambda title, parts: F.when(F.size(parts) > 0, F.concat(F.array(F.lit(title)), parts)).otherwise(F.slice(parts, 1, 0))
    return F.array_join(F.concat(F.array(F.concat(F.lit("User query:\n"), query)), headed("Retrieved context:", texts), headed("Retrieved visual context:", images)), "\n\n")


def chat_payload(query: Column, image_path: Column, chunks: Column) -> Column:
    """The chat messages as JSON: the text block, then the request's image and the retrieved ones."""
    url = lambda path: F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("file://"), path).alias("url")).alias("image_url")))
    said = lambda text: F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    shown = F.filter(chunks, lambda c: (c.modality == "image") & (F.coalesce(c.image_path, F.lit("")) != ""))
    own = F.when(F.coalesce(image_path, F.lit("")) != "", F.array(url(image_path))).otherwise(F.slice(F.array(F.lit("")), 1, 0))
    parts = F.concat(F.array(said(user_text_block(query, chunks))), own, F.transform(shown, lambda c: url(c.image_path)))
    message = lambda role, content: F.concat(F.lit('{"role":"' + role + '","content":['), content, F.lit("]}"))
    return F.concat(F.lit('{"messages":['), message("system", said(F.lit(SYSTEM))), F.lit(","), message("user", F.array_join(parts, ",")), F.lit("]}"))


def context_prompt(query: Column, chunks: Column) -> Column:
    """The plain prompt: numbered contexts, the question, and where the answer begins."""
    numbered = F.transform(chunks, lambda c, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit(" ("), F.when(c.modality == "image", "image").otherwise("text"), F.lit(")]: "), c.text))
    return F.concat(F.lit("Use the following context to answer the question.\n\n"), F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def _object(json: Column) -> Column:
    """A JSON object as a map of variants; anything else as an empty one."""
    value = F.try_parse_json(json)
    return F.coalesce(F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>")), F.create_map().cast("map<string,variant>"))


def merged_json(*objects: Column) -> Column:
    """JSON objects as one, its keys in order; of those that have a key the last counts, also with null."""
    merged = _object(objects[0])
    for later in map(_object, objects[1:]):
        merged = F.map_concat(_without(merged, later), later)
    keys = F.array_sort(F.map_keys(merged))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(merged, k))), {"ignoreNullFields": "false"})


def _without(entries: Column, later: Column) -> Column:
    return F.map_filter(entries, lambda k, _: ~F.map_contains_key(later, k))


def normalize_chunk(chunk: Column) -> Column:
    """A retrieved chunk, any JSON object, as a struct: what it may lack is filled, its score taken from its metadata.

    The metadata's score counts only where the chunk has no key score at all; a score of null stays null.
    """
    value = F.try_parse_json(chunk)
    at = lambda path: F.try_variant_get(value, path, "variant")
    told = lambda path, kind: F.try_variant_get(value, path, kind)
    text = lambda name, default: F.coalesce(told(f"$.{name}", "string"), F.lit(default)).alias(name)
    score = F.when(at("$.score").isNotNull(), told("$.score", "double")).otherwise(told("$.metadata.score", "double"))
    metadata = F.coalesce(F.to_json(F.when(F.schema_of_variant(at("$.metadata")).startswith("OBJECT"), at("$.metadata"))), F.lit("{}"))
    return F.struct(text("chunk_id", ""), text("text", ""), text("source", ""), text("modality", "text"), told("$.image_path", "string").alias("image_path"), told("$.retrieval_rank", "int").alias("retrieval_rank"), score.alias("score"), metadata.alias("metadata"))


def log_event(name: str, context: Column, payload: Column) -> Column:
    """A log line: the event's name, its context and its payload (objects in JSON) as one object; a key of both is the payload's."""
    return merged_json(context, payload, F.to_json(F.struct(F.lit(name).alias("event"))))


def normalize_segments(df: DataFrame) -> DataFrame:
    """Fill what a segment may lack: text, its length, role, modality, source."""
    text = F.coalesce("text", F.lit(""))
    return df.withColumns({"text": text, "text_length": F.coalesce("text_length", F.length(text)).cast("long"), "role": F.coalesce("role", F.lit("")), "modality": F.coalesce("modality", F.lit("text")), "source": F.coalesce("source", F.lit(""))})


def summarize(segments_: DataFrame, request: str) -> DataFrame:
    """Token totals of each request's segments (role, modality, text)."""
    n = X.token_count("text")
    return segments_.groupBy(request).agg(
        F.sum(n).alias("total_prompt_tokens"),
        F.coalesce(F.sum(F.when(F.col("role") == "retrieved_text", n)), F.lit(0)).alias("retrieved_text_token_count"),
        F.bool_or((F.col("modality") == "image") | (F.col("role") == "visual_context")).alias("visual_input_present"),
        F.count_if(F.col("role").startswith("retrieved_")).alias("num_retrieved_chunks"),
    )


def ordered_values(segments_: DataFrame, request: str, order: str, values: list[str]) -> DataFrame:
    """Lists of values in order, an array a request."""
    listed = F.array_sort(F.collect_list(F.struct(order, *values)))
    return segments_.groupBy(request).agg(listed.alias("l_")).select(request, *(F.col("l_").getField(v).alias(v) for v in values))


def token_maps(segments_: DataFrame, request: str) -> DataFrame:
    """Tokens of each request by role and by modality, as maps; a role whose segments have none is there with 0."""
    counted = segments_.select(request, "role", "modality", X.token_count("text").alias("n_"))

    def by(key: str) -> DataFrame:
        sums = counted.groupBy(request, key).agg(F.sum("n_").alias("n_"))
        return sums.groupBy(request).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n_")))).alias(f"tokens_by_{key}"))

    return by("role").join(by("modality"), request)
