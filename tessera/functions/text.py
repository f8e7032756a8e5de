"""Column expressions over text: words, tokens, chunks, record fields, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscores as one token, any other visible character as a token.
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
SPACE = r"(?U)\s+"
#: What white space is not; the separators \x1c to \x1f are white space too.
FILLED = r"(?U)[^\s\x1c-\x1f]"


def words(text: str | Column) -> Column:
    """The words of a text, cut at white space; none for a blank one."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def token_count(text: str | Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def windows(items: Column, size: int) -> Column:
    """Non-overlapping windows of at most ``size`` items, in order."""
    size = max(size, 1)
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(size)))


def first_filled(*columns: str | Column) -> Column:
    """The first column that isn't null or only white space, as it is; else the empty text."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*(F.when(c.rlike(FILLED), c) for c in named), F.lit(""))


def first_named(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def record_source(source: Column, doc_id: Column, page: Column) -> Column:
    """A record's source: its own, else doc#page=N, else doc, else unknown; empty ones count for none."""
    named, doc_id = F.nullif(source, F.lit("")), F.nullif(doc_id, F.lit(""))
    with_page = F.when(page.isNotNull(), F.concat(doc_id, F.lit("#page="), page.cast("string"))).otherwise(doc_id)
    return F.coalesce(named, with_page, F.lit("unknown"))


def short_hash(text: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def block_hash(modality: Column, ids: Column) -> Column:
    """The content address of a block: modality and token ids."""
    return short_hash(F.concat(modality, F.lit(":"), ids_text(ids)))


def chunk_id(source: Column, index: Column, ids: Column) -> Column:
    return short_hash(F.concat(source, F.lit(":"), index.cast("string"), F.lit(":"), ids_text(ids)))


def image_chunk_id(source: Column, path: Column) -> Column:
    return short_hash(F.concat(F.lit("image:"), source, F.lit(":"), path))


def image_file_name(stem: Column, page: Column) -> Column:
    """The name under which a record's image is kept."""
    suffix = F.when(page.isNotNull(), F.concat(F.lit("-page-"), page.cast("string"))).otherwise(F.lit(""))
    return F.concat(short_hash(F.concat(stem, suffix), 24), F.lit(".png"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def model_spec(name: Column) -> Column:
    """The loader's name of an embedding model."""
    return (
        F.when(name == "openai/clip-vit-large-patch14", F.lit("ViT-L-14"))
        .when(name.startswith("hf-hub:"), name)
        .when(name.contains("/"), F.concat(F.lit("hf-hub:"), name))
        .otherwise(name)
    )


def model_tag(name: Column) -> Column:
    """The pretrained weights that go with an aliased model; null for any other name."""
    return F.when(name == "openai/clip-vit-large-patch14", F.lit("openai"))


def effective_top_k(k: Column, default: int) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.nullif(k, F.lit(0)), F.lit(default)))


def _text_at(value: Column, path: str) -> Column:
    """What a path of a variant leads to, if that is a text."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def json_text(json: Column) -> Column:
    """The generated text of a response in JSON; empty if there is none.

    A text is itself; of an object, the first of the known keys that holds a text counts, of a list its
    first element; each may hold its text in the first of its ``outputs``.
    """
    keys, value = ("generated_text", "text", "answer_text"), F.try_parse_json(json)
    paths = ["$", *(f"$.{k}" for k in keys), "$[0].outputs[0].text", *(f"$[0].{k}" for k in keys), "$.outputs[0].text"]
    return F.coalesce(*(_text_at(value, p) for p in paths), F.lit(""))


def json_latency(json: Column, measured: Column) -> Column:
    """Seconds of a generation: those of ``timing``, else of the response, else the measured ones."""
    paths = ("$.timing.generation_seconds", "$.generation_seconds")
    return F.coalesce(*(F.get_json_object(json, p).try_cast("double") for p in paths), measured)
