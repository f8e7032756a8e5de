"""Queries over corpus records: fields, chunks, tokens, hashes, images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import corpus as C
from tessera.session import cut, shared_folder, table
from tessera.sources import tables as S
from tessera.sources.dataset_dir import read_dataset, write_dataset
from tessera.sources.image_sink import read_images, remove_images, write_images

WINDOW = 64
TEXT_NAMES = ("markdown", "text", "content", "query", "answer")
ID_NAMES = ("doc_id", "document_id", "id")


def record_text(spark, sf_dir: str) -> DataFrame:
    return S.records(spark, sf_dir).select("doc_id", X.first_filled(*TEXT_NAMES).alias("record_text"))


def record_doc_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.pmod("doc_id", F.lit(3))
    named = docs.select(F.col("doc_id").alias("key"), F.when(kind > 0, F.lit("")).otherwise(F.col("doc_id").cast("string")).alias("doc_id"), F.when(kind == 1, F.col("source")).alias("document_id"), F.when(kind == 2, F.col("lang")).alias("id"))
    return named.select("key", X.first_named(*ID_NAMES).alias("record_id"))


def record_source(spark, sf_dir: str) -> DataFrame:
    return S.records(spark, sf_dir).select("doc_id", X.record_source(F.col("source"), F.when(F.pmod(F.col("doc_id").cast("long"), F.lit(5)) == 0, F.lit("")).otherwise(F.col("doc_id")), F.col("page")).alias("record_source"))


def record_metadata(spark, sf_dir: str) -> DataFrame:
    rec = S.records(spark, sf_dir)
    rest = [c for c in rec.columns if c not in ("markdown", "text", "content", "image")]
    return rec.select("doc_id", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("metadata"))


def union_splits(spark, sf_dir: str) -> DataFrame:
    """Splits by lang, null being one of its own; one lacks a column, which is null there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"), "source", "n_chars")
    lacking = F.col("split").eqNullSafe("de")
    return docs.where(~lacking).unionByName(docs.where(lacking).drop("source"), allowMissingColumns=True)


def dataset_dir(spark, sf_dir: str) -> DataFrame:
    """Documents saved as a dataset with a split a lang, and two of its columns and the split read back."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "split")
    with shared_folder(spark, "dataset") as path:
        write_dataset(docs, path)
        read = read_dataset(spark, path, ["doc_id", "text", "split"])
        return cut(read.select("doc_id", "split", F.md5("text").alias("text_md5")))


def image_sink(spark, sf_dir: str) -> DataFrame:
    """Images of records, here their texts' bytes and null for some, written twice; the files that are there, and how many each write made."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(key.cast("string").alias("doc_id"), F.when(key % 3 == 0, key % 11).alias("page"), F.when(key % 5 != 0, F.col("text").cast("binary")).alias("image"))
    images = docs.select(X.image_file_name(F.col("doc_id"), F.col("page")).alias("file_name"), "image")
    names = images.select("file_name")  # those without an image, too, which must not be there
    with shared_folder(spark, "images") as path:
        first, second = (write_images(images, path)[0] for _ in range(2))
        read = read_images(spark, path, names).select("file_name", F.sha2("image", 256).alias("image_sha256"), F.lit(first).cast("long").alias("made_first"), F.lit(second).cast("long").alias("made_second"))
        found = cut(read)
        remove_images(names, path)  # a folder of many files would be listed in the driver to go
        return found


def image_file_name(spark, sf_dir: str) -> DataFrame:
    return S.records(spark, sf_dir).select("doc_id", X.image_file_name(F.col("doc_id"), F.col("page")).alias("file_name"))


def token_count(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count("text").alias("n_tokens"))


def tokenize(spark, sf_dir: str) -> DataFrame:
    tokens = X.tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("decoded_md5"))


def vocab_ids(spark, sf_dir: str) -> DataFrame:
    return C.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text")


def chunk_words(spark, sf_dir: str) -> DataFrame:
    chunks = C.word_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", WINDOW)
    return chunks.select("doc_id", "chunk_index", "chunk_id", "content", F.size("ids").cast("long").alias("n_tokens"), X.block_hash(F.lit("text"), F.col("ids")).alias("block_id"))


def chunk_tokens(spark, sf_dir: str) -> DataFrame:
    return C.token_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", WINDOW).select("doc_id", "chunk_index", "content", F.size("pieces").cast("long").alias("n_tokens"))


def chunk_ids(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = C.token_chunks(docs.select("doc_id", "text"), "doc_id", "text", WINDOW)
    numbered = C.with_token_ids(chunks, "doc_id")
    return numbered.select("doc_id", "chunk_index", X.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("token_ids")).alias("chunk_id"))


def block_hash(spark, sf_dir: str) -> DataFrame:
    ids = F.transform(X.words("text"), lambda w: F.length(w))
    return table(spark, sf_dir, "benchmark").select("item_id", X.block_hash(F.lit("text"), ids).alias("text_block"), X.block_hash(F.lit("visual"), ids).alias("visual_block"))


def block_build(spark, sf_dir: str) -> DataFrame:
    """Sizes of the blocks built from texts: at least one token, all layers, two half-precision tensors."""
    n = F.greatest(F.lit(1), X.token_count("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("num_tokens"), F.lit(0).cast("long").alias("layer_start"), F.lit(31).cast("long").alias("layer_end"), (n * 2 * 2 * 64).alias("bytes"))


def image_chunk_ids(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.image_chunk_id(F.col("url"), F.col("url")).alias("chunk_id"))


def image_chunks(spark, sf_dir: str) -> DataFrame:
    """Every page as a record whose image is its html's bytes, none being empty ones."""
    title = F.when(F.pmod("page_id", F.lit(3)) != 0, F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).otherwise(F.lit("  "))
    image = F.coalesce("html", F.lit("")).cast("binary")
    return C.image_chunks(table(spark, sf_dir, "pages"), F.col("url"), F.col("url"), title, image)


def image_chunks_b(spark, sf_dir: str) -> DataFrame:
    name = X.file_name(F.regexp_replace("url", r"[?#].*$", ""))
    ids = F.sequence(F.lit(0), F.lit(575))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("img_"), X.file_stem(name)).alias("chunk_id"), F.concat(F.lit("[Image: "), name, F.lit("]")).alias("content"), F.size(ids).cast("long").alias("n_tokens"), X.block_hash(F.lit("visual"), ids).alias("block_id"))


def model_spec(spark, sf_dir: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(4))
    name = F.when(kind == 0, F.lit("openai/clip-vit-large-patch14")).when(kind == 1, F.concat(F.lit("hf-hub:org/"), "source")).when(kind == 2, F.concat("lang", F.lit("/"), "source")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", X.model_spec(name).alias("spec"), X.model_tag(name).alias("pretrained"))


def query_sample(spark, sf_dir: str) -> DataFrame:
    """The first queries of the dataset, as its loader takes them."""
    return C.first_queries(lambda: table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", 20)


def variant_matrix(spark, sf_dir: str) -> DataFrame:
    """Every query under each of the three configurations."""
    variants = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(c).alias("cache_enabled"), F.lit(p).alias("pruning_enabled")) for n, c, p in (("baseline", False, False), ("eviction_only", True, False), ("pruning_plus_eviction", True, True))))
    return table(spark, sf_dir, "benchmark").select("item_id", F.inline(variants))


def synthetic_chunks(spark, sf_dir: str) -> DataFrame:
    """Hand-made chunks: positional token ids, so blocks of one kind share their address."""
    rows = [("doc_finances", "text", 128), ("doc_architecture", "text", 128), ("doc_chart", "visual", 576), ("doc_research", "text", 128), ("doc_diagram", "visual", 576)]
    made = spark.createDataFrame(rows, "chunk_id string, modality string, n_tokens int")
    return made.select("chunk_id", "modality", F.col("n_tokens").cast("long").alias("n_tokens"), X.block_hash(F.col("modality"), F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("block_id"))


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
_REC = """WITH rec AS (SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN ' ' || chr(10) || chr(9) || ' ' END AS markdown, CASE doc_id % 4 WHEN 1 THEN text WHEN 2 THEN '' END AS text,
 CASE doc_id % 4 WHEN 2 THEN text END AS content, CASE doc_id % 8 WHEN 3 THEN text END AS query, CASE doc_id % 8 WHEN 7 THEN text END AS answer, CASE doc_id % 4 WHEN 3 THEN '' WHEN 2 THEN source END AS source, CASE WHEN doc_id % 3 = 0 THEN doc_id % 11 END AS page, lang AS split, n_chars FROM documents) """
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"
_VOCAB = f"pieces AS (SELECT doc_id, unnest({_TOKENS}) AS piece, generate_subscripts({_TOKENS}, 1) AS pos FROM documents), vocab AS (SELECT piece, row_number() OVER (ORDER BY min((doc_id, pos))) AS token_id FROM pieces GROUP BY piece)"
_HASH = "substr(sha256('{m}:' || array_to_string({ids}, ',')), 1, 32)"

QUERIES = {
    f.__name__: f
    for f in (record_text, record_doc_id, record_source, record_metadata, union_splits, dataset_dir, image_sink, image_file_name, token_count, tokenize, vocab_ids, chunk_words, chunk_tokens, chunk_ids, block_hash, block_build, image_chunk_ids, image_chunks, image_chunks_b, model_spec, query_sample, variant_matrix, synthetic_chunks)
}
ORACLES = {
    "record_text": _REC + f"SELECT doc_id, coalesce({', '.join(f'CASE WHEN {_TRIM.format(c)} THEN {c} END' for c in TEXT_NAMES)}, '') AS record_text FROM rec",
    "record_doc_id": "SELECT doc_id AS key, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN nullif(source, '') ELSE nullif(lang, '') END AS record_id FROM documents",
    "record_source": _REC + "SELECT doc_id, CASE WHEN source <> '' THEN source WHEN doc_id::BIGINT % 5 = 0 THEN 'unknown' WHEN page IS NOT NULL THEN doc_id || '#page=' || page ELSE doc_id END AS record_source FROM rec",
    "record_metadata": _REC + "SELECT doc_id, json_object('doc_id', doc_id, 'query', query, 'answer', answer, 'source', source, 'page', page, 'split', split, 'n_chars', n_chars)::VARCHAR AS metadata FROM rec",
    "union_splits": "SELECT doc_id, lang AS split, CASE WHEN lang IS DISTINCT FROM 'de' THEN source END AS source, n_chars FROM documents",
    "dataset_dir": "SELECT doc_id, coalesce(lang, 'unnamed') AS split, md5(text) AS text_md5 FROM documents",
    "image_sink": "SELECT substr(sha256(doc_id || CASE WHEN doc_id % 3 = 0 THEN '-page-' || (doc_id % 11) ELSE '' END), 1, 24) || '.png' AS file_name, sha256(text) AS image_sha256, count(*) OVER () AS made_first, 0::BIGINT AS made_second FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL",
    "image_file_name": _REC + "SELECT doc_id, substr(sha256(doc_id || CASE WHEN page IS NOT NULL THEN '-page-' || page ELSE '' END), 1, 24) || '.png' AS file_name FROM rec",
    "token_count": f"SELECT doc_id, len({_WORDS})::BIGINT AS n_tokens FROM documents",
    "tokenize": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS decoded_md5 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "vocab_ids": f"WITH {_VOCAB} SELECT piece, token_id FROM vocab",
    "chunk_words": f"SELECT doc_id, i // 64 AS chunk_index, doc_id || '_chunk' || (i // 64) AS chunk_id, array_to_string(w[i + 1:i + 64], ' ') AS content, len(w[i + 1:i + 64])::BIGINT AS n_tokens, {_HASH.format(m='text', ids='range(i, least(i + 64, len(w)))')} AS block_id FROM (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))",
    "chunk_tokens": f"SELECT doc_id, i // 64 AS chunk_index, array_to_string(t[i + 1:i + 64], ' ') AS content, len(t[i + 1:i + 64])::BIGINT AS n_tokens FROM (SELECT doc_id, t, unnest(range(0, len(t), 64)) AS i FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))",
    "chunk_ids": f"WITH {_VOCAB} SELECT doc_id, (pos - 1) // 64 AS chunk_index, substr(sha256(doc_id || ':' || ((pos - 1) // 64) || ':' || string_agg(token_id, ',' ORDER BY pos)), 1, 32) AS chunk_id FROM pieces JOIN vocab USING (piece) GROUP BY doc_id, (pos - 1) // 64",
    "block_hash": f"SELECT item_id, {_HASH.format(m='text', ids='i')} AS text_block, {_HASH.format(m='visual', ids='i')} AS visual_block FROM (SELECT item_id, list_transform({_WORDS}, lambda w: length(w)) AS i FROM benchmark)",
    "block_build": f"SELECT doc_id, n AS num_tokens, 0::BIGINT AS layer_start, 31::BIGINT AS layer_end, n * 256 AS bytes FROM (SELECT doc_id, greatest(1, len({_WORDS}))::BIGINT AS n FROM documents)",
    "image_chunk_ids": "SELECT page_id, substr(sha256('image:' || url || ':' || url), 1, 32) AS chunk_id FROM pages",
    "image_chunks": "SELECT substr(sha256('image:' || url || ':' || url), 1, 32) AS chunk_id, coalesce(nullif(trim(CASE WHEN page_id % 3 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE '  ' END), ''), 'Retrieved image from ' || url) AS text, url AS source, 'image' AS modality, url AS image_path, 0::BIGINT AS chunk_index FROM pages",
    "image_chunks_b": f"SELECT page_id, 'img_' || regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS chunk_id, '[Image: ' || name || ']' AS content, 576::BIGINT AS n_tokens, {_HASH.format(m='visual', ids='range(576)')} AS block_id FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages)",
    "model_spec": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ViT-L-14' WHEN 1 THEN 'hf-hub:org/' || source WHEN 2 THEN 'hf-hub:' || lang || '/' || source ELSE source END AS spec, CASE WHEN doc_id % 4 = 0 THEN 'openai' END AS pretrained FROM documents",
    "query_sample": "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 20",
    "variant_matrix": "SELECT item_id, variant, cache_enabled, pruning_enabled FROM benchmark, (VALUES ('baseline', false, false), ('eviction_only', true, false), ('pruning_plus_eviction', true, true)) v(variant, cache_enabled, pruning_enabled)",
    "synthetic_chunks": f"SELECT chunk_id, modality, n AS n_tokens, substr(sha256(modality || ':' || array_to_string(range(n), ',')), 1, 32) AS block_id FROM (VALUES ('doc_finances', 'text', 128::BIGINT), ('doc_architecture', 'text', 128), ('doc_chart', 'visual', 576), ('doc_research', 'text', 128), ('doc_diagram', 'visual', 576)) v(chunk_id, modality, n)",
}
