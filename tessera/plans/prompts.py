"""Queries over prompts: assembly, flags, payloads, token summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import generation as G
from tessera.operators import prompts as P
from tessera.session import table
from tessera.sources import tables as S


def _requests(spark, sf_dir: str) -> DataFrame:
    return S.requests(spark, sf_dir).withColumn("chunks", P.ordered_chunks(F.col("chunks")))


def prompt_chunk_order(spark, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request_id", F.posexplode("chunks").alias("position", "c")).select("request_id", F.col("position").cast("long").alias("position"), "c.chunk_id")


def prompt_segments(spark, sf_dir: str) -> DataFrame:
    made = P.segments(F.col("query"), F.col("image_path"), F.col("chunks"))
    return _requests(spark, sf_dir).select("request_id", F.posexplode(made).alias("seg_index", "s")).select("request_id", F.col("seg_index").cast("long").alias("seg_index"), "s.*")


def prompt_flags(spark, sf_dir: str) -> DataFrame:
    """A path counts as visual context even if it is empty, though it then makes no segment."""
    visual = F.size(F.filter("chunks", lambda c: c.modality == "image")).cast("long")
    count = F.size("chunks") + 2 + F.when(F.coalesce("image_path", F.lit("")) != "", 1).otherwise(0)
    return _requests(spark, sf_dir).select("request_id", count.cast("long").alias("segment_count"), visual.alias("retrieved_visual_count"), (F.col("image_path").isNotNull() | (visual > 0)).alias("has_visual_context"))


def user_text_block(spark, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request_id", P.user_text_block(F.col("query"), F.col("chunks")).alias("block"))


def prompt_b(spark, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request_id", P.context_prompt(F.col("query"), F.col("chunks")).alias("prompt"))


def chat_payload(spark, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request_id", P.chat_payload(F.col("query"), F.col("image_path"), F.col("chunks")).alias("payload"))


class EchoEngine:
    """Stands in for a model: says what the user said, and fails on texts of some lengths."""

    def chat(self, messages: list[dict], **parameters) -> dict:
        text = messages[-1]["content"][0]["text"]
        if len(text) % 7 == 0:
            raise ValueError("a length that can't be answered")
        return {"generated_text": text, "timing": {"generation_seconds": len(messages)}}


def generate_responses(spark, sf_dir: str) -> DataFrame:
    """Every request through prompt, engine and summary; failing ones have an empty answer."""
    told = G.respond(_requests(spark, sf_dir), EchoEngine)
    number = lambda c, path: F.get_json_object(c, path).cast("long")
    return told.select("request_id", F.md5("answer_text").alias("answer_md5"), F.size("retrieved_chunk_ids").cast("long").alias("n_chunks"), F.col("error").isNotNull().alias("failed"), number("timing_summary", "$.generation_seconds").alias("seconds"), *(number("prompt_summary", f"$.{c}").alias(c) for c in ("total_prompt_tokens", "retrieved_text_token_count", "num_retrieved_chunks")))


def chunk_normalize(spark, sf_dir: str) -> DataFrame:
    """Retrieved chunks of every shape: the score absent, null or there, with and without one in the metadata."""
    n = F.col("vec_id")
    kind = F.pmod(n, F.lit(6))
    score = F.when(kind < 2, F.lit("")).when(kind < 4, F.lit('"score":null,')).otherwise(F.concat(F.lit('"score":'), n.cast("string"), F.lit(".5,")))
    metadata = F.when(F.pmod(n, F.lit(2)) == 0, F.concat(F.lit('"metadata":{"score":'), n.cast("string"), F.lit(".25},"))).when(F.pmod(n, F.lit(3)) == 0, F.lit('"metadata":null,')).otherwise(F.lit(""))
    modality = F.when(F.col("label") < 3, F.lit('"modality":"image","image_path":"a.png",')).when(F.col("label") < 5, F.lit('"retrieval_rank":3,')).otherwise(F.lit(""))
    body = F.concat(F.lit("{"), score, metadata, modality, F.lit('"chunk_id":"v'), n.cast("string"), F.lit('"}'))
    return table(spark, sf_dir, "embeddings").select("vec_id", P.normalize_chunk(body).alias("c")).select("vec_id", "c.*").withColumn("retrieval_rank", F.col("retrieval_rank").cast("long"))


def prompt_log_event(spark, sf_dir: str) -> DataFrame:
    """The event logged for a prompt: the caller's context, whose image path may be missing or null, and the summary."""
    asked = S.requests(spark, sf_dir)
    request = F.col("request_id")
    path = F.when(F.pmod(request, F.lit(3)) == 0, F.lit("")).when(F.pmod(request, F.lit(3)) == 1, F.lit(',"image_path":null')).otherwise(F.concat(F.lit(',"image_path":"req/'), request.cast("string"), F.lit('.png"')))
    context = F.concat(F.lit('{"conv":'), request.cast("string"), path, F.lit(',"total_prompt_tokens":"theirs"}'))
    summary = P.summarize(S.segments(spark, sf_dir), "request_id")
    payload = F.to_json(F.struct(*(c for c in summary.columns if c != "request_id")))
    return asked.select("request_id", context.alias("context")).join(summary.select("request_id", payload.alias("payload")), "request_id").select("request_id", P.log_event("prompt_summary", F.col("context"), F.col("payload")).alias("line"))


def metadata_merge(spark, sf_dir: str) -> DataFrame:
    """Fixed entries first; a chunk's own metadata overrides them, as the later map wins.

    The maps are merged by filtering, so the outcome doesn't hang on a session setting.
    """
    fixed = F.create_map(F.lit("chunk_id"), F.format_string("v%d", "doc_id"), F.lit("source"), F.lit("corpus"))
    own = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    merged = F.map_concat(F.map_filter(fixed, lambda k, _: ~F.map_contains_key(own, k)), own)
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(merged).alias("metadata"))


def segment_normalize(spark, sf_dir: str) -> DataFrame:
    seg = S.segments(spark, sf_dir)
    kind = F.pmod("seg_index", F.lit(3))
    holey = seg.select("request_id", "seg_index", F.when(kind != 0, F.col("role")).alias("role"), F.when(kind != 1, F.col("modality")).alias("modality"), F.lit(None).cast("string").alias("source"), F.when(kind != 2, F.col("text")).alias("text"), F.when(kind == 1, F.lit(7)).alias("text_length"))
    return P.normalize_segments(holey)


def prompt_summary(spark, sf_dir: str) -> DataFrame:
    return P.summarize(S.segments(spark, sf_dir), "request_id")


def tokens_by_role(spark, sf_dir: str) -> DataFrame:
    return S.segments(spark, sf_dir).groupBy("request_id", "role").agg(F.sum(X.token_count("text")).alias("tokens"))


def tokens_by_modality(spark, sf_dir: str) -> DataFrame:
    return S.segments(spark, sf_dir).groupBy("request_id", "modality").agg(F.sum(X.token_count("text")).alias("tokens"))


def ordered_roles(spark, sf_dir: str) -> DataFrame:
    listed = P.ordered_values(S.segments(spark, sf_dir), "request_id", "seg_index", ["role", "modality", "source"])
    return listed.select("request_id", *(F.array_join(c, ",").alias(name) for c, name in (("role", "roles"), ("modality", "modalities"), ("source", "sources"))))


def token_maps(spark, sf_dir: str) -> DataFrame:
    """Both maps of each request as JSON objects, their keys in order."""
    made = P.token_maps(S.segments(spark, sf_dir), "request_id")
    return made.select("request_id", F.to_json("tokens_by_role").alias("tokens_by_role"), F.to_json("tokens_by_modality").alias("tokens_by_modality"))


def prompt_log_json(spark, sf_dir: str) -> DataFrame:
    """The event that is logged for a prompt: its context and its summary in one JSON object."""
    summary = P.summarize(S.segments(spark, sf_dir), "request_id")
    return summary.select(F.to_json(F.struct(F.lit("prompt_summary").alias("event"), "*")).alias("line"))


def extract_text(spark, sf_dir: str) -> DataFrame:
    """Responses of every shape: objects by key, texts, lists, outputs, and such without a text."""
    kind, said = F.pmod("event_id", F.lit(8)), F.col("event_type")
    shapes = (
        F.to_json(F.struct(said.alias("generated_text"))),
        F.to_json(F.struct(said.alias("text"), F.lit("no").alias("answer_text"))),
        F.to_json(F.struct(F.lit(5).alias("text"), said.alias("answer_text"))),
        F.concat(F.lit('"'), said, F.lit('"')),
        F.to_json(F.array(F.struct(said.alias("text")))),
        F.to_json(F.array(F.struct(F.array(F.struct(said.alias("text"))).alias("outputs")))),
        F.to_json(F.struct(F.array(F.struct(said.alias("text"))).alias("outputs"))),
    )
    body = F.coalesce(*(F.when(kind == k, x) for k, x in enumerate(shapes)), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.json_text(body).alias("answer"))


def extract_latency(spark, sf_dir: str) -> DataFrame:
    kind = F.pmod("event_id", F.lit(3))
    seconds = F.pmod("event_id", F.lit(9)).cast("string")
    body = F.when(kind == 0, F.concat(F.lit('{"timing": {"generation_seconds": '), seconds, F.lit("}}"))).when(kind == 1, F.concat(F.lit('{"generation_seconds": '), seconds, F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.json_latency(body, F.col("value")).alias("seconds"))


_CHUNKS = """c AS (SELECT conv_id AS request_id, turn, CASE WHEN turn % 5 <> 1 THEN turn END AS rank, 'c' || conv_id || '-' || turn AS chunk_id, turn % 3 = 0 AS image, 'conv' || conv_id AS source, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS text FROM conversations WHERE role = 'assistant'),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank IS NULL, coalesce(rank, 0), chunk_id) - 1 AS pos FROM c),
r AS (SELECT conv_id AS request_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS query, CASE conv_id % 3 WHEN 0 THEN '' WHEN 2 THEN 'req/' || conv_id || '.png' END AS image_path FROM conversations GROUP BY conv_id)"""
_BLOCK = """e AS (SELECT request_id, image, pos, '[' || coalesce(rank::VARCHAR, 'unranked') || '] ' || source || chr(10) || CASE WHEN image AND text = '' THEN 'Image from ' || source ELSE text END AS entry FROM o),
 g AS (SELECT request_id, string_agg(entry, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE NOT image) AS t, string_agg(entry, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE image) AS i FROM e GROUP BY request_id),
 u AS (SELECT request_id, image_path, concat_ws(chr(10) || chr(10), 'User query:' || chr(10) || query, 'Retrieved context:' || chr(10) || chr(10) || t, 'Retrieved visual context:' || chr(10) || chr(10) || i) AS block FROM r LEFT JOIN g USING (request_id))"""
_TOLD = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"
_SEG = """seg AS (SELECT conv_id AS request_id, turn AS seg_index, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'retrieved_visual' ELSE 'retrieved_text' END ELSE role END AS role,
 CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'image' ELSE 'text' END AS modality, CASE WHEN role = 'assistant' THEN 'conv' || conv_id ELSE role END AS source, text, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM conversations)"""

QUERIES = {
    f.__name__: f
    for f in (prompt_chunk_order, prompt_segments, prompt_flags, user_text_block, prompt_b, chat_payload, generate_responses, chunk_normalize, prompt_log_event, metadata_merge, segment_normalize, prompt_summary, tokens_by_role, tokens_by_modality, token_maps, ordered_roles, prompt_log_json, extract_text, extract_latency)
}
ORACLES = {
    "prompt_chunk_order": f"WITH {_CHUNKS} SELECT request_id, pos AS position, chunk_id FROM o",
    "prompt_segments": f"""WITH {_CHUNKS}, s AS (
 SELECT request_id, 0 AS seg_index, 'system' AS role, 'text' AS modality, 'system' AS source, 'You are a helpful multimodal RAG assistant.' AS text, NULL::BIGINT AS retrieval_rank FROM r
 UNION ALL SELECT request_id, 1, 'user', 'text', 'user', query, NULL FROM r
 UNION ALL SELECT request_id, 2 + pos, CASE WHEN image THEN 'retrieved_visual' ELSE 'retrieved_text' END, CASE WHEN image THEN 'image' ELSE 'text' END, source, CASE WHEN image AND text = '' THEN 'retrieved image: ' || source ELSE text END, rank FROM o
 UNION ALL SELECT request_id, 2 + (SELECT count(*) FROM o WHERE o.request_id = r.request_id), 'visual_context', 'image', image_path, 'image attached: ' || image_path, NULL FROM r WHERE image_path <> '')
SELECT request_id, seg_index::BIGINT AS seg_index, role, modality, source, text, length(text) AS text_length, retrieval_rank FROM s""",
    "prompt_flags": f"WITH {_CHUNKS} SELECT r.request_id, 2 + count(o.pos) + CASE WHEN any_value(r.image_path) <> '' THEN 1 ELSE 0 END AS segment_count, count(*) FILTER (WHERE o.image) AS retrieved_visual_count, any_value(r.image_path) IS NOT NULL OR count(*) FILTER (WHERE o.image) > 0 AS has_visual_context FROM r LEFT JOIN o USING (request_id) GROUP BY r.request_id",
    "user_text_block": f"""WITH {_CHUNKS}, e AS (SELECT request_id, image, pos, '[' || coalesce(rank::VARCHAR, 'unranked') || '] ' || source || chr(10) || CASE WHEN image AND text = '' THEN 'Image from ' || source ELSE text END AS entry FROM o),
 g AS (SELECT request_id, string_agg(entry, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE NOT image) AS t, string_agg(entry, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE image) AS i FROM e GROUP BY request_id)
SELECT request_id, concat_ws(chr(10) || chr(10), 'User query:' || chr(10) || query, 'Retrieved context:' || chr(10) || chr(10) || t, 'Retrieved visual context:' || chr(10) || chr(10) || i) AS block FROM r LEFT JOIN g USING (request_id)""",
    "chat_payload": f"""WITH {_CHUNKS}, {_BLOCK}, v AS (SELECT request_id, string_agg(',' || json_object('type', 'image_url', 'image_url', json_object('url', 'file://img/' || turn || '.png'))::VARCHAR, '' ORDER BY pos) AS shown FROM o WHERE image AND turn > 0 GROUP BY request_id)
SELECT request_id, '{{"messages":[{{"role":"system","content":[{{"type":"text","text":"You are a helpful multimodal RAG assistant."}}]}},{{"role":"user","content":[' || json_object('type', 'text', 'text', block)::VARCHAR
 || CASE WHEN image_path <> '' THEN ',' || json_object('type', 'image_url', 'image_url', json_object('url', 'file://' || image_path))::VARCHAR ELSE '' END || coalesce(shown, '') || ']}}]}}' AS payload FROM u LEFT JOIN v USING (request_id)""",
    "generate_responses": f"""WITH {_CHUNKS}, {_BLOCK}, n AS (SELECT request_id, sum({_TOLD.format("CASE WHEN image AND text = '' THEN 'retrieved image: ' || source ELSE text END")}) AS words, sum({_TOLD.format('text')}) FILTER (WHERE NOT image) AS texts, count(*) AS n FROM o GROUP BY request_id)
SELECT u.request_id, md5(CASE WHEN length(block) % 7 = 0 THEN '' ELSE block END) AS answer_md5, coalesce(n, 0) AS n_chunks, length(block) % 7 = 0 AS failed, CASE WHEN length(block) % 7 <> 0 THEN 2::BIGINT END AS seconds,
 (7 + {_TOLD.format('query')} + coalesce(words, 0) + CASE WHEN u.image_path <> '' THEN 3 ELSE 0 END)::BIGINT AS total_prompt_tokens, coalesce(texts, 0)::BIGINT AS retrieved_text_token_count, coalesce(n, 0) AS num_retrieved_chunks FROM u JOIN r USING (request_id) LEFT JOIN n USING (request_id)""",
    "chunk_normalize": """SELECT vec_id, 'v' || vec_id AS chunk_id, '' AS text, '' AS source, CASE WHEN label < 3 THEN 'image' ELSE 'text' END AS modality, CASE WHEN label < 3 THEN 'a.png' END AS image_path, CASE WHEN label BETWEEN 3 AND 4 THEN 3::BIGINT END AS retrieval_rank,
 CASE WHEN vec_id % 6 = 0 THEN vec_id + 0.25::DOUBLE WHEN vec_id % 6 >= 4 THEN vec_id + 0.5::DOUBLE END AS score, CASE WHEN vec_id % 2 = 0 THEN '{"score":' || vec_id || '.25}' ELSE '{}' END AS metadata FROM embeddings""",
    "prompt_log_event": f"""WITH {_SEG}, s AS (SELECT request_id, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE role = 'retrieved_text'), 0)::BIGINT AS texts, bool_or(modality = 'image' OR role = 'visual_context') AS visual, count(*) FILTER (WHERE starts_with(role, 'retrieved_')) AS chunks FROM seg GROUP BY request_id)
SELECT request_id, '{{"conv":' || request_id || ',"event":"prompt_summary",' || CASE request_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"image_path":null,' ELSE '"image_path":"req/' || request_id || '.png",' END || '"num_retrieved_chunks":' || chunks || ',"retrieved_text_token_count":' || texts || ',"total_prompt_tokens":' || total || ',"visual_input_present":' || visual || '}}' AS line FROM s""",
    "prompt_b": f"""WITH {_CHUNKS}, g AS (SELECT request_id, string_agg('[Context ' || (pos + 1) || ' (' || CASE WHEN image THEN 'image' ELSE 'text' END || ')]: ' || text, chr(10) || chr(10) ORDER BY pos) AS t FROM o GROUP BY request_id)
SELECT request_id, 'Use the following context to answer the question.' || chr(10) || chr(10) || coalesce(t, '') || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Answer:' AS prompt FROM r LEFT JOIN g USING (request_id)""",
    "segment_normalize": f"WITH {_SEG} SELECT request_id, seg_index, CASE WHEN seg_index % 3 <> 0 THEN role ELSE '' END AS role, CASE WHEN seg_index % 3 <> 1 THEN modality ELSE 'text' END AS modality, '' AS source, CASE WHEN seg_index % 3 <> 2 THEN text ELSE '' END AS text, CASE seg_index % 3 WHEN 1 THEN 7 WHEN 2 THEN 0 ELSE length(text) END::BIGINT AS text_length FROM seg",
    "prompt_summary": f"WITH {_SEG} SELECT request_id, sum(n)::BIGINT AS total_prompt_tokens, coalesce(sum(n) FILTER (WHERE role = 'retrieved_text'), 0)::BIGINT AS retrieved_text_token_count, bool_or(modality = 'image' OR role = 'visual_context') AS visual_input_present, count(*) FILTER (WHERE starts_with(role, 'retrieved_')) AS num_retrieved_chunks FROM seg GROUP BY request_id",
    "prompt_log_json": f"WITH {_SEG}, s AS (SELECT request_id, sum(n)::BIGINT AS total_prompt_tokens, coalesce(sum(n) FILTER (WHERE role = 'retrieved_text'), 0)::BIGINT AS retrieved_text_token_count, bool_or(modality = 'image' OR role = 'visual_context') AS visual_input_present, count(*) FILTER (WHERE starts_with(role, 'retrieved_')) AS num_retrieved_chunks FROM seg GROUP BY request_id) SELECT json_object('event', 'prompt_summary', 'request_id', request_id, 'total_prompt_tokens', total_prompt_tokens, 'retrieved_text_token_count', retrieved_text_token_count, 'visual_input_present', visual_input_present, 'num_retrieved_chunks', num_retrieved_chunks)::VARCHAR AS line FROM s",
    "tokens_by_role": f"WITH {_SEG} SELECT request_id, role, sum(n)::BIGINT AS tokens FROM seg GROUP BY ALL",
    "tokens_by_modality": f"WITH {_SEG} SELECT request_id, modality, sum(n)::BIGINT AS tokens FROM seg GROUP BY ALL",
    "ordered_roles": f"WITH {_SEG} SELECT request_id, string_agg(role, ',' ORDER BY seg_index) AS roles, string_agg(modality, ',' ORDER BY seg_index) AS modalities, string_agg(source, ',' ORDER BY seg_index) AS sources FROM seg GROUP BY request_id",
    "metadata_merge": "SELECT doc_id, json_object('chunk_id', 'v' || doc_id, 'source', source, 'lang', lang)::VARCHAR AS metadata FROM documents",
    "token_maps": f"WITH {_SEG}, r AS (SELECT request_id, role AS k, sum(n)::BIGINT AS n FROM seg GROUP BY ALL), m AS (SELECT request_id, modality AS k, sum(n)::BIGINT AS n FROM seg GROUP BY ALL), a AS (SELECT request_id, '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' AS tokens_by_role FROM r GROUP BY request_id), b AS (SELECT request_id, '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' AS tokens_by_modality FROM m GROUP BY request_id) SELECT * FROM a JOIN b USING (request_id)",
    "extract_text": "SELECT event_id, CASE WHEN event_id % 8 < 7 THEN event_type ELSE '' END AS answer FROM events",
    "extract_latency": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (event_id % 9)::DOUBLE ELSE value END AS seconds FROM events",
}
