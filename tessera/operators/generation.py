"""A batch of requests through its steps, each of which a caller may bring: retriever, prompt builder, engine, summary.

Retriever and prompt builder work on whole tables and columns, so they run where Spark runs them.
Engines and summary helpers are Python objects; they see rows in Arrow batches, an engine is made once
a worker, and a row on which one fails gets a fallback value, with the error beside it, so the others
go on.
"""

from __future__ import annotations

import inspect
import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions.requests import SAMPLING
from tessera.operators import prompts as P

GENERATED = T.StructType([T.StructField("generated_text", T.StringType()), T.StructField("timing", T.StringType()), T.StructField("error", T.StringType())])
#: Engines of this worker, each under the name that its plan gave it.
_ENGINES: dict[str, Any] = {}

# Where a response may keep its text.
TEXT_KEYS = ("generated_text", "text", "answer_text")


def part_of(given: Any, method: str) -> Callable:
    """The method of a part that has it, else the part itself."""
    return getattr(given, method, given)


def with_known_arguments(call: Callable, offered: Mapping[str, Any]) -> Any:
    """Call with those of the offered arguments that it names, or all if it takes any."""
    named = inspect.signature(call).parameters.values()
    anything = any(p.kind is p.VAR_KEYWORD for p in named)
    return call(**(offered if anything else {p.name: offered[p.name] for p in named if p.name in offered}))


def retrieved(requests: DataFrame, chunks: DataFrame, retriever: Any) -> DataFrame:
    """What a retriever, an object with retrieve or a function, finds in chunks for requests; both are tables."""
    return part_of(retriever, "retrieve")(requests, chunks)


def built(requests: DataFrame, builder: Any = None) -> DataFrame:
    """requests (query, image_path, chunks, ...) with segments, payload and segment_metadata.

    builder, an object with build_prompt or a function, takes the three columns by name and gives three
    columns in this order, or a mapping of them; payload may be called request_payload there, and
    segment_metadata metadata. Without one, the service's own prompt is built.
    """
    given = {c: F.col(c) for c in ("query", "image_path", "chunks")}
    if builder is None:
        made: Any = (P.segments(**given), P.chat_payload(**given), F.create_map().cast("map<string,string>"))
    else:
        made = with_known_arguments(part_of(builder, "build_prompt"), given)
    if isinstance(made, Mapping):
        nothing = F.lit(None).cast("string")
        made = (made.get("segments", F.array()), made.get("payload", made.get("request_payload", nothing)), made.get("segment_metadata", made.get("metadata", F.create_map().cast("map<string,string>"))))
    return requests.withColumns(dict(zip(("segments", "payload", "segment_metadata"), made, strict=True)))


def text_of(response: Any) -> str:
    """The text of an engine's response: itself, of a mapping under a known key, of a list its first, of an object its first output."""
    if isinstance(response, str):
        return response
    if isinstance(response, Mapping):
        return next((v for k in TEXT_KEYS if isinstance(v := response.get(k), str)), "")
    for holder in (*(response[:1] if isinstance(response, list) else ()), response):
        outputs = getattr(holder, "outputs", None)
        if outputs and isinstance(getattr(outputs[0], "text", None), str):
            return outputs[0].text
    return text_of(response[0]) if isinstance(response, list) and response and isinstance(response[0], Mapping) else ""


def timing_of(response: Any, measured: float) -> dict:
    """Seconds as the response tells them, else as measured."""
    if isinstance(response, Mapping) and isinstance(response.get("timing"), Mapping):
        return dict(response["timing"])
    told = isinstance(response, Mapping) and "generation_seconds" in response
    return {"generation_seconds": response["generation_seconds"] if told else measured}


def _asked(engine: Any, payload: Any, parameters: dict) -> Any:
    if isinstance(payload, Mapping) and "messages" in payload and hasattr(engine, "chat"):
        return engine.chat(payload["messages"], **parameters)
    if not hasattr(engine, "generate"):
        raise AttributeError("an engine has chat or generate")
    return engine.generate(payload, **parameters)


def _payload(text: str) -> Any:
    """A payload as its engine takes it: an object in JSON as it is, any other text as a prompt."""
    try:
        known = json.loads(text)
    except ValueError:
        return {"prompt": text}
    return known if isinstance(known, dict) else {"prompt": text}


def generated(payload: str | Column, make_engine: Callable[[], Any], fallback: str = "", **parameters: Any) -> Column:
    """generated_text, timing (JSON) and error of each payload; null payloads aren't asked for.

    A failing row has the fallback as its text and the error's name and words. parameters go over the
    sampling defaults.
    """
    name, asked = uuid.uuid4().hex, SAMPLING | {k: v for k, v in parameters.items() if v is not None}

    @F.pandas_udf(GENERATED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                if text is None:
                    rows.append((None, None, None))
                    continue
                try:
                    if name not in _ENGINES:
                        _ENGINES[name] = make_engine()
                    began = time.perf_counter()
                    response = _asked(_ENGINES[name], _payload(text), asked)
                    rows.append((text_of(response), json.dumps(timing_of(response, time.perf_counter() - began)), None))
                except Exception as failed:  # one row's failure is told beside it
                    rows.append((fallback, None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=GENERATED.names)

    return run(payload)


def _own_summary(segments: Column) -> Column:
    """A prompt's summary in JSON, from its segments alone."""
    tokens = lambda wanted: F.aggregate(F.filter(segments, wanted), F.lit(0).cast("long"), lambda s, x: s + X.token_count(x.text))
    some = lambda x: x.role.startswith("retrieved_")
    told = F.struct(
        tokens(lambda x: F.lit(True)).alias("total_prompt_tokens"),
        tokens(lambda x: x.role == "retrieved_text").alias("retrieved_text_token_count"),
        F.exists(segments, lambda x: (x.modality == "image") | (x.role == "visual_context")).alias("visual_input_present"),
        F.size(F.filter(segments, some)).alias("num_retrieved_chunks"),
        F.transform(segments, lambda x: x.role).alias("ordered_segment_roles"),
    )
    return F.to_json(told)


def summarized(segments: str | Column, helper: Any = None, config: Any = None, timing: Column | None = None) -> Column:
    """A prompt's summary in JSON: the helper's, or the built-in one where there is none or it fails.

    helper, an object with summarize_prompt or a function, gets those of segments, prompt_segments,
    config, timing_summary and generation_timing that it names, and gives a mapping.
    """
    column = F.col(segments) if isinstance(segments, str) else segments
    if helper is None:
        return _own_summary(column)
    call = part_of(helper, "summarize_prompt")

    @F.pandas_udf(T.StringType())
    def run(lists: pd.Series, timings: pd.Series) -> pd.Series:
        out = []
        for text, told in zip(lists, timings, strict=True):
            try:
                parts, seconds = json.loads(text), json.loads(told) if told else None
                offered = {"segments": parts, "prompt_segments": parts, "config": config, "timing_summary": seconds, "generation_timing": seconds}
                out.append(json.dumps(dict(with_known_arguments(call, offered))))
            except Exception:  # the built-in summary stands in
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.coalesce(run(F.to_json(column, {"ignoreNullFields": "false"}), F.lit(None).cast("string") if timing is None else timing), _own_summary(column))


def respond(requests: DataFrame, make_engine: Callable[[], Any], builder: Any = None, helper: Any = None, fallback: str = "", **parameters: Any) -> DataFrame:
    """Responses to requests (query, image_path, chunks, ...): all their columns, and

    answer_text, retrieved_chunk_ids, token_summary, prompt_summary (the summary and the builder's
    metadata, which counts where both have a key), timing_summary, segments and error.
    """
    asked = built(requests, builder).withColumn("run_", generated("payload", make_engine, fallback, **parameters))
    summary = summarized("segments", helper, timing=F.col("run_.timing"))
    told = asked.withColumns({"answer_text": F.coalesce("run_.generated_text", F.lit(fallback)), "retrieved_chunk_ids": F.transform("chunks", lambda c: c.chunk_id), "token_summary": summary, "timing_summary": F.coalesce("run_.timing", F.lit("{}")), "error": F.col("run_.error")})
    whole = P.merged_json(F.col("token_summary"), F.to_json("segment_metadata"))
    return told.withColumn("prompt_summary", whole).drop("run_", "payload", "segment_metadata")
