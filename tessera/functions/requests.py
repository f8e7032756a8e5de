"""Requests and records whose fields may be missing altogether."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampling parameters where a request names none.
SAMPLING = {"max_tokens": 256, "temperature": 0.2, "top_p": 0.95}


def page_number(df: DataFrame) -> Column:
    """page_number_in_doc if there is such a column, even where it is null; else page_number; whole numbers only."""
    name = next((c for c in ("page_number_in_doc", "page_number") if c in df.columns), None)
    if name is None or dict(df.dtypes)[name] not in ("tinyint", "smallint", "int", "bigint"):
        return F.lit(None).cast("long")
    return F.col(name).cast("long")


def sampling(df: DataFrame) -> DataFrame:
    """df with every sampling parameter, the default where the column is missing or null."""
    given = set(df.columns)
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in given else F.lit(v) for k, v in SAMPLING.items()})


def request_messages(payload: Column) -> Column:
    """The chat messages of a request as JSON.

    A JSON object with messages keeps them; one with a prompt, and perhaps an image path, becomes one
    user message; any other text is a prompt itself.
    """
    messages = F.get_json_object(payload, "$.messages")
    prompt, image = F.get_json_object(payload, "$.prompt"), F.get_json_object(payload, "$.image_path")
    said = lambda text: F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    shown = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("file://"), image).alias("url")).alias("image_url")))
    parts = F.concat(said(F.coalesce(prompt, payload)), F.when(F.coalesce(image, F.lit("")) != "", F.concat(F.lit(","), shown)).otherwise(F.lit("")))
    return F.coalesce(messages, F.concat(F.lit('[{"role":"user","content":['), parts, F.lit("]}]")))
