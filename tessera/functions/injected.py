"""Parts that callers may bring themselves: counters, tokenizers, embedders, mask makers.

A part is a plain Python object or function; it is applied to Arrow batches, and where none is given
the built-in expression takes its place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X


def encoder_of(tokenizer: Any) -> Callable[[str], Sequence]:
    """What turns a text into ids: the tokenizer's encode, without special tokens if it knows of such, or itself."""
    encode = getattr(tokenizer, "encode", tokenizer)

    def ids(text: str) -> Sequence:
        try:
            found = encode(text, add_special_tokens=False)
        except TypeError:
            found = encode(text)
        return getattr(found, "ids", found)

    return ids


def tokenizer_name(settings: dict) -> str | None:
    """The first name that is given: of the tokenizer, the model, or the embedding model."""
    within = (settings, "tokenizer_name"), (settings.get("model") or {}, "name"), (settings.get("rag") or {}, "embedding_model"), (settings, "embedding_model")
    return next((v for part, key in within if isinstance(v := part.get(key), str) and v), None)


def counted_tokens(text: str | Column, counter: Callable[[str], int] | None = None, tokenizer: Any = None, settings: dict | None = None, load: Callable[[str], Any] | None = None) -> Column:
    """Tokens of a text by the counter given, else by the tokenizer given or loaded by its name, else its words.

    load may return None where a tokenizer isn't at hand. A blank text has no tokens for a tokenizer;
    a counter sees every text but null, which has none.
    """
    if counter is None and tokenizer is None and settings and load and (name := tokenizer_name(settings)):
        tokenizer = load(name)
    if counter is None and tokenizer is None:
        return X.token_count(text)
    count = counter or (lambda t, ids=encoder_of(tokenizer): len(ids(t)) if t.strip() else 0)

    @F.pandas_udf(T.LongType())
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else count(t) for t in texts], dtype="int64")

    return counts(text)


def embedded(text: str | Column, embed: Callable[[list[str]], Any]) -> Column:
    """Vectors of texts by an embedder of lists; null for a null text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        given = texts.notna().to_numpy()
        rows = iter(as_rows(embed(texts[given].tolist())) if given.any() else [])
        return pd.Series([next(rows) if there else None for there in given], dtype=object)

    return vectors(text)


def as_rows(value: Any) -> list[np.ndarray]:
    """An embedder's result as single-precision rows; one vector is one row."""
    return list(np.atleast_2d(np.asarray(value, dtype=np.float32)))


def as_vector(value: str | Column, nested: bool = False) -> Column:
    """Numbers of any kind, or lists of them, as one single-precision vector."""
    column = F.col(value) if isinstance(value, str) else value
    return (F.flatten(column) if nested else column).cast("array<float>")


def decoded(ids: DataFrame, key: str, vocab: DataFrame, name: str = "decoded") -> DataFrame:
    """key and the text of its ids (array column ``ids``), joined by blanks; ids that vocab (piece, token_id) lacks are skipped."""
    each = ids.select(key, F.posexplode("ids").alias("at_", "token_id")).join(vocab, "token_id")
    joined = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at_", "piece"))).alias("p_")).select(key, F.array_join("p_.piece", " ").alias(name))
    return ids.select(key).join(joined, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def mask_backend(wanted: str, segmenter: Callable | None = None) -> str:
    """The segmenter's masks if they are wanted and one is there, else the centre of the grid."""
    return "mobilesam" if wanted == "mobilesam" and segmenter is not None else "center_crop"


def kept_share(mask: str | Column) -> Column:
    """The number of patches that a mask keeps, and their share of all, 0 for an empty one."""
    kept, n = F.size(F.filter(mask, lambda x: x)), F.size(mask)
    return F.struct(kept.cast("long").alias("kept"), F.when(n > 0, kept / n).otherwise(F.lit(0.0)).alias("ratio"))
