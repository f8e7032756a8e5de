"""Sources and sinks in folders: texts, images, result files, and a store of cache blocks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X

try:
    import yaml
except ImportError:  # settings are then read as JSON
    yaml = None

# Suffixes of the files that a mixed folder is read for.
TEXT_SUFFIXES = ("txt", "md")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "tiff")


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """source (the path), doc_id (its stem) and markdown of all ``*.txt`` below a folder.

    Rows come as files are read; their order is that of source, which ids and ranks follow where it is
    their key, so no text is sorted. A missing folder raises when the frame is made, as Spark resolves the path then; a file that isn't
    UTF-8 when it is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.col("path").alias("source"), X.file_stem(F.col("path")).alias("doc_id"), F.validate_utf8(F.col("content").cast("string")).alias("markdown"))


@F.pandas_udf(T.StringType())
def _lenient(contents: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that are none."""
    return contents.map(lambda c: bytes(c).decode("utf-8", "ignore"), na_action="ignore")


def mixed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (text or image), length and text (without bytes that aren't UTF-8), for known suffixes in any case; their order is that of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kind = F.when(suffix.isin(*TEXT_SUFFIXES), "text").when(suffix.isin(*IMAGE_SUFFIXES), "image")
    known = files.select("path", kind.alias("kind"), "length", F.when(kind == "text", F.col("content")).alias("raw_")).where("kind is not null")
    return known.select("path", "kind", "length", _lenient("raw_").alias("text"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of result files that hold a ``results`` list, one JSON object a file."""
    return spark.read.option("multiLine", "true").json(path).select("config_name", F.inline("results"))


class BlockStore:
    """Blocks by id in Parquet: typed columns, a part of the table for each write, refused when full."""

    SCHEMA = "block_id string, modality string, token_ids array<int>, num_tokens int, bytes long"

    def __init__(self, spark: SparkSession, path: str, capacity_bytes: int) -> None:
        self.spark, self.path, self.capacity = spark, path, capacity_bytes

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA + ", version long, deleted boolean").parquet(self.path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], self.SCHEMA + ", version long, deleted boolean")

    def blocks(self) -> DataFrame:
        """The blocks that are there: of each id the last version, unless deleted."""
        rows = self._all()
        last = rows.groupBy("block_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "block_id"]), "version").alias("b"))
        return last.select("block_id", "b.*").where("not deleted").drop("version", "deleted")

    def usage_bytes(self) -> int:
        return self.blocks().agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def _append(self, rows: DataFrame, deleted: bool) -> None:
        version = self._all().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        rows.withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(deleted)}).write.mode("append").parquet(self.path)

    def store(self, rows: DataFrame) -> bool:
        if self.usage_bytes() >= self.capacity:
            return False
        self._append(rows, False)
        return True

    def load(self, block_id: str) -> DataFrame:
        return self.blocks().where(F.col("block_id") == block_id)

    def delete(self, block_ids: DataFrame) -> None:
        self._append(self.blocks().join(block_ids, "block_id", "left_semi"), True)


# The sections of a configuration, their keys and defaults.
@dataclass
class ModelSettings:
    name: str | None = None
    dtype: str = "float16"
    max_model_len: int = 4096
    gpu_memory_utilization: float = 0.85
    enforce_eager: bool = True


@dataclass
class RetrievalSettings:
    chunk_size_tokens: int = 512
    top_k: int = 5
    embedding_model: str = "openai/clip-vit-large-patch14"
    corpus_dir: str = "./data/corpus"
    visual_retrieval_boost: float = 1.0


@dataclass
class CacheSettings:
    enabled: bool = True
    gpu_blocks: int = 2048
    cpu_blocks: int = 8192
    ssd_capacity_gb: float = 50.0
    ssd_path: str = "/tmp/kv_ssd_cache"
    block_size: int = 16
    eviction_policy: str = "modality_aware_lru"
    text_gpu_pin_ratio: float = 0.7
    recompute_top_k: int = 32


@dataclass
class ServingSettings:
    host: str = "0.0.0.0"
    port: int = 8000
    max_concurrent: int = 16
    dry_run: bool = False
    offload_encoders_after_init: bool = False


@dataclass
class EvalSettings:
    num_samples: int = 500
    batch_sizes: list[int] = field(default_factory=lambda: [1, 2, 4, 8, 16, 32])
    warmup_queries: int = 10


@dataclass
class PruningSettings:
    enabled: bool = False
    backend: str = "mobilesam"
    foreground_threshold: float = 0.3


@dataclass
class Settings:
    """What operators are parametrised by; missing sections and keys have defaults, unknown ones are left out."""

    model: ModelSettings = field(default_factory=ModelSettings)
    rag: RetrievalSettings = field(default_factory=RetrievalSettings)
    cache: CacheSettings = field(default_factory=CacheSettings)
    serving: ServingSettings = field(default_factory=ServingSettings)
    eval: EvalSettings = field(default_factory=EvalSettings)
    pruning: PruningSettings = field(default_factory=PruningSettings)

    @classmethod
    def load(cls, path: str) -> Settings:
        """From a file in JSON or, where its library is there, in YAML; an error if there is no such file, or a model without a name."""
        with open(path, encoding="utf-8") as f:
            given = _parsed(f.read())
        parts = {}
        for part in fields(cls):
            kind = part.default_factory
            types = {x.name: x.type for x in fields(kind)}
            parts[part.name] = kind(**{k: _typed(f"{part.name}.{k}", types[k], v) for k, v in (given.get(part.name) or {}).items() if k in types})
        if not parts["model"].name:
            raise ValueError("model.name is missing")
        return cls(**parts)

    def variant(self, cache: bool, pruning: bool) -> Settings:
        """These settings with the cache and the pruning on or off."""
        return replace(self, cache=replace(self.cache, enabled=cache), pruning=replace(self.pruning, enabled=pruning))

    def as_json(self) -> str:
        return json.dumps(asdict(self))


def _parsed(text: str) -> dict:
    if yaml is None:
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


def _typed(name: str, kind: str, value):
    """A value of the kind that its key has; whole numbers do for others, and texts of numbers are read."""
    known = {"int": int, "float": float, "bool": bool}.get(kind)
    if known is None or isinstance(value, known):
        return value
    try:
        return known(value) if known is not bool and not isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
    except (KeyError, TypeError, ValueError):
        raise ValueError(f"{name} is no {kind}: {value!r}") from None
