"""JSON-lines sources and sinks for chat examples and training text (S1-S4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import ensure_checkpoint_dir

# metadata stays raw JSON text so "key missing" and "key is null" remain different.
EXAMPLE_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("metadata", T.StringType()),
    T.StructField("_bad", T.StringType()),
])
TEXT_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("_bad", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerline-out/{name}-{uuid.uuid4().hex[:12]}"


def read_examples(spark: SparkSession, path: str, strict: bool = False, partition_cols=()) -> DataFrame:
    """S1: examples as ``(example_id, messages, metadata_json)``; bad lines dropped.

    Blank lines are skipped by the reader. In the lenient mode malformed lines land
    in ``_bad`` and are filtered out (count them with ``bad_lines``); ``strict`` fails
    on the first malformed line. A missing path raises ``AnalysisException``.
    The id is the text of the example's ``metadata.example_id``; an example without one
    gets the SHA-1 of its content, so it keeps an id of its own on every read. Columns of
    the folder names (``split=...``) come along when named in ``partition_cols``.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    raw = (spark.read.schema(EXAMPLE_SCHEMA).option("mode", mode)
           .option("columnNameOfCorruptRecord", "_bad").json(path))
    good = raw.where(F.col("_bad").isNull()).drop("_bad")
    content = F.sha1(F.to_json(F.struct("messages", "metadata")))
    return good.select(F.coalesce(F.get_json_object("metadata", "$.example_id"), content).alias("example_id"),
                       "messages", F.col("metadata").alias("metadata_json"), *partition_cols)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines that are not valid JSON (what the lenient reader drops)."""
    lines = spark.read.text(path)
    return lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select(
        F.col("value").alias("line"))


def examples_to_long(examples: DataFrame) -> DataFrame:
    """Nested examples -> long message table ``(example_id, turn, role, content)``."""
    return examples.select("example_id", F.posexplode("messages").alias("turn", "m")).select(
        "example_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


def read_training_text(spark: SparkSession, path: str) -> DataFrame:
    """S2: training text files (``{text, metadata}``)."""
    raw = (spark.read.schema(TEXT_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad").json(path))
    return raw.where(F.col("_bad").isNull()).drop("_bad")


def write_examples(examples: DataFrame, path: str, split_col: str | None = "split") -> None:
    """S3: one JSON object per line, ``{messages, metadata}``, nulls written, one folder per split."""
    meta_cols = [c for c in examples.columns if c not in ("messages", split_col)]
    out = examples.select("messages", F.struct(*meta_cols).alias("metadata"),
                          *([split_col] if split_col else []))
    w = out.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(split_col) if split_col else w).json(path)


def write_training_text(texts: DataFrame, path: str, split_col: str | None = "split") -> None:
    """S4: ``{text, metadata}`` per line, one folder per split."""
    meta_cols = [c for c in texts.columns if c not in ("text", split_col)]
    out = texts.select("text", F.struct(*meta_cols).alias("metadata"), *([split_col] if split_col else []))
    w = out.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(split_col) if split_col else w).json(path)
