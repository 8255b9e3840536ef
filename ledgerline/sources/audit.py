"""An append-only table with commit marks: the audit log of guarded queries (S9).

Each append writes its rows into a folder of its own and then adds a mark that names the folder.
Readers take the folders that have a mark, so a job that fails half way, or is retried, leaves
nothing that is read, and two writers never touch each other's files. Marks carry the time of the
commit: a version reads the log as it was then.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "version string, n_rows bigint"


def append(rows: DataFrame, root: str) -> str:
    """Add ``rows`` to the log at ``root``; returns the version that first holds them."""
    spark = rows.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/rows/v={version}"
    rows.write.mode("errorifexists").parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()
    (spark.createDataFrame([(version, n)], MARK).coalesce(1)
     .write.mode("errorifexists").json(f"{root}/_marks/{version}"))
    return version


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The commits ``(version, n_rows)``."""
    return spark.read.schema(MARK).json(f"{root}/_marks/*")


def read(spark: SparkSession, root: str, schema: str, version: str | None = None) -> DataFrame:
    """All committed rows with the ``version`` that brought them, up to ``version`` if given."""
    marks = versions(spark, root)
    if version:
        marks = marks.where(F.col("version") <= version)
    rows = spark.read.schema(f"{schema}, v string").option("basePath", f"{root}/rows").parquet(f"{root}/rows/*")
    return rows.withColumnRenamed("v", "version").join(marks.select("version"), "version")
