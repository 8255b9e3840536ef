"""S5: load the reference tables all-or-nothing.

Every load writes all tables under a fresh version folder; only after every write
succeeded is a commit file added to ``_commits/``. Readers take the newest commit,
so they see either the previous complete set or the new one, never a mix. Commit
files are only ever created, never rewritten, which keeps the switch atomic on
object stores as well as on HDFS.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Load order of the reference tables.
LOAD_ORDER = ("lean_concepts", "risk_patterns", "sector_benchmarks", "investment_criteria")


def load_reference_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write ``tables`` (in ``LOAD_ORDER``, others after) and commit them together; returns the version."""
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    names = [n for n in LOAD_ORDER if n in tables] + sorted(n for n in tables if n not in LOAD_ORDER)
    for name in names:
        tables[name].write.mode("errorifexists").parquet(f"{root}/v={version}/{name}")
    commit = spark.createDataFrame([(version, ",".join(names))], "version string, tables string")
    commit.coalesce(1).write.mode("errorifexists").json(f"{root}/_commits/{version}")
    return version


def current_version(spark: SparkSession, root: str) -> str:
    commits = spark.read.schema("version string, tables string").json(f"{root}/_commits/*")
    return commits.agg(F.max("version")).first()[0]


def read_reference_table(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    v = version or current_version(spark, root)
    return spark.read.parquet(f"{root}/v={v}/{name}")
