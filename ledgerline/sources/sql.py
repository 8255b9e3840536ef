"""SQL entry points over registered tables and views (S8, S9)."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import audit

GUARD_MAX_ROWS = 20


def parameterised_query(spark: SparkSession, sql: str, params=None, fetch: str = "all") -> DataFrame | None:
    """S8: SQL with ``?`` (list) or ``:name`` (dict) markers; values are bound, never pasted.

    ``fetch``: ``all`` -> every row, ``one`` -> at most one row, ``none`` -> the statement
    runs and nothing is returned.
    """
    df = spark.sql(sql, args=params) if params is not None else spark.sql(sql)
    if fetch == "one":
        return df.limit(1)
    if fetch == "none":
        df.count()
        return None
    return df


AUDIT_SCHEMA = "logged_at timestamp_ntz, sql string, max_rows int"
AUDIT_CHARS = 300


def guarded_sql(spark: SparkSession, sql: str, max_rows: int = GUARD_MAX_ROWS, audit_root: str | None = None) -> DataFrame:
    """S9: run model-written SQL read-only with a row cap.

    The text must start with SELECT or WITH; it is then wrapped as
    ``SELECT * FROM (<sql>) LIMIT n`` so only a query can parse there (a ``WITH ...
    INSERT`` or a second statement fails to parse) and the cap always applies. With
    ``audit_root`` one audit row is appended to the log there before the query is returned; a
    refused text leaves none.
    """
    norm = sql.strip().upper()
    if not (norm.startswith("SELECT") or norm.startswith("WITH")):
        raise ValueError(f"Only SELECT queries are allowed: {sql[:100]}")
    body = re.sub(r";+\s*\Z", "", sql.strip())
    out = spark.sql(f"SELECT * FROM (\n{body}\n) LIMIT {int(max_rows)}")
    if audit_root:
        audit.append(audit_row(spark, sql, max_rows), audit_root)
    return out


def audit_row(spark: SparkSession, sql: str, max_rows: int = GUARD_MAX_ROWS) -> DataFrame:
    """One audit record per guarded query: time, text (300 chars) and cap."""
    return spark.createDataFrame([(datetime.now(timezone.utc).replace(tzinfo=None), sql[:AUDIT_CHARS], max_rows)], AUDIT_SCHEMA)


def audit_calls(classified: DataFrame, audit_root: str, max_rows: int = GUARD_MAX_ROWS) -> str:
    """One audit record for every accepted call of a batch, appended in one commit."""
    rows = classified.where(F.col("status").startswith("accepted")).select(
        F.current_timestamp().cast("timestamp_ntz").alias("logged_at"), F.substring("effective_sql", 1, AUDIT_CHARS).alias("sql"),
        F.lit(max_rows).alias("max_rows"))
    return audit.append(rows, audit_root)
