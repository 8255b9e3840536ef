"""One-row aggregates next to every row of a table, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate (exactly one row) to every row of ``df``.

    The row is a scalar subquery: Spark runs it once and inlines the value into the
    projection, so there is no join (and nothing is shuffled) on ``df``'s side.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_v")).scalar()
    out = df
    for c in one_row.columns:
        out = out.withColumn(c, packed[c])
    return out
