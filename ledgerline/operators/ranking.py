"""Running sums and minima along an order, positions and exact percentiles, in groups of any size.

``row_number() OVER (PARTITION BY g ORDER BY v)`` sorts each group in a single task; when one
group holds a third of the data that task holds a third of the data. Here Spark's range
partitioning cuts the total order (group, order columns) into blocks of even size, whatever the
keys' types or distribution. A scan runs inside each (block, group), and each block adds what
its group's earlier blocks amount to: one row per (block, group), scanned again. The results
equal those of a single sort, and there is one path for all sizes.

The blocks are checkpointed once in the cluster's checkpoint folder: both the blocks' totals and
the rows read them from there, so a lost executor can't give them other borders.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

#: Blocks whose totals one task adds up when there is no group to divide them by.
BLOCKS_PER_PART = 1024


def _null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL (group keys may be NULL)."""
    lt, rt = left.alias("_lt"), right.alias("_rt")
    cond = None
    for k in keys:
        c = F.col(f"_lt.`{k}`").eqNullSafe(F.col(f"_rt.`{k}`"))
        cond = c if cond is None else cond & c
    extra = [F.col(f"_rt.`{c}`") for c in right.columns if c not in keys]
    return lt.join(rt, cond, how).select(*[F.col(f"_lt.`{c}`") for c in left.columns], *extra)


def with_blocks(df: DataFrame, group_cols, order_cols, out: str = "_block") -> DataFrame:
    """Adds the number of the row's block in the order (groups, order columns), NULLs first.

    Rows of the same key stand in one block: make the order columns unique, or aggregate such
    rows first. Select only the columns that are needed: the rows are written once."""
    return cut_lineage(df.repartitionByRange(*group_cols, *order_cols).withColumn(out, F.spark_partition_id()))


def _before(totals: DataFrame, groups: list[str], how: str) -> DataFrame:
    """``_before``: what ``_total`` amounts to over the earlier blocks of the group (NULL: none).

    Without groups the blocks are divided into parts of BLOCKS_PER_PART neighbours, whose own
    totals fit in one row."""
    agg = {"sum": F.sum, "min": F.min}[how]
    if groups:
        w = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumn("_before", agg("_total").over(w))
    parted = totals.withColumn("_part", F.floor(F.col("_block") / BLOCKS_PER_PART))
    parts = (parted.groupBy("_part").agg(agg("_total").alias("_total"))
             .agg(F.sort_array(F.collect_list(F.struct("_part", "_total"))).alias("_all")))
    earlier = lambda i: F.transform(F.slice("_all", F.lit(1), i), lambda p: p["_total"])
    whole = (lambda i: F.aggregate(earlier(i), F.lit(0).cast("bigint"), lambda a, x: a + x)) if how == "sum" else (lambda i: F.array_min(earlier(i)))
    above = (parts.select(F.explode(F.transform("_all", lambda p, i: F.struct(p["_part"].alias("_part"), whole(i).alias("_above")))).alias("p"))
             .select("p._part", "p._above"))
    w = Window.partitionBy("_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = agg("_total").over(w)
    both = F.coalesce(inside, F.lit(0)) + F.col("_above") if how == "sum" else F.least(inside, "_above")
    return parted.join(above, "_part").withColumn("_before", both).drop("_part", "_above")


def running_sum(df: DataFrame, group_cols, order_cols, value: Column, out: str, total: str | None = None) -> DataFrame:
    """Sum of ``value`` (whole numbers) over the group's earlier rows; ``total``: over all of them."""
    groups = list(group_cols)
    b = with_blocks(df.withColumn("_v", value.cast("bigint")), groups, order_cols)
    totals = b.groupBy(*groups, "_block").agg(F.sum("_v").alias("_total"))
    offsets = _before(totals, groups, "sum")
    if total:
        offsets = (offsets.withColumn(total, F.sum("_total").over(Window.partitionBy(*groups))) if groups
                   else offsets.withColumn(total, totals.agg(F.sum("_total")).scalar()))
    inner = Window.partitionBy("_block", *groups).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return (_null_safe_join(b, offsets.drop("_total"), [*groups, "_block"])
            .withColumn(out, F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum("_v").over(inner), F.lit(0)))
            .drop("_block", "_before", "_v"))


def running_min(df: DataFrame, group_cols, order_cols, value: str, out: str) -> DataFrame:
    """Least ``value`` of the group's rows up to and with this one (NULLs don't count)."""
    groups = list(group_cols)
    b = with_blocks(df, groups, order_cols)
    totals = b.groupBy(*groups, "_block").agg(F.min(value).alias("_total"))
    inner = Window.partitionBy("_block", *groups).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (_null_safe_join(b, _before(totals, groups, "min").drop("_total"), [*groups, "_block"])
            .withColumn(out, F.least("_before", F.min(value).over(inner))).drop("_block", "_before"))


def positions_within(df: DataFrame, group_cols, order_cols, out: str = "pos") -> DataFrame:
    """0-based position of each row inside its group in ``order_cols`` order (make the
    order columns unique for a deterministic result). No groups = one global order."""
    return running_sum(df, group_cols, order_cols, F.lit(1), out)


def _rank_for(p: float, count_col: str) -> Column:
    """1-based rank of the discrete percentile: ``max(1, ceil(p * n))`` in integer arithmetic."""
    frac = Fraction(str(p))
    num, den = frac.numerator, frac.denominator
    return F.expr(f"greatest(CAST(1 AS BIGINT), ({count_col} * {num} + {den - 1}) div {den})")


def percentile_disc(df: DataFrame, group_cols, value: str, percentiles: dict[str, float]) -> DataFrame:
    """Exact ``percentile_disc`` per group, for values of any type with an order: for each
    name -> p, the value at rank ceil(p * n).

    Rows are first counted per (group, value), so a repeated value is one row; running sums of
    those counts then give the ranks that a value covers, and all percentiles of a group are
    picked from one pass over them. Groups without a non-NULL value have no row."""
    groups = list(group_cols)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, groups, [value], F.col("_n"), "_first", total="_all")
    wanted = {name: _rank_for(p, "_all") for name, p in percentiles.items()}
    covers = {name: (F.col("_first") < r) & (r <= F.col("_first") + F.col("_n")) for name, r in wanted.items()}
    any_of = F.lit(False)
    for c in covers.values():
        any_of = any_of | c
    return (ranked.where(any_of).groupBy(*groups)
            .agg(*[F.max(F.when(c, F.col(value))).alias(name) for name, c in covers.items()]))
