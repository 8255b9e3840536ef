"""Constraint checks and set-based updates (D1, D2, D4, D5, J9). The constraints of the knowledge
tables are rows of ``RULES``.

Checks return the offending rows (an empty result means the constraint holds);
updates return the new table state, which the caller writes out.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.enums import (
    CRITERION_WEIGHTS, CRITICALITIES, INVESTOR_PROFILES, LEAN_CATEGORIES, OUTCOMES, STAGES,
)


class Rule(NamedTuple):
    """One constraint of a column. ``kind``: ``not_null``; ``domain`` (allowed values);
    ``max_length`` (characters); ``precision`` (the absolute value stays below it);
    ``reference`` (``table.column`` that holds the value); ``unique`` (the columns that are a
    key together). NULL breaks ``not_null`` alone."""

    table: str
    column: str
    kind: str
    argument: object = None


def _required(table: str, *columns: str) -> list[Rule]:
    return [Rule(table, c, "not_null") for c in columns]


def _lengths(table: str, **columns: int) -> list[Rule]:
    return [Rule(table, c, "max_length", n) for c, n in columns.items()]


# Constraints of the six knowledge tables.
RULES: list[Rule] = [
    *_required("startups", "name", "sector", "stage", "description", "outcome"),
    Rule("startups", "stage", "domain", STAGES), Rule("startups", "outcome", "domain", OUTCOMES),
    *_lengths("startups", name=255, sector=100, subsector=100, region=100, country=100, business_model=100, source=255),
    Rule("startups", "mrr", "precision", 10 ** 10), Rule("startups", "growth_rate_monthly", "precision", 10 ** 3),
    *_required("pivot_cases", "pivot_type", "trigger_signal", "before_model", "after_model", "outcome"),
    Rule("pivot_cases", "outcome", "domain", OUTCOMES), *_lengths("pivot_cases", pivot_type=100, trigger_metric=100),
    Rule("pivot_cases", "startup_id", "reference", "startups.id"),
    *_required("risk_patterns", "pattern_name", "criticality", "description", "simple_explain", "warning_signals", "mitigation"),
    Rule("risk_patterns", "stage", "domain", STAGES), Rule("risk_patterns", "criticality", "domain", CRITICALITIES),
    *_lengths("risk_patterns", pattern_name=255, sector=100, category=100, impact_on_runway=50, time_to_impact=100),
    *_required("sector_benchmarks", "sector", "stage", "metric_name", "unit", "context"),
    Rule("sector_benchmarks", "stage", "domain", STAGES), *_lengths("sector_benchmarks", sector=100, metric_name=100, unit=50, source=255),
    Rule("sector_benchmarks", "metric_name", "unique", ("sector", "stage", "metric_name")),
    *_required("lean_concepts", "concept_name", "category", "technical_def", "simple_def", "example"),
    Rule("lean_concepts", "category", "domain", LEAN_CATEGORIES),
    *_lengths("lean_concepts", concept_name=255, source_whitepaper=255, source_page=50),
    Rule("lean_concepts", "concept_name", "unique", ("concept_name",)),
    *_required("investment_criteria", "investor_profile", "stage", "criterion_name", "weight", "description", "red_flags", "green_flags"),
    Rule("investment_criteria", "investor_profile", "domain", INVESTOR_PROFILES), Rule("investment_criteria", "stage", "domain", STAGES),
    Rule("investment_criteria", "weight", "domain", CRITERION_WEIGHTS),
    *_lengths("investment_criteria", criterion_name=255, criterion_category=100),
]

VIOLATION = ("table_name", "key", "column", "rule", "value")


def _broken(rule: Rule) -> Column:
    c = F.col(rule.column)
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "domain":
        return c.isNotNull() & ~c.isin(*rule.argument)
    if rule.kind == "max_length":
        return F.length(c) > rule.argument
    if rule.kind == "precision":
        return F.abs(c) >= rule.argument
    raise ValueError(f"not a rule of one row: {rule}")


def rule_violations(tables: dict[str, DataFrame], rules: list[Rule] = RULES, key: str = "id") -> DataFrame:
    """Every broken rule of every row: ``(table_name, key, column, rule, value)``.

    All rules of single rows are checked in one pass over their table; a reference is an
    anti-join with the parent's keys; a unique key is counted and only the rows of its repeated
    values are joined back, so each of them is listed. Rules on columns that a table doesn't have
    are left out; ``rule_summary`` says so.
    """
    found = []
    for name, df in tables.items():
        own = [r for r in rules if r.table == name and r.column in df.columns]
        entries = [F.when(_broken(r), F.struct(F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule"),
                                               F.col(r.column).cast("string").alias("value")))
                   for r in own if r.kind in ("not_null", "domain", "max_length", "precision")]
        ident = F.col(key).cast("string").alias("key")
        if entries:
            found.append(df.select(ident, F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("v"))
                         .select(F.lit(name).alias("table_name"), "key", "v.column", "v.rule", "v.value"))
        for r in own:
            said = [F.lit(r.table).alias("table_name"), ident, F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule")]
            if r.kind == "reference":
                parent, column = r.argument.split(".")
                if parent in tables:
                    lost = orphan_rows(df.select(key, r.column), tables[parent], r.column, column)
                    found.append(lost.select(*said, F.col(r.column).cast("string").alias("value")))
            elif r.kind == "unique":
                twice = unique_violations(df, list(r.argument)).drop("n_rows")
                text = F.concat_ws("|", *[F.col(c).cast("string") for c in r.argument])
                found.append(df.select(key, *r.argument).join(twice, list(r.argument), "left_semi").select(*said, text.alias("value")))
    return reduce(DataFrame.unionByName, found)


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """The rules as rows ``(table_name, column, rule, argument)``."""
    said = lambda a: None if a is None else ",".join(map(str, a)) if isinstance(a, tuple) else str(a)
    return spark.createDataFrame([(r.table, r.column, r.kind, said(r.argument)) for r in rules],
                                 "table_name string, column string, rule string, argument string")


def rule_summary(tables: dict[str, DataFrame], rules: list[Rule] = RULES, key: str = "id") -> DataFrame:
    """Each rule with the rows that break it (0: holds) and whether its column is there."""
    spark = next(iter(tables.values())).sparkSession
    there = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], "table_name string, column string")
    counts = rule_violations(tables, rules, key).groupBy("table_name", "column", "rule").agg(F.count(F.lit(1)).alias("n_rows"))
    keys = ["table_name", "column", "rule"]
    return (rule_table(spark, rules).join(there.withColumn("checked", F.lit(True)), ["table_name", "column"], "left")
            .join(counts, keys, "left")
            .select(*keys, "argument", F.coalesce("checked", F.lit(False)).alias("checked"),
                    F.when(F.col("checked"), F.coalesce("n_rows", F.lit(0).cast("bigint"))).alias("n_rows")))


def domain_violations(df: DataFrame, key: str, not_null=(), domains=None, max_length=None,
                      max_abs=None) -> DataFrame:
    """One row per broken rule: ``(key, column, rule, value)``.

    ``not_null``: required columns; ``domains``: column -> allowed values (NULL passes,
    NOT NULL is its own rule); ``max_length``: column -> character cap;
    ``max_abs``: column -> exclusive bound on the absolute value (numeric precision).
    """
    domains, max_length, max_abs = domains or {}, max_length or {}, max_abs or {}
    cols = set(df.columns)

    def entry(col, rule, bad: Column) -> Column:
        return F.when(bad, F.struct(F.lit(col).alias("column"), F.lit(rule).alias("rule"),
                                    F.col(col).cast("string").alias("value")))

    items = [entry(c, "not_null", F.col(c).isNull()) for c in not_null if c in cols]
    items += [entry(c, "domain", F.col(c).isNotNull() & ~F.col(c).isin(*dom)) for c, dom in domains.items() if c in cols]
    items += [entry(c, "max_length", F.length(c) > n) for c, n in max_length.items() if c in cols]
    items += [entry(c, "precision", F.abs(c) >= b) for c, b in max_abs.items() if c in cols]
    if not items:
        return df.select(key).limit(0).select(key, F.lit(None).cast("string").alias("column"),
                                              F.lit(None).cast("string").alias("rule"),
                                              F.lit(None).cast("string").alias("value"))
    kept = F.filter(F.array(*items), lambda x: x.isNotNull())
    return df.select(key, F.explode(kept).alias("v")).select(key, "v.column", "v.rule", "v.value")


def unique_violations(df: DataFrame, keys) -> DataFrame:
    """Key values held by more than one row, with their count (partial aggregation)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphan_rows(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children whose non-NULL foreign key has no parent (``left_anti``)."""
    keys = parents.select(F.col(pk).alias(fk)).distinct()
    return children.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def cascade_delete(children: DataFrame, deleted_parent_keys: DataFrame, fk: str) -> DataFrame:
    """Children left after their parents are deleted (rows with a NULL key stay).

    An anti-join on the distinct keys: adaptive execution broadcasts a small set of keys and
    splits a skewed child key otherwise.
    """
    gone = deleted_parent_keys.select(F.col(deleted_parent_keys.columns[0]).alias(fk)).distinct()
    return children.join(gone, fk, "left_anti")


def upsert_touch(old: DataFrame, new: DataFrame, key: str, now, touched: str = "updated_at",
                 created: str | None = None) -> DataFrame:
    """Apply a batch of new row versions; a changed row gets ``touched = now``.

    Rows only in ``old`` stay as they are; rows only in ``new`` are inserted with
    ``touched = now`` (and ``created = now`` when given); a row present in both takes
    the new values and is touched only when a value differs (NULL-safe compare).
    """
    value_cols = [c for c in new.columns if c not in (key, touched) and c != created]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in value_cols + [touched]]
                   + ([F.col(created).alias(f"_o_{created}")] if created else []) + [F.lit(True).alias("_in_old")])
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in value_cols], F.lit(True).alias("_in_new"))
    j = o.join(n, key, "full_outer")
    in_new = F.coalesce(F.col("_in_new"), F.lit(False))
    in_old = F.coalesce(F.col("_in_old"), F.lit(False))
    changed = reduce(lambda a, b: a | b,
                     [~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")) for c in value_cols], F.lit(False))
    now_col = now if isinstance(now, Column) else F.lit(now)
    out = [F.col(key)] + [F.when(in_new, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in value_cols]
    out.append(F.when(in_new & (~in_old | changed), now_col).otherwise(F.col(f"_o_{touched}")).alias(touched))
    if created:
        out.append(F.when(~in_old, now_col).otherwise(F.col(f"_o_{created}")).alias(created))
    out.append((in_new & in_old & changed).alias("changed"))
    return j.select(*out)
