"""Constraint checks and set-based updates on hand-made rows."""

from __future__ import annotations

from ledgerline.functions.enums import OUTCOMES, STAGES
from ledgerline.operators import constraints as C


def test_domain_violations(spark):
    df = spark.createDataFrame([(1, "a", "seed", "success", 10.0), (2, None, "mature", "won", 1e11),
                                (3, "x" * 300, None, None, None)],
                               "id long, name string, stage string, outcome string, mrr double")
    got = sorted((r.id, r.column, r.rule) for r in C.domain_violations(
        df, "id", not_null=("name", "stage", "outcome"), domains={"stage": STAGES, "outcome": OUTCOMES},
        max_length={"name": 255}, max_abs={"mrr": 1e10}).collect())
    assert got == [(2, "mrr", "precision"), (2, "name", "not_null"), (2, "outcome", "domain"),
                   (3, "name", "max_length"), (3, "outcome", "not_null"), (3, "stage", "not_null")]


def test_unique_orphans_and_cascade(spark):
    bench = spark.createDataFrame([("s", "seed", "m"), ("s", "seed", "m"), ("s", "idea", "m")],
                                  "sector string, stage string, metric_name string")
    assert [tuple(r) for r in C.unique_violations(bench, ["sector", "stage", "metric_name"]).collect()] == [
        ("s", "seed", "m", 2)]
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, 4), (13, None)], "cid long, startup_id long")
    assert [r.cid for r in C.orphan_rows(children, parents, "startup_id", "id").collect()] == [12]
    deleted = spark.createDataFrame([(2,)], "id long")
    kept = sorted(r.cid for r in C.cascade_delete(children, deleted, "startup_id").collect())
    assert kept == [10, 12, 13]          # NULL parent keys stay


def test_upsert_touch(spark):
    old = spark.createDataFrame([(1, "a", 1.0, "t0"), (2, "b", None, "t0"), (3, "c", 3.0, "t0")],
                                "id long, name string, mrr double, updated_at string")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (4, "d", 4.0)], "id long, name string, mrr double")
    got = {r.id: (r.name, r.mrr, r.updated_at, r.changed) for r in C.upsert_touch(old, new, "id", "t1").collect()}
    assert got == {1: ("a", 1.0, "t0", False),       # same values: not touched
                   2: ("b", 2.0, "t1", True),        # NULL -> 2.0 counts as a change
                   3: ("c", 3.0, "t0", False),       # only in old: kept
                   4: ("d", 4.0, "t1", False)}       # inserted


def test_rule_table(spark):
    startups = spark.createDataFrame([(1, "a", "seed"), (2, None, "exit"), (3, "x" * 300, None)], "id long, name string, stage string")
    pivots = spark.createDataFrame([(10, 1, "zoom-in"), (11, 9, None), (12, None, "zoom-in")], "id long, startup_id long, pivot_type string")
    concepts = spark.createDataFrame([(1, "MVP"), (2, "MVP"), (3, None), (4, None)], "id long, concept_name string")
    tables = {"startups": startups, "pivot_cases": pivots, "lean_concepts": concepts}
    got = sorted((r.table_name, r.key, r.column, r.rule) for r in C.rule_violations(tables).collect())
    assert got == sorted([
        ("startups", "2", "name", "not_null"), ("startups", "2", "stage", "domain"), ("startups", "3", "name", "max_length"),
        ("startups", "3", "stage", "not_null"), ("pivot_cases", "11", "pivot_type", "not_null"), ("pivot_cases", "11", "startup_id", "reference"),
        ("lean_concepts", "1", "concept_name", "unique"), ("lean_concepts", "2", "concept_name", "unique"),
        ("lean_concepts", "3", "concept_name", "not_null"), ("lean_concepts", "4", "concept_name", "not_null")])
    summary = {(r.table_name, r.column, r.rule): (r.checked, r.n_rows) for r in C.rule_summary(tables).collect()}
    assert len(summary) == len(C.RULES)
    assert summary["startups", "name", "max_length"] == (True, 1) and summary["startups", "stage", "domain"] == (True, 1)
    assert summary["startups", "sector", "not_null"] == (False, None) and summary["pivot_cases", "pivot_type", "max_length"] == (True, 0)
