"""Plan-shape checks: no nested loops or Cartesian products, no forced broadcasts,
partial top-k before the shuffle, pruned scans."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(spark, key):
    return E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["segment_risk_join", "startup_risk_exposure", "top_risks_per_startup",
                                 "concept_mentions", "diagnosis_context", "dataset_gate", "category_quotas",
                                 "value_distributions", "promotion_decision"])
def test_no_nested_loop_or_cartesian(spark, key):
    plan = _plan(spark, key)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = _plan(spark, "top_risks_per_startup")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(spark, "segment_risk_join")
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in plan
    assert "c_acctbal" not in plan


def test_no_broadcast_is_forced_outside_of_bounded_sides():
    """Hints are given where a bound is known (one row per kind); joins are left to Spark elsewhere."""
    import pathlib
    hinted = [str(p) for p in pathlib.Path("ledgerline/operators").glob("*.py") if "F.broadcast(" in p.read_text()]
    assert [p for p in hinted if not p.endswith("quality.py")] == []
