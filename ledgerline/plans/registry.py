"""Named queries: one Spark builder ``(spark, sf_dir) -> DataFrame`` per operator of the
survey inventory, with an optional independent SQL oracle (DuckDB dialect).

The oracle is written separately from the Spark code (plain SQL over the same
adapters), so the two only agree when the operator is right.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    key: str
    inventory_id: str
    build: Builder
    oracle: str | None


_REGISTRY: dict[str, QuerySpec] = {}


def query(key: str, inventory_id: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in _REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        _REGISTRY[key] = QuerySpec(key, inventory_id, fn, oracle)
        return fn
    return deco


def all_specs() -> dict[str, QuerySpec]:
    # Import side effect: the modules register their queries.
    from ledgerline.plans import knowledge, quality, outputs, runs, generation, constraints  # noqa: F401
    return dict(_REGISTRY)
