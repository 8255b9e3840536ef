"""Every registered query against its independent DuckDB SQL on the sf0.001 tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from ledgerline.plans.registry import all_specs
from ledgerline.sources.adapters import RAW_TABLES
from tests.conftest import SF_SMALL
from tests.helpers import canon, rows_of

# The reference's own operators; the training-data queries have their tests in tests/llm.
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in all_specs()}
QUERIES = {k: v for k, v in E.queries().items() if k in all_specs()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_inventory_id():
    assert all(spec.inventory_id for spec in all_specs().values())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    cur = duck.execute(ORACLES[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows_of(df)) == canon(ocols, orows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["metric_name", "level", "n_observations"]
    assert sum(r.n_observations for r in rows) == 1500
