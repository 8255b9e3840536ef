"""The queries and the pipeline on the smallest tables."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import queries
from tests.conftest import SF_SMALL
from tests.helpers import canon, rows_of

TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations")


def test_queries_with_sql_match_it(spark):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF_SMALL)
        want = db.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(cols)
        assert canon(got.columns, rows_of(got)) == canon(cols, want.fetchall()), name


def test_stages_chain_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    last = corpus_pipeline.run(spark, SF_SMALL)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "encoding"]
    assert 0 < last.count() < docs.count() and last.where("n_tokens is null").count() == 0
    step = corpus_pipeline.language_id(spark, docs.limit(0), SF_SMALL)
    assert step.columns == docs.columns and step.count() == 0
    odd = docs.limit(5).unionByName(spark.createDataFrame([(10 ** 9, None, None, None, None), (10 ** 9 + 1, "12", "en", "s", 2)], docs.schema))
    assert corpus_pipeline.language_id(spark, odd, SF_SMALL).where(F.col("doc_id") >= 10 ** 9).count() == 0
