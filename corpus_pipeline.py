"""The corpus pipeline: language ID, near-dedup, decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a stage's result
as Parquet under the shared checkpoint folder and rereads it as the next stage's documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontam, langid, neardup, pii
from ledgerline.llm.common import ensure_checkpoint_dir, fresh, table

#: A document is rejected if no language holds this share of its words (or it has no letters).
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language with LEAST_SCORE of it."""
    model = langid.fit(docs, ~langid.held_out())
    row, out = fresh("row", docs.columns), fresh("gone", docs.columns)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    gone = (langid.predict(keyed.select(row, "text"), model, key=row)
            .where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE))
            .select(F.col(row).alias(out)).distinct())
    return keyed.join(gone, F.col(row) == F.col(out), "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest id."""
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are generalised in the texts."""
    return pii.sanitise(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids (4 bytes each) of every text."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(coded, "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: No stage has a SQL form; the tests check that the stages chain, keep their columns and take effect.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
