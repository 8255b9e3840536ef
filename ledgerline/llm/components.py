"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder, and read from there with its
    schema. For loops: a checkpoint keeps its plan's size estimate, which every join multiplies, so
    that after some rounds planning drowns in the digits of that number."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; label: the smallest node of its component.

    Each round takes the least label among neighbours, then the label of the label, so the
    number of rounds follows the logarithm of the longest path. Labels of a hub are reduced
    before they are shuffled; joins on a hub are left to the adaptive skew handling."""
    both = written(links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
                       .unionByName(links.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct())
    labels = written(both.groupBy("src").agg(F.min("dst").alias("m"))
                         .select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        told = (both.join(labels, both["src"] == labels["node"]).groupBy(F.col("dst").alias("node"))
                .agg(F.min("label").alias("heard")))
        near = labels.join(told, "node").select("node", F.least("label", "heard").alias("new"), "label")
        up = near.select(F.col("node").alias("_n"), F.col("new").alias("_up"))
        jumped = (near.join(up, F.col("new") == F.col("_n"), "left")
                  .select("node", F.coalesce("_up", "new").alias("new"), "label"))
        done = written(jumped)
        moved = done.where("new <> label").limit(1).count()
        labels = done.select("node", F.col("new").alias("label"))
        if not moved:
            return labels
