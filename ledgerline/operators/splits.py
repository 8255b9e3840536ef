"""Reproducible shuffles and stratified train/val/test splits.

Order comes from ``sha1("<seed>:<id>")``, never from ``rand()``, so the result does
not depend on partitioning or retries. Positions in a global order come from block scans
(``ranking.running_sum``): blocks of about sqrt(n) rows, so neither a stratum that holds a
third of the data nor the whole order is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ranking import positions_within

SEED = 42


def seeded_hash(id_col: str, seed: int = SEED) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def global_positions(df: DataFrame, order_hash: str, id_col: str, group_cols=(), out: str = "pos") -> DataFrame:
    """0-based position of each row in the order (group_cols, order_hash, id_col)."""
    return positions_within(df, [], [*group_cols, order_hash, id_col], out=out)


def positions_by_order(df: DataFrame, order_cols, out: str = "pos") -> DataFrame:
    """0-based position of each row in the total order ``order_cols`` (must be unique)."""
    return positions_within(df, [], order_cols, out=out)


def stratum_key(facts: DataFrame) -> Column:
    """category|Label|Difficulty|tool-flag, missing (or null) fields as ``unknown``."""
    def field(f):
        return F.coalesce(F.when(F.col(f"p_{f}"), F.col(f"m_{f}")), F.lit("unknown"))
    return F.concat_ws("|", field("category"), field("Label"), field("Difficulty"),
                       F.when(F.col("tool_flag"), "tool").otherwise("no_tool"))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """Adds ``shuffle_pos``: the row's place in a reproducible random order."""
    h = df.withColumn("_h", seeded_hash(id_col, seed))
    return global_positions(h, "_h", id_col, out="shuffle_pos").drop("_h")


def stratified_split(facts: DataFrame, id_col: str = "example_id", seed: int = SEED,
                     train_slots: int = 8, val_slots: int = 1, test_slots: int = 1) -> DataFrame:
    """Systematic stratified split: slot = (global position in (stratum, hash) order) mod n.

    Exact totals (80/10/10 of 100 gives 80/10/10), strata of any size, no row lost
    or duplicated, same result on every run and partitioning.
    """
    n = train_slots + val_slots + test_slots
    s = facts.withColumn("stratum", stratum_key(facts)).withColumn("_h", seeded_hash(id_col, seed))
    pos = global_positions(s, "_h", id_col, ["stratum"], out="_pos")
    slot = F.col("_pos") % n
    return (pos.withColumn("split", F.when(slot < train_slots, "train")
                           .when(slot < train_slots + val_slots, "val").otherwise("test"))
            .drop("_h", "_pos"))


def split_leakage(split_df: DataFrame, fingerprint: Column) -> DataFrame:
    """Fingerprints found in more than one split (must be empty)."""
    return (split_df.withColumn("fingerprint", fingerprint).groupBy("fingerprint")
            .agg(F.array_sort(F.collect_set("split")).alias("splits"))
            .where(F.size("splits") > 1))


# Training-size rules.
TRAIN_FLOOR = 5000 * 0.75
EFFECTIVE_BATCH = 16
EPOCHS = 3


def split_sizes(split_df: DataFrame, batch: int = EFFECTIVE_BATCH, epochs: int = EPOCHS) -> DataFrame:
    """Rows per split, the train-size floor check and the estimated optimizer steps."""
    sizes = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return (sizes.withColumn("est_steps", (F.ceil(F.col("n_rows") / F.lit(batch)) * epochs).cast("bigint"))
            .withColumn("meets_floor", F.when(F.col("split") == "train", F.col("n_rows") >= TRAIN_FLOOR)))
