"""Prefix trie of conversations, its subtree totals by time-forward processing.

A conversation is a sequence of turns (role, text); each distinct sequence of its first d turns
is a node of depth d, from the textless root (d = 0). A node is known by two 64-bit hashes of
its turns with their places, taken with exclusive or along each conversation, so hot prefixes
meet in partial aggregations and no text is shuffled for them.

Subtree totals go from the leaves up. Within a shard, nodes arrive in reverse level order
(deepest first, then by hash; sorted outside of memory by Spark) and every node sends its totals
forward to its parent through a priority queue that spills sorted runs to disk. Shards are
whole subtrees: with T = ceil(sqrt(rows) / 4), a node of at least T members is *heavy*, and the
topmost light nodes are shard roots, dealt out by hash. A light subtree holds turns of under T
conversations. Totals of shard roots are summed by their heavy parent; the heavy nodes, at most
rows / T <= 4 * sqrt(rows) of them, then form the last shard.

Edge cases: a null conv_id takes no part (it names no conversation); null role or text is empty
text; equal turns of one conversation are ordered by role, then text; an empty table -> no
rows; other columns are ignored. The turns of one conversation are ordered within one task (an
external sort), as is a subtree of one conversation; both stream through it.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import keep, on_workers

#: Messages that a queue keeps in memory before it spills.
IN_MEMORY = 200_000
#: A chunk of a node's list of members spans 2 ** CHUNK_BITS neighbouring conv_ids.
CHUNK_BITS = 12
NODE = ["depth", "k1", "k2"]
PARENT = ["depth", "p1", "p2"]
OUT = "depth int, k1 bigint, k2 bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


class SpillingQueue:
    """A priority queue of tuples: the least first. Runs beyond ``limit`` tuples go to disk,
    sorted, and are merged with what is in memory. A tuple pushed must not be less than the last
    one popped (time-forward processing never does that)."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                pickle.dump(x, run)
            run.seek(0)
            self.heap = []
            self._next(run)
            if len(self.runs) > 64:
                self._merge()

    def _next(self, run) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def _merge(self) -> None:
        """All runs as one."""
        whole = tempfile.TemporaryFile()
        while self.runs:
            item, _, run = heapq.heappop(self.runs)
            pickle.dump(item, whole)
            self._next(run)
        whole.seek(0)
        self._next(whole)

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._next(run)
            return item
        return heapq.heappop(self.heap)


def pass_forward(nodes: Iterable[tuple], limit: int = IN_MEMORY) -> Iterator[tuple]:
    """Totals of nodes in reverse level order.

    A node: (depth, k1, k2, p1, p2, passes on, own saving, children, leaves and saving that came
    from other shards). Gives (depth, k1, k2, children, leaves in the subtree, saving there)."""
    queue = SpillingQueue(limit)
    for depth, k1, k2, p1, p2, inner, own, children, leaves, saved in nodes:
        saved += own
        here = (-depth, k1, k2)
        while (head := queue.least()) is not None and head[:3] <= here:
            if head[:3] != here:
                raise ValueError("a message's node isn't in its shard")
            queue.pop()
            children += 1
            leaves += head[3]
            saved += head[4]
        if not children:
            leaves = 1
        yield depth, k1, k2, children, leaves, saved
        if inner:
            queue.push((1 - depth, p1, p2, leaves, saved))


def _totals(shards: DataFrame, limit: int = IN_MEMORY) -> DataFrame:
    """``pass_forward`` over each partition of sorted nodes."""
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out, names = [], [c.split()[0] for c in OUT.split(", ")]
        types = [pa.int32()] + [pa.int64()] * 5

        def block():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for row in pass_forward(rows(), limit):
            out.append(row)
            if len(out) == 8192:
                yield block()
                out = []
        if out:
            yield block()

    return shards.select(*NODE, "p1", "p2", "inner", "own", "children", "leaves", "saved").mapInArrow(run, OUT)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ``pos`` (from 0, by turn, null first), role, text."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
            .select("conv_id", (F.row_number().over(w) - 1).alias("pos"), "role", "text"))


def shared_starts(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The input that the query asks for: each conversation c with the first h turns of
    conversation c - c % every (the remainder has the sign of c) in place of its own first h, h = crc32(c) % most. Turnless ones
    have one row with a null pos."""
    turns = keep(ordered_turns(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")), "trie-turns")
    own = turns.where("pos >= h").select("conv_id", F.col("pos").alias("at"), F.lit(1).alias("part"), "role", "text")
    first = (turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1))
             .select(F.col("conv_id").alias("base"), "pos", "role", "text"))
    ids = turns.where("pos = 0").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    lent = (ids.join(first, "base").where("pos < h")
            .select("conv_id", F.col("pos").alias("at"), F.lit(0).alias("part"), "role", "text"))
    none = ids.select("conv_id", F.lit(None).cast("int").alias("at"), F.lit(2).alias("part"),
                      F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    w = Window.partitionBy("conv_id").orderBy("part", "at")
    whole = own.unionByName(lent).unionByName(none).select("conv_id", "part", "role", "text", (F.row_number().over(w) - 1).alias("pos"))
    return (whole.where("part < 2 or pos = 0")
            .select("conv_id", F.when(F.col("part") < 2, F.col("pos")).alias("pos"), "role", "text"))


def paths(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth (0: root): the node's hashes, its parent's, the code
    points of its last turn's text, and whether the conversation ends there."""
    real = turns.where("pos is not null").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.char_length("text").cast("bigint").alias("chars"),
        F.xxhash64("pos", "role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role", "pos").alias("h2"))
    root = turns.where("pos is null or pos = 0").select("conv_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("chars"),
                                                        F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"))
    w = Window.partitionBy("conv_id").orderBy("depth")
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    return (real.unionByName(root)
            .select("conv_id", "depth", "chars", "h1", "h2", F.bit_xor("h1").over(here).alias("k1"), F.bit_xor("h2").over(here).alias("k2"),
                    F.lead("depth").over(w).isNull().alias("ends"))
            .select("conv_id", "depth", "chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
                    F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "ends"))


def member_digests(members: DataFrame) -> DataFrame:
    """Node, SHA-256 of its ``conv_id``s, ascending, comma-joined. Ids are joined in chunks of
    neighbouring numbers first, then a node's chunks stream through one task."""
    chunks = (members.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))

    def run(batches):
        at, sha = None, None
        out = []

        def block():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), pa.int64(), pa.string()])],
                                              [*NODE, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = node, hashlib.sha256(ids.encode())
            if len(out) >= 8192:
                yield block()
                out = []
        if at is not None:
            out.append((*at, sha.hexdigest()))
        if out:
            yield block()

    return (chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
            .mapInArrow(run, "depth int, k1 bigint, k2 bigint, ends_sha256 string"))


def prefix_trie(turns: DataFrame, limit: int = IN_MEMORY) -> DataFrame:
    """The trie of ``turns`` (conv_id, pos from 0 without gaps, role, text; one row with a null
    pos for a conversation without turns).

    A row for every node: ``depth``, ``k1``, ``k2`` (its name), ``p1``, ``p2`` (its parent's),
    ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``, ``chars`` (of its last text),
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = turns.sparkSession
    on_workers(spark)
    path = keep(paths(turns), "trie-paths")
    rows = path.count()
    heavy_from = max(2, int(np.ceil(np.sqrt(rows) / 4)))
    nodes = keep(path.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
                                         F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-nodes")
    heavy = nodes.where(F.col("n_convs") >= heavy_from)
    light = nodes.where(F.col("n_convs") < heavy_from)

    # at most 4 * sqrt(rows) heavy nodes: a small broadcast side. The deepest one on each path is
    # where its shard hangs; a conversation is the smallest member of its light nodes' shard
    tops = heavy.select(*NODE, F.lit(True).alias("heavy"))
    below = (path.join(F.broadcast(tops), NODE, "left")
             .groupBy("conv_id").agg(F.count("heavy").cast("int").alias("under")))
    shard = (path.join(below, "conv_id").where("depth = under")
             .select("conv_id", "under", F.col("k1").alias("s1"), F.col("k2").alias("s2")))
    own = (F.col("n_convs") - 1) * F.col("chars")
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("children", "leaves", "saved")]
    sharded = (light.join(shard, "conv_id")
               .select(*NODE, "p1", "p2", (F.col("depth") > F.col("under")).alias("inner"), own.alias("own"), *nothing, "s1", "s2")
               .repartition("s1", "s2").sortWithinPartitions(F.col("depth").desc(), "k1", "k2"))
    within = keep(_totals(sharded, limit).join(light, NODE), "trie-light")
    up = (within.join(F.broadcast(heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))), PARENT, "left_semi")
          .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
          .agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    last = (heavy.join(up, NODE, "left").select(
        *NODE, "p1", "p2", (F.col("depth") > 0).alias("inner"), own.alias("own"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("children", "leaves", "saved")])
        .coalesce(1).sortWithinPartitions(F.col("depth").desc(), "k1", "k2"))
    across = keep(_totals(last, limit).join(heavy, NODE), "trie-heavy")

    # parents: heavy ones are a small side, a light one has under T children
    def parent(df: DataFrame) -> DataFrame:
        return df.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                         F.col("conv_id").alias("parent_conv_id"))

    small = F.broadcast(parent(heavy))
    all_nodes = (across.join(small, PARENT, "left")
                 .unionByName(within.join(small, PARENT))
                 .unionByName(within.join(small, PARENT, "left_anti").join(parent(light), PARENT, "left")))
    ends = member_digests(path.where("ends").select(*NODE, "conv_id"))
    return (all_nodes.join(ends, NODE, "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))


def digests(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens", "ends_sha256")


def trie_of_conversations(conversations: DataFrame) -> DataFrame:
    return digests(prefix_trie(shared_starts(conversations)))
