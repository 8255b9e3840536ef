"""Exact top-k inner products by norm buckets.

Vectors are integers, floor(256 x) of each component. They are sorted by length into buckets
of at most ``BUCKET`` vectors; queries (every ``EVERY``-th id) into blocks of at most
``BLOCK``. A first pass over the longest vectors gives every query a lower bound theta of its
k-th best score. In the second pass each (query block, bucket) takes, for each query, the
local cosine threshold t = theta / (|q| * longest vector of the bucket):

* t > 1: no vector of the bucket can reach theta; the query leaves the bucket out;
* t < ``COSINE``: length pruning, the bucket's vectors with |p| >= theta / |q|;
* else coordinate pruning: on the query's ``FOCUS`` largest coordinates a unit vector p with
  cosine t or more has q_f t - r <= p_f <= q_f t + r, r = sqrt((1 - q_f^2)(1 - t^2)) (or no
  bound on the side where q_f itself exceeds t); what passes on all of them is a candidate.

Candidates are verified by exact products. A bucket hands on its k best per query, and the
last step keeps the k best of these: no cap is ever taken on what can be in the result.

Edge cases: null vectors, or with null or non-finite components, take no part; vectors of
another dimension are no candidates; equal rows (id and vector) count once; rows without an id
are no queries and no candidates; ties go to the smaller vec_id; an empty table gives an empty
result. Scores are exact where they fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut_lineage, on_workers

K = 5
EVERY = 50
BUCKET = 2048
BLOCK = 1024
COSINE = 0.7
FOCUS = 4
_EXACT = 2 ** 53


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor(scale * x) as longs), dim, norm: the rows that take part, each once."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    d = vectors.where(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    return d.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _packed(df: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` vectors of one dimension, in order of length (longest first)."""
    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for lo in range(0, len(at), most):
                    part = batch.take(pa.array(at[lo:lo + most]))
                    norm = part.column(3).to_numpy()
                    flat = part.column(1).flatten().to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d)], pa.int32()), pa.array([float(norm.max())]),
                         pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                         pa.array([flat.astype("<i8").tobytes()], pa.binary())], ["dim", "longest", "ids", "vectors"])

    return df.select("vec_id", "v", "dim", "norm").mapInArrow(
        run, "dim int, longest double, ids binary, vectors binary")


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<i8").reshape(len(i), dim)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where all partial sums fit, else by integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(q.shape[1], 1)
    if top < _EXACT:
        return np.rint(q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_block(q_ids, q, theta, p_ids, p, k: int, cosine: float = COSINE, focus: int = FOCUS):
    """(query id, vector id, score) that a bucket adds; theta: lower bounds, -inf for none."""
    out = []
    qn, pn = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((p.astype(np.float64) ** 2).sum(1))
    longest = pn.max(initial=0.0)
    order = np.argsort(-pn, kind="stable")
    p, p_ids, pn = p[order], p_ids[order], pn[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(theta > 0, theta / (qn * longest), -1.0)
    by_length = np.flatnonzero(~(t > 1 + 1e-9) & ~(t >= cosine))
    if len(by_length):
        scores = products(q[by_length], p)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(theta[by_length] > 0, theta[by_length] / qn[by_length] * (1 - 1e-9), 0.0)
        upto = np.searchsorted(-pn, -least, side="right")
        for r, i in enumerate(by_length):
            own = np.flatnonzero(p_ids[:upto[r]] != q_ids[i])
            s = scores[r, own]
            keep = s >= theta[i]
            s, own = s[keep], own[keep]
            for j in best(s, p_ids[own], k):
                out.append((q_ids[i], p_ids[own[j]], s[j]))
    by_coordinate = np.flatnonzero((t >= cosine) & (t <= 1 + 1e-9))
    if len(by_coordinate):
        unit = p / np.maximum(pn, 1e-300)[:, None]
        for i in by_coordinate:
            u, c = q[i] / qn[i], min(float(t[i]), 1.0)
            at = np.arange(len(p))
            for f in np.argsort(-np.abs(u), kind="stable")[:focus]:
                r = np.sqrt(max(1 - u[f] ** 2, 0) * max(1 - c * c, 0)) + 1e-9
                low = -2.0 if u[f] < 0 and -u[f] >= c else u[f] * c - r
                high = 2.0 if u[f] > 0 and u[f] >= c else u[f] * c + r
                x = unit[at, f]
                at = at[(x >= low) & (x <= high)]
            at = at[p_ids[at] != q_ids[i]]
            s = products(q[i:i + 1], p[at])[0]
            keep = s >= theta[i]
            s, at = s[keep], at[keep]
            for j in best(s, p_ids[at], k):
                out.append((q_ids[i], p_ids[at[j]], s[j]))
    return out


def _hits(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in rows], pa.int64()) for c in range(3)],
                                      ["query_id", "vec_id", "score"])


_HIT = "query_id bigint, vec_id bigint, score bigint"


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest products with the other rows."""
    on_workers(vectors.sparkSession)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = integers(vectors)
    # the range of lengths is cut by id too, so vectors of one length spread over many buckets
    buckets = cut_lineage(_packed(v.repartitionByRange(parts, F.desc("norm"), "vec_id")
                                  .sortWithinPartitions(F.desc("norm"), "vec_id"), BUCKET))
    queries = _packed(v.where(F.pmod("vec_id", F.lit(every)) == 0).coalesce(1 + parts // 8), BLOCK)
    queries = cut_lineage(queries.withColumn("block", F.xxhash64("ids")))

    def first(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                q_ids, q = _unpacked(r["ids"], r["vectors"], r["dim"])
                p_ids, p = _unpacked(r["p_ids"], r["p_vectors"], r["dim"])
                rows += search_block(q_ids, q, np.full(len(q), -np.inf), p_ids, p, k)
            yield _hits(rows)

    def second(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                q_ids, q = _unpacked(r["ids"], r["vectors"], r["dim"])
                p_ids, p = _unpacked(r["p_ids"], r["p_vectors"], r["dim"])
                known = dict(zip(r["known"] or [], r["theta"] or []))
                theta = np.array([known.get(i, -np.inf) for i in q_ids.tolist()], np.float64)
                rows += search_block(q_ids, q, theta, p_ids, p, k)
            yield _hits(rows)

    offered = buckets.select("dim", F.col("ids").alias("p_ids"), F.col("vectors").alias("p_vectors"), "longest")
    # one bucket of the longest vectors for each dimension
    head = offered.groupBy("dim").agg(F.max_by(F.struct("p_ids", "p_vectors"), "longest").alias("b")).select(
        "dim", "b.p_ids", "b.p_vectors")
    seen = queries.select("dim", "ids", "vectors").join(head, "dim").mapInArrow(first, _HIT)
    ranked = _ranked(seen, k)
    bound = ranked.groupBy("query_id").agg(F.min("score").alias("theta"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") == k).select("query_id", F.col("theta").cast("double").alias("theta"))
    q_of = queries.select("block", F.explode(_ids_of("ids")).alias("query_id"))
    told = q_of.join(bound, "query_id").groupBy("block").agg(
        F.collect_list("query_id").alias("known"), F.collect_list("theta").alias("theta"))     # at most BLOCK
    blocks = queries.select("block", "dim", "ids", "vectors").join(told, "block", "left")
    # the query set against all buckets, in blocks
    both = blocks.join(offered, "dim").repartition(parts, "ids", "p_ids").select(
        "dim", "ids", "vectors", "known", "theta", "p_ids", "p_vectors")
    hits = both.mapInArrow(second, _HIT)
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")


def _ids_of(col: str):
    @F.arrow_udf("array<bigint>")
    def ids(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, "<i8") for x in packed.to_pylist()], pa.list_(pa.int64()))
    return ids(col)
