"""Near-duplicate classes by improved consistent weighted sampling of TF-IDF shingles.

1. Every document is its set of 5-word shingles (a shorter one: all its words as one shingle)
   with weight (1 + ln tf) * idf. Document frequencies are counted over all documents in a
   hashed feature space of ``FEATURES`` slots, which has a fixed size at any number of
   documents; idf = 1 + ``IDF`` * ln(N / df) / ln(N) is damped so that the copies of a large
   group, which make the group's own shingles frequent, don't fall under the threshold.
2. ``SAMPLES`` consistent weighted samples (shingle, level) a document: two documents agree in
   a sample with the probability of their weighted Jaccard similarity. ``SAMPLES`` bands of
   five samples each, any two of them with at most one sample in common.
3. Documents with the same shingles and weights are one class at once. The representatives
   that share a band key are compared: all pairs of a key with at most ``SMALL`` of them, else
   each with the most popular member (the least edited one shares the most keys) of each of
   ``PIVOTS`` parts. Pairs that agree in fewer than ``AGREE`` samples are left out (at a
   similarity of 0.8 once in 10 ** 8 pairs).
   Large keys that still hold several classes are settled exactly and without all their pairs:
   they form clusters, and each member is described by what it has more and less than the
   cluster's centre (signed differences of weights). The centre is no document: it holds the
   shingles of more than half of the members that agree in ``CORE`` samples with the most popular
   one, so what most members share is nobody's difference. With c = (1 - SIMILAR) / (1 + SIMILAR), E
   a member's total difference, S its total weight and slack = E - c * S, two members are similar if
   and only if twice the weight of the differences that they share is slack_x + slack_y or more.
   So members whose slack is -slack_m or less, m being the one of least slack, are similar to m,
   and of any other pair to settle one member, x, has a slack over -slack_m and, if it is the one of
   more slack, shares more than max(slack_y, (slack_y - slack_m) / 2) with y: of y's differences,
   rarest first, a prefix that leaves less than that must hold one of x's. What members lack of the
   centre is common to many of them, but is enough for a pair only if half of slack_x + slack_y is
   no more than what either lacks in all; other pairs meet on additions alone, on a prefix of y's
   that leaves less than the bound above minus all that y lacks. As a pair's distance is
   at least the difference of what they have over the centre, and of what they have under it, pairs
   with more than c * (S_x + S_y) of that don't meet. Only pairs that meet are compared.
   1 - similarity is a metric: a round settles the pairs with a member within NEAR of
   the centre (the other one is within NEAR + 1 - SIMILAR), and the rest elects a new one.
4. A pair is a link if its weighted Jaccard similarity, from the whole texts, is ``SIMILAR`` or
   more; classes are the connected components, named after their smallest id.

Edge cases: null, empty or word-free text, or a null id -> a class of its own (class_id is the
id); repeated rows of an id share its class; an id with several texts joins their classes;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import (U, bitmap, fresh, in_bitmap, keep, mix, on_workers, short_batches,
                                   slices, word_slices)
from ledgerline.llm.components import components, written

SHINGLE = 5
SIMILAR = 0.8
FEATURES = 1 << 18
IDF = 0.1
SAMPLES = 24
BAND = (0, 1, 4, 9, 11)      # its differences are all distinct modulo 24
SMALL = 10
PIVOTS = 3
AGREE = 8                    # of SAMPLES
CORE = 12                    # of SAMPLES
NEAR = 0.6                   # distance from the centre whose members a round settles
ROUNDS = 3                   # of centres; the last one settles all that is left, near or not
PAIRS = 256                  # of whole texts in one Arrow batch
_BITS = 44                   # of a shingle's hash

_rng = np.random.default_rng(2010)
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LN_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = _rng.random(1 << 16).astype(np.float32)
_ODD = _rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * U(2) + U(1)


def shingles(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a slice: (document << 44 | hash, tf, first)."""
    g, first = w.grams(SHINGLE)
    doc = np.repeat(np.arange(len(first) - 1, dtype=U), np.diff(first))
    key = np.sort((doc << U(_BITS)) | (g >> U(64 - _BITS)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(key)))
    key = key[new]
    return key, tf, np.searchsorted(key, np.arange(len(first), dtype=U) << U(_BITS))


def weights(key: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)).astype(np.float32) * idf[(key & U(FEATURES - 1)).astype(np.int64)]


def samples(key: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents with shingles) x SAMPLES hashes of the sampled (shingle, level)."""
    starts = first[:-1][np.diff(first) > 0]
    g = key & U((1 << _BITS) - 1)
    ln_w = np.log(weight)
    index = np.arange(len(key), dtype=np.int64)
    out = np.empty((len(starts), SAMPLES), U)
    for k in range(SAMPLES):
        h = g * _ODD[k]
        h ^= h >> U(32)
        h *= U(0x94D049BB133111EB)
        r, beta = _R[(h >> U(48)).astype(np.int64)], _BETA[((h >> U(32)) & U(0xFFFF)).astype(np.int64)]
        level = np.floor(ln_w / r + beta)
        ln_a = _LN_C[((h >> U(16)) & U(0xFFFF)).astype(np.int64)] - r * (level + 1 - beta)
        bits = ln_a.view(np.int32).astype(np.int64)
        bits ^= (bits >> 31) & 0x7FFFFFFF                       # sorts as the float does
        at = np.minimum.reduceat((bits << 32) | index, starts) & 0xFFFFFFFF
        out[:, k] = mix(h[at] ^ (level[at].astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)))
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    cols = []
    for j in range(SAMPLES):
        key = np.full(len(s), U(j + 1))
        for o in BAND:
            key = mix(key * U(0x9E3779B97F4A7C15) + s[:, (j + o) % SAMPLES])
        cols.append(key)
    return np.stack(cols, 1).view(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Damped idf of each hashed feature; FEATURES numbers, whatever the size of ``docs``."""
    def count(batches):
        n = np.zeros(FEATURES, np.int64)
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            for _, _, w in word_slices(batch.column(0)):
                key, _, _ = shingles(w)
                n += np.bincount((key & U(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], seen))],
                                         ["feature", "n"])

    got = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "feature bigint, n bigint")
           .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())
    at, n = got["feature"].to_numpy(), got["n"].to_numpy()
    total = max(int(n[at < 0].sum()), 2)          # slot -1 holds the number of documents
    df = np.ones(FEATURES)
    df[at[at >= 0]] = n[at >= 0]
    return (1 + IDF * np.log(total / np.minimum(df, total)) / np.log(total)).astype(np.float32)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, sig (16 bytes: same shingles and counts, null without words), samples (their low
    32 bits), bands."""
    def sign(batches):
        for batch in batches:
            sig, drawn, bands = [], [], []
            for a, b, w in word_slices(batch.column(1)):
                key, tf, first = shingles(w)
                has = np.diff(first) > 0
                s = samples(key, weights(key, tf, idf), first) if has.any() else np.zeros((0, SAMPLES), U)
                own = key & U((1 << _BITS) - 1)
                rows = zip(s.astype(np.uint32).view(np.int32), band_keys(s))
                for i in range(b - a):
                    if not has[i]:
                        sig.append(None)
                        drawn.append(None)
                        bands.append(None)
                        continue
                    x, y = first[i], first[i + 1]
                    sig.append(hashlib.blake2b(own[x:y].tobytes() + tf[x:y].tobytes(), digest_size=16).digest())
                    low, high = next(rows)
                    drawn.append(low)
                    bands.append(high)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sig, pa.binary()), pa.array(drawn, pa.list_(pa.int32())),
                 pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "sig", "samples", "bands"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(sign, "doc_id bigint, sig binary, samples array<int>, bands array<bigint>")


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, to compare, from rows (key, rep): linear in the rows."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keys.join(sizes, "key"))
    popular = shared.groupBy("rep").agg(F.sum("n").alias("pop"))
    small = shared.where(F.col("n") <= SMALL).select("key", "rep")
    pairs = small.join(small.select("key", F.col("rep").alias("other")), "key").where("rep < other").select(
        F.col("rep").alias("a"), F.col("other").alias("b"))
    large = shared.where(F.col("n") > SMALL).select("key", "rep")
    part = F.pmod(F.xxhash64("rep"), F.lit(PIVOTS))
    pivots = (large.join(popular, "rep").groupBy("key", part.alias("part"))
              .agg(F.max(F.struct("pop", "rep"))["rep"].alias("pivot")).select("key", "pivot"))
    stars = large.join(pivots, "key").where("rep <> pivot").select(
        F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    return pairs.unionByName(stars).distinct()


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that agree in ``AGREE`` samples or more (at a similarity of SIMILAR fewer agree
    once in 10 ** 8 pairs)."""
    drawn = reps.select("rep", "samples")
    both = pairs.join(drawn.select(F.col("rep").alias("b"), F.col("samples").alias("sb")), "b").join(
        drawn.select(F.col("rep").alias("a"), F.col("samples").alias("sa")), "a")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.where(same >= AGREE).select("a", "b")


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents in ``pairs``, each text once."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    bits = bitmap(ids, "doc_id")

    def near(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy())))

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = d.where("doc_id is not null").mapInArrow(near, "doc_id bigint, text string")
    return keep(some.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")


def similar_pairs(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similar: float = SIMILAR) -> DataFrame:
    """The pairs whose weighted Jaccard similarity reaches ``similar``: a, b, similarity."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def compare(batches):
        for batch in batches:
            size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy() for c in (2, 3))
            for lo, hi in slices(np.concatenate(([0], np.cumsum(size, dtype=np.int64)))):
                part = batch.slice(lo, hi - lo)
                got = []
                for c in (2, 3):
                    ks, ws, at = [], [], 0
                    for a, b, w in word_slices(part.column(c)):
                        key, tf, _ = shingles(w)
                        ks.append(key + (U(a) << U(_BITS)))
                        ws.append(weights(key, tf, idf).astype(np.float64))
                    got.append((np.concatenate(ks), np.concatenate(ws)))
                (ka, wa), (kb, wb) = got
                n = part.num_rows
                at = np.searchsorted(kb, ka)
                at[at == len(kb)] = 0
                same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
                low = np.bincount((ka[same] >> U(_BITS)).astype(np.int64), np.minimum(wa[same], wb[at[same]]), n)
                total = (np.bincount((ka >> U(_BITS)).astype(np.int64), wa, n)
                         + np.bincount((kb >> U(_BITS)).astype(np.int64), wb, n))
                s = low / np.maximum(total - low, 1e-12)
                keep = s >= similar - 1e-9
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask),
                                                  pa.array(s[keep])], ["a", "b", "similarity"])

    return both.mapInArrow(compare, "a bigint, b bigint, similarity double")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the class), is_first, for every row of ``docs``."""
    on_workers(docs.sparkSession)
    idf = inverse_frequencies(docs)
    sigs = written(signatures(docs, idf))
    known = sigs.where(F.col("doc_id").isNotNull() & F.col("sig").isNotNull())
    reps = written(known.groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.any_value("samples").alias("samples"), F.any_value("bands").alias("bands")))
    keys = reps.select(F.explode("bands").alias("key"), "rep")
    pairs = written(plausible(candidate_pairs(keys), reps))
    links = _links(pairs, docs, idf)
    # ids that carry several texts hold these together
    held = known.select("doc_id", "sig").distinct().join(reps.select("sig", "rep"), "sig").where("doc_id <> rep")
    held = held.join(held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "doc_id").select(
        F.least("rep", "doc_id").alias("a"), F.greatest("rep", "doc_id").alias("b"))
    found = _merged(reps.select("rep", F.col("rep").alias("label")).distinct(), links.unionByName(held))
    found = _settled(keys, found, pairs, reps, docs, idf)
    named = reps.select("sig", "rep").join(found, "rep").select("sig", F.col("label").alias("class_id"))
    out = sigs.select("doc_id", "sig").join(named, "sig", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return out.withColumn("is_first", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _links(pairs: DataFrame, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    texts = texts_of(pairs, docs)
    with short_batches(docs.sparkSession, PAIRS):
        return written(similar_pairs(pairs, texts, idf).select("a", "b"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label) of all representatives after the classes of linked ones become one."""
    of = lambda c: found.select(F.col("rep").alias(c), F.col("label").alias(f"label_{c}"))
    both = links.join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b").select(
        F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    up = components(both).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return written(found.join(up, "label", "left").select("rep", F.coalesce("least", "label").alias("label")))


def _large(keys: DataFrame, found: DataFrame) -> DataFrame:
    """key, rep, n, label of the members of large keys."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL)
    return keys.join(sizes, "key").join(found, "rep").select("key", "rep", "n", "label")


def _clusters(keys: DataFrame, found: DataFrame) -> DataFrame:
    """cluster, rep, pop of the members of large keys that hold several classes; keys that share a
    member are one cluster."""
    big = _large(keys, found)
    open_ = (big.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rep").alias("first"))
             .where("lo <> hi").select("key", "first"))
    rows = written(big.join(open_, "key").groupBy("rep", "first").agg(F.sum("n").alias("n")))
    joined = components(rows.where("rep <> first"), "rep", "first")
    return written(rows.groupBy("rep").agg(F.sum("n").alias("pop")).join(joined, F.col("rep") == F.col("node"))
                       .select(F.col("label").alias("cluster"), "rep", "pop"))


def centres(core: DataFrame, texts: DataFrame) -> DataFrame:
    """cluster, shingles, counts: what more than half of the texts of the cluster's ``core`` (cluster,
    rep) hold, so at most twice their mean size; counts are the holders' means, rounded."""
    low = U((1 << _BITS) - 1)

    def count(batches):
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            for a, b, w in word_slices(batch.column(1)):
                key, tf, first = shingles(w)
                own = np.repeat(cluster[a:b], np.diff(first))
                own, g = np.concatenate([own, cluster[a:b]]), np.concatenate([(key & low).view(np.int64), np.full(b - a, -1)])
                order = np.lexsort((g, own))                   # shingle -1 counts the texts
                own, g, tf = own[order], g[order], np.concatenate([tf, np.ones(b - a, np.int64)])[order]
                new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (own[1:] != own[:-1])][:len(g)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[new]), pa.array(g[new]), pa.array(np.diff(np.append(new, len(g)))),
                     pa.array(np.add.reduceat(tf, new) if len(new) else tf)], ["cluster", "g", "n", "tf"])

    held = (core.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("cluster", "text")
            .mapInArrow(count, "cluster bigint, g bigint, n bigint, tf bigint")
            .groupBy("cluster", "g").agg(F.sum("n").alias("n"), F.sum("tf").alias("tf")))
    held = written(held)
    size = held.where("g = -1").select("cluster", F.col("n").alias("size"))
    common = held.join(size, "cluster").where("g >= 0 and 2 * n > size").select(
        "cluster", F.struct("g", F.round(F.col("tf") / F.col("n")).cast("bigint").alias("tf")).alias("x"))
    listed = common.groupBy("cluster").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return size.join(listed, "cluster", "left").select(
        "cluster", F.coalesce("x.g", F.array().cast("array<bigint>")).alias("shingles"),
        F.coalesce("x.tf", F.array().cast("array<bigint>")).alias("counts"))


def differences(members: DataFrame, texts: DataFrame, idf: np.ndarray, middle: DataFrame | None = None,
                similar: float = SIMILAR) -> DataFrame:
    """From (cluster, label, rep, lead): the similarity to the cluster's centre (of ``middle``, else the
    text of ``lead``), the weight ``over`` and ``under`` the centre's ``size``, the ``slack``, and
    ``every`` signed difference (odd: an addition), rarest first, with the weight of it and all later
    ones in ``tail``, and of these the additions' in ``added``."""
    if middle is None:
        middle = centres(members.select("cluster", F.col("lead").alias("rep")).distinct(), texts)
    both = (members.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").join(middle, "cluster")
            .select("cluster", "label", "rep", "text", "shingles", "counts"))
    c = (1 - similar) / (1 + similar)
    low = U((1 << _BITS) - 1)

    def one(kx, wx, kl, wl):
        g = np.union1d(kx, kl)
        diff = np.zeros(len(g))
        diff[np.searchsorted(g, kx)] += wx
        diff[np.searchsorted(g, kl)] -= wl
        at = np.flatnonzero(np.abs(diff) > 1e-9)
        at = at[np.argsort(-idf[(g[at] & U(FEATURES - 1)).astype(np.int64)], kind="stable")]
        g, diff = g[at], diff[at]
        weight = np.abs(diff)
        e, own, size = weight.sum(), wx.sum(), wl.sum()
        return ((own + size - e) / max(own + size + e, 1e-12), weight[diff > 0].sum(), weight[diff < 0].sum(), size, e - c * own,
                (g << U(1) | (diff > 0).astype(U)).view(np.int64), np.cumsum(weight[::-1])[::-1],
                np.cumsum(np.maximum(diff, 0)[::-1])[::-1])

    def run(batches):
        for batch in batches:
            middles = [(np.array(k.as_py(), np.int64).view(U), np.array(n.as_py(), np.int64))
                       for k, n in zip(batch.column(4), batch.column(5))]
            got = []
            for a, _, w in word_slices(batch.column(3)):
                key, tf, first = shingles(w)
                weight = weights(key, tf, idf).astype(np.float64)
                for i, (x, y) in enumerate(zip(first[:-1], first[1:])):
                    kl, n = middles[a + i]
                    got.append(one(key[x:y] & low, weight[x:y], kl, weights(kl, n, idf).astype(np.float64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)),
                 *(pa.array([g[k] for g in got], pa.float64()) for k in range(5)),
                 pa.array([g[5] for g in got], pa.list_(pa.int64())),
                 *(pa.array([g[k] for g in got], pa.list_(pa.float64())) for k in (6, 7))],
                ["cluster", "label", "rep", "similarity", "over", "under", "size", "slack", "every", "tail", "added"])

    return both.mapInArrow(run, "cluster bigint, label bigint, rep bigint, similarity double, over double, under double, size double, "
                                "slack double, every array<bigint>, tail array<double>, added array<double>")


def _least(told: DataFrame) -> DataFrame:
    """cluster, head, head_label, least: the member of least slack."""
    return told.groupBy("cluster").agg(F.min(F.struct("slack", "rep", "label")).alias("l")).select(
        "cluster", F.col("l.rep").alias("head"), F.col("l.label").alias("head_label"), F.col("l.slack").alias("least"))


def _about() -> Column:
    """What sums of weights may be off by."""
    return 1e-6 * (F.col("size") + F.col("over") + F.col("under"))


def _meeting(told: DataFrame, last: bool, similar: float = SIMILAR) -> DataFrame:
    """Distinct (a, b), a < b, of different classes that meet on a difference; see the module's text."""
    near, reach, c = 1 - NEAR, similar - NEAR, (1 - similar) / (1 + similar)
    every = told.join(_least(told), "cluster").withColumn("apart", F.col("slack") + F.col("least") > -_about())
    edge = every.where(F.col("apart") & (F.col("slack") + F.col("least") <= _about()) & (F.col("label") != F.col("head_label"))).select(
        F.col("rep").alias("x"), F.col("head").alias("y"))
    inside = every if last else every.where(F.col("similarity") >= reach - 1e-6)
    told_of = lambda rep: [
        F.col("rep").alias(rep), *(F.col(k).alias(f"{k}_{rep}") for k in ("label", "over", "under", "size", "slack")),
        (F.col("similarity") >= near - 1e-6).alias(f"near_{rep}")]
    shared = F.greatest(F.col("slack"), (F.col("slack") - F.col("least")) / 2) - _about()
    x = inside.where("apart").select("cluster", F.explode("every").alias("e"), *told_of("x"))
    add = lambda e: e.bitwiseAND(F.lit(1)) == 1
    y = inside.withColumn("shared", shared).select("cluster", F.explode(F.filter(
        F.arrays_zip("every", "tail", "added"), lambda z: (z["tail"] >= F.col("shared")) | (
            add(z["every"]) & (z["added"] >= F.col("shared") - F.col("under"))))["every"]).alias("e"), *told_of("y"))
    on = ["cluster", "e"]
    several = (x.select(*on, F.col("label_x").alias("l")).unionByName(y.select(*on, F.col("label_y").alias("l")))
               .groupBy(*on).agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo <> hi").select(*on))
    least = F.abs(F.col("over_x") - F.col("over_y")) + F.abs(F.col("under_x") - F.col("under_y"))
    sizes = 2 * F.col("size_x") + F.col("over_x") - F.col("under_x") + F.col("over_y") - F.col("under_y")
    about = 1e-6 * (F.col("size_x") + F.col("over_x") + F.col("over_y"))
    met = (x.join(several, on).join(y, on).where("label_x <> label_y")
           .where(F.col("slack_x") >= F.col("slack_y") - about).where(least <= c * sizes + about)
           .where(add(F.col("e")) | ((F.col("slack_x") + F.col("slack_y")) / 2 <= F.least("under_x", "under_y") + about)))
    met = met if last else met.where("near_x or near_y")
    return met.select("x", "y").unionByName(edge).where("x <> y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _core(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(cluster, rep) of the members that agree with the cluster's ``lead`` in ``CORE`` samples."""
    drawn = members.select("cluster", "rep", "lead").join(reps.select("rep", "samples"), "rep")
    lead = drawn.where("rep = lead").select("cluster", F.col("samples").alias("lead_samples"))
    same = F.size(F.filter(F.zip_with("samples", "lead_samples", lambda x, y: x == y), lambda x: x))
    return drawn.join(lead, "cluster").where(same >= CORE).select("cluster", "rep").distinct()


def _settled(keys: DataFrame, found: DataFrame, done: DataFrame, reps: DataFrame, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``found`` after every pair of a large key between different classes was compared or ruled out."""
    left = _clusters(keys, found)
    for k in range(ROUNDS):
        last = k == ROUNDS - 1
        now = left.join(found, "rep")
        leaders = (now.groupBy("cluster").agg(F.max(F.struct("pop", "rep"))["rep"].alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi"))
                   .where("lo <> hi").select("cluster", "lead"))
        members = written(now.join(leaders, "cluster"))
        if members.isEmpty():
            break
        texts = texts_of(members.select(F.col("rep").alias("a"), F.col("lead").alias("b")), docs)
        with short_batches(docs.sparkSession, PAIRS):
            told = written(differences(members, texts, idf, centres(_core(members, reps), texts)))
        same = F.col("slack") + F.col("least") <= -_about()
        named = told.join(_least(told), "cluster").withColumn("label", F.when(same, F.col("head_label")).otherwise(F.col("label")))
        close = named.where(same & (F.col("rep") != F.col("head"))).select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
        met = written(_meeting(named.select(told.columns), last).join(done, ["a", "b"], "left_anti"))
        found = _merged(found, close if met.isEmpty() else close.unionByName(_links(met, docs, idf)))
        if last:
            break
        far = told.groupBy("rep").agg(F.min("similarity").alias("s")).where(F.col("s") < 1 - NEAR - 1e-6)
        left = written(members.join(far, "rep", "left_semi").select("cluster", "rep", "pop"))
    return found


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id (rows without an id
    stay; of repeated rows of an id one stays). Columns are those of ``docs``."""
    one, out = fresh("one", docs.columns), fresh("gone", docs.columns)
    gone = classes(docs).where(~F.col("is_first")).select(F.col("doc_id").alias(out)).distinct()
    each = docs.withColumn(one, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    left = each.join(gone, F.col("doc_id") == F.col(out), "left_anti")
    return left.dropDuplicates(["doc_id", one]).select(*docs.columns)
