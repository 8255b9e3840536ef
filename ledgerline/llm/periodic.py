"""Periodic runs of words, found by a suffix automaton whose link tree is accessed like a
link-cut tree, and texts with the repeats of those runs taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
that no neighbouring word extends keeping period q. Runs of at least ``MIN_WORDS`` words and
``REPEATS`` periods are returned.

The states of the automaton of a stretch, along their suffix links, form a tree; each state
keeps the place where its words were last seen to end. When word i is appended, the path from
its prefix's state to the root is accessed: the path falls into segments of one last place e,
each with the longest word count L that ends at both e and i, and all of it is recoloured to i.
e and i are i-e words apart, so i-e <= L means a square of period i-e, and i-e = L the leftmost
square of a run: one word further left the period breaks. The last place of a square's half is
one period back, so the period is the smallest one. The run is then extended to the right.
Segments live in splay trees (one colour each), so n words cost O(n log n) steps.

Only stretches that can hold a run enter the automaton. With g = MIN_WORDS * (REPEATS - 2) //
REPEATS (at least 1), every g words in a row inside a run recur one period before or after:
a run of length l >= REPEATS * q has 2 * q + g <= l + 1. So a run lies whole within a maximal
stretch of places whose g words recur at most (stretch length / REPEATS) words away. This cut
drops no run; it is checked against a search over all periods in the tests.

Edge cases: null or blank text -> no words, no runs, empty collapsed text; null ids and
repeated rows -> a row each; an empty table -> no rows; other columns are ignored. A text is
handled whole in one task; memory follows the longest text (about 1 KB for each word of the
longest stretch that holds runs).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import id_crc, on_workers, spread

MIN_WORDS = 24
REPEATS = 3
ROWS = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FAR = np.iinfo(np.int64).max
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length, state of each prefix); the root is state 1, 0 is none."""
    link, length, moves = [0, 0], [0, 0], [{}, {}]
    prefix = []
    last = 1
    for c in word:
        cur = len(link)
        link.append(1)
        length.append(length[last] + 1)
        moves.append({})
        prefix.append(cur)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                moves.append(dict(moves[q]))
                while p and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return link, length, prefix


def leftmost_squares(word: list[int]) -> list[tuple[int, int]]:
    """(last word, period) of the leftmost square of every run of two periods or more."""
    up, length, prefix = automaton(word)
    size = len(up)
    low, high, colour = [0] * size, [0] * size, [-1] * size
    found = []
    for i, state in enumerate(prefix):
        x, below = state, 0
        while x:
            # splay x to the root of its segment; ``up`` of a root leads to the segment above
            p = up[x]
            while p and (low[p] == x or high[p] == x):
                g = up[p]
                deep = g and (low[g] == p or high[g] == p)
                if deep:
                    # two rotations: p over g (or x over p) and then x over the other
                    if (low[g] == p) == (low[p] == x):
                        if low[g] == p:
                            t = high[p]
                            low[g] = t
                            high[p] = g
                        else:
                            t = low[p]
                            high[g] = t
                            low[p] = g
                        if t:
                            up[t] = g
                        if low[p] == x:
                            t = high[x]
                            low[p] = t
                            high[x] = p
                        else:
                            t = low[x]
                            high[p] = t
                            low[x] = p
                        if t:
                            up[t] = p
                        top = up[g]
                        up[g] = p
                        up[p] = x
                    else:
                        if low[p] == x:
                            s, t = low[x], high[x]
                            high[g], low[p] = s, t
                            low[x], high[x] = g, p
                            if s:
                                up[s] = g
                            if t:
                                up[t] = p
                        else:
                            s, t = low[x], high[x]
                            high[p], low[g] = s, t
                            low[x], high[x] = p, g
                            if s:
                                up[s] = p
                            if t:
                                up[t] = g
                        top = up[g]
                        up[g] = up[p] = x
                    if top:
                        if low[top] == g:
                            low[top] = x
                        elif high[top] == g:
                            high[top] = x
                    up[x] = top
                    colour[x] = colour[g]
                else:
                    if low[p] == x:
                        t = high[x]
                        low[p] = t
                        high[x] = p
                    else:
                        t = low[x]
                        high[p] = t
                        low[x] = p
                    if t:
                        up[t] = p
                    up[p] = x
                    up[x] = g
                    colour[x] = colour[p]
                p = up[x]
            e = colour[x]
            if e >= 0 and length[x] == i - e:
                found.append((i, i - e))
            rest = high[x]
            if rest:                 # deeper states of the segment keep their own last place
                colour[rest] = e
            high[x] = below
            below = x
            x = up[x]
        colour[below] = i
    return found


def stretches(ids: np.ndarray, min_words: int, repeats: int) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run can lie (see the module's text)."""
    g = max(1, min_words * (repeats - 2) // repeats)
    n = len(ids) - g + 1
    if n < 1 or len(ids) < min_words:
        return []
    gram = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(g):
            gram = (gram ^ (gram >> np.uint64(29))) * _MULTIPLIER + ids[k:k + n].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    again = gram[order[1:]] == gram[order[:-1]]
    first, second = order[:-1][again], order[1:][again]
    near = np.full(n, FAR)
    near[first] = second - first
    near[second] = np.minimum(near[second], second - first)
    inside = near <= len(ids) // repeats
    while True:
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        words = end - start + g - 1
        kept = np.zeros(n, bool)
        for a, b, w in zip(start[words >= min_words].tolist(), end[words >= min_words].tolist(), words[words >= min_words].tolist()):
            kept[a:b] = near[a:b] <= w // repeats
        if np.array_equal(kept, inside):
            return list(zip(start.tolist(), (start + words).tolist()))
        inside = kept


def runs(words: list, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    if len(words) < max(min_words, repeats):
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    out = []
    for a, b in stretches(ids, min_words, repeats):
        part = ids[a:b].tolist()
        for i, q in leftmost_squares(part):
            start, j = i - 2 * q + 1, i + 1
            while j < len(part) and part[j] == part[j - q]:
                j += 1
            if j - start >= max(min_words, repeats * q):
                out.append((a + start, j - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that stand in no run, or in the first period of every run that holds them."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(edge[:-1]).tolist()) if not over]


def find_runs(docs: DataFrame, key: str = "doc_id", prepare: Callable | None = None, seed: Column | None = None,
              min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """key, ``n_words``, ``runs`` (start, length, period; by start, then period) and the
    ``collapsed`` text (kept words joined by one blank), a row for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``prepare(words, seed)`` may replace a document's list of
    words (bytes) before the search."""
    on_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                counts, ends, rows, texts = [], [0], [], []
                for text, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (text or b"").split()
                    if prepare is not None:
                        words = prepare(words, g)
                    found = runs(words, min_words, repeats)
                    counts.append(len(words))
                    rows += found
                    ends.append(len(rows))
                    texts.append(b" ".join(collapsed(words, found)))
                r = np.array(rows, np.int64).reshape(-1, 3)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(r[:, k])) for k in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())],
                    [key, "n_words", "runs", "collapsed"])

    d = docs.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").cast("binary").alias("text"),
                    (F.lit(None) if seed is None else seed).cast("bigint").alias("seed"))
    return spread(d, key).mapInArrow(run, f"`{key}` bigint, n_words bigint, runs {RUNS}, collapsed string")


def tiled(words: list, h: int) -> list:
    """The input that the query asks for: in a tenth of the documents the words from a on repeat."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """The query's columns: the run of the greatest exact length/period, and digests."""
    better = lambda a, b: F.when((a["length"] * b["period"] > b["length"] * a["period"]), a).when(
        a["length"] * b["period"] < b["length"] * a["period"], b).when(
        (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"])), a).otherwise(b)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                    F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words"))


def runs_of_documents(docs: DataFrame) -> DataFrame:
    return digests(find_runs(docs, "doc_id", tiled, id_crc("doc_id")))
