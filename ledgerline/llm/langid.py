"""Language of words and documents by a linear-chain conditional random field.

Every word of a text gets a label; its emission score is the sum of learned weights of its
features (whole-word lexicon entry, prefixes and suffixes of 1 to 3 bytes, all byte 2- to
4-grams of the padded word, hashed into ``FEATURES`` slots), and learned transitions join
neighbours. Forward-backward gives each word's label marginals; a document's language has the
largest sum of marginals, its score is that sum over the number of words.

Chains are the lines of a text; a line of over ``CHAIN`` words is labelled in chains of that
many. Every word of the whole text is labelled.

Edge cases: null text, or one without a letter -> ``und`` with score 0; a tie -> the label
first in alphabetical order; no labelled rows at all -> every text is ``und``; null id ->
a row with a null id; repeated rows -> one result for each; extra columns are ignored.
The model is fitted on the driver on the whole texts of at most ``SAMPLE`` rows a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import IS_LETTER, U, Words, id_crc, mix, on_workers, spread, word_slices

FEATURES = 1 << 17
CHAIN = 128
SAMPLE = 240
PARTS = 64               # of a language, whose smallest hashes are found apart
EPOCHS = 4
SWITCHED = 0.35          # share of training chains spliced from two languages
UNKNOWN = "und"


def _word_bytes(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The picked words, each between two zero bytes: (bytes, start of each, lengths)."""
    n = w.end[pick] - w.start[pick]
    size = n + 2
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    out = np.zeros(int(size.sum()), np.uint8)
    src = np.repeat(w.start[pick] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
    dst = np.repeat(first + 1 - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
    b = w.data[src]
    # capitals of the Latin-1 letters, which lower-casing of ASCII leaves as they are
    prev = np.concatenate(([0], b[:-1]))
    out[dst] = np.where((prev == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 32, b)
    return out, first, size


def features(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature slots, start of each picked word's slots); every word has at least one."""
    b, first, size = _word_bytes(w, pick)
    owner = np.repeat(np.arange(len(pick)), size)
    place = np.arange(len(b)) - first[owner]
    left = size[owner] - place
    x = b.astype(np.uint32) + np.uint32(1)
    parts, owners = [w.hash[pick] ^ U(0x51)], [np.arange(len(pick))]
    gram = x.copy()
    for n in (2, 3, 4):
        nxt = np.concatenate((x[n - 1:], np.zeros(min(n - 1, len(x)), np.uint32)))[:len(x)]
        gram = gram * np.uint32(0x01000193) ^ nxt
        ok = left >= n
        parts.append(gram[ok].astype(U) * U(8) + U(n))
        owners.append(owner[ok])
    for n in (1, 2, 3):      # affixes: the first and last n bytes
        k = np.minimum(n, size - 2)
        head = np.zeros(len(pick), np.uint32)
        tail = np.zeros(len(pick), np.uint32)
        for j in range(n):
            use = j < k
            head = np.where(use, head * np.uint32(257) + x[np.minimum(first + 1 + j, len(x) - 1)], head)
            tail = np.where(use, tail * np.uint32(257) + x[np.maximum(first + size - 2 - j, 0)], tail)
        parts += [head.astype(U) * U(8) + U(5), tail.astype(U) * U(8) + U(6)]
        owners += [np.arange(len(pick))] * 2
    slot = (mix(np.concatenate(parts)) >> U(40)).astype(np.int64) % FEATURES
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(len(pick)))


def chains(w: Words) -> np.ndarray:
    """Start of each chain: a document's first word, a line's first word, every CHAIN words."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    line = np.cumsum(w.data == 10)[w.start]
    new = np.zeros(n, bool)
    new[w.first[:-1][w.first[:-1] < n]] = True
    new[1:] |= line[1:] != line[:-1]
    at = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return np.flatnonzero(new | (place % CHAIN == 0))


def forward_backward(e: np.ndarray, starts: np.ndarray, trans: np.ndarray, begin: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of each word, alpha, scaled beta) for emissions ``e`` in log space.

    All chains advance together: step t handles the t-th word of those that are long enough."""
    n, k = e.shape
    size = np.diff(np.append(starts, n))
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    x = np.exp(e - e.max(1, keepdims=True))
    t_mat, b0 = np.exp(trans), np.exp(begin)
    alpha, beta = np.empty_like(x), np.empty_like(x)
    steps = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps + 1)]  # size > t
    for t in range(steps):
        at = starts[:live[t]] + t
        a = (alpha[at - 1] @ t_mat if t else b0) * x[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        at = starts[:live[t]] + t
        more = live[t + 1]
        beta[at[more:]] = 1.0
        if more:
            nxt = at[:more] + 1
            b = (beta[nxt] * x[nxt]) @ t_mat.T
            beta[at[:more]] = b / b.sum(1, keepdims=True)
    m = alpha * beta
    m /= m.sum(1, keepdims=True)
    return m, alpha, beta * 1.0


class Model:
    """Learned weights; ``langs`` in alphabetical order."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        k = len(langs)
        self.weight = np.zeros((FEATURES, k), np.float32)
        self.trans = np.zeros((k, k), np.float32)
        self.begin = np.zeros(k, np.float32)

    def emissions(self, w: Words) -> np.ndarray:
        _, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
        slot, at = features(w, where)
        return np.add.reduceat(self.weight[slot], at, axis=0)[back]

    def marginals(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        return forward_backward(self.emissions(w), chains(w), self.trans, self.begin)[0]


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (text, language) rows: conditional log-likelihood of labelled chains by
    mini-batches with Adagrad. Chains are lines; some are spliced from two languages."""
    langs = sorted({lang for _, lang in rows})
    model, rng = Model(langs), np.random.default_rng(seed)
    if len(langs) < 2:
        return model
    raw = [t.encode() for t, _ in rows]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    w = Words(np.frombuffer(b"".join(raw), np.uint8), off, IS_LETTER)
    if not len(w.start):
        return model
    gold = np.repeat([langs.index(g) for _, g in rows], np.diff(w.first))
    _, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
    parts, at, total = [], [], 0
    for lo in range(0, len(where), 20_000):            # each word once, some at a time, to bound the driver's memory
        s, first = features(w, where[lo:lo + 20_000])
        parts.append(s.astype(np.int32))
        at.append(first + total)
        total += len(s)
    slot, at = np.concatenate(parts), np.concatenate(at)
    at, end = at[back], np.append(at[1:], len(slot))[back]
    cs = chains(w)
    pieces = [np.arange(a, b) for a, b in zip(cs, np.append(cs[1:], len(w.start)))]
    g_w = np.full(model.weight.shape, 1e-2, np.float32)
    g_t, g_b = np.full(model.trans.shape, 1.0, np.float32), np.full(model.begin.shape, 1.0, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        made = []
        for i in order:
            p = pieces[i]
            if rng.random() < SWITCHED:
                q = pieces[order[rng.integers(len(order))]]
                a, b = rng.integers(1, len(p) + 1), rng.integers(0, len(q))
                p = np.concatenate((p[:a], q[b:]))[:CHAIN]
            made.append(p)
        for lo in range(0, len(made), 64):
            batch = made[lo:lo + 64]
            words = np.concatenate(batch)
            starts = np.concatenate(([0], np.cumsum([len(p) for p in batch])))[:-1]
            n = end[words] - at[words]
            rows_at = np.concatenate(([0], np.cumsum(n)))[:-1]
            f = slot[np.repeat(at[words] - rows_at, n) + np.arange(int(n.sum()))]
            e = np.add.reduceat(model.weight[f], rows_at, axis=0)
            y = gold[words]
            m, alpha, beta = forward_backward(e, starts, model.trans, model.begin)
            d = m.copy()
            d[np.arange(len(y)), y] -= 1
            d /= len(batch)
            uniq, back = np.unique(f, return_inverse=True)
            grad = np.zeros((len(uniq), len(langs)), np.float32)
            spread_d = np.repeat(d, n, axis=0)
            for c in range(len(langs)):
                grad[:, c] = np.bincount(back, spread_d[:, c], len(uniq))
            g_w[uniq] += grad * grad
            model.weight[uniq] -= 0.15 * grad / np.sqrt(g_w[uniq])
            inner = np.ones(len(y), bool)
            inner[starts] = False
            i = np.flatnonzero(inner)
            x = np.exp(e - e.max(1, keepdims=True))
            pair = alpha[i - 1][:, :, None] * np.exp(model.trans)[None] * (x[i] * beta[i])[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            gt = pair.sum(0)
            np.subtract.at(gt, (y[i - 1], y[i]), 1)
            gt /= len(batch)
            g_t += gt * gt
            model.trans -= 0.1 * gt / np.sqrt(g_t)
            gb = d[starts].sum(0)
            g_b += gb * gb
            model.begin -= 0.1 * gb / np.sqrt(g_b)
    return model


def drawn(rows: DataFrame) -> DataFrame:
    """lang, doc_id, text, hash of the rows up to the SAMPLE-th smallest hash of their language. Only
    hashes move to find it, those of a language in PARTS parts; the texts stay where they are."""
    rows = rows.select("lang", "doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    least = lambda df, *of: df.withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", *of).orderBy("hash"))).where(F.col("place") <= SAMPLE)
    some = least(rows.select("lang", "hash"), F.pmod("hash", F.lit(PARTS)))
    last = least(some.select("lang", "hash")).groupBy("lang").agg(F.max("hash").alias("last"))
    return rows.join(F.broadcast(last), "lang").where(F.col("hash") <= F.col("last")).drop("last")   # a row a language


def fit(docs: DataFrame, learn=None) -> Model:
    """Model from the rows of ``docs`` with text and language that satisfy ``learn``.

    ``SAMPLE`` rows a language: those of the smallest hashes of id and text (so rows that share an
    id, or have none, are drawn one by one), with their whole texts."""
    on_workers(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    first = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    got = (drawn(rows).withColumn("place", F.row_number().over(first))
           .where(F.col("place") <= SAMPLE).select("text", "lang", "doc_id").collect())
    if not got:
        return Model([])
    got = sorted(got, key=lambda r: (r["lang"], -1 if r["doc_id"] is None else r["doc_id"], r["text"]))
    return train([(r["text"], r["lang"]) for r in got])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", runs: bool = False) -> DataFrame:
    """One row per document: key, ``lang_pred``, ``score``, ``n_words``; with ``runs`` also the
    word labels as runs (first word, number of words, language) of the most probable labels."""
    on_workers(docs.sparkSession)
    langs = np.array([*model.langs, UNKNOWN], object)

    def label(batches):
        for batch in batches:
            out = {"id": batch.column(0), "lang_pred": [], "score": [], "n_words": [], "runs": []}
            texts = batch.column(1)
            for a, b, w in word_slices(texts, IS_LETTER):
                n = np.diff(w.first)
                if len(model.langs) and len(w.start):
                    m = model.marginals(w)
                    total = np.zeros((b - a, len(model.langs)))
                    has = np.flatnonzero(n > 0)
                    total[has] = np.add.reduceat(m, w.first[:-1][has], axis=0, dtype=np.float64)
                    best = total.argmax(1)
                    score = total[np.arange(b - a), best] / np.maximum(n, 1)
                else:
                    m, best, score = np.zeros((len(w.start), 1)), np.full(b - a, len(model.langs)), np.zeros(b - a)
                none = n == 0
                plain = np.append(0, np.cumsum((w.data >= 97) & (w.data <= 122)))
                ascii_letters = np.diff(plain[w.offsets])
                for i in np.flatnonzero(~none & (ascii_letters == 0)):   # perhaps only marks outside ASCII
                    none[i] = not any(c.isalpha() for c in texts[a + int(i)].as_py() or "")
                best = np.where(none, len(model.langs), best)
                out["lang_pred"] += langs[best].tolist()
                out["score"] += np.clip(np.where(best == len(model.langs), 0.0, score), 0, 1).tolist()
                out["n_words"] += n.tolist()
                if runs:
                    lab = m.argmax(1)
                    for i in range(b - a):
                        own = lab[w.first[i]:w.first[i + 1]]
                        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
                        out["runs"].append([] if none[i] else [
                            {"first_word": int(s), "n_words": int(t - s), "lang": langs[own[s]]}
                            for s, t in zip(cut, np.append(cut[1:], len(own)))])
            cols = [out["id"], pa.array(out["lang_pred"], pa.string()), pa.array(out["score"], pa.float64()),
                    pa.array(out["n_words"], pa.int64())]
            names = [key, "lang_pred", "score", "n_words"]
            if runs:
                cols.append(pa.array(out["runs"], pa.list_(pa.struct(
                    [("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))))
                names.append("runs")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` bigint, lang_pred string, score double, n_words bigint"
    schema += ", runs array<struct<first_word:bigint,n_words:bigint,lang:string>>" if runs else ""
    d = docs.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text"))
    return spread(d, key).mapInArrow(label, schema)


def held_out():
    return id_crc() % 4 == 2


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict every row."""
    model = fit(docs, ~held_out())
    return predict(docs, model).withColumn("held_out", held_out()).select(
        "doc_id", "held_out", "lang_pred", "score", "n_words")
