"""Benchmark decontamination: rare n-gram seeds join passages of the training texts to test
items, Smith-Waterman alignment scores them.

1. The words of the test items are counted over all training texts; an n-gram's information is
   the sum of -log2 of its words' frequencies. An item's seeds are its 3-grams of at least
   ``RARE_BITS`` bits and the rarer half of its 3-grams (an item of fewer words: all its words;
   texts are then scanned for 1- or 2-grams as well).
2. Training texts are scanned with a bitmap of the seeds, of fixed size (``common.BITMAP`` bits; it
   only saves rows, the join that follows is exact). Seeds close together form a passage,
   widened by the length of the longest item on both sides.
3. Passages join items on seeds; each (passage, item) is aligned word by word over its whole
   length: match +1, mismatch -1, gap -1. score = best local alignment / words of the item:
   1 for a verbatim copy, 0.6 with every fifth word replaced.

A training text is contaminated by an item at a score of ``SCORE`` or more; an item of under
``SHORT`` words has to be there verbatim.

Edge cases: null or empty texts and items match nothing; items with equal text each give rows;
repeated rows of a document give its row once; null ids stay null and match as one document;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.sizing import attach_one_row
from ledgerline.llm.common import U, bitmap, cut_lineage, fresh, in_bitmap, on_workers, word_slices

GRAM = 3
RARE_BITS = 30.0
SCORE = 0.5
SHORT = 8


def _words_of(items: DataFrame) -> DataFrame:
    """item_id, n_words, words, grams of each item with words."""
    def cut(batches):
        for batch in batches:
            words, grams = [], []
            for a, b, w in word_slices(batch.column(1)):
                g, first = w.grams(GRAM)
                for i in range(b - a):
                    words.append(w.hash[w.first[i]:w.first[i + 1]].view(np.int64))
                    grams.append(g[first[i]:first[i + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64())),
                                              pa.array(grams, pa.list_(pa.int64()))], ["item_id", "words", "grams"])

    d = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(cut, "item_id bigint, words array<bigint>, grams array<bigint>").where(F.size("words") > 0)


def word_frequencies(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n over all texts) for the given words; one row with the number of all words."""
    bits = bitmap(words, "word")

    def count(batches):
        parts, total = [], 0
        for batch in batches:
            for _, _, w in word_slices(batch.column(0)):
                total += len(w.hash)
                parts.append(np.unique(w.hash[in_bitmap(bits, w.hash)], return_counts=True))
                if len(parts) > 64:
                    parts = [_merge(parts)]
        word, n = _merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(word.view(np.int64), 0)),
                                          pa.array(np.append(np.zeros(len(n), bool), True)),
                                          pa.array(np.append(n, total))], ["word", "is_total", "n"])

    got = cut_lineage(docs.select(F.col("text").cast("string").alias("text"))
                      .mapInArrow(count, "word bigint, is_total boolean, n bigint")
                      .groupBy("word", "is_total").agg(F.sum("n").alias("n")))
    counts = words.distinct().join(got.where(~F.col("is_total")).select("word", "n"), "word", "left").select(
        "word", F.coalesce("n", F.lit(0)).alias("n"))
    return counts, got.where("is_total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def _merge(parts) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    word, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return word, np.bincount(back, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)


def seeds(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, gram): each item's rare n-grams, as hashes. ``items`` as from ``_words_of``."""
    counts, total = word_frequencies(docs, items.select(F.explode("words").alias("word")))
    bits = attach_one_row(counts, total).select(
        "word", F.log2((F.col("total") + 1) / (F.col("n") + 1)).alias("bits"))
    place = items.select("item_id", F.posexplode("words").alias("pos", "word"), F.size("words").alias("n_words"))
    # a word counts for each n-gram that it stands in
    spread_out = place.join(bits, "word").select(
        "item_id", "bits", F.explode(F.sequence(F.greatest(F.col("pos") - GRAM + 1, F.lit(0)),
                                                F.greatest(F.least(F.col("pos"), F.col("n_words") - GRAM), F.lit(0))))
        .alias("at"))
    known = spread_out.groupBy("item_id", "at").agg(F.sum("bits").alias("bits"))
    grams = items.select("item_id", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("at", "gram"))
    by_rarity = Window.partitionBy("item_id").orderBy(F.desc("bits"), "at")   # one item's n-grams
    ranked = grams.join(known, ["item_id", "at"]).withColumn("rank", F.row_number().over(by_rarity))
    return ranked.where((F.col("bits") >= RARE_BITS) | (F.col("rank") <= F.ceil(F.col("n_grams") / 2))).select(
        "item_id", "gram").distinct()


def passages(docs: DataFrame, seed_bits: np.ndarray, widen: int, sizes: list[int] | None = None) -> DataFrame:
    """doc_id, at (first word), words, grams: passages of the texts that hold seeds, which are
    n-grams of ``sizes`` words (GRAM, and less where items are shorter)."""
    sizes = sizes or [GRAM]

    def find(batches):
        for batch in batches:
            ids, ats, words, grams = [], [], [], []
            for a, b, w in word_slices(batch.column(1)):
                held = []
                for size in sizes:
                    g, first = w.grams(size)
                    hit = np.flatnonzero(in_bitmap(seed_bits, g))
                    of = np.searchsorted(first, hit, side="right") - 1
                    held.append((of, hit - first[of] + w.first[of], g[hit]))
                doc, at, gram = (np.concatenate([x[k] for x in held]) for k in range(3))
                if not len(doc):
                    continue
                order = np.lexsort((at, doc))
                doc, at, gram = doc[order], at[order], gram[order]
                cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > widen)])
                for x, y in zip(cut, np.append(cut[1:], len(doc))):
                    d = int(doc[x])
                    lo = max(int(at[x]) - widen, int(w.first[d]))
                    hi = min(int(at[y - 1]) + GRAM + widen, int(w.first[d + 1]))
                    ids.append(a + d)
                    ats.append(lo - int(w.first[d]))
                    words.append(w.hash[lo:hi].view(np.int64))
                    grams.append(np.unique(gram[x:y]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(ats, pa.int64()),
                 pa.array(words, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))],
                ["doc_id", "at", "words", "grams"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(find, "doc_id bigint, at bigint, words array<bigint>, grams array<bigint>")


def smith_waterman(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, place in the passage where it ends)."""
    n = len(passage)
    step = np.arange(n + 1, dtype=np.int32)
    row = np.zeros(n + 1, np.int32)
    best, end = 0, 0
    for word in item:
        new = np.empty(n + 1, np.int32)
        new[0] = 0
        np.maximum(row[:-1] + np.where(passage == word, 1, -1), row[1:] - 1, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step      # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, last_word (where the best alignment ends): every contaminated
    document with each item that it holds."""
    on_workers(docs.sparkSession)
    tests = cut_lineage(_words_of(items))
    shape = tests.agg(F.max(F.size("words")).alias("longest"), *[F.count_if(F.size("words") == n).alias(f"of_{n}") for n in range(1, GRAM)]).first()
    longest, sizes = shape.longest or 0, [GRAM] + [n for n in range(1, GRAM) if shape[f"of_{n}"]]
    seed = cut_lineage(seeds(tests, docs))
    found = cut_lineage(passages(docs, bitmap(seed, "gram"), max(longest, GRAM), sizes).withColumn(
        "passage", F.xxhash64("doc_id", "at", "words")).dropDuplicates(["passage"]))
    pairs = (found.select("passage", F.explode("grams").alias("gram")).join(seed, "gram")
             .select("passage", "item_id").distinct())
    both = (found.select("passage", "doc_id", "at", F.col("words").alias("text")).join(pairs, "passage")
            .join(tests.select("item_id", "words"), "item_id").select("doc_id", "item_id", "at", "text", "words"))

    def align(batches):
        for batch in batches:
            got, ends, keep = [], [], []
            for text, item, at in zip(batch.column(3), batch.column(4), batch.column(2)):
                x, y = text.values.to_numpy(), item.values.to_numpy()
                s, end = smith_waterman(x, y)
                s /= len(y)
                keep.append(s >= (score if len(y) >= SHORT else max(score, 1.0)))
                got.append(s)
                ends.append(at.as_py() + end - 1)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask),
                 pa.array(got, pa.float64()).filter(mask), pa.array(ends, pa.int64()).filter(mask)],
                ["doc_id", "item_id", "score", "last_word"])

    hits = both.mapInArrow(align, "doc_id bigint, item_id bigint, score double, last_word bigint")
    return hits.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", (-F.col("last_word")).alias("l"))).alias("m")).select(
        "doc_id", "item_id", F.col("m.score").alias("score"), (-F.col("m.l")).alias("last_word"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents (rows without an id stay)."""
    out = fresh("gone", docs.columns)
    gone = contaminated(docs, items).where("doc_id is not null").select(F.col("doc_id").alias(out)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(out), "left_anti")
