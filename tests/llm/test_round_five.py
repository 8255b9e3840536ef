"""What the review of round 3 found."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import langid, neardup, pii


def test_edits_of_one_text_meet_by_what_they_add(spark):
    """Copies with edits of their own lack common parts of the leader, which doesn't pair them all;
    every similar pair meets, also of cut copies, of longer ones and of partners in an edit."""
    r = random.Random(5)
    source = [f"w{r.randrange(10_000)}" for _ in range(120)]
    texts = [" ".join(source)]
    for i in range(150):
        words = list(source)
        for k in r.sample(range(120), r.choice([2, 4, 5, 6])):
            words[k] = f"e{r.randrange(100_000)}"
        if i % 30 == 0:
            words = words[:r.randrange(80, 110)] if i % 60 else words + source[:r.randrange(20, 60)]
        texts.append(" ".join(words))
        if i % 3 == 0:
            texts.append(" ".join(words[:-1] + ["other"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = np.ones(neardup.FEATURES, np.float32)
    members = docs.select(F.lit(0).cast("long").alias("cluster"), F.col("doc_id").alias("label"),
                          F.col("doc_id").alias("rep"), F.lit(0).cast("long").alias("lead"))
    told = neardup.written(neardup.differences(members, docs, idf))
    every = docs.select(F.col("doc_id").alias("a")).join(docs.select(F.col("doc_id").alias("b")), F.col("a") < F.col("b"))
    met = {(x.a, x.b) for x in neardup._meeting(told, True).collect()}
    apart = {x.rep for x in told.where(F.col("similarity") < neardup.SIMILAR - 1e-9).collect()}
    similar = {(x.a, x.b) for x in neardup.similar_pairs(every, docs, idf).collect() if {x.a, x.b} & apart and x.a}
    assert len(similar) > 20 and similar <= met
    assert len(met) < len(texts) ** 2 / 10          # all pairs: half of the square


def test_training_texts_are_drawn_by_their_hashes(spark, monkeypatch):
    """Only the rows drawn hand on their texts; they are those of the smallest hashes, ties and
    repeated rows included."""
    monkeypatch.setattr(langid, "SAMPLE", 7)
    rows = [(i if i % 9 else None, f"text {i % 150}", ("de", "en", "fr")[i % 3 if i < 290 else 2]) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string").repartition(8)
    every = docs.withColumn("hash", F.xxhash64("doc_id", "text")).collect()
    want = []
    for lang in ("de", "en", "fr"):
        of = sorted((x.hash, -1 if x.doc_id is None else x.doc_id, x.text) for x in every if x.lang == lang)
        want += [(lang, *x) for x in of if x[0] <= of[6][0]]
    got = [(x.lang, x.hash, -1 if x.doc_id is None else x.doc_id, x.text) for x in langid.drawn(docs).collect()]
    assert sorted(got) == sorted(want) and len(got) < 40
    kept = []
    monkeypatch.setattr(langid, "train", lambda rows: kept.extend(rows))
    langid.fit(docs)
    of = {lang: sorted((x.hash, -1 if x.doc_id is None else x.doc_id, x.text) for x in every if x.lang == lang)[:7]
          for lang in ("de", "en", "fr")}
    assert sorted(kept) == sorted((t, lang) for lang, xs in of.items() for _, _, t in xs)


def test_training_holds_the_features_of_each_word_once(monkeypatch):
    """The driver's memory follows the distinct words; the model is the one of all words."""
    rng = random.Random(3)
    words = {k: [f"{k}{i}é" for i in range(60)] for k in ("al", "be", "ga")}
    rows = [(" ".join(rng.choice(words[k]) for _ in range(50)) + "\n" + rng.choice(words[k]), k) for k in words for _ in range(8)]
    features, asked = langid.features, []
    monkeypatch.setattr(langid, "features", lambda w, pick: asked.append(len(pick)) or features(w, pick))
    model = langid.train(rows)
    assert sum(asked) <= 180 and model.langs == ["al", "be", "ga"]
    slot, at = features(w := langid.Words(*_bytes_of([t for t, _ in rows]), langid.IS_LETTER), np.arange(len(w.start)))
    every = np.split(slot, at[1:])
    for i in range(0, len(every), 7):              # the same word has the same features at each place
        j = int(np.flatnonzero(w.hash == w.hash[i])[0])
        assert np.array_equal(every[i], every[j])


def _bytes_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def test_small_tables_of_terms_are_not_shuffled(spark):
    """The tables between the steps have sizes of their own: joins with small ones are broadcast."""
    texts = [(i, f"word{i} alpha beta mail{i % 5}@example.org gamma delta{i % 7} term{i % 5}") for i in range(60)]
    s = pii.spans(spark.createDataFrame(texts, "doc_id long, text string"))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and plan.count("BroadcastHashJoin") >= 3, plan
    assert s.count() == 60
