"""What the next review found."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import neardup


def test_copies_without_their_source_meet_by_their_own_edits(spark, monkeypatch):
    """A large group of edited copies, none of which is the source: what one copy has edited is no
    difference of all others, so few pairs meet, and the classes are those from all pairs."""
    signatures, meeting = neardup.signatures, neardup._meeting
    monkeypatch.setattr(neardup, "signatures", lambda *a: signatures(*a).withColumn("bands", F.array(F.lit(1).cast("bigint"))))
    monkeypatch.setattr(neardup, "AGREE", 0)
    r = random.Random(21)
    source = [f"w{r.randrange(10_000)}" for _ in range(150)]
    texts = []
    for i in range(180):
        words = list(source)
        for k in r.sample(range(150), r.choice([2, 3, 4, 5, 6])):
            words[k] = f"e{r.randrange(100_000)}"
        texts.append(" ".join(words))
        if i % 12 == 0:                          # a partner in the edits
            texts.append(" ".join(words[:-1] + ["other"]))
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []

    def counted(told, last):
        pairs = neardup.written(meeting(told, last))
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_meeting", counted)
    named = {}
    for small in (10 ** 6, 2):                   # all pairs of the key, then by differences
        monkeypatch.setattr(neardup, "SMALL", small)
        named[small] = {(x.doc_id, x.class_id) for x in neardup.classes(docs).collect()}
    assert named[2] == named[10 ** 6] and 20 < len({c for _, c in named[2]}) < len(texts)
    assert met and sum(met) < len(texts) ** 2 / 40, met     # all pairs: half of the square


def test_a_centre_holds_what_most_members_hold(spark):
    core = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)], "cluster long, rep long")
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e a b c d e"), (3, "v w x y z"), (4, "one"), (5, "two")],
                                  "doc_id long, text string")
    got = {x.cluster: (len(x.shingles), list(x.counts)) for x in neardup.centres(core, texts).collect()}
    assert got == {1: (1, [2]), 2: (0, [])}          # counts of 1 and 2, rounded up
    idf = np.ones(neardup.FEATURES, np.float32)
    members = core.select("cluster", F.col("rep").alias("label"), "rep", F.col("rep").alias("lead"))
    told = neardup.differences(members, texts, idf, neardup.centres(core, texts)).collect()
    for x in told:
        weight = 1 + np.log(2) if x.cluster == 1 else 0
        assert abs(x.size - weight) < 1e-6 and len(x.every) == len(x.tail)
        assert abs(x.over + x.under - (x.tail[0] if x.tail else 0)) < 1e-6
