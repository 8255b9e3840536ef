"""Dataset-quality edge cases: empty conversations, NULL roles, missing vs NULL metadata,
Unicode blanks, duplicates, and the split / position invariants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from ledgerline.operators import splits as S

MSG_SCHEMA = "example_id long, turn long, role string, content string"


def _facts(spark, meta_rows, msg_rows, meta_schema):
    meta = spark.createDataFrame(meta_rows, meta_schema)
    msgs = spark.createDataFrame(msg_rows, MSG_SCHEMA)
    return Q.example_facts(meta, msgs)


def test_role_errors_count_entries(spark):
    meta = [(1,), (2,), (3,), (4,)]
    msgs = [(2, 0, "system", "s"), (2, 1, None, "x"), (2, 2, "assistant", "a"),       # NULL role, no user
            (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a"),    # clean
            (4, 0, "user", "u"), (4, 1, "bot", "b")]                                 # bad first/last + bad role
    facts = _facts(spark, meta, msgs, "example_id long")
    got = sorted((r.example_id, r.error, r.detail) for r in Q.role_errors(facts).collect())
    assert got == [(1, "no_user", None), (1, "sequence", None),       # empty conversation: two entries
                   (2, "invalid_roles", "NULL"), (2, "no_user", None),
                   (4, "invalid_roles", "bot"), (4, "sequence", None)]


def test_metadata_missing_versus_null(spark):
    meta = spark.createDataFrame([
        (1, '{"category": "c", "Label": "Green Flag", "Severity": "Majeur", "Difficulty": "Mixte", '
            '"has_tool_use": false, "lean_principle": "p"}'),
        (2, '{"category": "c", "Severity": null, "Difficulty": "Mixte", "has_tool_use": true, "lean_principle": "p"}'),
    ], "example_id long, metadata_json string")
    msgs = spark.createDataFrame([], MSG_SCHEMA)
    facts = Q.example_facts(meta, msgs)
    got = sorted((r.example_id, r.error) for r in Q.metadata_errors(facts).collect())
    # a missing Label adds two entries; an explicit null Severity only fails the domain check
    assert got == [(2, "invalid:Label"), (2, "invalid:Severity"), (2, "missing:Label")]
    dist = {(r.dimension, r.value): r["count"] for r in Q.value_distributions(facts).collect()}
    assert dist[("Label", "unknown")] == 1 and dist[("Severity", None)] == 1
    assert dist[("sector", "unknown")] == 2


def test_label_and_tool_flag_checks(spark):
    meta = [(1, "Red Flag", True), (2, "Mixed", False), (3, "Green Flag", False)]
    msgs = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "Label: Red Flag\nold"),
            (1, 3, "assistant", "final without label"),                           # label only in an early turn
            (2, 0, "system", "s"), (2, 1, "tool", "{}"), (2, 2, "assistant", "Label: Mixed"),
            (3, 0, "system", "s"), (3, 1, "user", "u")]                             # no assistant at all
    facts = _facts(spark, meta, msgs, "example_id long, Label string, has_tool_use boolean")
    assert sorted(r.example_id for r in Q.label_mismatches(facts).collect()) == [1, 3]
    assert sorted((r.example_id, r.error) for r in Q.tool_flag_errors(facts).collect()) == [
        (1, "flag_without_tool"), (2, "tool_without_flag")]


def test_prompt_normalisation_unicode_blanks_and_duplicates(spark):
    meta = [(1,), (2,), (3,), (4,)]
    msgs = [(1, 0, "user", "Hello  World"), (1, 1, "user", "again"),
            (2, 0, "user", " hello world AGAIN "),
            (3, 0, "user", "other"), (4, 0, "system", "no user text")]
    facts = _facts(spark, meta, msgs, "example_id long")
    texts = {r.example_id: r.p for r in facts.select(
        "example_id", Q.normalise_prompt(F.col("user_text")).alias("p")).collect()}
    assert texts == {1: "hello world again", 2: "hello world again", 3: "other", 4: ""}
    assert Q.duplicate_count(facts, "prompt_hash").first().duplicates == 1


def test_split_is_lossless_disjoint_exact_and_reproducible(spark):
    for n, want in ((100, {"train": 80, "val": 10, "test": 10}), (1000, {"train": 800, "val": 100, "test": 100})):
        meta = spark.range(n).select(
            F.col("id").alias("example_id"),
            F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.col("id") % 4 + 1).cast("int")).alias("category"),
            F.when(F.col("id") % 7 == 0, "Mixed").otherwise("Red Flag").alias("Label"),
            F.lit("Mixte").alias("Difficulty"), (F.col("id") % 3 == 0).alias("has_tool_use"))
        facts = Q.normalise_metadata(meta)
        a = S.stratified_split(facts).select("example_id", "split")
        b = S.stratified_split(facts.repartition(7)).select("example_id", "split")
        rows = a.collect()
        assert len(rows) == n and len({r.example_id for r in rows}) == n
        counts = {}
        for r in rows:
            counts[r.split] = counts.get(r.split, 0) + 1
        assert counts == want
        assert sorted(map(tuple, rows)) == sorted(map(tuple, b.collect()))


def test_positions_match_a_full_sort_with_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 17).cast("string")).alias("g"),
        F.sha1(F.col("id").cast("string")).alias("h"), F.col("id"))
    got = S.global_positions(df, "h", "id", ["g"], out="pos").select("id", "pos")
    want = df.withColumn("pos", F.row_number().over(Window.orderBy("g", "h", "id")) - 1).select("id", "pos")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_n_per_kind(spark):
    entries = spark.range(50).select(F.col("id").alias("example_id"), F.lit("e").alias("error"),
                                     F.when(F.col("id") < 45, "big").otherwise("small").alias("kind"))
    out = Q.first_n_per_kind(entries, ("big", "small"), 20).collect()
    big = sorted(r.example_id for r in out if r.kind == "big")
    assert big == list(range(20)) and {r.n_more for r in out if r.kind == "big"} == {25}
    assert {r.n_more for r in out if r.kind == "small"} == {0}


def test_positions_by_order_with_outlier_ids(spark):
    ids = spark.range(3000).select(F.when(F.col("id") == 7, F.lit(10 ** 15)).otherwise(F.col("id") * 2).alias("k"))
    from ledgerline.operators.ranking import positions_within
    got = positions_within(ids, [], ["k"], out="pos").select("k", "pos")
    assert sorted(map(tuple, S.positions_by_order(ids, ["k"]).select("k", "pos").collect())) == \
        sorted(map(tuple, got.collect()))
    want = ids.withColumn("pos", F.row_number().over(Window.orderBy("k")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_positions_within_hot_group_outliers_and_null_keys(spark):
    from ledgerline.operators.ranking import percentile_disc, positions_within
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise((F.col("id") % 5).cast("string")).alias("g"),
        F.when(F.col("id") == 10, F.lit(1e12)).otherwise((F.col("id") * 37) % 1000).cast("double").alias("v"),
        F.col("id"))
    got = positions_within(df, ["g"], ["v", "id"], out="pos").select("id", "pos")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "pos").collect()))
    pct = {r.g: (r.p10, r.p50, r.p90) for r in percentile_disc(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    vals = {}
    for r in df.collect():
        vals.setdefault(r.g, []).append(r.v)
    import math
    for g, xs in vals.items():
        xs.sort()
        assert pct[g] == tuple(xs[max(1, math.ceil(p * len(xs) - 1e-9)) - 1] for p in (0.1, 0.5, 0.9))


def test_percentiles_of_any_type_with_repeated_values(spark):
    from ledgerline.operators.ranking import percentile_disc
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("g"),
        F.when(F.col("id") % 4 == 0, "same").otherwise(F.sha1(F.col("id").cast("string"))).alias("s"),
        F.when(F.col("id") % 5 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int"))).alias("d"))
    rows = df.collect()
    for col in ("s", "d"):
        got = {r.g: (r.p0, r.p25, r.p100) for r in percentile_disc(df, ["g"], col, {"p0": 0.0, "p25": 0.25, "p100": 1.0}).collect()}
        groups = {}
        for r in rows:
            if r[col] is not None:
                groups.setdefault(r.g, []).append(r[col])
        assert set(got) == set(groups)
        for g, xs in groups.items():
            xs.sort()
            assert got[g] == (xs[0], xs[-(-len(xs) // 4) - 1], xs[-1])


def test_running_sums_and_minima_with_and_without_groups(spark):
    from ledgerline.operators.ranking import running_min, running_sum
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
                                  F.col("id").alias("k"), F.when(F.col("id") % 13 > 0, (F.col("id") * 7919) % 1000).alias("v"))
    for groups in ([], ["g"]):
        w = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("k")
        least = df.withColumn("m", F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("k", "m")
        assert sorted(map(tuple, running_min(df, groups, ["k"], "v", "m").select("k", "m").collect()), key=str) == sorted(map(tuple, least.collect()), key=str)
        before = F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        every = F.sum("x").over(Window.partitionBy(*groups))
        d = df.withColumn("x", F.col("k") % 17)
        want = sorted(map(tuple, d.withColumn("s", before).withColumn("t", every).select("k", "s", "t").collect()))
        got = running_sum(d, groups, ["k"], F.col("x"), "s", total="t").select("k", "s", "t")
        assert sorted(map(tuple, got.collect())) == want
        assert running_sum(d.limit(0), groups, ["k"], F.col("x"), "s", total="t").count() == 0


def test_canonical_json_and_line_hash(spark):
    a = '{"b": 1, "a": {"y": [1, {"q": null, "p": "é"}], "x": 2}}'
    b = '{"a":{"x":2,"y":[1,{"p":"é","q":null}]},"b":1}'
    rows = [(1, [("user", "hi")], a), (2, [("user", "hi")], b), (3, [("user", "hi")], a.replace("2}", "3}")),
            (4, [("user", "ho")], a), (5, [("user", "hi")], "no json"), (6, None, None)]
    df = spark.createDataFrame(rows, "example_id long, messages array<struct<role: string, content: string>>, metadata_json string")
    h = {r.example_id: r.h for r in df.select("example_id", Q.line_hash(df).alias("h")).collect()}
    assert h[1] == h[2] and len(set(h.values())) == 5
    said = [r.c for r in df.where("example_id < 3 or example_id = 5").orderBy("example_id").select(Q.canonical_json(F.col("metadata_json")).alias("c")).collect()]
    assert said == [b, b, "no json"]


def test_flat_duplicates_look_at_unlisted_columns_and_the_id(spark):
    meta = spark.createDataFrame([(1, "c", "x"), (2, "c", "x")], "example_id long, category string, note string")
    msgs = spark.createDataFrame([(1, 0, "user", "q"), (2, 0, "user", "q")], "example_id long, turn long, role string, content string")
    m = Q.quality_metrics(Q.example_facts(meta, msgs)).first()
    assert (m.total, m.duplicate_full, m.duplicate_user) == (2, 0, 1)
    empty = Q.quality_metrics(Q.example_facts(meta.limit(0), msgs)).first()
    assert (empty.total, empty.duplicate_full, empty.tool_use_ratio) == (0, 0, None)
