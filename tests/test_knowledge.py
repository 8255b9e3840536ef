"""Hand-made edge rows for the knowledge-base operators (NULL wildcards, thresholds,
orientation, ties, enum order), checked against small brute-force references."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerline.functions.enums import OUTCOMES, enum_rank
from ledgerline.operators import knowledge as K

BENCH_SCHEMA = ("sector string, stage string, metric_name string, value_median double, value_good double, "
                "value_excellent double, value_warning double")


def _levels(spark, bench_rows, obs_rows):
    bench = spark.createDataFrame(bench_rows, BENCH_SCHEMA)
    obs = spark.createDataFrame(obs_rows, "obs_id int, sector string, stage string, metric_name string, value double")
    out = K.evaluate_metrics(obs, bench)
    return {r.obs_id: r.level for r in out.collect()}


def test_metric_levels_higher_is_better_and_ties_inclusive(spark):
    bench = [("saas", "seed", "nps", 30.0, 50.0, 70.0, 10.0)]
    obs = [(1, "saas", "seed", "nps", 70.0), (2, "saas", "seed", "nps", 50.0), (3, "saas", "seed", "nps", 30.0),
           (4, "saas", "seed", "nps", 29.9), (5, "saas", "seed", "nps", 10.0), (6, "saas", "seed", "other", 1.0),
           (7, "fintech", "seed", "nps", 99.0)]
    lv = _levels(spark, bench, obs)
    assert lv == {1: "excellent", 2: "good", 3: "median", 4: "warning", 5: "warning", 6: "unknown", 7: "unknown"}


def test_metric_levels_lower_is_better_and_null_thresholds(spark):
    bench = [("saas", "seed", "churn", 8.0, 5.0, 3.0, 12.0),          # excellent < warning: lower is better
             ("saas", "seed", "flat", None, None, None, None),        # all NULL: lower-is-better, all skipped
             ("saas", "seed", "same", 5.0, 5.0, 4.0, 4.0),            # excellent == warning: lower is better
             ("saas", "seed", "gap", None, 5.0, 9.0, None)]           # NULL median skipped
    obs = [(1, "saas", "seed", "churn", 3.0), (2, "saas", "seed", "churn", 5.0), (3, "saas", "seed", "churn", 8.0),
           (4, "saas", "seed", "churn", 8.1), (5, "saas", "seed", "flat", 1.0), (6, "saas", "seed", "same", 4.0),
           (7, "saas", "seed", "same", 4.5), (8, "saas", "seed", "gap", 4.0), (9, "saas", "seed", "gap", 9.0)]
    lv = _levels(spark, bench, obs)
    assert lv == {1: "excellent", 2: "good", 3: "median", 4: "warning", 5: "warning", 6: "excellent",
                  7: "good", 8: "warning", 9: "excellent"}


RISKS = [(1, "r1", None, None, "high", "c"), (2, "r2", "saas", None, "critical", "c"),
         (3, "r3", None, "seed", "critical", "c"), (4, "r4", "saas", "seed", "low", "c"),
         (5, "r5", "fintech", "seed", "critical", "c"), (6, "r6", "saas", "seed", "critical", "c"),
         (7, "r7", None, None, "critical", "c")]
RISK_SCHEMA = "id long, pattern_name string, sector string, stage string, criticality string, category string"


def test_wildcard_filter_and_order(spark):
    risks = spark.createDataFrame(RISKS, RISK_SCHEMA)
    top = [r.id for r in K.risk_patterns_filter(risks, sector="saas", stage="seed", limit=10).collect()]
    # critical first; sector-specific before universal; ties by id
    assert top == [2, 6, 3, 7, 1, 4]
    assert [r.id for r in K.risk_patterns_filter(risks, limit=2).collect()] == [2, 5]


def test_segment_join_equals_theta_join(spark):
    risks = spark.createDataFrame(RISKS, RISK_SCHEMA)
    st = spark.createDataFrame([(1, "saas", "seed"), (2, "saas", "growth"), (3, "fintech", "seed"), (4, "edtech", "idea")],
                               "id long, sector string, stage string")
    got = {(r.sector, r.stage, r.risk_id) for r in K.segment_risk_join(st, risks).collect()}
    want = {(s, g, rid) for _, s, g in [(1, "saas", "seed"), (2, "saas", "growth"), (3, "fintech", "seed"),
                                        (4, "edtech", "idea")]
            for rid, _, rs, rg, _, _ in RISKS if (rs is None or rs == s) and (rg is None or rg == g)}
    assert got == want
    exposure = {r.startup_id: (r.n_risks, r.n_critical) for r in K.startup_risk_exposure(st, risks).collect()}
    assert exposure == {1: (6, 4), 2: (3, 2), 3: (4, 3), 4: (2, 1)}
    top = K.top_risks_per_startup(st, risks, k=2).collect()
    assert sorted((r.startup_id, r.risk_rank, r.risk_id) for r in top) == [
        (1, 1, 2), (1, 2, 6), (2, 1, 2), (2, 2, 7), (3, 1, 5), (3, 2, 3), (4, 1, 7), (4, 2, 1)]


def test_similar_startups_null_year_first_and_zero_pivots(spark):
    st = spark.createDataFrame([(1, "saas", 2010), (2, "saas", None), (3, "saas", 2015), (4, "saas", 2001)],
                               "id long, sector string, founding_year int").withColumn("stage", F.lit("seed")) \
        .withColumn("outcome", F.lit("success"))
    pv = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 2), (14, 3), (15, None)], "id long, startup_id long")
    got = [(r.id, r.pivot_count) for r in K.similar_startups(st, pv, "saas", limit=5).collect()]
    assert got == [(2, 2), (1, 2), (3, 1), (4, 0)]
    # a pivot without startup is dropped by the inner join
    pv2 = pv.withColumn("pivot_type", F.lit("zoom-in")).withColumn("outcome", F.lit("pivot")) \
        .withColumn("trigger_value", F.lit(1.0))
    st2 = st.withColumn("region", F.lit("eu"))
    assert K.pivot_case_search(pv2, st2, limit=50).count() == 5


def test_outcome_enum_order(spark):
    df = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    got = [r.outcome for r in df.orderBy(enum_rank("outcome", OUTCOMES).desc()).collect()]
    assert got == ["ongoing", "acquired", "pivot", "failure", "success"]


def test_unknown_enum_values_sort_last(spark):
    df = spark.createDataFrame([(1, "blocker"), (2, "low"), (3, None), (4, "critical")], "id int, criticality string")
    got = [(r.id, r.criticality_rank) for r in K.priority_sort(df).collect()]
    assert got == [(4, 1), (2, 4), (1, None), (3, None)]


def _brute_mentions(terms, concepts):
    out = {}
    for t in terms:
        pat = "^.*" + "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in t.lower()) + ".*$"
        ids = [cid for cid, name, aliases in concepts
               if re.match(pat, name.lower(), re.S) or (aliases is not None and t in aliases)]
        out[t] = min(ids) if ids else None
    return out


def test_concept_mentions_matches_brute_force(spark):
    concepts = [(1, "Minimum Viable Product", ["MVP"]), (2, "Product-Market Fit", ["PMF", "fit"]),
                (3, "Pivot", None), (4, "Burn rate", ["burn"]), (5, "ab", []), (6, "x_y%z", ["X"])]
    terms = ["product", "PMF", "pmf", "pivot", "vot", "t", "", "%", "__", "___", "____________________________",
             "p_v", "m%t", "x_y", "zzz", "r", "fit", "Fit", "burn r", "%z", "b_"]
    cdf = spark.createDataFrame(concepts, "id long, concept_name string, aliases array<string>") \
        .withColumn("category", F.lit("metric")).withColumn("simple_def", F.lit("d"))
    req = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.term: r.id for r in K.concept_mentions(req, cdf).collect()}
    assert got == _brute_mentions(terms, concepts)


def test_validate_requests(spark):
    df = spark.createDataFrame([("x" * 50, "vc", "seed", "simple", 5), ("short", "ceo", "mature", "deep", 99)],
                               "description string, investor_profile string, stage string, detail_level string, limit int")
    rows = K.validate_requests(df).collect()
    assert rows[0].valid and rows[0].reasons == []
    assert set(rows[1].reasons) == {"description_too_short", "bad_profile", "bad_stage", "bad_detail_level", "bad_limit"}


def test_concept_mentions_store_no_names_and_take_repeated_rows(spark, monkeypatch):
    """What is written between the passes follows the terms, whatever the number of names."""
    rows = [(i, f"Steel bolt number {i}", ["b"]) for i in range(500)] + [(7, "Steel bolt number 7", ["b"])] * 2 + [(None, "brass nut", None), (900, None, ["nut"])]
    cdf = spark.createDataFrame(rows, "id long, concept_name string, aliases array<string>")
    terms = ["bolt number", "number 7", "number 499", "eel", "b", "brass", "nut", "b%7", "_l n", None, "number 5000"]
    stored = []
    real = K.keep

    def counted(df, name):
        out = real(df, name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(K, "keep", counted)
    got = {r.term: r.id for r in K.concept_mentions(spark.createDataFrame([(t,) for t in terms], "term string"), cdf).collect()}
    want = _brute_mentions([t for t in terms if t], [r for r in rows if r[0] is not None and r[1] is not None] + [(900, "", ["nut"])])
    assert got == want
    assert max(stored) <= sum(len(t) for t in terms if t)
