"""Metric series, run summaries, perplexity overflow, version picks and decisions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import runs as R
from ledgerline.operators.ranking import running_min


def test_perplexity_overflow_rules(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (None,)], "loss double")
    rows = df.select(*[R.perplexity(F.col("loss"), o).alias(o) for o in ("omit", "zero", "cap999")]).collect()
    assert math.isclose(rows[0].omit, math.exp(9.99)) and rows[0].cap999 == rows[0].omit
    assert (rows[1].omit, rows[1].zero, rows[1].cap999) == (None, 0.0, 999.0)


def test_metric_series_keys_and_running_best(spark):
    logs = spark.createDataFrame(
        [(1, 1, "loss", 2.0), (1, 1, "learning_rate", 1e-4), (1, 2, "eval_loss", 1.5), (1, 3, "eval_loss", 1.7),
         (1, 4, "eval_loss", 1.2), (1, 5, "loss", 12.0), (1, 5, "grad_norm", 0.3)],
        "run_id long, step int, log_key string, value double")
    s = R.metric_series(logs)
    keys = {r.metric for r in s.collect()}
    assert keys == {"train/loss", "train/perplexity", "train/learning_rate", "eval/loss", "eval/perplexity",
                    "train/grad_norm", "eval/best_loss_so_far"}
    best = [r.value for r in s.where(F.col("metric") == "eval/best_loss_so_far").orderBy("step").collect()]
    assert best == [1.5, 1.5, 1.2]
    assert s.where((F.col("metric") == "train/perplexity") & (F.col("step") == 5)).count() == 0   # loss >= 10
    summ = R.run_summary(s).first()
    assert (summ.total_steps, summ.best_eval_loss, summ.best_step, summ.final_eval_loss, summ.final_train_loss) == (
        5, 1.2, 4, 1.2, 12.0)


def test_running_min_across_step_buckets(spark):
    df = spark.range(6000).select(F.lit(7).alias("run_id"), F.col("id").alias("step"),
                                  ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    got = running_min(df, ["run_id"], ["step"], "v", "m").select("step", "m")
    want = df.withColumn("m", F.min("v").over(Window.partitionBy("run_id").orderBy("step")
                                               .rowsBetween(Window.unboundedPreceding, 0))).select("step", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_final_metrics_fallbacks(spark):
    m = spark.createDataFrame([(1, "final/eval_loss", 10, 0.9), (1, "eval/best_loss", 10, 0.8),
                               (2, "eval/best_loss", 5, 0.7), (3, "other", 5, 1.0)],
                              "run_id long, metric string, step int, value double")
    got = {r.run_id: r.eval_loss for r in R.final_metrics(m).collect()}
    assert got == {1: 0.9, 2: 0.7, 3: 999.0}


VERSIONS = "model_name string, version string, stage string, run_id long"


def test_versions_compare_as_numbers_and_decisions(spark):
    versions = spark.createDataFrame(
        [("m", "9", "Staging", 1), ("m", "10", "Staging", 2), ("m", "3", "Production", 3),
         ("n", "1", "Staging", 4),                                              # no production
         ("z", "2", "Staging", 5), ("z", "1", "Production", 6)], VERSIONS)      # production loss 0
    latest = {(r.model_name, r.stage): r.version for r in R.latest_version_per_stage(versions).collect()}
    assert latest[("m", "Staging")] == "10"
    loss = spark.createDataFrame([(2, 1.0), (3, 1.2), (4, 3.0), (5, 0.5), (6, 0.0)], "run_id long, eval_loss double")
    cmp = {r.model_name: r for r in R.compare_versions(versions, loss).collect()}
    assert cmp["m"].should_promote and cmp["m"].reason == "improvement" and cmp["m"].delta == -0.2
    assert cmp["n"].should_promote and cmp["n"].reason == "first_production" and cmp["n"].delta is None
    assert cmp["z"].should_promote and cmp["z"].delta_pct == 0.0 and cmp["z"].reason == "marginal_degradation"
    regress = spark.createDataFrame([(2, 1.5), (3, 1.2)], "run_id long, eval_loss double")
    assert R.compare_versions(versions.where("model_name = 'm'"), regress).first().reason == "regression"
    schema = "model_name string, tool_call_accuracy double, source string, error string"
    evaluations = spark.createDataFrame([("m", 0.5, "live", None), ("n", 0.9, "error", "timeout"), ("z", 0.9, "error", None)], schema)
    dec = {r.model_name: r for r in R.promotion_decision(R.compare_versions(versions, loss), evaluations).collect()}
    assert dec["m"].rejection_reasons == ["tool_accuracy"] and not dec["m"].promoted and dec["m"].model_stage == "Staging"
    assert dec["n"].rejection_reasons == ["evaluation_error: timeout"] and dec["z"].rejection_reasons == ["evaluation_error: None"]
    unseen = R.promotion_decision(R.compare_versions(versions.where("model_name = 'm'"), regress), evaluations.limit(0)).first()
    assert unseen.rejection_reasons == ["regression: regression", "tool_accuracy"]
    good = spark.createDataFrame([("m", 0.9, "live", None)], schema)
    applied = R.apply_promotion(versions, R.promotion_decision(R.compare_versions(versions, loss), good))
    stages = {(r.model_name, r.version): r.new_stage for r in applied.collect()}
    assert stages[("m", "10")] == "Production" and stages[("m", "3")] == "Archived" and stages[("m", "9")] == "Staging"
    trained = spark.createDataFrame([(2, "m", 1.0), (4, "n", 3.0), (7, "never", 1.0), (8, "never", None), (6, "z", 0.1)],
                                    "run_id long, model_name string, eval_loss double")
    gate = {r.run_id: (r.promoted, r.reason, r.version, r.new_stage) for r in R.staging_gate(versions, trained).collect()}
    assert gate == {2: (True, None, "10", "Staging"), 4: (False, "eval_loss_above_threshold", None, None), 7: (False, "no_version", None, None),
                    8: (False, "eval_loss_above_threshold", None, None), 6: (True, None, "2", "Staging")}


def test_answer_scores(spark):
    cases = R.evaluation_cases(spark)
    answers = spark.createDataFrame(
        [(1, 0, "## Plan\n" + "x" * 300 + " marketplace artisans", 1), (2, 2, "court", 0)],
        "answer_id long, case_id int, answer string, tool_calls_made long")
    s = {r.answer_id: r for r in R.answer_scores(answers, cases).collect()}
    assert s[1].tool_call_ok and s[1].structure_ok and s[1].keyword_ratio == 0.5 and s[1].keyword_hit
    assert not s[2].tool_call_ok and not s[2].structure_ok and s[2].keyword_ratio == 0.0
    summ = R.score_summary(R.answer_scores(answers, cases)).first()
    assert (summ.tool_call_accuracy, summ.structure_score, summ.keyword_coverage) == (0.5, 0.5, 0.5)


def test_running_min_keeps_null_steps_and_runs(spark):
    rows = [(1, 5, 3.0), (1, None, 4.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "run_id long, step long, value double")
    got = {(r.run_id, r.step): r.best for r in running_min(df, ["run_id"], ["step"], "value", "best").collect()}
    assert set(got) == {(1, 5), (1, None), (None, 2)} and got[(1, 5)] == 3.0 and got[(None, 2)] == 1.0
