"""Training-run and evaluation analytics: metric series, run summaries, answer scores,
version comparison and promotion decisions.

Inputs are tables: a training log ``(run_id, step, log_key, value)``, per-example
losses, scored answers, and the model registry ``(model_name, version, stage, run_id)``.
Latest-per-group picks use ``max_by`` aggregates (partial aggregation, no sort of a
whole group); running minima are block scans (``ranking.running_min``), so a very long run
is not ranked inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.sizing import attach_one_row
from ledgerline.operators.ranking import running_min

# Thresholds of the training and promotion rules.
PERPLEXITY_MAX_LOSS = 10.0
STAGING_MAX_EVAL_LOSS = 2.5
MAX_REGRESSION_DELTA = 0.10
MIN_TOOL_CALL_ACCURACY = 0.70
STRUCTURE_MIN_CHARS = 300
KEYWORD_HIT_SHARE = 0.5


def perplexity(loss: Column, overflow: str = "omit") -> Column:
    """``exp(loss)`` guarded against overflow: above ``loss >= 10`` it is NULL (``omit``),
    ``0`` (``zero``) or ``999`` (``cap999``)."""
    fallback = {"omit": F.lit(None).cast("double"), "zero": F.lit(0.0), "cap999": F.lit(999.0)}[overflow]
    return F.when(loss < PERPLEXITY_MAX_LOSS, F.exp(loss)).otherwise(fallback)


# --- W5 --------------------------------------------------------------------
def metric_series(logs: DataFrame) -> DataFrame:
    """Trainer logs -> logged metrics ``(run_id, step, metric, value)``.

    ``loss`` -> ``train/loss`` (+ ``train/perplexity`` below loss 10); ``learning_rate``
    -> ``train/learning_rate``; other train keys -> ``train/<key>``; ``eval_*`` keys ->
    ``eval/<key without eval_>`` (+ ``eval/perplexity`` for the loss); plus
    ``eval/best_loss_so_far``, the running minimum of the eval loss.
    """
    key, v = F.col("log_key"), F.col("value")
    is_eval = key.startswith("eval_")
    clean = F.replace(key, F.lit("eval_"), F.lit(""))
    name = F.when(is_eval, F.concat(F.lit("eval/"), clean)).otherwise(F.concat(F.lit("train/"), key))
    ppl_name = F.when(is_eval & (clean == "loss"), F.lit("eval/perplexity")).when(
        ~is_eval & (key == "loss"), F.lit("train/perplexity"))
    items = F.array(F.struct(name.alias("metric"), v.alias("value")),
                    F.when(ppl_name.isNotNull() & (v < PERPLEXITY_MAX_LOSS),
                           F.struct(ppl_name.alias("metric"), F.exp(v).alias("value"))))
    base = logs.select("run_id", "step", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("m")) \
        .select("run_id", "step", "m.metric", "m.value")
    evals = base.where(F.col("metric") == "eval/loss")
    best = running_min(evals, ["run_id"], ["step"], "value", "_best").select(
        "run_id", "step", F.lit("eval/best_loss_so_far").alias("metric"), F.col("_best").alias("value"))
    return base.unionByName(best)


# --- A16 -------------------------------------------------------------------
def run_summary(series: DataFrame) -> DataFrame:
    """Per run: last step, best eval loss and its perplexity, best step, final losses."""
    m, v, s = F.col("metric"), F.col("value"), F.col("step")
    ev = m == "eval/loss"
    out = series.groupBy("run_id").agg(
        F.max(s).alias("total_steps"),
        F.min(F.when(ev, v)).alias("best_eval_loss"),
        F.min_by(s, F.when(ev, F.struct(v, s))).alias("best_step"),
        F.max_by(v, F.when(ev, s)).alias("final_eval_loss"),
        F.max_by(v, F.when(m == "train/loss", s)).alias("final_train_loss"))
    return out.withColumn("best_perplexity", perplexity(F.col("best_eval_loss")))


# --- A15 -------------------------------------------------------------------
def mean_loss(losses: DataFrame, by: str | None = None, overflow: str = "cap999") -> DataFrame:
    """Mean per-example loss (4 dp), its perplexity (2 dp) and the sample count; 0 when empty."""
    grouped = losses.groupBy(by) if by else losses.groupBy()
    # Exact decimal mean: the 4-digit rounding must not depend on summation order.
    exact = F.avg(F.col("loss").cast("decimal(30,12)"))
    out = grouped.agg(F.coalesce(exact, F.lit(0).cast("decimal(30,12)")).alias("_avg"),
                      F.count("loss").alias("test_samples"))
    return out.select(*([by] if by else []), F.round("_avg", 4).cast("double").alias("eval_loss"),
                      F.round(perplexity(F.col("_avg").cast("double"), overflow), 2).alias("eval_perplexity"),
                      "test_samples")


# --- A18 -------------------------------------------------------------------
def final_metrics(run_metrics: DataFrame, default: float = 999.0) -> DataFrame:
    """Per run: ``final/eval_loss``, else ``eval/best_loss``, else ``default``.

    ``run_metrics`` is ``(run_id, metric, step, value)``; each key's latest value counts.
    """
    m, s, v = F.col("metric"), F.col("step"), F.col("value")
    latest = run_metrics.groupBy("run_id").agg(
        F.max_by(v, F.when(m == "final/eval_loss", s)).alias("final_eval_loss"),
        F.max_by(v, F.when(m == "eval/best_loss", s)).alias("best_loss"),
        F.max_by(v, F.when(m == "final/eval_perplexity", s)).alias("final_eval_perplexity"))
    return latest.withColumn("eval_loss", F.coalesce("final_eval_loss", "best_loss", F.lit(default)))


# --- F14 / F15 / F17 / A14 ----------------------------------------------------
def keyword_share(answer_lower: Column, keywords: Column) -> Column:
    found = F.filter(keywords, lambda kw: F.instr(answer_lower, F.lower(kw)) > 0)
    return F.size(found) / F.size(keywords)


def has_structure(answer_lower: Column) -> Column:
    return (F.length(answer_lower) > STRUCTURE_MIN_CHARS) & (
        answer_lower.contains("##") | answer_lower.contains("**") | answer_lower.contains("\n-"))


def perplexity_band(ppl: Column) -> Column:
    # Interpretation sentences of the evaluation report.
    return (F.when(ppl < 10, "Excellent — le modèle est très confiant dans ses réponses.")
            .when(ppl < 20, "Bon — niveau acceptable pour une mise en production.")
            .when(ppl < 35, "Correct — envisager plus d'epochs ou un dataset plus large.")
            .otherwise("Insuffisant — le modèle nécessite plus d'entraînement."))


def answer_scores(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Per answer: tool call as expected, structure, keyword ratio (2 dp) and keyword hit.

    ``answers``: ``(answer_id, case_id, answer, tool_calls_made)``; ``cases``: ``(case_id,
    expected_tool_call, expected_keywords, category)``.
    """
    j = answers.join(cases, "case_id")
    low = F.lower(F.coalesce("answer", F.lit("")))
    share = keyword_share(low, F.col("expected_keywords"))
    return j.select("answer_id", "case_id", "category",
                    ((F.col("tool_calls_made") > 0) == F.col("expected_tool_call")).alias("tool_call_ok"),
                    has_structure(low).alias("structure_ok"),
                    F.round(share, 2).alias("keyword_ratio"),
                    (share >= KEYWORD_HIT_SHARE).alias("keyword_hit"),
                    F.length(low).alias("response_length"))


# The four evaluation cases (expected tool use, expected keywords).
EVALUATION_CASES = (
    (0, "tc_marketplace_preseed", "angel", True, ("cold start", "marketplace", "artisans", "risque"), "diagnostic"),
    (1, "tc_saas_churn", "entrepreneur", True, ("churn", "rétention", "clients", "product"), "diagnostic"),
    (2, "tc_concept_mvp", "entrepreneur", True, ("minimum", "viable", "tester", "utilisateurs"), "concept"),
    (3, "tc_fintech_danger", "impact", True, ("licence", "régulation", "défaut", "risque"), "danger"),
)


def evaluation_cases(spark) -> DataFrame:
    rows = [(i, cid, prof, exp, list(kws), cat) for i, cid, prof, exp, kws, cat in EVALUATION_CASES]
    return spark.createDataFrame(rows, "case_id int, case_name string, investor_profile string, "
                                       "expected_tool_call boolean, expected_keywords array<string>, category string")


def score_summary(scores: DataFrame, by: str | None = None) -> DataFrame:
    """Shares of hits over all answers (3 dp), or per ``by``: tool accuracy, structure, keyword coverage."""
    return (scores.groupBy(by) if by else scores).agg(
        F.round(F.avg(F.col("tool_call_ok").cast("double")), 3).alias("tool_call_accuracy"),
        F.round(F.avg(F.col("structure_ok").cast("double")), 3).alias("structure_score"),
        F.round(F.avg(F.col("keyword_hit").cast("double")), 3).alias("keyword_coverage"),
        F.count(F.lit(1)).alias("cases_evaluated"))


# --- W1 / W2 ---------------------------------------------------------------
def latest_version_per_stage(versions: DataFrame) -> DataFrame:
    """Newest version (compared as a number) per model and stage."""
    num = F.col("version").cast("bigint")
    return versions.groupBy("model_name", "stage").agg(
        F.max_by(F.struct("version", "run_id"), num).alias("v")).select("model_name", "stage", "v.version", "v.run_id")


def latest_run_for_token(runs: DataFrame, token_match: Column, experiment: str = "experiment_id",
                         start: str = "start_time", run: str = "run_id") -> DataFrame:
    """Per experiment: the newest run carrying the tag, else the newest run at all."""
    key = F.struct(token_match.cast("int").alias("m"), F.col(start).alias("t"), F.col(run).alias("r"))
    return runs.groupBy(experiment).agg(F.max_by(F.struct(F.col(run).alias("run_id"), token_match.alias("matched")),
                                                 key).alias("p")).select(experiment, "p.run_id", "p.matched")


# --- J11 / D6 / D7 -----------------------------------------------------------
def compare_versions(versions: DataFrame, run_loss: DataFrame,
                     max_regression: float = MAX_REGRESSION_DELTA) -> DataFrame:
    """Staging against production per model: losses, delta, relative delta, decision.

    ``run_loss``: ``(run_id, eval_loss)``. A missing production loss counts as +inf,
    no production version means promotion.
    """
    latest = latest_version_per_stage(versions.where(F.col("stage").isin("Staging", "Production")))
    losses = run_loss.select("run_id", "eval_loss")
    st = latest.where(F.col("stage") == "Staging").join(losses, "run_id", "left").select(
        "model_name", F.col("version").alias("staging_version"), F.col("eval_loss").alias("staging_loss"))
    pr = latest.where(F.col("stage") == "Production").join(losses, "run_id", "left").select(
        "model_name", F.col("version").alias("production_version"),
        F.coalesce("eval_loss", F.lit(float("inf"))).alias("production_loss"))
    j = st.join(pr, "model_name", "left")
    has_prod = F.col("production_version").isNotNull()
    delta = F.col("staging_loss") - F.col("production_loss")
    pct = F.when(F.col("production_loss") > 0, delta / F.col("production_loss")).otherwise(F.lit(0.0))
    promote = ~has_prod | ~(pct > max_regression)
    reason = (F.when(~has_prod, "first_production").when(pct > max_regression, "regression")
              .when(delta <= 0, "improvement").otherwise("marginal_degradation"))
    return j.select("model_name", has_prod.alias("has_production"), promote.alias("should_promote"),
                    reason.alias("reason"), "staging_version", "staging_loss", "production_version",
                    F.when(has_prod, F.col("production_loss")).alias("production_loss"),
                    F.when(has_prod, F.round(delta, 4)).alias("delta"),
                    F.when(has_prod, F.round(pct, 4)).alias("delta_pct"))


def staging_gate(versions: DataFrame, run_loss: DataFrame, max_eval_loss: float = STAGING_MAX_EVAL_LOSS) -> DataFrame:
    """Per trained run ``run_loss(run_id, model_name, eval_loss)``: does its eval loss (999 when
    missing) pass the threshold, and what follows for the model it was trained for.

    A run above the threshold stops there, whatever is registered. A passing one needs a
    registered version: without any the reason is ``no_version``; else the model's newest
    version is promoted, and it ends in Staging unless it is in Staging or Production already.
    """
    latest = versions.groupBy("model_name").agg(F.max_by(F.struct("version", "stage"),
                                                         F.col("version").cast("bigint")).alias("v"))
    loss = F.coalesce("eval_loss", F.lit(999.0))
    j = (run_loss.select("run_id", "model_name", loss.alias("eval_loss"), (loss < max_eval_loss).alias("passes_threshold"))
         .join(latest, "model_name", "left"))
    promoted = F.col("passes_threshold") & F.col("v").isNotNull()
    return j.select("run_id", "model_name", "eval_loss", "passes_threshold", promoted.alias("promoted"),
                    F.when(~F.col("passes_threshold"), "eval_loss_above_threshold")
                    .when(F.col("v").isNull(), "no_version").alias("reason"),
                    F.when(promoted, F.col("v.version")).alias("version"),
                    F.when(promoted & F.coalesce(F.col("v.stage").isin("Staging", "Production"), F.lit(False)), F.col("v.stage"))
                    .when(promoted, F.lit("Staging")).alias("new_stage"))


def promotion_decision(comparison: DataFrame, evaluations: DataFrame,
                       min_tool_accuracy: float = MIN_TOOL_CALL_ACCURACY) -> DataFrame:
    """All rejection reasons per model; promoted when there is none.

    ``evaluations``: ``(model_name, tool_call_accuracy, source, error)``, the qualitative
    evaluation of each model. A missing accuracy counts as 0; ``source = 'error'`` means that the
    evaluation itself failed, and ``error`` says how.
    """
    j = comparison.join(evaluations.select("model_name", "tool_call_accuracy", "source", "error"), "model_name", "left")
    failed = F.coalesce(F.col("source") == "error", F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~F.col("should_promote"), F.concat(F.lit("regression: "), "reason")),
        F.when(F.coalesce(F.col("tool_call_accuracy"), F.lit(0.0)) < min_tool_accuracy, F.lit("tool_accuracy")),
        F.when(failed, F.concat(F.lit("evaluation_error: "), F.coalesce("error", F.lit("None"))))))
    return j.select("model_name", "staging_version", "production_version", reasons.alias("rejection_reasons"),
                    (F.size(reasons) == 0).alias("promoted"),
                    F.when(F.size(reasons) == 0, "Production").otherwise("Staging").alias("model_stage"))


def apply_promotion(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Registry after the decision: staging version -> Production, old Production -> Archived."""
    d = decisions.select("model_name", "promoted", "staging_version")
    j = versions.join(d, "model_name", "left")
    promoted = F.coalesce(F.col("promoted"), F.lit(False))
    new_stage = (F.when(promoted & (F.col("version") == F.col("staging_version")), "Production")
                 .when(promoted & (F.col("stage") == "Production"), "Archived").otherwise(F.col("stage")))
    return j.select("model_name", "version", "run_id", "stage", new_stage.alias("new_stage"))
