"""Registered run, evaluation and decision queries (survey A14-A16, A18, F14, F15, F17,
W1, W2, W5, J11, D6, D7, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import outputs as O
from ledgerline.operators import quality as Q
from ledgerline.operators import runs as R
from ledgerline.plans.registry import query
from ledgerline.sources import jsonl as J
from ledgerline.sources.adapters import adapter, with_chain

TL = with_chain("training_log").rstrip()

SERIES_SQL = TL + """
, base AS (
  SELECT run_id, step, CASE WHEN starts_with(log_key, 'eval_') THEN 'eval/' || replace(log_key, 'eval_', '')
                            ELSE 'train/' || log_key END AS metric, value FROM training_log
  UNION ALL SELECT run_id, step, 'train/perplexity', round(exp(value), 6) FROM training_log WHERE log_key = 'loss' AND value < 10
  UNION ALL SELECT run_id, step, 'eval/perplexity', round(exp(value), 6) FROM training_log WHERE log_key = 'eval_loss' AND value < 10),
series AS (
  SELECT * FROM base
  UNION ALL SELECT run_id, step, 'eval/best_loss_so_far',
    min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  FROM base WHERE metric = 'eval/loss')
"""
SUMMARY_SQL = SERIES_SQL + """
, ev AS (SELECT run_id, step, value FROM series WHERE metric = 'eval/loss'),
best AS (SELECT run_id, min(value) AS best_eval_loss FROM ev GROUP BY run_id),
summary AS (
  SELECT s.run_id, CAST(max(s.step) AS INTEGER) AS total_steps, b.best_eval_loss,
    CAST((SELECT min(e.step) FROM ev e WHERE e.run_id = s.run_id AND e.value = b.best_eval_loss) AS INTEGER) AS best_step,
    arg_max(s.value, s.step) FILTER (WHERE s.metric = 'eval/loss') AS final_eval_loss,
    arg_max(s.value, s.step) FILTER (WHERE s.metric = 'train/loss') AS final_train_loss,
    CASE WHEN b.best_eval_loss < 10 THEN round(exp(b.best_eval_loss), 6) END AS best_perplexity
  FROM series s LEFT JOIN best b USING (run_id) GROUP BY s.run_id, b.best_eval_loss)
"""
RUN_LOSS_SQL = """
, run_loss AS (
  SELECT run_id,
    -- exact mean of the 12-digit decimals, rounded half-up to 4 digits in integer arithmetic
    coalesce(CAST((2 * sum(CAST(CAST(value AS DECIMAL(30, 12)) * 1000000000000 AS HUGEINT)) + count(value) * 100000000)
                  // (2 * count(value) * 100000000) AS DOUBLE) / 10000, 0.0) AS eval_loss,
    round(CASE WHEN coalesce(avg(value), 0) < 10 THEN exp(coalesce(avg(value), 0)) ELSE 999 END, 2) AS eval_perplexity,
    count(value) AS test_samples
  FROM training_log WHERE log_key = 'eval_loss' GROUP BY run_id)
"""
COMPARE_SQL = """
, lv AS (SELECT model_name, stage, version, run_id FROM (
    SELECT *, row_number() OVER (PARTITION BY model_name, stage ORDER BY CAST(version AS BIGINT) DESC) AS rn
    FROM model_versions WHERE stage IN ('Staging', 'Production')) z WHERE rn = 1),
st AS (SELECT lv.model_name, lv.version AS staging_version, rl.eval_loss AS staging_loss
       FROM lv LEFT JOIN run_loss rl USING (run_id) WHERE lv.stage = 'Staging'),
pr AS (SELECT lv.model_name, lv.version AS production_version, coalesce(rl.eval_loss, 'inf'::DOUBLE) AS production_loss
       FROM lv LEFT JOIN run_loss rl USING (run_id) WHERE lv.stage = 'Production'),
cmp0 AS (SELECT st.*, pr.production_version, pr.production_loss, st.staging_loss - pr.production_loss AS d,
           CASE WHEN pr.production_loss > 0 THEN (st.staging_loss - pr.production_loss) / pr.production_loss ELSE 0.0 END AS p
         FROM st LEFT JOIN pr USING (model_name)),
cmp AS (
  SELECT model_name, production_version IS NOT NULL AS has_production,
    production_version IS NULL OR NOT (NOT isnan(p) AND p > 0.1) AS should_promote,
    CASE WHEN production_version IS NULL THEN 'first_production' WHEN NOT isnan(p) AND p > 0.1 THEN 'regression'
         WHEN d <= 0 THEN 'improvement' ELSE 'marginal_degradation' END AS reason,
    staging_version, staging_loss, production_version,
    CASE WHEN production_version IS NOT NULL THEN production_loss END AS production_loss,
    CASE WHEN production_version IS NOT NULL THEN round(d, 4) END AS delta,
    CASE WHEN production_version IS NOT NULL THEN round(p, 4) END AS delta_pct
  FROM cmp0)
"""


def _series(spark, sf_dir):
    return R.metric_series(adapter(spark, sf_dir, "training_log"))


def _run_loss(spark, sf_dir):
    tl = adapter(spark, sf_dir, "training_log").where(F.col("log_key") == "eval_loss")
    return R.mean_loss(tl.select("run_id", F.col("value").alias("loss")), by="run_id")


def _answers(spark, sf_dir):
    """Model outputs as answers to the four cases; calls are counted in the output's own row."""
    return adapter(spark, sf_dir, "model_outputs").select(
        F.col("output_id").alias("answer_id"), (F.col("output_id") % 4).cast("int").alias("case_id"),
        O.clean_answer(F.col("output")).alias("answer"), O.calls_made(F.col("output")).alias("tool_calls_made"))


CASES_SQL = """
, cases AS (SELECT * FROM (VALUES
    (0, 'diagnostic', true, ['cold start', 'marketplace', 'artisans', 'risque']),
    (1, 'diagnostic', true, ['churn', 'rétention', 'clients', 'product']),
    (2, 'concept', true, ['minimum', 'viable', 'tester', 'utilisateurs']),
    (3, 'danger', true, ['licence', 'régulation', 'défaut', 'risque'])) t(case_id, category, expected_tool_call, kws)),
ans AS (SELECT c.output_id AS answer_id, CAST(c.output_id % 4 AS INTEGER) AS case_id,
          lower(coalesce(regexp_replace(replace(replace(replace(replace(replace(
            regexp_replace(m.output, '(?s)<\\|tool_call_start\\|>.*?<\\|tool_call_end\\|>', '', 'g'),
            '<|im_start|>', ''), '<|im_end|>', ''), '<|endoftext|>', ''), '<|tool_call_start|>', ''), '<|tool_call_end|>', ''),
            '^\\s+|\\s+$', '', 'g'), '')) AS a,
          coalesce(s.made, 0) AS tool_calls_made
        FROM (SELECT output_id FROM model_outputs) c JOIN model_outputs m USING (output_id)
        LEFT JOIN (SELECT output_id, count(*) AS made FROM calls GROUP BY output_id) s USING (output_id)),
scores AS (
  SELECT answer_id, case_id, category, (tool_calls_made > 0) = expected_tool_call AS tool_call_ok,
    length(a) > 300 AND (contains(a, '##') OR contains(a, '**') OR contains(a, chr(10) || '-')) AS structure_ok,
    round(len(list_filter(kws, lambda k: instr(a, lower(k)) > 0)) / len(kws), 2) AS keyword_ratio,
    len(list_filter(kws, lambda k: instr(a, lower(k)) > 0)) / len(kws) >= 0.5 AS keyword_hit,
    CAST(length(a) AS INTEGER) AS response_length
  FROM ans JOIN cases USING (case_id)),
score_summary AS (
  SELECT round(avg(CAST(tool_call_ok AS DOUBLE)), 3) AS tool_call_accuracy,
    round(avg(CAST(structure_ok AS DOUBLE)), 3) AS structure_score,
    round(avg(CAST(keyword_hit AS DOUBLE)), 3) AS keyword_coverage, count(*) AS cases_evaluated FROM scores)
"""


def _calls_sql(*more_adapters):
    """The model-output call CTEs, with extra adapters merged into the same WITH."""
    from ledgerline.plans.outputs import CALLS_SQL, MO
    return with_chain("model_outputs", "risk_patterns", "startups", *more_adapters).rstrip() + CALLS_SQL[len(MO.rstrip()):]


# The qualitative evaluation of each model: its own share of the scored answers; where the evaluation
# of a model's answers broke off, its source is 'error' with the reason.
EVALUATIONS_SQL = """
, ev AS (SELECT 'model_' || CAST(answer_id % 5 AS VARCHAR) AS model_name,
    round(avg(CAST(tool_call_ok AS DOUBLE)), 3) + CASE answer_id % 5 WHEN 2 THEN 0.0 ELSE 0.3 END AS tool_call_accuracy,
    CASE answer_id % 5 WHEN 3 THEN 'error' ELSE 'live' END AS source,
    CASE answer_id % 5 WHEN 3 THEN 'timeout' END AS error
  FROM scores GROUP BY answer_id % 5)
"""
DECISION_SQL = EVALUATIONS_SQL + """
, dec0 AS (SELECT cmp.model_name, cmp.staging_version, cmp.production_version,
    concat_ws(',', CASE WHEN NOT cmp.should_promote THEN 'regression: ' || cmp.reason END,
              CASE WHEN coalesce(ev.tool_call_accuracy, 0) < 0.7 THEN 'tool_accuracy' END,
              CASE WHEN ev.source = 'error' THEN 'evaluation_error: ' || coalesce(ev.error, 'None') END) AS rejection_reasons
  FROM cmp LEFT JOIN ev USING (model_name)),
dec AS (SELECT *, rejection_reasons = '' AS promoted,
    CASE WHEN rejection_reasons = '' THEN 'Production' ELSE 'Staging' END AS model_stage FROM dec0)
"""


def _evaluations(spark, sf_dir):
    model = F.col("answer_id") % 5
    scores = R.answer_scores(_answers(spark, sf_dir), R.evaluation_cases(spark)).withColumn("_m", model)
    return R.score_summary(scores, "_m").select(
        F.concat(F.lit("model_"), F.col("_m").cast("string")).alias("model_name"),
        (F.col("tool_call_accuracy") + F.when(F.col("_m") == 2, 0.0).otherwise(0.3)).alias("tool_call_accuracy"),
        F.when(F.col("_m") == 3, "error").otherwise("live").alias("source"), F.when(F.col("_m") == 3, "timeout").alias("error"))


@query("metric_series", "W5", oracle=SERIES_SQL + "SELECT run_id, CAST(step AS INTEGER) AS step, metric, value FROM series")
def q_metric_series(spark, sf_dir):
    rounded = F.when(F.col("metric").endswith("/perplexity"), F.round("value", 6)).otherwise(F.col("value"))
    return _series(spark, sf_dir).withColumn("value", rounded)


@query("run_summary", "A16", oracle=SUMMARY_SQL + "SELECT * FROM summary")
def q_run_summary(spark, sf_dir):
    s = R.run_summary(_series(spark, sf_dir))
    return s.withColumn("best_perplexity", F.round("best_perplexity", 6))


@query("mean_loss", "A15", oracle=TL + RUN_LOSS_SQL + "SELECT * FROM run_loss")
def q_mean_loss(spark, sf_dir):
    return _run_loss(spark, sf_dir)


@query("perplexity_band", "F17", oracle=TL + RUN_LOSS_SQL + """
SELECT run_id, eval_perplexity,
  CASE WHEN eval_perplexity < 10 THEN 'Excellent — le modèle est très confiant dans ses réponses.'
       WHEN eval_perplexity < 20 THEN 'Bon — niveau acceptable pour une mise en production.'
       WHEN eval_perplexity < 35 THEN 'Correct — envisager plus d''epochs ou un dataset plus large.'
       ELSE 'Insuffisant — le modèle nécessite plus d''entraînement.' END AS interpretation
FROM run_loss
""")
def q_perplexity_band(spark, sf_dir):
    rl = _run_loss(spark, sf_dir)
    return rl.select("run_id", "eval_perplexity", R.perplexity_band(F.col("eval_perplexity")).alias("interpretation"))


@query("final_metrics", "A18", oracle=SUMMARY_SQL + """
SELECT run_id, final_eval_loss, best_eval_loss AS best_loss, CAST(NULL AS DOUBLE) AS final_eval_perplexity,
  coalesce(final_eval_loss, best_eval_loss, 999.0) AS eval_loss
FROM summary
""")
def q_final_metrics(spark, sf_dir):
    s = R.run_summary(_series(spark, sf_dir))
    # What the trainer logs at the end of a run: the last and the best eval loss.
    logged = s.select("run_id", F.explode(F.array(
        F.struct(F.lit("final/eval_loss").alias("metric"), F.col("final_eval_loss").alias("value")),
        F.struct(F.lit("eval/best_loss").alias("metric"), F.col("best_eval_loss").alias("value")))).alias("m"),
        F.col("total_steps").alias("step")).select("run_id", "m.metric", "step", "m.value")
    return R.final_metrics(logged.where(F.col("value").isNotNull()).unionByName(
        s.select("run_id", F.lit("none").alias("metric"), F.col("total_steps").alias("step"),
                 F.lit(None).cast("double").alias("value"))))


@query("latest_version_per_stage", "W1", oracle=with_chain("model_versions") + """
SELECT model_name, stage, version, run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name, stage ORDER BY CAST(version AS BIGINT) DESC) AS rn FROM model_versions) z
WHERE rn = 1
""")
def q_latest_version_per_stage(spark, sf_dir):
    return R.latest_version_per_stage(adapter(spark, sf_dir, "model_versions"))


@query("latest_run_for_token", "W2", oracle="""
SELECT user_id AS experiment_id, event_id AS run_id, matched FROM (
  SELECT user_id, event_id, coalesce(json_extract_string(props, '$.k') = '42', false) AS matched,
    row_number() OVER (PARTITION BY user_id ORDER BY coalesce(json_extract_string(props, '$.k') = '42', false) DESC,
                                                   ts DESC, event_id DESC) AS rn
  FROM events) z WHERE rn = 1
""")
def q_latest_run_for_token(spark, sf_dir):
    ev = adapter(spark, sf_dir, "events").select(
        F.col("user_id").alias("experiment_id"), F.col("event_id").alias("run_id"),
        F.col("ts").alias("start_time"), "props")
    match = F.coalesce(F.get_json_object("props", "$.k") == "42", F.lit(False))
    return R.latest_run_for_token(ev, match)


@query("compare_versions", "J11", oracle=with_chain("training_log", "model_versions").rstrip() + RUN_LOSS_SQL
       + COMPARE_SQL + "SELECT * FROM cmp")
def q_compare_versions(spark, sf_dir):
    return R.compare_versions(adapter(spark, sf_dir, "model_versions"), _run_loss(spark, sf_dir))


# The runs that were trained for each registered model, and for one model that was never registered.
TRAINED_SQL = """
, trained AS (SELECT run_id, 'model_' || CAST(run_id % 6 AS VARCHAR) AS model_name, eval_loss FROM run_loss)
"""


@query("staging_gate", "D6", oracle=with_chain("training_log", "model_versions").rstrip() + RUN_LOSS_SQL + TRAINED_SQL + """
, lt AS (SELECT model_name, version, stage FROM (
    SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY CAST(version AS BIGINT) DESC) AS rn FROM model_versions) z
  WHERE rn = 1)
SELECT t.run_id, t.model_name, t.eval_loss, t.eval_loss < 2.5 AS passes_threshold,
  t.eval_loss < 2.5 AND lt.version IS NOT NULL AS promoted,
  CASE WHEN NOT t.eval_loss < 2.5 THEN 'eval_loss_above_threshold' WHEN lt.version IS NULL THEN 'no_version' END AS reason,
  CASE WHEN t.eval_loss < 2.5 THEN lt.version END AS version,
  CASE WHEN t.eval_loss < 2.5 AND lt.version IS NOT NULL THEN CASE WHEN lt.stage IN ('Staging', 'Production') THEN lt.stage ELSE 'Staging' END END
    AS new_stage
FROM trained t LEFT JOIN lt USING (model_name)
""")
def q_staging_gate(spark, sf_dir):
    trained = _run_loss(spark, sf_dir).withColumn("model_name", F.concat(F.lit("model_"), (F.col("run_id") % 6).cast("string")))
    return R.staging_gate(adapter(spark, sf_dir, "model_versions"), trained)


def _scores_sql():
    return _calls_sql() + CASES_SQL


@query("answer_scores", "A14+F14+F15", oracle=_calls_sql() + CASES_SQL + "SELECT * FROM scores")
def q_answer_scores(spark, sf_dir):
    return R.answer_scores(_answers(spark, sf_dir), R.evaluation_cases(spark))


@query("score_summary", "A14", oracle=_calls_sql() + CASES_SQL + "SELECT * FROM score_summary")
def q_score_summary(spark, sf_dir):
    return R.score_summary(R.answer_scores(_answers(spark, sf_dir), R.evaluation_cases(spark)))


@query("promotion_decision", "D7", oracle=_calls_sql("training_log", "model_versions") + CASES_SQL + RUN_LOSS_SQL
       + COMPARE_SQL + DECISION_SQL + "SELECT * FROM dec")
def q_promotion_decision(spark, sf_dir):
    cmp = R.compare_versions(adapter(spark, sf_dir, "model_versions"), _run_loss(spark, sf_dir))
    d = R.promotion_decision(cmp, _evaluations(spark, sf_dir))
    return d.withColumn("rejection_reasons", F.array_join("rejection_reasons", ","))


@query("apply_promotion", "D7", oracle=_calls_sql("training_log", "model_versions") + CASES_SQL + RUN_LOSS_SQL
       + COMPARE_SQL + DECISION_SQL + """
SELECT v.model_name, v.version, v.run_id, v.stage,
  CASE WHEN coalesce(d.promoted, false) AND v.version = d.staging_version THEN 'Production'
       WHEN coalesce(d.promoted, false) AND v.stage = 'Production' THEN 'Archived' ELSE v.stage END AS new_stage
FROM model_versions v LEFT JOIN dec d USING (model_name)
""")
def q_apply_promotion(spark, sf_dir):
    versions = adapter(spark, sf_dir, "model_versions")
    cmp = R.compare_versions(versions, _run_loss(spark, sf_dir))
    return R.apply_promotion(versions, R.promotion_decision(cmp, _evaluations(spark, sf_dir)))


@query("evaluation_pairs", "S6+W3", oracle=with_chain("example_meta", "example_messages", "model_outputs") + """
, p AS (SELECT example_id, arg_max(content, turn) FILTER (WHERE role = 'user') AS prompt,
          arg_max(content, turn) FILTER (WHERE role = 'assistant') AS expected FROM example_messages GROUP BY example_id)
SELECT p.example_id AS id, p.prompt, p.expected,
  regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(m.output, '(?s)<\\|tool_call_start\\|>.*?<\\|tool_call_end\\|>', '', 'g'),
    '<|im_start|>', ''), '<|im_end|>', ''), '<|endoftext|>', ''), '<|tool_call_start|>', ''), '<|tool_call_end|>', ''),
    '^\\s+|\\s+$', '', 'g') AS prediction
FROM p LEFT JOIN model_outputs m ON m.output_id = p.example_id
WHERE p.prompt IS NOT NULL AND p.expected IS NOT NULL
ORDER BY id LIMIT 10
""")
def q_evaluation_pairs(spark, sf_dir):
    msgs = adapter(spark, sf_dir, "example_messages")
    pairs = Q.last_message_by_role(msgs).where(F.col("last_user").isNotNull() & F.col("last_assistant").isNotNull())
    preds = adapter(spark, sf_dir, "model_outputs").select(
        F.col("output_id").alias("example_id"), O.clean_answer(F.col("output")).alias("prediction"))
    out = pairs.join(preds, "example_id", "left").select(
        F.col("example_id").alias("id"), F.col("last_user").alias("prompt"),
        F.col("last_assistant").alias("expected"), "prediction")
    path = J.scratch_path(spark, "evaluation-pairs")
    out.write.mode("overwrite").json(path)
    back = spark.read.schema("id bigint, prompt string, expected string, prediction string").json(path)
    return back.orderBy("id").limit(10)
