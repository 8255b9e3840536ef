"""Adapters: SQL views that shape the driver's generic tables like the knowledge,
dataset and run tables the operators expect.

Each text runs unchanged on Spark SQL and on DuckDB, so the same fixture feeds both
the Spark job and its SQL oracle. They are fixtures, not operators: the operators
in ``ledgerline.operators`` take DataFrames and never see this SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Adapter texts (shared with the DuckDB oracle).
ADAPTER_SQL: dict[str, str] = {
    "startups": """
select c_custkey as id, c_name as name, lower(c_mktsegment) as sector,
  case c_custkey % 7 when 0 then 'idea' when 1 then 'pre-seed' when 2 then 'seed' when 3 then 'series-a' when 4 then 'series-b' when 5 then 'growth' else 'mature' end as stage,
  r_name as region, n_name as country,
  case when c_custkey % 11 = 0 then null else 2000 + cast(c_custkey % 25 as int) end as founding_year,
  case c_custkey % 5 when 0 then 'success' when 1 then 'failure' when 2 then 'pivot' when 3 then 'acquired' else 'ongoing' end as outcome,
  c_acctbal as mrr
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""",
    "pivot_cases": """
select o_orderkey as id, o_custkey as startup_id,
  case substr(o_orderpriority, 1, 1) when '1' then 'zoom-in' when '2' then 'zoom-out' when '3' then 'customer-segment' when '4' then 'platform' else 'channel' end as pivot_type,
  case o_orderkey % 5 when 0 then 'success' when 1 then 'failure' when 2 then 'pivot' when 3 then 'acquired' else 'ongoing' end as outcome,
  o_totalprice as trigger_value, o_orderdate as created_at
from orders
""",
    "risk_patterns": """
select p_partkey as id, p_name as pattern_name,
  case when p_partkey % 3 = 0 then null else (case p_partkey % 5 when 0 then 'automobile' when 1 then 'building' when 2 then 'furniture' when 3 then 'household' else 'machinery' end) end as sector,
  case when p_partkey % 4 = 0 then null else (case p_partkey % 7 when 0 then 'idea' when 1 then 'pre-seed' when 2 then 'seed' when 3 then 'series-a' when 4 then 'series-b' when 5 then 'growth' else 'mature' end) end as stage,
  case p_size % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as criticality,
  lower(p_type) as category
from part
""",
    "sector_benchmarks": """
select s.sector, s.stage, 'order_value' as metric_name,
  percentile_disc(0.5) within group (order by o_totalprice) as value_median,
  percentile_disc(0.75) within group (order by o_totalprice) as value_good,
  percentile_disc(0.9) within group (order by o_totalprice) as value_excellent,
  percentile_disc(0.25) within group (order by o_totalprice) as value_warning
from orders join startups s on o_custkey = s.id
where s.stage <> 'mature'
group by s.sector, s.stage
union all
select s.sector, s.stage, 'order_cost' as metric_name,
  percentile_disc(0.5) within group (order by o_totalprice) as value_median,
  percentile_disc(0.25) within group (order by o_totalprice) as value_good,
  percentile_disc(0.1) within group (order by o_totalprice) as value_excellent,
  percentile_disc(0.75) within group (order by o_totalprice) as value_warning
from orders join startups s on o_custkey = s.id
where s.stage <> 'mature'
group by s.sector, s.stage
""",
    "observations": """
select o_orderkey as obs_id, s.sector, s.stage,
  case when o_orderkey % 2 = 0 then 'order_value' else 'order_cost' end as metric_name, o_totalprice as value
from orders join startups s on o_custkey = s.id
""",
    "lean_concepts": """
select p_partkey as id, p_name || ' ' || cast(p_partkey as string) as concept_name,
  case p_partkey % 5 when 0 then 'framework' when 1 then 'metric' when 2 then 'strategy' when 3 then 'principle' else 'tool' end as category,
  split(p_brand, '#') as aliases, p_type as simple_def, p_brand || ': ' || p_type as technical_def
from part
""",
    "investment_criteria": """
select s_suppkey as id,
  case s_suppkey % 5 when 0 then 'angel' when 1 then 'vc' when 2 then 'impact' when 3 then 'strategic' else 'crowdfunding' end as investor_profile,
  case s_suppkey % 7 when 0 then 'idea' when 1 then 'pre-seed' when 2 then 'seed' when 3 then 'series-a' when 4 then 'series-b' when 5 then 'growth' else 'mature' end as stage, s_name as criterion_name,
  case s_suppkey % 3 when 0 then 'critical' when 1 then 'important' else 'nice-to-have' end as weight
from supplier
""",
    "example_meta": """
select conv_id as example_id,
  case conv_id % 4 when 0 then 'diagnostic_complet' when 1 then 'identification_des_dangers' when 2 then 'evaluation_investissement' else 'simplification_concept' end as category,
  case when conv_id % 19 = 18 then 'Blue Flag' when conv_id % 3 = 0 then 'Green Flag' when conv_id % 3 = 1 then 'Red Flag' else 'Mixed' end as label,
  case when conv_id % 13 = 12 then null when conv_id % 2 = 0 then 'Majeur' else 'Non applicable' end as severity,
  case conv_id % 5 when 0 then 'Explicite' when 1 then 'Implicite' when 2 then 'Ambigu' else 'Mixte' end as difficulty,
  (conv_id % 3 = 0) as has_tool_use
from (select distinct conv_id from conversations) c
""",
    "example_messages": """
select c.conv_id as example_id, c.turn,
  case when c.conv_id % 17 = 5 and c.turn = 0 then 'bot' when c.conv_id % 2 = 0 and c.turn = 1 then 'tool' else c.role end as role,
  case when c.role = 'assistant' and c.conv_id % 6 <> 0 then 'Label: ' || m.label || chr(10) || c.text else c.text end as content
from conversations c join example_meta m on m.example_id = c.conv_id
""",
    "model_outputs": """
select doc_id as output_id, case doc_id % 6
  when 0 then text
  when 1 then text || '<|tool_call_start|>[query_postgresql(sql="SELECT * FROM risk_patterns WHERE id = ' || cast(doc_id as string) || '")]<|tool_call_end|>'
  when 2 then '<|tool_call_start|>{"name": "query_postgresql", "parameters": {"sql": "SELECT id, name FROM startups WHERE sector = ''building'' LIMIT 3"}}<|tool_call_end|>' || text
  when 3 then text || '<|tool_call_start|>[query_postgresql(sql="DROP TABLE startups")]<|tool_call_end|>'
  when 4 then text || '<|tool_call_start|>[drop_table(sql="SELECT 1")]<|tool_call_end|> and <|tool_call_start|>[query_postgresql(sql="SELECT b FROM startups")]<|tool_call_end|>'
  else '<|tool_call_start|>[oops]<|tool_call_end|>' || text end as output
from documents
""",
    "metric_log": """
select user_id as run_id, event_type as metric_key,
  row_number() over (partition by user_id, event_type order by ts, event_id) as step, value
from events
""",
    "model_versions": """
select 'model_' || cast(s_suppkey % 5 as string) as model_name, cast(s_suppkey as string) as version,
  case s_suppkey % 3 when 0 then 'Production' when 1 then 'Staging' else 'None' end as stage, s_suppkey as run_id
from supplier
""",
    # The six knowledge tables as a careless load would leave them: every rule is broken by some rows.
    "loaded_startups": """
select id, case when id % 41 = 1 then null when id % 41 = 2 then repeat(name, 20) else name end as name,
  case when id % 43 = 1 then null when id % 43 = 2 then repeat(sector, 20) else sector end as sector,
  case when id % 47 = 1 then null when id % 47 = 2 then 'unicorn' else stage end as stage,
  case when id % 53 = 1 then repeat(region, 40) else region end as region,
  case when id % 53 = 2 then repeat(country, 40) else country end as country,
  case when id % 59 = 1 then null else country || ' ' || sector end as description,
  case when id % 61 = 1 then null when id % 61 = 2 then 'bankrupt' else outcome end as outcome,
  cast(case when id % 67 = 1 then cast(mrr as decimal(14, 2)) * 100000000 else cast(mrr as decimal(14, 2)) end as decimal(24, 2)) as mrr
from startups
""",
    "loaded_pivot_cases": """
select id, case when id % 71 = 1 then startup_id + 100000000 when id % 71 = 2 then null else startup_id end as startup_id,
  case when id % 73 = 1 then null when id % 73 = 2 then repeat(pivot_type, 60) else pivot_type end as pivot_type,
  case when id % 79 = 1 then null else 'signal ' || pivot_type end as trigger_signal,
  case when id % 79 = 2 then null else 'before ' || pivot_type end as before_model,
  case when id % 79 = 3 then null else 'after ' || pivot_type end as after_model,
  case when id % 83 = 1 then null when id % 83 = 2 then 'merged' else outcome end as outcome
from pivot_cases
""",
    "loaded_risk_patterns": """
select id, case when id % 41 = 3 then null when id % 41 = 4 then repeat(pattern_name, 40) else pattern_name end as pattern_name,
  case when id % 43 = 3 then repeat('sector ', 20) else sector end as sector, case when id % 47 = 3 then 'exit' else stage end as stage,
  case when id % 53 = 3 then null when id % 53 = 4 then 'severe' else criticality end as criticality,
  case when id % 59 = 3 then repeat(category, 20) else category end as category,
  case when id % 61 = 3 then null else category end as description, case when id % 61 = 4 then null else category end as simple_explain,
  case when id % 61 = 5 then null else category end as warning_signals, case when id % 61 = 6 then null else category end as mitigation
from risk_patterns
""",
    "loaded_sector_benchmarks": """
select sector || '/' || stage || '/' || metric_name as id, sector, stage,
  metric_name, 'USD' as unit, case when stage = 'growth' then null else metric_name end as context from sector_benchmarks
union all select sector || '/' || stage || '/' || metric_name || '/again', sector, stage, metric_name, repeat('USD', 20), metric_name
from sector_benchmarks where stage = 'seed'
union all select 'wrong/' || sector || '/' || metric_name, null, 'exit', repeat(metric_name, 20), null, metric_name
from sector_benchmarks where stage = 'idea'
union all select 'wrong2/' || sector || '/' || metric_name, repeat(sector, 20), null, null, 'USD', metric_name
from sector_benchmarks where stage = 'idea'
""",
    "loaded_lean_concepts": """
select id, case when id % 37 = 1 then null when id % 37 = 2 then repeat(concept_name, 40) when id % 37 = 3 then 'the same name' else concept_name end as concept_name,
  case when id % 41 = 5 then null when id % 41 = 6 then 'rumour' else category end as category,
  case when id % 43 = 5 then null else technical_def end as technical_def, case when id % 43 = 6 then null else simple_def end as simple_def,
  case when id % 43 = 7 then null else simple_def end as example
from lean_concepts
""",
    "loaded_investment_criteria": """
select id, case when id % 7 = 1 then null when id % 7 = 2 then 'hedge' else investor_profile end as investor_profile,
  case when id % 9 = 1 then null when id % 9 = 2 then 'exit' else stage end as stage,
  case when id % 8 = 1 then null when id % 8 = 2 then repeat(criterion_name, 30) else criterion_name end as criterion_name,
  case when id % 10 = 1 then null when id % 10 = 2 then 'minor' else weight end as weight,
  case when id % 10 = 3 then null else criterion_name end as description, case when id % 10 = 4 then null else criterion_name end as red_flags,
  case when id % 10 = 5 then null else criterion_name end as green_flags
from investment_criteria
""",
    # Catalogues of the example generator, worded from the tables; the branches' forms are few rows.
    "gen_risks": """
select p_partkey as id, p_name as name, 'principle of ' || p_brand as principle,
  case p_size % 3 when 0 then 'Fatal' when 1 then 'Majeur' else 'Mineur' end as severity, lower(p_brand) as slug,
  'numbers show ' || p_name || ' under ' || p_type as explicit, 'customers mention ' || p_name as implicit,
  p_name || ' costs more than it returns' as why
from part
""",
    "gen_strengths": """
select s_suppkey as id, s_name as name, 'growth by ' || s_name as principle, 'clients of ' || s_name || ' come back' as evidence,
  s_name || ' repeats its sales' as why
from supplier
""",
    "gen_concepts": """
select id, concept_name as name, category as principle, simple_def, 'like a ' || category || ' in a kitchen' as analogy from lean_concepts
""",
    "gen_criteria": """
select id, criterion_name, weight, 'show ' || criterion_name || ' before raising' as simple_rule from investment_criteria
""",
    "gen_contexts": """
select n_nationkey as id, 'a talk in ' || n_name as context from nation
""",
    "gen_branches": """
select 'diagnostic_complet' as category, 'Green Flag' as label, 'Implicite#Ambigu' as implicit_for, '{strength.evidence}' as evidence,
  'Project {idx}: {sector}, {stage}, {region}. We see that {evidence}. I am {profile}.' as users,
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. Good sign: {strength.why}. Principle: {principle}.' as answer,
  'SELECT pattern_name, criticality FROM risk_patterns WHERE pattern_slug = {risk.slug} LIMIT 3' as sql,
  'You judge young companies.' as system_plain, 'You judge young companies and may query a database.' as system_tools
union all select 'diagnostic_complet', 'Mixed', 'Implicite#Ambigu', '{strength.evidence}, yet {risk.mode}',
  'Project {idx}: {sector}, {stage}, {region}. We see that {evidence}. I am {profile}.',
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. There is demand, but {risk.name} remains: {risk.why}. Principle: {principle}.',
  'SELECT pattern_name, criticality FROM risk_patterns WHERE pattern_slug = {risk.slug} LIMIT 3',
  'You judge young companies.', 'You judge young companies and may query a database.'
union all select 'diagnostic_complet', 'Red Flag', 'Implicite#Ambigu', '{risk.mode}',
  'Project {idx}: {sector}, {stage}, {region}. We see that {evidence}. I am {profile}.',
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. Stop: {risk.name}, since {risk.why}. Principle broken: {principle}.',
  'SELECT pattern_name, criticality FROM risk_patterns WHERE pattern_slug = {risk.slug} LIMIT 3',
  'You judge young companies.', 'You judge young companies and may query a database.'
union all select 'identification_des_dangers', l.label, 'Implicite#Ambigu', '{risk.mode} and {risk2.mode}',
  'What threatens a {sector} company? Signs: {evidence}. Reader: {profile}.',
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. First {risk.name}, then {risk2.name}. Principle broken: {principle}.',
  'SELECT pattern_name, criticality FROM risk_patterns WHERE pattern_slug IN ({risk.slug}, {risk2.slug}) LIMIT 5',
  'You judge young companies.', 'You judge young companies and may query a database.'
  from (select 'Red Flag' as label union all select 'Mixed') l
union all select 'evaluation_investissement', 'Green Flag', 'Implicite#Ambigu#Mixte', '{strength.evidence}, in one clear segment',
  'Deal {idx}: {sector}, {stage}, {region}. Thesis: {evidence}. Would {profile} invest?',
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. Worth a closer look. Principle: {principle}.',
  'SELECT criterion_name, weight FROM investment_criteria WHERE investor_profile = {profile} AND stage = {stage_slug} LIMIT 4',
  'You judge young companies.', 'You judge young companies and may query a database.'
union all select 'evaluation_investissement', 'Mixed', 'Implicite#Ambigu#Mixte', '{strength.evidence}, yet {risk.mode}',
  'Deal {idx}: {sector}, {stage}, {region}. Thesis: {evidence}. Would {profile} invest?',
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. Not yet clear for {profile}. Principle to check: {principle}.',
  'SELECT criterion_name, weight FROM investment_criteria WHERE investor_profile = {profile} AND stage = {stage_slug} LIMIT 4',
  'You judge young companies.', 'You judge young companies and may query a database.'
union all select 'evaluation_investissement', 'Red Flag', 'Implicite#Ambigu#Mixte', '{risk.mode}',
  'Deal {idx}: {sector}, {stage}, {region}. Thesis: {evidence}. Would {profile} invest?',
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. No money now. Principle broken: {principle}.',
  'SELECT criterion_name, weight FROM investment_criteria WHERE investor_profile = {profile} AND stage = {stage_slug} LIMIT 4',
  'You judge young companies.', 'You judge young companies and may query a database.'
union all select 'simplification_concept', 'Green Flag', 'Implicite', '',
  'Case {idx}: what is {concept.name}? I prepare {context} as {profile}.#Case {idx}: in {context}, say {concept.name} in plain words.#Case {idx}: during {context} I take {concept.name} for a mere feature. Why not?',
  'Label: {label}, Severity: {severity}, Difficulty: {difficulty}. {concept.name} means {concept.simple_def}, {concept.analogy}. Principle: {principle}.',
  'SELECT concept_name, simple_def FROM lean_concepts WHERE concept_name ILIKE {concept.name} LIMIT 1',
  'You judge young companies.', 'You judge young companies and may query a database.'
""",
    "gen_instructions": """
select investor_profile, 'Answer for ' || investor_profile || ', who weighs ' || min(criterion_name) || ' first.' as instruction
from investment_criteria group by investor_profile
""",
    # Example lines as files hold them: some lines come twice, with their keys in another order at some
    # depth; others differ in a key that no list names.
    "raw_lines": """
select example_id, '{"example_id":' || cast(example_id as string) || ',"category":"' || category || '","extra":{"b":1,"a":[1,{"z":null,"y":"x"}]},"note":"first"}' as metadata_json
from example_meta
union all select example_id, '{"note":"first", "extra":{"b":1,"a":[1,{"z":null,"y":"x"}]}, "category":"' || category || '","example_id":' || cast(example_id as string) || '}'
from example_meta where example_id % 5 = 1
union all select example_id, '{"example_id":' || cast(example_id as string) || ',"category":"' || category || '","extra":{"a":[1,{"y":"x","z":null}],"b":1},"note":"first"}'
from example_meta where example_id % 11 = 3
union all select example_id, '{"example_id":' || cast(example_id as string) || ',"category":"' || category || '","extra":{"b":1,"a":[1,{"z":null,"y":"x"}]},"note":"second"}'
from example_meta where example_id % 7 = 2
""",
    # Some conversations are in the set twice, under two ids.
    "leaky_meta": """
select example_id, category, label, severity, difficulty, has_tool_use from example_meta
union all select example_id + 1000000, category, label, severity, difficulty, has_tool_use from example_meta where example_id % 3 = 0
""",
    "leaky_messages": """
select example_id, turn, role, content from example_messages
union all select example_id + 1000000, turn, role, content from example_messages where example_id % 3 = 0
""",
    # Trainer-style log keys over the metric series (loss, eval_loss, learning_rate, ...).
    "training_log": """
select run_id, step,
  case metric_key when 'view' then 'loss' when 'error' then 'eval_loss' when 'click' then 'learning_rate'
    when 'purchase' then 'grad_norm' else 'epoch' end as log_key,
  case metric_key when 'view' then value / 25 when 'error' then value / 25 when 'click' then value / 100000
    else value end as value
from metric_log
""",
}

# Which raw tables / adapters each adapter reads (dependency order matters).
ADAPTER_DEPS: dict[str, tuple[str, ...]] = {
    "startups": ("customer", "nation", "region"),
    "pivot_cases": ("orders",),
    "risk_patterns": ("part",),
    "sector_benchmarks": ("orders", "startups"),
    "observations": ("orders", "startups"),
    "lean_concepts": ("part",),
    "investment_criteria": ("supplier",),
    "example_meta": ("conversations",),
    "example_messages": ("conversations", "example_meta"),
    "model_outputs": ("documents",),
    "metric_log": ("events",),
    "model_versions": ("supplier",),
    "training_log": ("metric_log",),
    "gen_risks": ("part",), "gen_strengths": ("supplier",), "gen_concepts": ("lean_concepts",), "gen_criteria": ("investment_criteria",),
    "gen_contexts": ("nation",), "gen_branches": (), "gen_instructions": ("investment_criteria",), "raw_lines": ("example_meta",),
    "leaky_meta": ("example_meta",), "leaky_messages": ("example_messages",),
    "loaded_startups": ("startups",),
    "loaded_pivot_cases": ("pivot_cases",),
    "loaded_risk_patterns": ("risk_patterns",),
    "loaded_sector_benchmarks": ("sector_benchmarks",),
    "loaded_lean_concepts": ("lean_concepts",),
    "loaded_investment_criteria": ("investment_criteria",),
}


def _spark_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as the SQL text; the per-(user, type) numbering avoids one task per group."""
    from pyspark.sql import functions as F
    from ledgerline.operators.ranking import positions_within
    ev = raw_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    pos = positions_within(ev, ["user_id", "event_type"], ["ts", "event_id"], out="_p")
    return pos.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric_key"),
                      (F.col("_p") + 1).cast("int").alias("step"), "value")


def _spark_sector_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as the SQL text; exact discrete percentiles without a group in one task."""
    from pyspark.sql import functions as F
    from ledgerline.operators.ranking import percentile_disc
    st = adapter(spark, sf_dir, "startups").where(F.col("stage") != "mature").select("id", "sector", "stage")
    orders = raw_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    j = orders.join(st, orders["o_custkey"] == st["id"]).select("sector", "stage", "o_totalprice")
    q = percentile_disc(j, ["sector", "stage"], "o_totalprice",
                        {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    value = q.select("sector", "stage", F.lit("order_value").alias("metric_name"), F.col("p50").alias("value_median"),
                     F.col("p75").alias("value_good"), F.col("p90").alias("value_excellent"),
                     F.col("p25").alias("value_warning"))
    cost = q.select("sector", "stage", F.lit("order_cost").alias("metric_name"), F.col("p50").alias("value_median"),
                    F.col("p25").alias("value_good"), F.col("p10").alias("value_excellent"),
                    F.col("p75").alias("value_warning"))
    return value.unionByName(cost)


# Spark-side builders for adapters whose SQL text would rank a whole group in one
# task; their output equals the shared SQL text (checked by the oracle runs).
SPARK_BUILDERS = {"metric_log": _spark_metric_log, "sector_benchmarks": _spark_sector_benchmarks}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(spark: SparkSession, sf_dir: str, name: str) -> None:
    if name in RAW_TABLES:
        raw_table(spark, sf_dir, name).createOrReplaceTempView(name)
        return
    adapter(spark, sf_dir, name).createOrReplaceTempView(name)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one adapter over the tables in ``sf_dir``.

    The views are resolved when the DataFrame is created, so later re-registration
    for another folder does not change an adapter already returned.
    """
    if name in RAW_TABLES:
        return raw_table(spark, sf_dir, name)
    if name in SPARK_BUILDERS:
        return SPARK_BUILDERS[name](spark, sf_dir)
    for dep in ADAPTER_DEPS[name]:
        _register(spark, sf_dir, dep)
    return spark.sql(ADAPTER_SQL[name])


def with_chain(*names: str) -> str:
    """``WITH`` clause (DuckDB oracle) holding the named adapters and their adapter deps."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in RAW_TABLES or n in ordered:
            return
        for dep in ADAPTER_DEPS[n]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return ""
    parts = [f"{n} AS ({ADAPTER_SQL[n].strip()})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n"
