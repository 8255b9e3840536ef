"""Registered constraint, update and loading queries (survey 2.9 D1, D2, D4, D5; 2.3 J9; 2.1 S5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.enums import LEAN_CATEGORIES, OUTCOMES, STAGES
from ledgerline.operators import constraints as C
from ledgerline.plans.registry import query
from ledgerline.sources import seeds
from ledgerline.sources.adapters import adapter, with_chain
from ledgerline.sources.jsonl import scratch_path

NOW = "2025-01-01 00:00:00"
BEFORE = "2024-01-01 00:00:00"


# The rules written out by hand, one line each: table, key, column, rule, SQL condition.
STAGE_SET = "('idea', 'pre-seed', 'seed', 'series-a', 'series-b', 'growth', 'mature')"
OUTCOME_SET = "('success', 'failure', 'pivot', 'acquired', 'ongoing')"
CONDITIONS = {
    "startups": [
        *[(c, "not_null", f"{c} IS NULL") for c in ("name", "sector", "stage", "description", "outcome")],
        ("stage", "domain", f"stage NOT IN {STAGE_SET}"), ("outcome", "domain", f"outcome NOT IN {OUTCOME_SET}"),
        ("name", "max_length", "length(name) > 255"), ("sector", "max_length", "length(sector) > 100"),
        ("region", "max_length", "length(region) > 100"), ("country", "max_length", "length(country) > 100"),
        ("mrr", "precision", "abs(mrr) >= 10000000000")],
    "pivot_cases": [
        *[(c, "not_null", f"{c} IS NULL") for c in ("pivot_type", "trigger_signal", "before_model", "after_model", "outcome")],
        ("outcome", "domain", f"outcome NOT IN {OUTCOME_SET}"), ("pivot_type", "max_length", "length(pivot_type) > 100"),
        ("startup_id", "reference", "startup_id IS NOT NULL AND startup_id NOT IN (SELECT id FROM loaded_startups)")],
    "risk_patterns": [
        *[(c, "not_null", f"{c} IS NULL") for c in ("pattern_name", "criticality", "description", "simple_explain", "warning_signals", "mitigation")],
        ("stage", "domain", f"stage NOT IN {STAGE_SET}"), ("criticality", "domain", "criticality NOT IN ('critical', 'high', 'medium', 'low')"),
        ("pattern_name", "max_length", "length(pattern_name) > 255"), ("sector", "max_length", "length(sector) > 100"),
        ("category", "max_length", "length(category) > 100")],
    "sector_benchmarks": [
        *[(c, "not_null", f"{c} IS NULL") for c in ("sector", "stage", "metric_name", "unit", "context")],
        ("stage", "domain", f"stage NOT IN {STAGE_SET}"), ("sector", "max_length", "length(sector) > 100"),
        ("metric_name", "max_length", "length(metric_name) > 100"), ("unit", "max_length", "length(unit) > 50")],
    "lean_concepts": [
        *[(c, "not_null", f"{c} IS NULL") for c in ("concept_name", "category", "technical_def", "simple_def", "example")],
        ("category", "domain", "category NOT IN ('framework', 'metric', 'strategy', 'principle', 'tool')"),
        ("concept_name", "max_length", "length(concept_name) > 255")],
    "investment_criteria": [
        *[(c, "not_null", f"{c} IS NULL")
          for c in ("investor_profile", "stage", "criterion_name", "weight", "description", "red_flags", "green_flags")],
        ("investor_profile", "domain", "investor_profile NOT IN ('angel', 'vc', 'impact', 'strategic', 'crowdfunding')"),
        ("stage", "domain", f"stage NOT IN {STAGE_SET}"), ("weight", "domain", "weight NOT IN ('critical', 'important', 'nice-to-have')"),
        ("criterion_name", "max_length", "length(criterion_name) > 255")],
}
TABLES = tuple(CONDITIONS)
VIOLATIONS_SQL = with_chain(*[f"loaded_{t}" for t in TABLES]).rstrip() + ", found AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(id AS VARCHAR) AS \"key\", '{c}' AS \"column\", '{r}' AS rule, CAST({c} AS VARCHAR) AS value "
    f"FROM loaded_{t} WHERE {cond}" for t, rows in CONDITIONS.items() for c, r, cond in rows) + """
 UNION ALL SELECT 'sector_benchmarks', id, 'metric_name', 'unique', sector || '|' || stage || '|' || metric_name FROM loaded_sector_benchmarks
   WHERE sector IS NOT NULL AND stage IS NOT NULL AND (sector, stage, metric_name) IN (SELECT (sector, stage, metric_name) FROM loaded_sector_benchmarks
                                          GROUP BY sector, stage, metric_name HAVING count(*) > 1)
 UNION ALL SELECT 'lean_concepts', CAST(id AS VARCHAR), 'concept_name', 'unique', concept_name FROM loaded_lean_concepts
   WHERE concept_name IN (SELECT concept_name FROM loaded_lean_concepts GROUP BY concept_name HAVING count(*) > 1))
"""


def _loaded(spark, sf_dir, *names):
    return {n: adapter(spark, sf_dir, f"loaded_{n}") for n in names or TABLES}


@query("rule_violations", "D1+D2+J9", oracle=VIOLATIONS_SQL + "SELECT * FROM found")
def q_rule_violations(spark, sf_dir):
    return C.rule_violations(_loaded(spark, sf_dir))


CHECKED = [(t, c, r) for t, rows in CONDITIONS.items() for c, r, _ in rows] + [
    ("sector_benchmarks", "metric_name", "unique"), ("lean_concepts", "concept_name", "unique")]
UNCHECKED = [("startups", "subsector", "max_length"), ("startups", "business_model", "max_length"), ("startups", "source", "max_length"),
             ("startups", "growth_rate_monthly", "precision"), ("pivot_cases", "trigger_metric", "max_length"),
             ("risk_patterns", "impact_on_runway", "max_length"), ("risk_patterns", "time_to_impact", "max_length"),
             ("sector_benchmarks", "source", "max_length"), ("lean_concepts", "source_whitepaper", "max_length"),
             ("lean_concepts", "source_page", "max_length"), ("investment_criteria", "criterion_category", "max_length")]


@query("rule_summary", "D1", oracle=VIOLATIONS_SQL + ", rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{c}', '{r}', {str((t, c, r) in CHECKED).lower()})" for t, c, r in CHECKED + UNCHECKED)
    + """) v(table_name, "column", rule, checked))
SELECT r.table_name, r."column", r.rule, r.checked, CASE WHEN r.checked THEN count(f."key") END AS n_rows
FROM rules r LEFT JOIN found f ON f.table_name = r.table_name AND f."column" = r."column" AND f.rule = r.rule
GROUP BY r.table_name, r."column", r.rule, r.checked
""")
def q_rule_summary(spark, sf_dir):
    return C.rule_summary(_loaded(spark, sf_dir)).drop("argument")


@query("domain_violations", "D1", oracle=with_chain("loaded_startups").rstrip() + " " + " UNION ALL ".join(
    f"SELECT id, '{c}' AS \"column\", '{r}' AS rule, CAST({c} AS VARCHAR) AS value FROM loaded_startups WHERE {cond}"
    for c, r, cond in CONDITIONS["startups"]))
def q_domain_violations(spark, sf_dir):
    return C.domain_violations(
        adapter(spark, sf_dir, "loaded_startups"), "id", not_null=("name", "sector", "stage", "description", "outcome"),
        domains={"stage": STAGES, "outcome": OUTCOMES},
        max_length={"name": 255, "sector": 100, "region": 100, "country": 100}, max_abs={"mrr": 1e10})


@query("concept_domain_violations", "D1", oracle=with_chain("loaded_lean_concepts") + """
SELECT id, 'category' AS "column", 'domain' AS rule, category AS value FROM loaded_lean_concepts
WHERE category NOT IN ('framework', 'metric', 'strategy', 'principle', 'tool')
UNION ALL SELECT id, 'concept_name', 'max_length', concept_name FROM loaded_lean_concepts WHERE length(concept_name) > 255
""")
def q_concept_domain_violations(spark, sf_dir):
    return C.domain_violations(adapter(spark, sf_dir, "loaded_lean_concepts"), "id",
                               domains={"category": LEAN_CATEGORIES}, max_length={"concept_name": 255})


@query("unique_violations", "D2", oracle=with_chain("sector_benchmarks") + """
SELECT sector, stage, metric_name, count(*) AS n_rows
FROM (SELECT sector, stage, metric_name FROM sector_benchmarks
      UNION ALL SELECT sector, stage, metric_name FROM sector_benchmarks WHERE stage = 'seed')
GROUP BY sector, stage, metric_name HAVING count(*) > 1
""")
def q_unique_violations(spark, sf_dir):
    rows = adapter(spark, sf_dir, "sector_benchmarks").select("sector", "stage", "metric_name")
    planted = rows.unionByName(rows.where("stage = 'seed'"))           # the benchmarks of one stage are entered twice
    return C.unique_violations(planted, ["sector", "stage", "metric_name"])


@query("concept_name_unique", "D2", oracle=with_chain("lean_concepts") + """
SELECT concept_name, count(*) AS n_rows
FROM (SELECT concept_name FROM lean_concepts UNION ALL SELECT concept_name FROM lean_concepts WHERE id % 97 = 3)
GROUP BY concept_name HAVING count(*) > 1
""")
def q_concept_name_unique(spark, sf_dir):
    concepts = adapter(spark, sf_dir, "lean_concepts").select("id", "concept_name")
    planted = concepts.unionByName(concepts.where("id % 97 = 3"))      # every 97th concept is entered twice
    return C.unique_violations(planted, ["concept_name"])


@query("orphan_rows", "J9", oracle=with_chain("loaded_pivot_cases") + """
SELECT p.id, p.startup_id, p.pivot_type FROM loaded_pivot_cases p WHERE p.startup_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = p.startup_id)
""")
def q_orphan_rows(spark, sf_dir):
    pivots = adapter(spark, sf_dir, "loaded_pivot_cases").select("id", "startup_id", "pivot_type")
    return C.orphan_rows(pivots, adapter(spark, sf_dir, "customer"), "startup_id", "c_custkey")


@query("orphan_lineitems", "J9", oracle="""
SELECT l_orderkey, l_linenumber FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')
""")
def q_orphan_lineitems(spark, sf_dir):
    # the line items whose orders were archived
    li = adapter(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    kept = adapter(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return C.orphan_rows(li, kept, "l_orderkey", "o_orderkey")


@query("cascade_delete", "D5", oracle=with_chain("startups", "pivot_cases") + """
SELECT id, startup_id, pivot_type, outcome FROM pivot_cases
WHERE startup_id IS NULL OR startup_id NOT IN (SELECT id FROM startups WHERE outcome = 'failure')
""")
def q_cascade_delete(spark, sf_dir):
    deleted = adapter(spark, sf_dir, "startups").where(F.col("outcome") == "failure").select("id")
    kept = C.cascade_delete(adapter(spark, sf_dir, "pivot_cases"), deleted, "startup_id")
    return kept.select("id", "startup_id", "pivot_type", "outcome")


@query("upsert_touch", "D4", oracle=with_chain("startups") + f"""
, old AS (SELECT id, name, stage, mrr, '{BEFORE}' AS updated_at FROM startups WHERE id % 10 <> 7),
new AS (SELECT id, name, CASE WHEN id % 4 = 0 THEN 'growth' ELSE stage END AS stage,
          CASE WHEN id % 3 = 0 THEN CAST(round(CAST(mrr AS DECIMAL(14, 2)) * 1.1, 2) AS DOUBLE) ELSE mrr END AS mrr FROM startups WHERE id % 2 = 0 OR id % 10 = 7)
SELECT coalesce(n.id, o.id) AS id,
  CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name,
  CASE WHEN n.id IS NOT NULL THEN n.stage ELSE o.stage END AS stage,
  CASE WHEN n.id IS NOT NULL THEN n.mrr ELSE o.mrr END AS mrr,
  CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.name IS DISTINCT FROM n.name OR o.stage IS DISTINCT FROM n.stage
                                   OR o.mrr IS DISTINCT FROM n.mrr) THEN '{NOW}' ELSE o.updated_at END AS updated_at,
  n.id IS NOT NULL AND o.id IS NOT NULL AND (o.name IS DISTINCT FROM n.name OR o.stage IS DISTINCT FROM n.stage
                                              OR o.mrr IS DISTINCT FROM n.mrr) AS changed
FROM old o FULL OUTER JOIN new n ON n.id = o.id
""")
def q_upsert_touch(spark, sf_dir):
    st = adapter(spark, sf_dir, "startups")
    old = st.where(F.col("id") % 10 != 7).select("id", "name", "stage", "mrr", F.lit(BEFORE).alias("updated_at"))
    new = st.where((F.col("id") % 2 == 0) | (F.col("id") % 10 == 7)).select(
        "id", "name", F.when(F.col("id") % 4 == 0, F.lit("growth")).otherwise(F.col("stage")).alias("stage"),
        F.when(F.col("id") % 3 == 0, F.round(F.col("mrr").cast("decimal(14,2)") * F.lit(1.1).cast("decimal(2,1)"), 2)
               .cast("double")).otherwise(F.col("mrr")).alias("mrr"))
    return C.upsert_touch(old, new, "id", NOW)


@query("load_reference_tables", "S5+A11", oracle=with_chain("lean_concepts", "risk_patterns", "sector_benchmarks",
                                                             "investment_criteria") + """
SELECT 'lean_concepts' AS table_name, count(*) AS n_rows FROM lean_concepts
UNION ALL SELECT 'risk_patterns', count(*) FROM risk_patterns
UNION ALL SELECT 'sector_benchmarks', count(*) FROM sector_benchmarks
UNION ALL SELECT 'investment_criteria', count(*) FROM investment_criteria
""")
def q_load_reference_tables(spark, sf_dir):
    root = scratch_path(spark, "reference-tables")
    tables = {n: adapter(spark, sf_dir, n) for n in seeds.LOAD_ORDER}
    version = seeds.load_reference_tables(spark, tables, root)
    parts = [seeds.read_reference_table(spark, root, n, version).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("table_name"), "n_rows") for n in seeds.LOAD_ORDER]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
