"""Registered knowledge-base queries (survey sections 2.2, 2.3, 2.5: P*, J*, W6, W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.enums import CRITERION_WEIGHTS, CRITICALITIES, INVESTOR_PROFILES, OUTCOMES, STAGES, sql_enum_rank
from ledgerline.operators import knowledge as K
from ledgerline.plans.registry import query
from ledgerline.sources.adapters import adapter, with_chain

SECTOR, STAGE = "building", "seed"


# Request terms derived from the data: words of part names (many matches), region
# names (no match, fallback path) and brand numbers (exact alias matches).
def _term_requests(spark, sf_dir):
    part = adapter(spark, sf_dir, "part")
    region = adapter(spark, sf_dir, "region")
    words = part.select(F.explode(F.split("p_name", " ")).alias("term"))
    regions = region.select(F.lower("r_name").alias("term"))
    brands = part.select(F.try_element_at(F.split("p_brand", "#"), F.lit(2)).alias("term"))
    terms = words.unionByName(regions).unionByName(brands).distinct()
    return terms.withColumn("detail_level", F.when(F.length("term") % 2 == 0, "technical").otherwise("simple"))


TERMS_SQL = """terms AS (
  SELECT DISTINCT term FROM (
    SELECT unnest(string_split(p_name, ' ')) AS term FROM part
    UNION ALL SELECT lower(r_name) FROM region
    UNION ALL SELECT string_split(p_brand, '#')[2] FROM part)),
term_hits AS (
  SELECT t.term, c.id FROM terms t JOIN lean_concepts c ON lower(c.concept_name) LIKE '%' || lower(t.term) || '%'
  UNION ALL
  SELECT t.term, c.id FROM terms t JOIN lean_concepts c ON list_contains(c.aliases, t.term)),
term_first AS (SELECT term, min(id) AS id FROM term_hits GROUP BY term)"""


@query("evaluate_metrics", "J5+F16", oracle=with_chain("observations", "sector_benchmarks") + """
SELECT o.obs_id, o.sector, o.stage, o.metric_name, o.value,
  b.value_median, b.value_good, b.value_excellent, b.value_warning,
  CASE WHEN b.metric_name IS NULL THEN 'unknown'
       WHEN coalesce(b.value_excellent, 0) > coalesce(b.value_warning, 0) THEN
         CASE WHEN b.value_excellent IS NOT NULL AND o.value >= b.value_excellent THEN 'excellent'
              WHEN b.value_good IS NOT NULL AND o.value >= b.value_good THEN 'good'
              WHEN b.value_median IS NOT NULL AND o.value >= b.value_median THEN 'median'
              ELSE 'warning' END
       ELSE
         CASE WHEN b.value_excellent IS NOT NULL AND o.value <= b.value_excellent THEN 'excellent'
              WHEN b.value_good IS NOT NULL AND o.value <= b.value_good THEN 'good'
              WHEN b.value_median IS NOT NULL AND o.value <= b.value_median THEN 'median'
              ELSE 'warning' END
  END AS level
FROM observations o LEFT JOIN sector_benchmarks b
  ON o.sector = b.sector AND o.stage = b.stage AND o.metric_name = b.metric_name
""")
def q_evaluate_metrics(spark, sf_dir):
    return K.evaluate_metrics(adapter(spark, sf_dir, "observations"), adapter(spark, sf_dir, "sector_benchmarks"))


@query("metric_interpretation", "F16", oracle=with_chain("observations", "sector_benchmarks") + """
, lv AS (
SELECT o.obs_id, o.sector, o.stage, o.metric_name, o.value,
  CASE WHEN b.metric_name IS NULL THEN 'unknown'
       WHEN coalesce(b.value_excellent, 0) > coalesce(b.value_warning, 0) THEN
         CASE WHEN b.value_excellent IS NOT NULL AND o.value >= b.value_excellent THEN 'excellent'
              WHEN b.value_good IS NOT NULL AND o.value >= b.value_good THEN 'good'
              WHEN b.value_median IS NOT NULL AND o.value >= b.value_median THEN 'median'
              ELSE 'warning' END
       ELSE
         CASE WHEN b.value_excellent IS NOT NULL AND o.value <= b.value_excellent THEN 'excellent'
              WHEN b.value_good IS NOT NULL AND o.value <= b.value_good THEN 'good'
              WHEN b.value_median IS NOT NULL AND o.value <= b.value_median THEN 'median'
              ELSE 'warning' END
  END AS level
FROM observations o LEFT JOIN sector_benchmarks b
  ON o.sector = b.sector AND o.stage = b.stage AND o.metric_name = b.metric_name)
SELECT obs_id, level,
  CASE level
    WHEN 'excellent' THEN 'Votre ' || metric_name || ' de ' || CAST(value AS VARCHAR) || ' est excellent — dans le top quartile du secteur ' || sector || ' en ' || stage || '.'
    WHEN 'good' THEN 'Votre ' || metric_name || ' de ' || CAST(value AS VARCHAR) || ' est bon — au-dessus de la médiane sectorielle.'
    WHEN 'median' THEN 'Votre ' || metric_name || ' de ' || CAST(value AS VARCHAR) || ' est dans la médiane du secteur ' || sector || ' en ' || stage || '. Correct, mais améliorable.'
    WHEN 'warning' THEN 'Votre ' || metric_name || ' de ' || CAST(value AS VARCHAR) || ' est en zone d''alerte — en dessous des standards du secteur ' || sector || ' en ' || stage || '.'
    ELSE 'Aucun benchmark disponible pour ' || metric_name || ' en ' || sector || '/' || stage || '.'
  END AS interpretation
FROM lv
""")
def q_metric_interpretation(spark, sf_dir):
    ev = K.evaluate_metrics(adapter(spark, sf_dir, "observations"), adapter(spark, sf_dir, "sector_benchmarks"))
    return ev.select("obs_id", "level", K.interpretation_text(
        F.col("level"), F.col("metric_name"), F.col("value"), F.col("sector"), F.col("stage")).alias("interpretation"))


@query("benchmarks_with_context", "P4", oracle=with_chain("startups", "sector_benchmarks") + """
, req AS (SELECT DISTINCT sector, stage FROM startups)
SELECT r.sector, r.stage, b.metric_name, b.value_median, b.value_good, b.value_excellent, b.value_warning,
  count(b.metric_name) OVER (PARTITION BY r.sector, r.stage) AS count,
  count(b.metric_name) OVER (PARTITION BY r.sector, r.stage) > 0 AS found
FROM req r LEFT JOIN sector_benchmarks b ON b.sector = r.sector AND b.stage = r.stage
""")
def q_benchmarks_with_context(spark, sf_dir):
    req = adapter(spark, sf_dir, "startups").select("sector", "stage").distinct()
    return K.benchmarks_for_requests(req, adapter(spark, sf_dir, "sector_benchmarks"))


@query("risk_patterns_filter", "P1", oracle=with_chain("risk_patterns") + f"""
SELECT id, pattern_name, sector, stage, criticality, category FROM risk_patterns
WHERE (sector = '{SECTOR}' OR sector IS NULL) AND (stage = '{STAGE}' OR stage IS NULL)
ORDER BY CASE criticality WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END,
  CASE WHEN sector IS NULL THEN 1 ELSE 0 END, id
LIMIT 10
""")
def q_risk_patterns_filter(spark, sf_dir):
    return K.risk_patterns_filter(adapter(spark, sf_dir, "risk_patterns"), sector=SECTOR, stage=STAGE)


@query("risk_cards", "P1", oracle=with_chain("risk_patterns") + f"""
, top AS (SELECT * FROM risk_patterns WHERE criticality = 'critical' AND (sector = 'machinery' OR sector IS NULL)
  ORDER BY CASE WHEN sector IS NULL THEN 1 ELSE 0 END, id LIMIT 10)
SELECT id, coalesce(pattern_name, '') AS name, coalesce(criticality, '') AS criticality, '' AS explanation,
  '' AS warning_signs, '' AS mitigation, CAST(NULL AS VARCHAR) AS time_to_impact, count(*) OVER () AS count
FROM top
""")
def q_risk_cards(spark, sf_dir):
    top = K.risk_patterns_filter(adapter(spark, sf_dir, "risk_patterns"), sector="machinery", criticality="critical")
    return K.risk_cards(top)


@query("risk_pattern_search", "P2", oracle=with_chain("risk_patterns") + """
SELECT * FROM risk_patterns WHERE pattern_name ILIKE '%ring%'
""")
def q_risk_pattern_search(spark, sf_dir):
    return K.risk_pattern_search(adapter(spark, sf_dir, "risk_patterns"), "ring", first_only=False)


@query("risk_pattern_first", "P2", oracle=with_chain("risk_patterns") + """
SELECT * FROM risk_patterns WHERE pattern_name ILIKE '%ring%' ORDER BY id LIMIT 1
""")
def q_risk_pattern_first(spark, sf_dir):
    return K.risk_pattern_search(adapter(spark, sf_dir, "risk_patterns"), "ring", first_only=True)


@query("critical_risks", "P3", oracle=with_chain("risk_patterns") + """
SELECT id, pattern_name, sector, stage, criticality, category,
  CAST(CASE criticality WHEN 'critical' THEN 1 WHEN 'high' THEN 2 END AS INTEGER) AS criticality_rank
FROM risk_patterns WHERE criticality IN ('critical', 'high')
""")
def q_critical_risks(spark, sf_dir):
    return K.critical_risks(adapter(spark, sf_dir, "risk_patterns"))


@query("concept_lookup", "P5", oracle=with_chain("lean_concepts") + """
SELECT id, concept_name, category, simple_def FROM lean_concepts
WHERE concept_name ILIKE '%ING%' OR list_contains(aliases, 'ING') ORDER BY id LIMIT 1
""")
def q_concept_lookup(spark, sf_dir):
    return K.concept_lookup(adapter(spark, sf_dir, "lean_concepts"), "ING").select(
        "id", "concept_name", "category", "simple_def")


@query("concept_alias_lookup", "P5", oracle=with_chain("lean_concepts") + """
SELECT id, concept_name, category, simple_def FROM lean_concepts
WHERE concept_name ILIKE '%Brand%' OR list_contains(aliases, 'Brand') ORDER BY id LIMIT 1
""")
def q_concept_alias_lookup(spark, sf_dir):
    return K.concept_lookup(adapter(spark, sf_dir, "lean_concepts"), "Brand").select(
        "id", "concept_name", "category", "simple_def")


@query("concepts_by_category", "P6", oracle=with_chain("lean_concepts") + """
SELECT concept_name, category, simple_def FROM lean_concepts WHERE category = 'metric'
""")
def q_concepts_by_category(spark, sf_dir):
    return K.concepts_by_category(adapter(spark, sf_dir, "lean_concepts"), "metric")


@query("investment_criteria_filter", "P7", oracle=with_chain("investment_criteria") + """
SELECT id, investor_profile, stage, criterion_name, weight,
  CAST(CASE weight WHEN 'critical' THEN 1 WHEN 'important' THEN 2 WHEN 'nice-to-have' THEN 3 END AS INTEGER) AS weight_rank
FROM investment_criteria WHERE investor_profile = 'vc' AND stage = 'pre-seed'
""")
def q_investment_criteria_filter(spark, sf_dir):
    return K.investment_criteria_filter(adapter(spark, sf_dir, "investment_criteria"), "vc", "pre-seed")


@query("criteria_for_requests", "P7", oracle=with_chain("investment_criteria", "startups") + """
, req AS (SELECT DISTINCT unnest(['angel', 'vc', 'impact', 'strategic', 'crowdfunding']) AS investor_profile, stage
          FROM startups),
lst AS (SELECT investor_profile, stage, id, criterion_name, weight,
          row_number() OVER (PARTITION BY investor_profile, stage
            ORDER BY CASE weight WHEN 'critical' THEN 1 WHEN 'important' THEN 2 WHEN 'nice-to-have' THEN 3 ELSE 4 END, id) AS criterion_rank,
          count(*) OVER (PARTITION BY investor_profile, stage) AS n FROM investment_criteria)
SELECT r.investor_profile, r.stage, l.criterion_rank, l.id, l.criterion_name, l.weight, coalesce(l.n, 0) AS count, l.n IS NOT NULL AS found
FROM req r LEFT JOIN lst l ON l.investor_profile = r.investor_profile AND l.stage = r.stage
""")
def q_criteria_for_requests(spark, sf_dir):
    stages = adapter(spark, sf_dir, "startups").select("stage").distinct()
    profiles = stages.select(F.explode(F.array(*[F.lit(p) for p in INVESTOR_PROFILES])).alias("investor_profile"), "stage")
    return K.criteria_for_requests(profiles, adapter(spark, sf_dir, "investment_criteria"))


@query("concept_cards", "P9", oracle=with_chain("lean_concepts") + "," + TERMS_SQL + """
, req AS (SELECT term, CASE WHEN length(term) % 2 = 0 THEN 'technical' ELSE 'simple' END AS detail_level FROM terms)
SELECT r.term, r.detail_level, f.id IS NOT NULL AS found, coalesce(c.concept_name, r.term) AS concept_name,
  CASE WHEN f.id IS NOT NULL THEN c.simple_def
       ELSE 'Concept ''' || r.term || ''' non trouvé dans la base. Essayez avec un terme différent (ex: ''MVP'', ''churn'', ''pivot'').' END AS simple_def,
  CASE WHEN r.detail_level = 'technical' THEN c.technical_def END AS technical_def
FROM req r LEFT JOIN term_first f ON f.term = r.term LEFT JOIN lean_concepts c ON c.id = f.id
""")
def q_concept_cards(spark, sf_dir):
    return K.concept_cards(_term_requests(spark, sf_dir), adapter(spark, sf_dir, "lean_concepts"))


@query("concept_mentions", "J6", oracle=with_chain("lean_concepts") + "," + TERMS_SQL + """
SELECT t.term, f.id, c.concept_name, c.category, c.simple_def, f.id IS NOT NULL AS found
FROM terms t LEFT JOIN term_first f ON f.term = t.term LEFT JOIN lean_concepts c ON c.id = f.id
""")
def q_concept_mentions(spark, sf_dir):
    out = K.concept_mentions(_term_requests(spark, sf_dir), adapter(spark, sf_dir, "lean_concepts"))
    return out.select("term", "id", "concept_name", "category", "simple_def", "found")


@query("validate_requests", "P12", oracle="""
SELECT doc_id,
  concat_ws(',', CASE WHEN text IS NULL OR length(text) < 50 THEN 'description_too_short' END,
                 CASE WHEN length(text) > 5000 THEN 'description_too_long' END) AS reasons,
  NOT (text IS NULL OR length(text) < 50 OR length(text) > 5000) AS valid
FROM documents
""")
def q_validate_requests(spark, sf_dir):
    docs = adapter(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
    return K.validate_requests(docs).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "valid")


@query("startups_with_pivot_count", "J1", oracle=with_chain("startups", "pivot_cases") + """
SELECT s.id, s.name, s.sector, s.stage, s.region, s.country, s.founding_year, s.outcome, s.mrr,
  count(pc.id) AS pivot_count
FROM startups s LEFT JOIN pivot_cases pc ON pc.startup_id = s.id
GROUP BY s.id, s.name, s.sector, s.stage, s.region, s.country, s.founding_year, s.outcome, s.mrr
""")
def q_startups_with_pivot_count(spark, sf_dir):
    return K.startups_with_pivot_count(adapter(spark, sf_dir, "startups"), adapter(spark, sf_dir, "pivot_cases"))


@query("similar_startups", "J2", oracle=with_chain("startups", "pivot_cases") + f"""
, v AS (SELECT s.id, count(pc.id) AS pivot_count FROM startups s LEFT JOIN pivot_cases pc ON pc.startup_id = s.id GROUP BY s.id)
SELECT s.id, s.name, s.sector, s.stage, s.region, s.country, s.founding_year, s.outcome, s.mrr, v.pivot_count
FROM v JOIN startups s ON s.id = v.id
WHERE s.sector = '{SECTOR}'
ORDER BY v.pivot_count DESC, s.founding_year DESC NULLS FIRST, s.id LIMIT 5
""")
def q_similar_startups(spark, sf_dir):
    return K.similar_startups(adapter(spark, sf_dir, "startups"), adapter(spark, sf_dir, "pivot_cases"), SECTOR)


@query("pivot_case_search", "J3", oracle=with_chain("startups", "pivot_cases") + f"""
SELECT pc.id, pc.startup_id, pc.pivot_type, pc.outcome, pc.trigger_value, s.sector, s.region
FROM pivot_cases pc JOIN startups s ON s.id = pc.startup_id
WHERE pc.pivot_type = 'zoom-in' AND s.sector = '{SECTOR}'
ORDER BY {sql_enum_rank('pc.outcome', OUTCOMES)} DESC, pc.id LIMIT 5
""")
def q_pivot_case_search(spark, sf_dir):
    return K.pivot_case_search(adapter(spark, sf_dir, "pivot_cases"), adapter(spark, sf_dir, "startups"),
                               pivot_type="zoom-in", sector=SECTOR)


@query("segment_risk_join", "J4", oracle=with_chain("startups", "risk_patterns") + """
, seg AS (SELECT sector, stage, count(*) AS n_startups FROM startups GROUP BY sector, stage)
SELECT g.sector, g.stage, r.id AS risk_id, r.criticality, r.category, r.sector IS NULL AS universal_sector, g.n_startups
FROM seg g JOIN risk_patterns r
  ON (r.sector = g.sector OR r.sector IS NULL) AND (r.stage = g.stage OR r.stage IS NULL)
""")
def q_segment_risk_join(spark, sf_dir):
    return K.segment_risk_join(adapter(spark, sf_dir, "startups"), adapter(spark, sf_dir, "risk_patterns"))


@query("startup_risk_exposure", "J4", oracle=with_chain("startups", "risk_patterns") + """
SELECT s.id AS startup_id, s.sector, s.stage, count(r.id) AS n_risks,
  count(r.id) FILTER (WHERE r.criticality = 'critical') AS n_critical,
  count(r.id) FILTER (WHERE r.criticality = 'high') AS n_high,
  count(r.id) FILTER (WHERE r.criticality = 'medium') AS n_medium,
  count(r.id) FILTER (WHERE r.criticality = 'low') AS n_low
FROM startups s LEFT JOIN risk_patterns r
  ON (r.sector = s.sector OR r.sector IS NULL) AND (r.stage = s.stage OR r.stage IS NULL)
GROUP BY s.id, s.sector, s.stage
""")
def q_startup_risk_exposure(spark, sf_dir):
    return K.startup_risk_exposure(adapter(spark, sf_dir, "startups"), adapter(spark, sf_dir, "risk_patterns"))


@query("top_risks_per_startup", "W6", oracle=with_chain("startups", "risk_patterns") + f"""
, pairs AS (
SELECT s.id AS startup_id, s.sector, s.stage, r.id AS risk_id, r.criticality,
  row_number() OVER (PARTITION BY s.id ORDER BY {sql_enum_rank('r.criticality', CRITICALITIES)},
                     CASE WHEN r.sector IS NULL THEN 1 ELSE 0 END, r.id) AS rn
FROM startups s JOIN risk_patterns r
  ON (r.sector = s.sector OR r.sector IS NULL) AND (r.stage = s.stage OR r.stage IS NULL))
SELECT sector, stage, startup_id, risk_id, criticality, CAST(rn AS INTEGER) AS risk_rank FROM pairs WHERE rn <= 5
""")
def q_top_risks_per_startup(spark, sf_dir):
    return K.top_risks_per_startup(adapter(spark, sf_dir, "startups"), adapter(spark, sf_dir, "risk_patterns"), k=5)


@query("diagnosis_context", "J7", oracle=with_chain("startups", "risk_patterns", "sector_benchmarks",
                                                    "investment_criteria", "pivot_cases") + """
, seg AS (SELECT DISTINCT sector, stage FROM startups),
rk AS (SELECT g.sector, g.stage, r.id,
         row_number() OVER (PARTITION BY g.sector, g.stage ORDER BY CASE WHEN r.sector IS NULL THEN 1 ELSE 0 END, r.id) AS rn
       FROM seg g JOIN risk_patterns r ON (r.sector = g.sector OR r.sector IS NULL) AND (r.stage = g.stage OR r.stage IS NULL)
       WHERE r.criticality = 'critical'),
pc AS (SELECT s.id, s.name, s.sector, s.stage, s.founding_year, count(p.id) AS n FROM startups s LEFT JOIN pivot_cases p ON p.startup_id = s.id
       GROUP BY s.id, s.name, s.sector, s.stage, s.founding_year),
sr AS (SELECT sector, stage, id, name,
         row_number() OVER (PARTITION BY sector, stage ORDER BY n DESC, founding_year DESC NULLS FIRST, id) AS rn FROM pc)
SELECT sector, stage, 'segment' AS kind, CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS VARCHAR) AS item FROM seg
UNION ALL SELECT sector, stage, 'risk', rn, id, NULL FROM rk WHERE rn <= 5
UNION ALL SELECT b.sector, b.stage, 'benchmark', row_number() OVER (PARTITION BY b.sector, b.stage ORDER BY b.metric_name), NULL, b.metric_name
  FROM sector_benchmarks b JOIN seg USING (sector, stage)
UNION ALL SELECT g.sector, g.stage, 'criterion', row_number() OVER (PARTITION BY g.sector, g.stage ORDER BY c.id), c.id, NULL
  FROM seg g JOIN investment_criteria c ON c.stage = g.stage WHERE c.investor_profile = 'angel' AND c.weight = 'critical'
UNION ALL SELECT sector, stage, 'startup', rn, id, name FROM sr WHERE rn <= 3
""")
def q_diagnosis_context(spark, sf_dir):
    st = adapter(spark, sf_dir, "startups")
    return K.diagnosis_context(st, adapter(spark, sf_dir, "risk_patterns"), adapter(spark, sf_dir, "sector_benchmarks"),
                               adapter(spark, sf_dir, "investment_criteria"), st, adapter(spark, sf_dir, "pivot_cases"))


@query("priority_sort", "W9", oracle=with_chain("investment_criteria") + f"""
SELECT id, investor_profile, stage, criterion_name, weight,
  CAST({sql_enum_rank('weight', CRITERION_WEIGHTS)} AS INTEGER) AS weight_rank,
  CAST({sql_enum_rank('stage', STAGES)} AS INTEGER) AS stage_rank,
  CAST({sql_enum_rank('investor_profile', INVESTOR_PROFILES)} AS INTEGER) AS investor_profile_rank
FROM investment_criteria
""")
def q_priority_sort(spark, sf_dir):
    return K.priority_sort(adapter(spark, sf_dir, "investment_criteria"))
