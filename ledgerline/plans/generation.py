"""Registered generation queries (survey 2.8 G1-G7, F1, F20): examples are seeded from
the ids of a given table, so the work grows with it. The oracles spell out seeds, weights and
vocabularies by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import generate as G
from ledgerline.operators import quality as Q
from ledgerline.operators import splits as S
from ledgerline.plans.registry import query
from ledgerline.sources import jsonl as J
from ledgerline.sources.adapters import adapter, with_chain


def _ids(spark, sf_dir):
    return adapter(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


def _hard_ids(spark, sf_dir):
    return adapter(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()


def _catalogues(spark, sf_dir):
    return G.Catalogues(*[adapter(spark, sf_dir, f"gen_{n}") for n in ("risks", "strengths", "concepts", "criteria", "contexts", "branches")])


def _u(field, seed=42, ident="id"):
    return f"(CAST('0x' || substr(sha1('{seed}:{field}:' || CAST({ident} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"


LABEL_SQL = {False: "CASE WHEN {u} < 0.36 THEN 'Green Flag' WHEN {u} < 0.75 THEN 'Red Flag' ELSE 'Mixed' END",
             True: "CASE WHEN {u} < 0.31 THEN 'Green Flag' WHEN {u} < 0.68 THEN 'Red Flag' ELSE 'Mixed' END"}
DIFFICULTY_SQL = {
    False: "CASE WHEN {u} < 0.30 THEN 'Explicite' WHEN {u} < 0.68 THEN 'Implicite' WHEN {u} < 0.86 THEN 'Ambigu' ELSE 'Mixte' END",
    True: "CASE WHEN {u} < 0.15 THEN 'Explicite' WHEN {u} < 0.55 THEN 'Implicite' WHEN {u} < 0.85 THEN 'Ambigu' ELSE 'Mixte' END"}
SECTORS_SQL = ("['SaaS B2B', 'Marketplace', 'Fintech', 'Healthtech', 'Edtech', 'Agritech', 'E-commerce', 'Deeptech', 'Web3', 'Cleantech', "
               "'Proptech', 'Adtech', 'Insurtech', 'Logistique', 'Foodtech']", 15)
STAGES_SQL = ("['Idéation', 'Pre-Seed', 'Seed', 'Series A', 'Post-Pivot']", 5)
REGIONS_SQL = ("['France', 'Afrique subsaharienne', 'Maroc', 'USA', 'Europe', 'Asie du Sud-Est']", 6)
PROFILES_SQL = ("['angel', 'vc', 'impact', 'strategic', 'entrepreneur']", 5)


QUOTA_SQL = """
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id AS id, pos,
  CASE WHEN pos < floor(n * 0.32) THEN 'diagnostic_complet'
       WHEN pos < floor(n * 0.32) + floor(n * 0.25) THEN 'identification_des_dangers'
       WHEN pos < floor(n * 0.32) + floor(n * 0.25) + floor(n * 0.28) THEN 'evaluation_investissement'
       ELSE 'simplification_concept' END AS category, n AS n_total
FROM p
"""


@query("category_quotas", "G1", oracle=QUOTA_SQL)
def q_category_quotas(spark, sf_dir):
    return G.category_quotas(_ids(spark, sf_dir))


@query("weighted_choice", "G2", oracle=f"""
SELECT doc_id AS id, {_u('tool', ident='doc_id')} < 0.35 AS has_tool_use,
  {LABEL_SQL[False].format(u=_u('label', ident='doc_id'))} AS drawn_label,
  {DIFFICULTY_SQL[False].format(u=_u('difficulty', ident='doc_id'))} AS drawn_difficulty
FROM documents
""")
def q_weighted_choice(spark, sf_dir):
    return G.draws(_ids(spark, sf_dir)).select("id", "has_tool_use", "drawn_label", "drawn_difficulty")


CATALOGUE_ADAPTERS = ("gen_risks", "gen_strengths", "gen_concepts", "gen_criteria", "gen_contexts", "gen_branches")


def _set_sql(name: str, ids: str, hard: bool = False) -> str:
    """CTEs ``<name>_...`` of one set, the last one ``<name>`` with every field of an example."""
    seed = 141 if hard else 42
    u = lambda field: _u(field, seed)
    one = lambda values, field: f"{values[0]}[CAST(floor({u(field)} * {values[1]}) AS INTEGER) + 1]"
    place = lambda cat, field: f"CAST(floor({u(field)} * (SELECT count(*) FROM {cat})) AS BIGINT)"
    second = lambda cat, field: (f"(({place(cat, field)} + 1 + CAST(floor({u(field + '2')} * greatest((SELECT count(*) FROM {cat}) - 1, 1)) AS BIGINT)) "  # noqa: E731
                                 f"% (SELECT count(*) FROM {cat}))")
    danger_label = f"CASE WHEN {u('mixed')} < 0.75 THEN 'Red Flag' ELSE 'Mixed' END" if hard else "'Red Flag'"
    simple = f"CASE WHEN {u('simple_difficulty')} < 0.5 THEN 'Explicite' ELSE 'Implicite' END" if hard else "'Explicite'"
    return f"""
{name}_p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM ({ids})),
{name}_q AS (SELECT id, pos,
  CASE WHEN pos < floor(n * 0.32) THEN 'diagnostic_complet'
       WHEN pos < floor(n * 0.32) + floor(n * 0.25) THEN 'identification_des_dangers'
       WHEN pos < floor(n * 0.32) + floor(n * 0.25) + floor(n * 0.28) THEN 'evaluation_investissement'
       ELSE 'simplification_concept' END AS category,
  {u('tool')} < 0.35 AS tools, {LABEL_SQL[hard].format(u=u('label'))} AS drawn_label, {DIFFICULTY_SQL[hard].format(u=u('difficulty'))} AS drawn_difficulty,
  {danger_label} AS danger_label, {simple} AS simple_difficulty, {u('form')} AS u_form,
  {one(SECTORS_SQL, 'sector')} AS sector, {one(STAGES_SQL, 'stage')} AS stage, {one(REGIONS_SQL, 'region')} AS region, {one(PROFILES_SQL, 'profile')} AS profile,
  {place('gen_risks', 'risk')} AS r1, {second('gen_risks', 'risk')} AS r2, {place('gen_strengths', 'strength')} AS s1,
  {place('gen_concepts', 'concept')} AS c1, {place('gen_criteria', 'criterion')} AS k1, {second('gen_criteria', 'criterion')} AS k2,
  {place('gen_contexts', 'context')} AS x1
  FROM {name}_p),
{name}_l AS (SELECT *,
  CASE category WHEN 'identification_des_dangers' THEN danger_label WHEN 'simplification_concept' THEN 'Green Flag' ELSE drawn_label END AS label,
  CASE WHEN category = 'simplification_concept' THEN simple_difficulty ELSE drawn_difficulty END AS difficulty FROM {name}_q),
{name}_f AS (SELECT q.*, ra.name AS ra_name, ra.principle AS ra_principle, ra.severity AS ra_severity, ra.slug AS ra_slug, ra.explicit AS ra_explicit,
    ra.implicit AS ra_implicit, ra.why AS ra_why, rb.name AS rb_name, rb.principle AS rb_principle, rb.severity AS rb_severity, rb.slug AS rb_slug,
    rb.explicit AS rb_explicit, rb.implicit AS rb_implicit, rb.why AS rb_why, st.name AS st_name, st.principle AS st_principle, st.evidence AS st_evidence,
    st.why AS st_why, co.name AS co_name, co.principle AS co_principle, co.simple_def, co.analogy, ka.criterion_name AS ka_name, ka.weight AS ka_weight,
    ka.simple_rule AS ka_rule, kb.criterion_name AS kb_name, kb.weight AS kb_weight, kb.simple_rule AS kb_rule, cx.context,
    CASE WHEN category = 'identification_des_dangers' THEN CASE WHEN ra.severity = 'Fatal' OR rb.severity = 'Fatal' THEN 'Fatal' ELSE 'Majeur' END
         WHEN category = 'simplification_concept' OR label = 'Green Flag' THEN 'Non applicable' ELSE ra.severity END AS severity,
    CASE WHEN category = 'simplification_concept' THEN co.principle WHEN category <> 'identification_des_dangers' AND label = 'Green Flag' THEN st.principle
         ELSE ra.principle END AS principle
  FROM {name}_l q JOIN n_risks ra ON ra.pos = q.r1 JOIN n_risks rb ON rb.pos = q.r2 JOIN n_strengths st ON st.pos = q.s1
    JOIN n_concepts co ON co.pos = q.c1 JOIN n_criteria ka ON ka.pos = q.k1 JOIN n_criteria kb ON kb.pos = q.k2 JOIN n_contexts cx ON cx.pos = q.x1),
{name} AS (SELECT f.*, b.system_plain, b.system_tools, b.evidence, b.answer, b.sql, string_split(b.users, '#') AS forms,
    CASE WHEN list_contains(string_split(b.implicit_for, '#'), f.difficulty) THEN 'implicit' ELSE 'explicit' END AS mode
  FROM {name}_f f JOIN gen_branches b ON b.category = f.category AND b.label = f.label)"""


FIELDS = {
    "evidence": "evidence", "risk.mode": "CASE mode WHEN 'implicit' THEN ra_implicit ELSE ra_explicit END",
    "risk2.mode": "CASE mode WHEN 'implicit' THEN rb_implicit ELSE rb_explicit END", "idx": "CAST(pos AS VARCHAR)", "sector": "sector", "stage": "stage",
    "region": "region", "profile": "profile", "stage_slug": "translate(lower(stage), 'éèê -', 'eee__')", "label": "label", "severity": "severity",
    "difficulty": "difficulty", "principle": "principle", "context": "context", "risk.name": "ra_name", "risk.slug": "ra_slug", "risk.why": "ra_why",
    "risk2.name": "rb_name", "risk2.slug": "rb_slug", "strength.evidence": "st_evidence", "strength.why": "st_why", "concept.name": "co_name",
    "concept.simple_def": "simple_def", "concept.analogy": "analogy"}


def _filled(template: str) -> str:
    for field, value in FIELDS.items():
        template = f"replace({template}, '{{{field}}}', {value})"
    return template


NUMBERED = with_chain(*CATALOGUE_ADAPTERS).rstrip() + "".join(
    f", n_{t} AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM gen_{t})" for t in ("risks", "strengths", "concepts", "criteria", "contexts")) + ","
PLAIN_IDS, HARD_IDS = "SELECT doc_id AS id FROM documents", "SELECT DISTINCT conv_id AS id FROM conversations"
RESULT_SQL = """'{"status":"success","row_count":' || CASE WHEN category IN ('identification_des_dangers', 'evaluation_investissement') THEN '2' ELSE '1' END
  || ',"execution_time_ms":8.4,"data":' || CAST(CASE category
    WHEN 'identification_des_dangers' THEN to_json([{'pattern_name': ra_name, 'criticality': ra_severity, 'simple_explain': ra_why, 'lean_principle': ra_principle},
                                                    {'pattern_name': rb_name, 'criticality': rb_severity, 'simple_explain': rb_why, 'lean_principle': rb_principle}])
    WHEN 'evaluation_investissement' THEN to_json([{'criterion_name': ka_name, 'weight': CASE WHEN severity = 'Fatal' THEN 'critical' ELSE ka_weight END, 'simple_rule': ka_rule},
                                                   {'criterion_name': kb_name, 'weight': kb_weight, 'simple_rule': kb_rule}])
    WHEN 'simplification_concept' THEN to_json([{'concept_name': co_name, 'simple_def': simple_def, 'analogy': analogy, 'lean_principle': principle}])
    ELSE to_json([{'pattern_name': ra_name, 'criticality': severity, 'simple_explain': ra_why, 'lean_principle': principle}]) END AS VARCHAR) || '}'"""


def _turns_sql(name: str) -> str:
    """CTE ``<name>_t(pos, turn, role, content)``."""
    call = ("'<|tool_call_start|>{\"name\": \"query_postgresql\", \"parameters\": {\"sql\": \"' || " + _filled("sql")
            + " || '\"}}<|tool_call_end|>'")
    user = _filled("forms[CAST(floor(u_form * len(forms)) AS INTEGER) + 1]")
    return f"""
{name}_t AS (
  SELECT pos, 0 AS turn, 'system' AS role, CASE WHEN tools THEN system_tools ELSE system_plain END AS content FROM {name}
  UNION ALL SELECT pos, 1, 'user', {user} FROM {name}
  UNION ALL SELECT pos, 2, 'assistant', {call} FROM {name} WHERE tools
  UNION ALL SELECT pos, 3, 'tool', {RESULT_SQL} FROM {name} WHERE tools
  UNION ALL SELECT pos, CASE WHEN tools THEN 4 ELSE 2 END, 'assistant', {_filled('answer')} FROM {name})"""


META_COLUMNS = """printf('lean-%05d', pos) AS example_key, category, label AS "Label", severity AS "Severity", difficulty AS "Difficulty",
  CASE WHEN category = 'simplification_concept' THEN 'universal' ELSE sector END AS sector,
  CASE WHEN category IN ('diagnostic_complet', 'evaluation_investissement') THEN stage ELSE 'non applicable' END AS stage,
  CASE WHEN category IN ('diagnostic_complet', 'evaluation_investissement') THEN region ELSE 'non applicable' END AS region,
  profile AS investor_profile, tools AS has_tool_use, principle AS lean_principle"""
PLAIN = NUMBERED + _set_sql("g", PLAIN_IDS)


@query("generated_examples", "G3-G6", oracle=PLAIN + "," + _turns_sql("g") + """
SELECT pos AS example_id, CAST(turn AS BIGINT) AS turn, role, content FROM g_t
""")
def q_generated_examples(spark, sf_dir):
    _, msgs = G.generate_examples(_ids(spark, sf_dir), _catalogues(spark, sf_dir))
    return msgs.drop("hard_eval")


@query("generated_metadata", "G3-G6", oracle=PLAIN + f" SELECT pos AS example_id, false AS hard_eval, {META_COLUMNS} FROM g")
def q_generated_metadata(spark, sf_dir):
    return G.generate_examples(_ids(spark, sf_dir), _catalogues(spark, sf_dir))[0]


@query("hard_eval_examples", "G7", oracle=NUMBERED + _set_sql("g", PLAIN_IDS, hard=True) + "," + _turns_sql("g") + f"""
SELECT g.pos AS example_id, true AS hard_eval, {META_COLUMNS.replace('pos)', 'g.pos)')}, t.text
FROM g JOIN (SELECT pos AS p, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY turn) AS text FROM g_t GROUP BY pos) t
  ON t.p = g.pos
""")
def q_hard_eval_examples(spark, sf_dir):
    meta, msgs = G.generate_examples(_ids(spark, sf_dir), _catalogues(spark, sf_dir), hard=True)
    return meta.join(Q.render_chat_text(msgs), "example_id")


@query("generated_overview", "G7+A2", oracle=PLAIN + "," + _turns_sql("g") + """,
ch AS (SELECT pos, count(*) AS n_messages, sum(length(content)) AS n_chars FROM g_t GROUP BY pos)
SELECT count(*) AS total, count(*) FILTER (WHERE tools) AS tool_use_count,
  count(*) FILTER (WHERE tools) / count(*) AS tool_use_ratio,
  count(*) FILTER (WHERE difficulty IN ('Implicite', 'Ambigu', 'Mixte')) / count(*) AS implicit_ratio,
  round(sum(n_messages) / count(*), 1) AS avg_messages_per_example,
  CAST(round(sum(n_chars) / count(*), 0) AS BIGINT) AS avg_chars_per_example,
  CAST(min(n_chars) AS BIGINT) AS min_chars, CAST(max(n_chars) AS BIGINT) AS max_chars
FROM g JOIN ch USING (pos)
""")
def q_generated_overview(spark, sf_dir):
    meta, msgs = G.generate_examples(_ids(spark, sf_dir), _catalogues(spark, sf_dir))
    return Q.dataset_overview(Q.example_facts(meta, msgs))


SPLIT_OF_SET = """,
strat AS (SELECT pos, category || '|' || label || '|' || difficulty || '|' || CASE WHEN tools THEN 'tool' ELSE 'no_tool' END AS stratum,
                 sha1('42:' || CAST(pos AS VARCHAR)) AS h FROM g),
ranked AS (SELECT pos, row_number() OVER (ORDER BY stratum, h, pos) - 1 AS p FROM strat),
splits AS (SELECT pos, CASE WHEN p % 10 < 8 THEN 'train' WHEN p % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM ranked)
"""


@query("generated_split_sizes", "G7+W4+A13", oracle=PLAIN + SPLIT_OF_SET + """
SELECT split, count(*) AS n_rows, CAST(ceil(count(*) / 16) * 3 AS BIGINT) AS est_steps,
  CASE WHEN split = 'train' THEN count(*) >= 3750 END AS meets_floor
FROM splits GROUP BY split
""")
def q_generated_split_sizes(spark, sf_dir):
    meta, _ = G.generate_examples(_ids(spark, sf_dir), _catalogues(spark, sf_dir))
    return S.split_sizes(S.stratified_split(Q.normalise_metadata(meta)))


@query("slug_values", "F1", oracle="""
SELECT doc_id, translate(lower(text), 'éèê -', 'eee__') AS slug FROM documents
""")
def q_slug_values(spark, sf_dir):
    return adapter(spark, sf_dir, "documents").select("doc_id", G.slug(F.col("text")).alias("slug"))


PROFILES = ("angel", "vc", "impact", "strategic", "crowdfunding", "unheard-of")
SYSTEM_TEXT = "You judge young companies."


def _prompt_requests(spark, sf_dir):
    conv = adapter(spark, sf_dir, "conversations")
    msgs = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    last_user = F.array_max(F.transform(F.filter("m", lambda x: x["role"] == "user"), lambda x: x["turn"]))
    profiles = F.array(*[F.lit(p) for p in PROFILES])
    return (msgs.withColumn("_lu", last_user).where(F.col("_lu").isNotNull())
            .select(F.col("conv_id").alias("request_id"),
                    F.element_at(profiles, (F.col("conv_id") % len(PROFILES)).cast("int") + 1).alias("investor_profile"),
                    F.transform(F.filter("m", lambda x: x["turn"] < F.col("_lu")),
                                lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("history"),
                    F.filter("m", lambda x: x["turn"] == F.col("_lu"))[0]["text"].alias("user_text")))


@query("prompt_batches", "F20", oracle=with_chain("gen_instructions").rstrip() + """,
lu AS (SELECT conv_id, max(turn) AS lu FROM conversations WHERE role = 'user' GROUP BY conv_id),
req AS (SELECT conv_id, lu, ['angel', 'vc', 'impact', 'strategic', 'crowdfunding', 'unheard-of'][conv_id % 6 + 1] AS profile FROM lu),
parts AS (
  SELECT y.conv_id, -1 AS turn, '<|im_start|>system' || chr(10) || 'You judge young companies.'
      || coalesce(chr(10) || chr(10) || i.instruction, '') || '<|im_end|>' AS p
    FROM req y LEFT JOIN gen_instructions i ON i.investor_profile = y.profile
  UNION ALL SELECT c.conv_id, c.turn, '<|im_start|>' || c.role || chr(10) || c.text || '<|im_end|>'
    FROM conversations c JOIN req y ON y.conv_id = c.conv_id WHERE c.turn <= y.lu)
SELECT conv_id AS request_id, count(*) AS n_messages, string_agg(p, chr(10) ORDER BY turn) AS rendered
FROM parts GROUP BY conv_id
""")
def q_prompt_batches(spark, sf_dir):
    out = G.prompt_batches(_prompt_requests(spark, sf_dir), adapter(spark, sf_dir, "gen_instructions"), SYSTEM_TEXT)
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(
        F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n")
    return out.select("request_id", F.size("messages").cast("bigint").alias("n_messages"), rendered.alias("rendered"))


def _lines_sql() -> str:
    """Every line that build_dataset writes, as its file holds it."""
    meta = ("{'example_id': pos, 'hard_eval': hard, 'example_key': printf('lean-%05d', pos), 'category': category, 'Label': label, 'Severity': severity, "
            "'Difficulty': difficulty, 'sector': CASE WHEN category = 'simplification_concept' THEN 'universal' ELSE sector END, "
            "'stage': CASE WHEN category IN ('diagnostic_complet', 'evaluation_investissement') THEN stage ELSE 'non applicable' END, "
            "'region': CASE WHEN category IN ('diagnostic_complet', 'evaluation_investissement') THEN region ELSE 'non applicable' END, "
            "'investor_profile': profile, 'has_tool_use': tools, 'lean_principle': principle}")
    chat = "string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY turn)"
    parts = []
    for name, hard, split in (("g", "false", "s.split"), ("h", "true", "'hard_eval'")):
        join = "JOIN splits s USING (pos)" if name == "g" else ""
        parts += [f"SELECT 'examples' AS format, {split} AS split, CAST(to_json({{'messages': t.m, 'metadata': {meta}}}) AS VARCHAR) AS line "
                  f"FROM (SELECT *, {hard} AS hard FROM {name}) g0 {join} JOIN {name}_m t USING (pos)",
                  f"SELECT 'training_text', {split}, CAST(to_json({{'text': t.x, 'metadata': {meta}}}) AS VARCHAR) "
                  f"FROM (SELECT *, {hard} AS hard FROM {name}) g0 {join} JOIN {name}_m t USING (pos)"]
    agg = "".join(f", {n}_m AS (SELECT pos, list({{'role': role, 'content': content}} ORDER BY turn) AS m, {chat} AS x FROM {n}_t GROUP BY pos)" for n in "gh")
    return (PLAIN + "," + _turns_sql("g") + "," + _set_sql("h", HARD_IDS, hard=True) + "," + _turns_sql("h") + SPLIT_OF_SET + agg
            + " UNION ALL ".join(["\n" + parts[0], *parts[1:]]))


@query("build_dataset", "G7+W4+S3+S4", oracle=_lines_sql())
def q_build_dataset(spark, sf_dir):
    root = G.build_dataset(_ids(spark, sf_dir), _hard_ids(spark, sf_dir), _catalogues(spark, sf_dir), J.scratch_path(spark, "dataset"))
    formats = [spark.read.schema("value string, split string").text(f"{root}/{f}").select(
        F.lit(f).alias("format"), "split", F.col("value").alias("line")) for f in ("examples", "training_text")]
    return formats[0].unionByName(formats[1])
