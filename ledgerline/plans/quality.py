"""Registered dataset-quality queries (survey 2.4 A1-A13, 2.5 W3/W4/W7/W8, 2.6 U1-U3,
2.7 F2-F4/F13, 2.1 S1-S4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.enums import VALID_SEVERITIES
from ledgerline.operators import quality as Q
from ledgerline.operators import splits as S
from ledgerline.plans.registry import query
from ledgerline.sources import jsonl as J
from ledgerline.sources.adapters import RAW_TABLES, adapter, with_chain


def facts_of(spark, sf_dir):
    return Q.example_facts(adapter(spark, sf_dir, "example_meta"), adapter(spark, sf_dir, "example_messages"))


# DuckDB: the same per-example facts, written directly in SQL.
FACTS_SQL = """
, msg AS (
  SELECT example_id, count(*) AS n_messages, sum(length(coalesce(content, ''))) AS n_chars,
    arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
    bool_or(role = 'user') AS has_user, bool_or(role = 'tool') AS has_tool_message,
    arg_max(content, turn) FILTER (WHERE role = 'assistant') AS last_assistant,
    string_agg(coalesce(content, ''), ' ' ORDER BY turn) FILTER (WHERE role = 'user') AS user_text,
    string_agg(coalesce(role, 'NULL'), ',' ORDER BY turn)
      FILTER (WHERE role IS NULL OR role NOT IN ('system', 'user', 'assistant', 'tool')) AS invalid_roles
  FROM example_messages GROUP BY example_id),
facts AS (
  SELECT m.example_id, m.category, m.label, m.severity, m.difficulty, m.has_tool_use,
    coalesce(g.n_messages, 0) AS n_messages, coalesce(g.n_chars, 0) AS n_chars, g.first_role, g.last_role,
    coalesce(g.has_user, false) AS has_user, coalesce(g.has_tool_message, false) AS has_tool_message,
    g.last_assistant, coalesce(g.user_text, '') AS user_text, g.invalid_roles,
    sha1(trim(regexp_replace(lower(coalesce(g.user_text, '')), '\\s+', ' ', 'g'))) AS prompt_hash
  FROM example_meta m LEFT JOIN msg g ON g.example_id = m.example_id)
"""
FACTS = with_chain("example_meta", "example_messages").rstrip() + FACTS_SQL

ROLE_ERRORS_SQL = """
SELECT example_id, 'sequence' AS error, CAST(NULL AS VARCHAR) AS detail FROM facts
  WHERE n_messages = 0 OR NOT coalesce(first_role = 'system', false) OR NOT coalesce(last_role = 'assistant', false)
UNION ALL SELECT example_id, 'no_user', NULL FROM facts WHERE NOT has_user
UNION ALL SELECT example_id, 'invalid_roles', invalid_roles FROM facts WHERE invalid_roles IS NOT NULL
"""
META_ERRORS_SQL = """
SELECT example_id, 'missing:lean_principle' AS error, CAST(NULL AS VARCHAR) AS detail FROM facts
UNION ALL SELECT example_id, 'invalid:Label', label FROM facts
  WHERE label IS NULL OR label NOT IN ('Green Flag', 'Red Flag', 'Mixed')
UNION ALL SELECT example_id, 'invalid:Severity', severity FROM facts
  WHERE severity IS NULL OR severity NOT IN ('Mineur', 'Majeur', 'Fatal', 'Non applicable')
UNION ALL SELECT example_id, 'invalid:Difficulty', difficulty FROM facts
  WHERE difficulty IS NULL OR difficulty NOT IN ('Explicite', 'Implicite', 'Ambigu', 'Mixte')
"""
LABEL_ERRORS_SQL = """
SELECT example_id, 'label_mismatch' AS error, label AS detail FROM facts
WHERE label IS NOT NULL AND label <> '' AND instr(coalesce(last_assistant, ''), 'Label: ' || label) = 0
"""
TOOL_ERRORS_SQL = """
SELECT example_id, 'flag_without_tool' AS error, CAST(NULL AS VARCHAR) AS detail FROM facts
  WHERE coalesce(has_tool_use, false) AND NOT has_tool_message
UNION ALL SELECT example_id, 'tool_without_flag', NULL FROM facts WHERE NOT coalesce(has_tool_use, false) AND has_tool_message
"""
ENTRIES_SQL = f""", entries AS (
  SELECT *, 'roles' AS kind FROM ({ROLE_ERRORS_SQL})
  UNION ALL SELECT *, 'metadata' FROM ({META_ERRORS_SQL})
  UNION ALL SELECT *, 'label' FROM ({LABEL_ERRORS_SQL})
  UNION ALL SELECT *, 'tool' FROM ({TOOL_ERRORS_SQL}))
"""
METRICS_SQL = ENTRIES_SQL + """, metrics AS (
  SELECT count(*) AS total,
    count(*) FILTER (WHERE coalesce(has_tool_use, false)) / count(*) AS tool_use_ratio,
    count(*) FILTER (WHERE difficulty IN ('Implicite', 'Ambigu', 'Mixte')) / count(*) AS implicit_ratio,
    (SELECT coalesce(sum(n - 1), 0) FROM (
       SELECT count(*) AS n FROM example_meta em LEFT JOIN (
         SELECT example_id, string_agg(CAST(turn AS VARCHAR) || chr(2) || coalesce(role, '') || chr(2) || coalesce(content, ''),
                                       chr(1) ORDER BY turn) AS mfp FROM example_messages GROUP BY example_id) mf USING (example_id)
       GROUP BY mf.mfp, em.example_id, em.category, em.label, em.severity, em.difficulty, em.has_tool_use) z WHERE n > 1) AS duplicate_full,
    (SELECT coalesce(sum(n - 1), 0) FROM (SELECT prompt_hash, count(*) AS n FROM facts GROUP BY prompt_hash) z WHERE n > 1) AS duplicate_user,
    (SELECT count(*) FROM entries WHERE kind = 'roles') AS roles_errors,
    (SELECT count(*) FROM entries WHERE kind = 'metadata') AS metadata_errors,
    (SELECT count(*) FROM entries WHERE kind = 'label') AS label_errors,
    (SELECT count(*) FROM entries WHERE kind = 'tool') AS tool_errors
  FROM facts)
"""
WARNINGS_SQL = """, warnings AS (
  SELECT 'volume' AS rule, CAST(total AS DOUBLE) AS observed FROM metrics WHERE total < 5000
  UNION ALL SELECT 'tool_ratio', tool_use_ratio FROM metrics WHERE NOT (tool_use_ratio BETWEEN 0.25 AND 0.45)
  UNION ALL SELECT 'implicit_ratio', implicit_ratio FROM metrics WHERE implicit_ratio < 0.55
  UNION ALL SELECT 'duplicate_full', CAST(duplicate_full AS DOUBLE) FROM metrics WHERE duplicate_full > 0
  UNION ALL SELECT 'duplicate_user', CAST(duplicate_user AS DOUBLE) FROM metrics WHERE duplicate_user / total > 0.03
  UNION ALL SELECT 'role_errors', CAST(roles_errors AS DOUBLE) FROM metrics WHERE roles_errors > 0
  UNION ALL SELECT 'metadata_errors', CAST(metadata_errors AS DOUBLE) FROM metrics WHERE metadata_errors > 0
  UNION ALL SELECT 'label_mismatches', CAST(label_errors AS DOUBLE) FROM metrics WHERE label_errors > 0
  UNION ALL SELECT 'tool_flag_errors', CAST(tool_errors AS DOUBLE) FROM metrics WHERE tool_errors > 0)
"""


@query("value_distributions", "A1", oracle=FACTS + """
SELECT dimension, value, count(*) AS count, count(*) / (SELECT count(*) FROM facts) AS ratio FROM (
  SELECT 'category' AS dimension, category AS value FROM facts
  UNION ALL SELECT 'Label', label FROM facts
  UNION ALL SELECT 'Severity', severity FROM facts
  UNION ALL SELECT 'Difficulty', difficulty FROM facts
  UNION ALL SELECT 'sector', 'unknown' FROM facts
  UNION ALL SELECT 'investor_profile', 'unknown' FROM facts
  UNION ALL SELECT 'lean_principle', 'unknown' FROM facts) d
GROUP BY dimension, value
""")
def q_value_distributions(spark, sf_dir):
    return Q.value_distributions(facts_of(spark, sf_dir))


@query("dataset_overview", "A2", oracle=FACTS + """
SELECT count(*) AS total,
  count(*) FILTER (WHERE coalesce(has_tool_use, false)) AS tool_use_count,
  count(*) FILTER (WHERE coalesce(has_tool_use, false)) / count(*) AS tool_use_ratio,
  count(*) FILTER (WHERE difficulty IN ('Implicite', 'Ambigu', 'Mixte')) / count(*) AS implicit_ratio,
  round(sum(n_messages) / count(*), 1) AS avg_messages_per_example,
  CAST(round(sum(n_chars) / count(*), 0) AS BIGINT) AS avg_chars_per_example,
  CAST(min(n_chars) AS BIGINT) AS min_chars, CAST(max(n_chars) AS BIGINT) AS max_chars
FROM facts
""")
def q_dataset_overview(spark, sf_dir):
    return Q.dataset_overview(facts_of(spark, sf_dir))


@query("duplicate_examples", "A3+F3", oracle="""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT sha1(text) AS h, count(*) AS n FROM documents GROUP BY h) g WHERE n > 1
""")
def q_duplicate_examples(spark, sf_dir):
    docs = adapter(spark, sf_dir, "documents")
    return Q.duplicate_count(docs.select(F.sha1("text").alias("fp")), "fp")


@query("duplicate_lines", "A3", oracle=with_chain("raw_lines", "example_messages") + """
, said AS (SELECT example_id, string_agg(coalesce(role, '') || chr(2) || coalesce(content, ''), chr(1) ORDER BY turn) AS m FROM example_messages GROUP BY example_id),
l AS (SELECT example_id, json_extract_string(metadata_json, '$.note') AS note, json_extract_string(metadata_json, '$.category') AS category,
        json_extract_string(metadata_json, '$.extra.b') AS b, json_extract_string(metadata_json, '$.extra.a[0]') AS a0,
        json_extract_string(metadata_json, '$.extra.a[1].y') AS y, said.m FROM raw_lines LEFT JOIN said USING (example_id))
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM l GROUP BY example_id, note, category, b, a0, y, m) z WHERE n > 1
""")
def q_duplicate_lines(spark, sf_dir):
    nested = Q.examples_nested(adapter(spark, sf_dir, "raw_lines"), adapter(spark, sf_dir, "example_messages"))
    return Q.duplicate_count(nested.select(Q.line_hash(nested).alias("fp")), "fp")


@query("duplicate_prompts", "A4+F2", oracle=FACTS + """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT prompt_hash, count(*) AS n FROM facts GROUP BY prompt_hash) g WHERE n > 1
""")
def q_duplicate_prompts(spark, sf_dir):
    return Q.duplicate_count(facts_of(spark, sf_dir), "prompt_hash")


@query("role_errors", "A5", oracle=FACTS + ROLE_ERRORS_SQL)
def q_role_errors(spark, sf_dir):
    return Q.role_errors(facts_of(spark, sf_dir))


@query("metadata_errors", "A6", oracle=FACTS + META_ERRORS_SQL)
def q_metadata_errors(spark, sf_dir):
    return Q.metadata_errors(facts_of(spark, sf_dir))


@query("label_mismatches", "A7", oracle=FACTS + LABEL_ERRORS_SQL)
def q_label_mismatches(spark, sf_dir):
    return Q.label_mismatches(facts_of(spark, sf_dir))


@query("tool_flag_errors", "A8", oracle=FACTS + TOOL_ERRORS_SQL)
def q_tool_flag_errors(spark, sf_dir):
    return Q.tool_flag_errors(facts_of(spark, sf_dir))


@query("dataset_warnings", "A9", oracle=FACTS + METRICS_SQL + WARNINGS_SQL + "SELECT * FROM warnings")
def q_dataset_warnings(spark, sf_dir):
    return Q.dataset_warnings(Q.quality_metrics(facts_of(spark, sf_dir)))


@query("dataset_gate", "A10", oracle=FACTS + METRICS_SQL + WARNINGS_SQL + """
, g AS (SELECT total, round(tool_use_ratio, 3) AS tool_ratio, (SELECT count(*) FROM warnings) AS warning_count FROM metrics)
SELECT total, tool_ratio, warning_count,
  concat_ws(',', CASE WHEN total < 5000 THEN 'volume' END, CASE WHEN tool_ratio < 0.2 THEN 'tool_ratio_low' END,
            CASE WHEN tool_ratio > 0.85 THEN 'tool_ratio_high' END, CASE WHEN warning_count > 0 THEN 'warnings' END) AS errors,
  NOT (total < 5000 OR tool_ratio < 0.2 OR tool_ratio > 0.85 OR warning_count > 0) AS valid
FROM g
""")
def q_dataset_gate(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    gate = Q.dataset_gate(Q.quality_metrics(facts))
    return gate.withColumn("errors", F.array_join("errors", ","))


@query("table_volumes", "A11+U1", oracle=" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) > 0 AS non_empty FROM {t}" for t in RAW_TABLES))
def q_table_volumes(spark, sf_dir):
    return Q.table_volumes({t: adapter(spark, sf_dir, t) for t in RAW_TABLES})


@query("union_volumes", "U1", oracle=with_chain("startups", "pivot_cases", "risk_patterns", "sector_benchmarks",
                                                "lean_concepts", "investment_criteria") + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) > 0 AS non_empty FROM {t}" for t in (
            "startups", "pivot_cases", "risk_patterns", "sector_benchmarks", "lean_concepts", "investment_criteria")))
def q_union_volumes(spark, sf_dir):
    names = ("startups", "pivot_cases", "risk_patterns", "sector_benchmarks", "lean_concepts", "investment_criteria")
    return Q.table_volumes({t: adapter(spark, sf_dir, t) for t in names})


@query("build_stats", "A12", oracle=with_chain("example_meta") + """
SELECT category, count(*) AS count, (SELECT count(*) FROM example_meta) AS total_examples,
  (SELECT count(*) FILTER (WHERE has_tool_use) FROM example_meta) AS tool_use_count,
  round((SELECT count(*) FILTER (WHERE has_tool_use) FROM example_meta) / (SELECT count(*) FROM example_meta), 3) AS tool_use_ratio
FROM example_meta GROUP BY category
""")
def q_build_stats(spark, sf_dir):
    return Q.build_stats(facts_of(spark, sf_dir))


SPLIT_SQL = """
, strat AS (SELECT example_id, category || '|' || label || '|' || difficulty || '|' ||
                   CASE WHEN has_tool_use THEN 'tool' ELSE 'no_tool' END AS stratum,
                   sha1('42:' || CAST(example_id AS VARCHAR)) AS h FROM example_meta),
pos AS (SELECT example_id, stratum, row_number() OVER (ORDER BY stratum, h, example_id) - 1 AS p FROM strat),
splits AS (SELECT example_id, stratum,
  CASE WHEN p % 10 < 8 THEN 'train' WHEN p % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM pos)
"""


def split_of(spark, sf_dir):
    return S.stratified_split(Q.normalise_metadata(adapter(spark, sf_dir, "example_meta")))


@query("stratified_split", "W4+F13", oracle=with_chain("example_meta").rstrip() + SPLIT_SQL + "SELECT * FROM splits")
def q_stratified_split(spark, sf_dir):
    return split_of(spark, sf_dir).select("example_id", "stratum", "split")


@query("split_sizes", "A13", oracle=with_chain("example_meta").rstrip() + SPLIT_SQL + """
SELECT split, count(*) AS n_rows, CAST(ceil(count(*) / 16) * 3 AS BIGINT) AS est_steps,
  CASE WHEN split = 'train' THEN count(*) >= 3750 END AS meets_floor
FROM splits GROUP BY split
""")
def q_split_sizes(spark, sf_dir):
    return S.split_sizes(split_of(spark, sf_dir))


@query("split_leakage", "U2", oracle=with_chain("leaky_meta", "leaky_messages").rstrip() + SPLIT_SQL.replace("FROM example_meta", "FROM leaky_meta") + """
, fp AS (SELECT example_id, sha1(string_agg(coalesce(content, ''), chr(10) ORDER BY turn)) AS fingerprint
         FROM leaky_messages GROUP BY example_id)
SELECT fingerprint, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits
FROM splits s JOIN fp USING (example_id) GROUP BY fingerprint HAVING count(DISTINCT split) > 1
""")
def q_split_leakage(spark, sf_dir):
    msgs = adapter(spark, sf_dir, "leaky_messages")
    fp = msgs.groupBy("example_id").agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("turn", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n")).alias("_fp"))
    sp = S.stratified_split(Q.normalise_metadata(adapter(spark, sf_dir, "leaky_meta"))).join(fp, "example_id")
    return S.split_leakage(sp, F.col("_fp")).withColumn("splits", F.array_join("splits", ","))


@query("seeded_shuffle", "W8", oracle=with_chain("example_meta") + """
SELECT example_id, row_number() OVER (ORDER BY sha1('42:' || CAST(example_id AS VARCHAR)), example_id) - 1 AS shuffle_pos
FROM example_meta
""")
def q_seeded_shuffle(spark, sf_dir):
    return S.seeded_shuffle(adapter(spark, sf_dir, "example_meta").select("example_id"), "example_id")


@query("first_error_entries", "W7", oracle=FACTS + ENTRIES_SQL + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY example_id, error) AS rn,
                   count(*) OVER (PARTITION BY kind) AS total FROM entries)
SELECT kind, example_id, error, detail, total, greatest(total - 20, 0) AS n_more FROM ranked WHERE rn <= 20
""")
def q_first_error_entries(spark, sf_dir):
    entries = Q.all_error_entries(facts_of(spark, sf_dir))
    return Q.first_n_per_kind(entries, ("roles", "metadata", "label", "tool"), 20)


@query("first_examples", "W7", oracle=with_chain("example_meta") + """
SELECT * FROM example_meta ORDER BY example_id LIMIT 20
""")
def q_first_examples(spark, sf_dir):
    return adapter(spark, sf_dir, "example_meta").orderBy("example_id").limit(20)


@query("missing_severities", "U3", oracle=with_chain("example_meta") + """
SELECT severity FROM (SELECT unnest(['Mineur', 'Majeur', 'Fatal', 'Non applicable']) AS severity)
EXCEPT SELECT severity FROM example_meta
""")
def q_missing_severities(spark, sf_dir):
    return Q.missing_values(adapter(spark, sf_dir, "example_meta"), "severity", VALID_SEVERITIES)


@query("last_message_by_role", "W3", oracle="""
SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user,
  arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant
FROM conversations GROUP BY conv_id
""")
def q_last_message_by_role(spark, sf_dir):
    return Q.last_message_by_role(adapter(spark, sf_dir, "conversations"), key="conv_id", text="text")


@query("normalise_prompt", "F2", oracle="""
SELECT c.conv_id, trim(regexp_replace(lower(coalesce(u.t, '')), '\\s+', ' ', 'g')) AS prompt
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id) u
  ON u.conv_id = c.conv_id
""")
def q_normalise_prompt(spark, sf_dir):
    conv = adapter(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "example_id") \
        .withColumnRenamed("text", "content")
    facts = Q.message_facts(conv)
    return facts.select(F.col("example_id").alias("conv_id"),
                        Q.normalise_prompt(F.coalesce("user_text", F.lit(""))).alias("prompt"))


@query("content_fingerprint", "F3", oracle="SELECT doc_id, sha1(text) AS fingerprint FROM documents")
def q_content_fingerprint(spark, sf_dir):
    return adapter(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("fingerprint"))


@query("render_chat_text", "F4", oracle="""
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def q_render_chat_text(spark, sf_dir):
    return Q.render_chat_text(adapter(spark, sf_dir, "conversations"), key="conv_id", text="text")


@query("examples_roundtrip", "S3+S1", oracle=with_chain("example_meta", "example_messages").rstrip() + SPLIT_SQL + """
SELECT s.example_id, s.split, m.category, m.label, coalesce(n.n, 0) AS n_messages,
  sha256(coalesce(n.body, '')) AS messages_sha256
FROM splits s JOIN example_meta m USING (example_id)
LEFT JOIN (SELECT example_id, count(*) AS n, string_agg(role || ':' || coalesce(content, ''), '|' ORDER BY turn) AS body
           FROM example_messages GROUP BY example_id) n USING (example_id)
""")
def q_examples_roundtrip(spark, sf_dir):
    meta = adapter(spark, sf_dir, "example_meta")
    split = split_of(spark, sf_dir).select("example_id", "split")
    nested = Q.examples_nested(meta.join(split, "example_id"), adapter(spark, sf_dir, "example_messages"))
    path = J.scratch_path(spark, "examples")
    J.write_examples(nested, path)
    back = J.read_examples(spark, path, partition_cols=("split",))
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit(""))))
    return back.select(F.col("example_id").cast("bigint").alias("example_id"), "split",
                       F.get_json_object("metadata_json", "$.category").alias("category"),
                       F.get_json_object("metadata_json", "$.label").alias("label"),
                       F.size("messages").cast("bigint").alias("n_messages"),
                       F.sha2(F.array_join(said, "|"), 256).alias("messages_sha256"))


@query("training_text_roundtrip", "S4+S2", oracle=with_chain("example_meta", "example_messages").rstrip() + SPLIT_SQL + """
SELECT s.split, count(*) AS n_rows,
  CAST(sum(length(t.text)) AS BIGINT) AS n_chars
FROM splits s JOIN (SELECT example_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) ORDER BY turn) AS text
                    FROM example_messages GROUP BY example_id) t USING (example_id)
GROUP BY s.split
""")
def q_training_text_roundtrip(spark, sf_dir):
    split = split_of(spark, sf_dir).select("example_id", "split", "category")
    text = Q.render_chat_text(adapter(spark, sf_dir, "example_messages"))
    path = J.scratch_path(spark, "training-text")
    J.write_training_text(split.join(text, "example_id"), path)
    back = J.read_training_text(spark, path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum(F.length("text")).cast("bigint").alias("n_chars"))
