"""Registered model-output queries (survey 2.7 F5-F12, F18, F19; 2.3 J10; 2.4 A17; 2.1 S8, S9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import outputs as O
from ledgerline.plans.registry import query
from ledgerline.sources import audit
from ledgerline.sources import sql as SQ
from ledgerline.sources.adapters import adapter, with_chain
from ledgerline.sources.jsonl import scratch_path

MO = with_chain("model_outputs", "risk_patterns", "startups")
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
BLOCK_RE = "(?s)<\\|tool_call_start\\|>(.*?)<\\|tool_call_end\\|>"
FN_RE = """(?s)^(\\w+)\\s*\\(\\s*sql\\s*=\\s*["']?(.*?)["']?\\s*\\)\\s*$""".replace("'", "''")
BARE_RE = """(?si)sql\\s*=\\s*["']?(SELECT.*?)["']?\\s*$""".replace("'", "''")

# DuckDB: blocks, parse forms and parsed numbering written directly in SQL.
CALLS_SQL = MO.rstrip() + f"""
, arr AS (SELECT output_id, regexp_extract_all(output, '{BLOCK_RE}', 1) AS b FROM model_outputs),
blk AS (SELECT output_id, i AS block_pos, {STRIP.format(x='b[i + 1]')} AS raw FROM (
          SELECT output_id, b, unnest(range(len(b))) AS i FROM arr)),
blk2 AS (SELECT *, {STRIP.format(x="regexp_replace(raw, '^[\\[\\]]+|[\\[\\]]+$', '', 'g')")} AS content FROM blk),
forms AS (
  SELECT *,
    content LIKE '{{%' AND json_valid(content) AND coalesce(json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.name'), '') <> ''
      AND coalesce(json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.parameters.sql'), '') <> '' AS json_ok,
    regexp_matches(content, '{FN_RE}') AND regexp_extract(content, '{FN_RE}', 1) <> ''
      AND {STRIP.format(x=f"regexp_extract(content, '{FN_RE}', 2)")} <> '' AS fn_ok,
    regexp_matches(content, '{BARE_RE}') AS bare_ok
  FROM blk2),
parsed AS (
  SELECT output_id, block_pos, raw, content,
    CASE WHEN json_ok THEN 'json' WHEN fn_ok THEN 'function' WHEN bare_ok THEN 'bare_sql' ELSE 'none' END AS parse_path,
    CASE WHEN json_ok THEN json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.name') WHEN fn_ok THEN regexp_extract(content, '{FN_RE}', 1)
         WHEN bare_ok THEN 'query_postgresql' END AS function_name,
    CASE WHEN json_ok THEN json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.parameters.sql')
         WHEN fn_ok THEN {STRIP.format(x=f"regexp_extract(content, '{FN_RE}', 2)")}
         WHEN bare_ok THEN {STRIP.format(x=f"regexp_extract(content, '{BARE_RE}', 1)")} END AS sql
  FROM forms),
calls AS (
  SELECT output_id, CAST(row_number() OVER (PARTITION BY output_id ORDER BY block_pos) - 1 AS INTEGER) AS call_pos,
    block_pos, raw, content, parse_path, function_name, sql
  FROM parsed WHERE parse_path <> 'none'),
cls AS (
  SELECT *,
    CASE WHEN function_name IS NULL OR function_name NOT IN ('query_postgresql') THEN 'unknown_tool'
         WHEN coalesce(sql, '') = '' THEN 'empty_sql'
         WHEN NOT (upper({STRIP.format(x='sql')}) LIKE 'SELECT%' OR upper({STRIP.format(x='sql')}) LIKE 'WITH%') THEN 'rejected_non_select'
         WHEN instr(upper({STRIP.format(x='sql')}), 'LIMIT') > 0 THEN 'accepted'
         ELSE 'accepted_capped' END AS status
  FROM calls),
cls2 AS (
  SELECT *,
    CASE status WHEN 'unknown_tool' THEN 'Outil ''' || function_name || ''' non disponible. Outils disponibles : [''query_postgresql'']'
      WHEN 'empty_sql' THEN 'Paramètre ''sql'' vide ou absent dans le tool call.'
      WHEN 'rejected_non_select' THEN 'Seules les requêtes SELECT sont autorisées via le tool use. Requête reçue : ' || substr(sql, 1, 100)
    END AS error,
    CASE status WHEN 'accepted' THEN sql WHEN 'accepted_capped' THEN regexp_replace(sql, ';+$', '') || ' LIMIT 20' END AS effective_sql
  FROM cls),
risk_rows AS (SELECT id, pattern_name, sector, stage, criticality, category FROM risk_patterns),
building AS (SELECT id, name FROM startups WHERE sector = 'building' ORDER BY id LIMIT 3),
res AS (
  SELECT c.output_id, c.call_pos, c.status LIKE 'accepted%' AND c.sql NOT LIKE 'SELECT b%' AS success,
    CASE WHEN c.status NOT LIKE 'accepted%' THEN c.error
         WHEN c.sql LIKE 'SELECT b%' THEN 'No registered call of the form SELECT B FROM STARTUPS LIMIT ?' END AS error,
    CASE WHEN c.status NOT LIKE 'accepted%' OR c.sql LIKE 'SELECT b%' THEN NULL
         WHEN c.sql LIKE 'SELECT id, name%' THEN (SELECT count(*) FROM building)
         WHEN r.id IS NULL THEN 0 ELSE 1 END AS row_count,
    0.0 AS execution_time_ms,
    CASE WHEN c.status NOT LIKE 'accepted%' OR c.sql LIKE 'SELECT b%' THEN NULL
         WHEN c.sql LIKE 'SELECT id, name%' THEN (SELECT '[' || string_agg('{{"id":' || id || ',"name":"' || name || '"}}', ',' ORDER BY id) || ']' FROM building)
         WHEN r.id IS NULL THEN '[]'
         ELSE '[{{"id":' || r.id || ',"pattern_name":"' || r.pattern_name || '"' || coalesce(',"sector":"' || r.sector || '"', '')
              || coalesce(',"stage":"' || r.stage || '"', '') || ',"criticality":"' || r.criticality || '","category":"' || r.category || '"}}]' END AS data_json
  FROM cls2 c LEFT JOIN risk_rows r ON c.sql LIKE 'SELECT * FROM risk_patterns WHERE id = %'
    AND CAST(r.id AS VARCHAR) = regexp_extract(c.sql, 'id = ([0-9]+)', 1))
"""


def parsed_of(spark, sf_dir):
    return O.parsed_calls(adapter(spark, sf_dir, "model_outputs"))


def templates_of(spark, sf_dir):
    """The registered forms: one risk pattern by id, and the first startups of a sector."""
    return [
        O.CallTemplate("SELECT * FROM RISK_PATTERNS WHERE ID = ? LIMIT ?", adapter(spark, sf_dir, "risk_patterns"), "id",
                       ("id", "pattern_name", "sector", "stage", "criticality", "category"), ("id",)),
        O.CallTemplate("SELECT ID, NAME FROM STARTUPS WHERE SECTOR = ? LIMIT ?", adapter(spark, sf_dir, "startups"), "sector",
                       ("id", "name"), ("id",))]


def results_of(spark, sf_dir, parsed):
    return O.execute_calls(O.classify_calls(parsed), templates_of(spark, sf_dir))


@query("has_tool_call", "F7/R13", oracle=MO + f"""
SELECT output_id, instr(output, '<|tool_call_start|>') > 0 AS has_marker,
  CAST(len(regexp_extract_all(output, '{BLOCK_RE}', 1)) AS INTEGER) AS n_blocks
FROM model_outputs
""")
def q_has_tool_call(spark, sf_dir):
    mo = adapter(spark, sf_dir, "model_outputs")
    return mo.select("output_id", O.has_tool_call(F.col("output")).alias("has_marker"),
                     F.size(F.regexp_extract_all("output", F.lit(O.BLOCK), 1)).alias("n_blocks"))


@query("extract_tool_calls", "F7", oracle=CALLS_SQL + """
SELECT output_id, CAST(block_pos AS INTEGER) AS block_pos, raw, content FROM blk2
""")
def q_extract_tool_calls(spark, sf_dir):
    return O.extract_tool_calls(adapter(spark, sf_dir, "model_outputs"))


@query("parse_tool_calls", "F8", oracle=CALLS_SQL + """
SELECT output_id, CAST(block_pos AS INTEGER) AS block_pos, parse_path, function_name, sql FROM parsed
""")
def q_parse_tool_calls(spark, sf_dir):
    calls = O.parse_tool_calls(O.extract_tool_calls(adapter(spark, sf_dir, "model_outputs")))
    return calls.select("output_id", "block_pos", "parse_path", "function_name", "sql")


@query("split_free_text", "F9", oracle=MO + f"""
SELECT output_id, array_to_string(list_filter(list_transform(
  string_split_regex(output, '(?s)<\\|tool_call_start\\|>.*?<\\|tool_call_end\\|>'),
  lambda x: {STRIP.format(x='x')}), lambda x: x <> ''), ' ') AS free_text
FROM model_outputs
""")
def q_split_free_text(spark, sf_dir):
    mo = adapter(spark, sf_dir, "model_outputs")
    return mo.select("output_id", O.free_text(F.col("output")).alias("free_text"))


@query("clean_answers", "F10", oracle=MO + f"""
SELECT output_id, {STRIP.format(x='''replace(replace(replace(replace(replace(
  regexp_replace(output, '(?s)<\\|tool_call_start\\|>.*?<\\|tool_call_end\\|>', '', 'g'),
  '<|im_start|>', ''), '<|im_end|>', ''), '<|endoftext|>', ''), '<|tool_call_start|>', ''), '<|tool_call_end|>', '')''')}
  AS answer
FROM model_outputs
""")
def q_clean_answers(spark, sf_dir):
    mo = adapter(spark, sf_dir, "model_outputs")
    return mo.select("output_id", O.clean_answer(F.col("output")).alias("answer"))


@query("source_tables", "F11", oracle=CALLS_SQL + """
SELECT output_id, call_pos, nullif(regexp_extract(sql, '(?i)FROM\\s+(\\w+)', 1), '') AS source_table FROM calls
""")
def q_source_tables(spark, sf_dir):
    return parsed_of(spark, sf_dir).select("output_id", "call_pos", O.source_table(F.col("sql")).alias("source_table"))


@query("classify_calls", "F12", oracle=CALLS_SQL + """
SELECT output_id, call_pos, CAST(block_pos AS INTEGER) AS block_pos, function_name, sql, status, error, effective_sql,
  substr(effective_sql, 1, 300) AS audit_sql
FROM cls2
""")
def q_classify_calls(spark, sf_dir):
    c = O.classify_calls(parsed_of(spark, sf_dir))
    return c.select("output_id", "call_pos", "block_pos", "function_name", "sql", "status", "error",
                    "effective_sql", "audit_sql")


@query("call_result_pairs", "J10+F18", oracle=CALLS_SQL + """
SELECT c.output_id, c.call_pos, r.success, CAST(r.row_count AS INTEGER) AS row_count,
  CASE WHEN r.success THEN '{"status":"success","row_count":' || CAST(r.row_count AS VARCHAR) || ',"execution_time_ms":0.0,"data":'
         || r.data_json || ',"_tool_call_sql":' || coalesce(CAST(to_json(substr(c.sql, 1, 200)) AS VARCHAR), 'null') || '}'
       ELSE '{"status":"error","error":' || coalesce(CAST(to_json(r.error) AS VARCHAR), 'null') || ',"_tool_call_sql":'
         || coalesce(CAST(to_json(substr(c.sql, 1, 200)) AS VARCHAR), 'null') || '}' END AS tool_message
FROM calls c JOIN res r ON r.output_id = c.output_id AND r.call_pos = c.call_pos
""")
def q_call_result_pairs(spark, sf_dir):
    parsed = parsed_of(spark, sf_dir)
    pairs = O.call_result_pairs(parsed, results_of(spark, sf_dir, parsed))
    return pairs.select("output_id", "call_pos", "success", "row_count", O.tool_message(pairs).alias("tool_message"))


@query("results_context", "F19", oracle=CALLS_SQL + """
, sec AS (SELECT output_id, call_pos,
    CASE WHEN success AND coalesce(row_count, 0) > 0 THEN '[Données récupérées ' || (call_pos + 1) || '/' || n || ' — ' || row_count || ' résultat(s)]' || chr(10) || data_json
         WHEN NOT success THEN '[Erreur requête ' || (call_pos + 1) || '/' || n || ']' || chr(10) || coalesce(error, 'None')
         ELSE '[Requête ' || (call_pos + 1) || '/' || n || ' — aucun résultat]' END AS s
  FROM (SELECT *, count(*) OVER (PARTITION BY output_id) AS n FROM res))
SELECT output_id, string_agg(s, chr(10) || chr(10) ORDER BY call_pos) AS context FROM sec GROUP BY output_id
""")
def q_results_context(spark, sf_dir):
    return O.results_context(results_of(spark, sf_dir, parsed_of(spark, sf_dir)))


@query("tool_use_stats", "A17", oracle=CALLS_SQL + """
, src AS (SELECT c.output_id, c.call_pos, nullif(regexp_extract(c.sql, '(?i)FROM\\s+(\\w+)', 1), '') AS t, r.success
          FROM calls c LEFT JOIN res r USING (output_id, call_pos)),
firsts AS (SELECT output_id, t, min(call_pos) AS p FROM src WHERE t IS NOT NULL GROUP BY output_id, t),
per AS (SELECT output_id, count(*) AS made, count(*) FILTER (WHERE coalesce(success, false)) AS ok FROM src GROUP BY output_id),
srcs AS (SELECT output_id, string_agg(t, ',' ORDER BY p) AS s FROM firsts GROUP BY output_id)
SELECT m.output_id, coalesce(per.made, 0) AS tool_calls_made, coalesce(per.ok, 0) AS tool_calls_successful,
  coalesce(srcs.s, '') AS data_sources_used
FROM model_outputs m LEFT JOIN per USING (output_id) LEFT JOIN srcs USING (output_id)
""")
def q_tool_use_stats(spark, sf_dir):
    st = O.tool_use_stats(adapter(spark, sf_dir, "model_outputs"), results_of(spark, sf_dir, parsed_of(spark, sf_dir)))
    return st.withColumn("data_sources_used", F.array_join("data_sources_used", ","))


@query("format_tool_calls", "F5", oracle=with_chain("risk_patterns") + """
SELECT id, '<|tool_call_start|>{"name": "query_postgresql", "parameters": {"sql": "SELECT * FROM risk_patterns WHERE pattern_name = '''
  || pattern_name || '''"}}<|tool_call_end|>' AS call_text
FROM risk_patterns
""")
def q_format_tool_calls(spark, sf_dir):
    rp = adapter(spark, sf_dir, "risk_patterns")
    sql = F.concat(F.lit("SELECT * FROM risk_patterns WHERE pattern_name = '"), F.col("pattern_name"), F.lit("'"))
    return rp.select("id", O.format_tool_call(sql).alias("call_text"))


@query("tool_result_payload", "F6", oracle=with_chain("risk_patterns") + """
, req AS (SELECT category, id // 20 AS request, id, pattern_name, criticality FROM risk_patterns)
SELECT category, request, '{"status":"success","row_count":' || count(*) || ',"execution_time_ms":8.4,"data":'
  || CAST(to_json(list({'id': id, 'pattern_name': pattern_name, 'criticality': criticality} ORDER BY id)) AS VARCHAR) || '}' AS payload
FROM req GROUP BY category, request
""")
def q_tool_result_payload(spark, sf_dir):
    # a request asks for the patterns of a category in a range of 20 ids, so payloads stay small
    req = adapter(spark, sf_dir, "risk_patterns").withColumn("request", F.floor(F.col("id") / 20))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", "pattern_name", "criticality"))),
                       lambda x: x)
    return req.groupBy("category", "request").agg(O.tool_result_payload(rows).alias("payload"))


@query("tool_error_payload", "F6", oracle=CALLS_SQL + """
SELECT output_id, call_pos, '{"status":"error","error":' || CAST(to_json(error) AS VARCHAR) || '}' AS payload FROM res WHERE error IS NOT NULL
""")
def q_tool_error_payload(spark, sf_dir):
    failed = results_of(spark, sf_dir, parsed_of(spark, sf_dir)).where(F.col("error").isNotNull())
    return failed.select("output_id", "call_pos", O.tool_error_payload(F.col("error")).alias("payload"))


@query("call_templates", "J10", oracle=CALLS_SQL + """
SELECT CASE WHEN sql LIKE 'SELECT * FROM risk_patterns%' THEN 'SELECT * FROM RISK_PATTERNS WHERE ID = ? LIMIT ?'
            WHEN sql LIKE 'SELECT id, name%' THEN 'SELECT ID, NAME FROM STARTUPS WHERE SECTOR = ? LIMIT ?'
            ELSE 'SELECT B FROM STARTUPS LIMIT ?' END AS template,
  count(*) AS n_calls, count(DISTINCT sql) AS n_constants
FROM cls2 WHERE status LIKE 'accepted%' GROUP BY 1
""")
def q_call_templates(spark, sf_dir):
    accepted = O.classify_calls(parsed_of(spark, sf_dir)).where(F.col("status").startswith("accepted"))
    t = accepted.select(O.call_template(F.col("effective_sql")).alias("t"))
    return t.groupBy(F.col("t.template").alias("template")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_distinct(F.col("t.constants")).alias("n_constants"))


@query("parameterised_query", "S8", oracle=with_chain("risk_patterns") + """
SELECT id, pattern_name, criticality FROM risk_patterns WHERE criticality = 'high' AND category LIKE '%med%'
""")
def q_parameterised_query(spark, sf_dir):
    adapter(spark, sf_dir, "risk_patterns").createOrReplaceTempView("risk_patterns")
    return SQ.parameterised_query(
        spark, "SELECT id, pattern_name, criticality FROM risk_patterns WHERE criticality = ? AND category LIKE ?",
        ["high", "%med%"])


@query("guarded_sql", "S9", oracle=with_chain("risk_patterns") + """
SELECT id, pattern_name FROM risk_patterns WHERE criticality = 'critical' ORDER BY id LIMIT 20
""")
def q_guarded_sql(spark, sf_dir):
    adapter(spark, sf_dir, "risk_patterns").createOrReplaceTempView("risk_patterns")
    return SQ.guarded_sql(spark, "SELECT id, pattern_name FROM risk_patterns WHERE criticality = 'critical' ORDER BY id;")


@query("audit_log", "S9", oracle=CALLS_SQL + """
, logged AS (
  SELECT substr(effective_sql, 1, 300) AS sql, 1 AS commit FROM cls2 WHERE status LIKE 'accepted%'
  UNION ALL SELECT 'SELECT id FROM risk_patterns WHERE criticality = ''low''', 2
  UNION ALL SELECT 'SELECT count(*) AS n FROM risk_patterns', 3)
SELECT sql, 20 AS max_rows, count(*) AS n_rows, min(commit) AS first_commit, max(commit) AS last_commit FROM logged GROUP BY sql
""")
def q_audit_log(spark, sf_dir):
    """One commit for the batch of accepted calls, one for each of two guarded queries."""
    root = scratch_path(spark, "audit")
    adapter(spark, sf_dir, "risk_patterns").createOrReplaceTempView("risk_patterns")
    SQ.audit_calls(O.classify_calls(parsed_of(spark, sf_dir)), root)
    for text in ("SELECT id FROM risk_patterns WHERE criticality = 'low'", "SELECT count(*) AS n FROM risk_patterns"):
        SQ.guarded_sql(spark, text, audit_root=root)
    log = audit.read(spark, root, SQ.AUDIT_SCHEMA)
    place = audit.versions(spark, root).select("version", F.dense_rank().over(Window.orderBy("version")).alias("commit"))
    return log.join(place, "version").groupBy("sql", "max_rows").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("commit").alias("first_commit"), F.max("commit").alias("last_commit"))
