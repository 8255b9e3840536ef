"""Model-output analytics: tool-call extraction, parsing, guard classification,
answer cleaning, tool messages and per-output statistics.

Model outputs arrive as a table ``(output_id, output)``; every step is a column
expression or an explode, so extraction runs in whole-stage code generation and
scales with the number of outputs. Executing model-written SQL is not nested in
tasks: calls are classified here, results come in as a table and are paired with
their calls by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Special tokens and the tool registry.
TOOL_CALL_START = "<|tool_call_start|>"
TOOL_CALL_END = "<|tool_call_end|>"
SPECIAL_TOKENS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|tool_call_start|>", "<|tool_call_end|>")
AVAILABLE_TOOLS = ("query_postgresql",)
MAX_ROWS = 20
AUDIT_CHARS = 300
TRACE_SQL_CHARS = 200

# Patterns of call blocks and their forms.
BLOCK = r"(?s)<\|tool_call_start\|>(.*?)<\|tool_call_end\|>"
FUNCTION_FORM = r"""(?sU)^(\w+)\s*\(\s*sql\s*=\s*["']?(.*?)["']?\s*\)\s*$"""
BARE_SQL_FORM = r"""(?si)sql\s*=\s*["']?(SELECT.*?)["']?\s*$"""
FROM_TABLE = r"(?i)FROM\s+(\w+)"
CALL_JSON_SCHEMA = "name STRING, parameters STRUCT<sql: STRING>"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing (Unicode) whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def has_tool_call(output: Column) -> Column:
    """Only the start token is looked for (an unclosed block still counts)."""
    return F.instr(output, TOOL_CALL_START) > 0


# --- F7 --------------------------------------------------------------------
def _block_content(body: Column) -> tuple[Column, Column]:
    raw = strip_ws(body)
    return raw, strip_ws(F.regexp_replace(raw, r"^[\[\]]+|[\[\]]+\z", ""))


def extract_tool_calls(outputs: DataFrame, key: str = "output_id", text: str = "output") -> DataFrame:
    """One row per complete marked block: ``(key, block_pos, raw, content)``.

    ``raw`` is the block body stripped; ``content`` additionally loses any run of
    square brackets at both ends (then whitespace again).
    """
    blocks = F.regexp_extract_all(F.col(text), F.lit(BLOCK), 1)
    exploded = outputs.select(key, F.posexplode(blocks).alias("block_pos", "_body"))
    raw, content = _block_content(F.col("_body"))
    return exploded.select(key, F.col("block_pos").cast("int").alias("block_pos"),
                           raw.alias("raw"), content.alias("content"))


# --- F8 --------------------------------------------------------------------
def parse_call(content: Column) -> Column:
    """``struct(parse_path, function_name, sql)`` for one block body.

    Forms are tried in order: a JSON object ``{name, parameters: {sql}}`` with both
    values non-empty; ``name(sql="...")`` (quotes optional); any ``sql=SELECT ...``
    (tool name assumed); otherwise ``none`` with NULL name and SQL.
    """
    c = content
    js = F.from_json(c, CALL_JSON_SCHEMA)
    json_ok = c.startswith("{") & (F.coalesce(js["name"], F.lit("")) != "") \
        & (F.coalesce(js["parameters"]["sql"], F.lit("")) != "")
    fn_name = F.regexp_extract(c, FUNCTION_FORM, 1)
    fn_sql = strip_ws(F.regexp_extract(c, FUNCTION_FORM, 2))
    fn_ok = c.rlike(FUNCTION_FORM) & (fn_name != "") & (fn_sql != "")
    bare_sql = strip_ws(F.regexp_extract(c, BARE_SQL_FORM, 1))
    bare_ok = c.rlike(BARE_SQL_FORM)
    path = F.when(json_ok, "json").when(fn_ok, "function").when(bare_ok, "bare_sql").otherwise("none")
    name = F.when(json_ok, js["name"]).when(fn_ok, fn_name).when(bare_ok, F.lit(AVAILABLE_TOOLS[0]))
    sql = F.when(json_ok, js["parameters"]["sql"]).when(fn_ok, fn_sql).when(bare_ok, bare_sql)
    return F.struct(path.alias("parse_path"), name.alias("function_name"), sql.alias("sql"))


def parse_tool_calls(calls: DataFrame) -> DataFrame:
    """Adds ``parse_path``, ``function_name`` and ``sql`` to extracted blocks."""
    return calls.withColumn("_p", parse_call(F.col("content"))).select("*", "_p.*").drop("_p")


def parsed_calls(outputs: DataFrame, key: str = "output_id", text: str = "output") -> DataFrame:
    """Parsed calls only, numbered among themselves (``call_pos``) as the reference pairs
    them with results; ``block_pos`` keeps the place among all marked blocks.

    Parsing runs on the per-output block array, so the numbering needs no window.
    """
    blocks = F.regexp_extract_all(F.col(text), F.lit(BLOCK), 1)

    def item(body, i):
        raw, content = _block_content(body)
        return F.struct(i.alias("block_pos"), raw.alias("raw"), content.alias("content"),
                        parse_call(content).alias("p"))

    kept = F.filter(F.transform(blocks, item), lambda x: x["p"]["parse_path"] != "none")
    return (outputs.select(key, F.posexplode(kept).alias("call_pos", "c"))
            .select(key, F.col("call_pos").cast("int").alias("call_pos"), F.col("c.block_pos").alias("block_pos"),
                    "c.raw", "c.content", "c.p.parse_path", "c.p.function_name", "c.p.sql"))


# --- F9 / F10 / F11 ----------------------------------------------------------
def free_text(output: Column) -> Column:
    """Text outside complete blocks: parts stripped, empty parts dropped, joined by a blank."""
    parts = F.split(output, r"(?s)<\|tool_call_start\|>.*?<\|tool_call_end\|>", -1)
    return F.array_join(F.filter(F.transform(parts, strip_ws), lambda p: p != ""), " ")


def clean_answer(output: Column) -> Column:
    """Drop complete blocks, then the special tokens, then strip."""
    out = F.regexp_replace(output, r"(?s)<\|tool_call_start\|>.*?<\|tool_call_end\|>", "")
    for tok in SPECIAL_TOKENS:
        out = F.replace(out, F.lit(tok), F.lit(""))
    return strip_ws(out)


def source_table(sql: Column) -> Column:
    """First word after FROM (any case), NULL when there is none."""
    return F.nullif(F.regexp_extract(sql, FROM_TABLE, 1), F.lit(""))


# --- F12 -------------------------------------------------------------------
def classify_calls(parsed: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Guard outcome per parsed call: ``status``, ``error``, ``effective_sql`` and audit text.

    Mirrors the text guard: tool must be registered, SQL non-empty, first word
    SELECT or WITH; the row cap is added when the text holds no ``LIMIT`` anywhere.
    """
    sql = F.coalesce(F.col("sql"), F.lit(""))
    norm = F.upper(strip_ws(sql))
    known = F.col("function_name").isin(*AVAILABLE_TOOLS)
    is_select = norm.startswith("SELECT") | norm.startswith("WITH")
    has_limit = F.instr(norm, "LIMIT") > 0
    status = (F.when(~F.coalesce(known, F.lit(False)), "unknown_tool")
              .when(sql == "", "empty_sql")
              .when(~is_select, "rejected_non_select")
              .when(has_limit, "accepted")
              .otherwise("accepted_capped"))
    # Error texts returned to the model.
    error = (F.when(status == "unknown_tool", F.format_string(
                "Outil '%s' non disponible. Outils disponibles : ['query_postgresql']", F.col("function_name")))
             .when(status == "empty_sql", F.lit("Paramètre 'sql' vide ou absent dans le tool call."))
             .when(status == "rejected_non_select", F.concat(
                 F.lit("Seules les requêtes SELECT sont autorisées via le tool use. Requête reçue : "),
                 F.substring(sql, 1, 100))))
    effective = F.when(status == "accepted", sql).when(
        status == "accepted_capped", F.concat(F.regexp_replace(sql, r";+\z", ""), F.lit(f" LIMIT {max_rows}")))
    return (parsed.where(F.col("parse_path") != "none")
            .withColumn("status", status).withColumn("error", error)
            .withColumn("effective_sql", effective)
            .withColumn("audit_sql", F.substring(effective, 1, AUDIT_CHARS)))


@dataclass(frozen=True)
class CallTemplate:
    """A form of call that is answered from a table: SQL with its constants as ``?`` (upper case,
    single blanks), the rows to look in, the column that the first constant is compared with
    (None: no condition), the columns of a result row and their order. A second constant, or the
    only one where there is no condition, is the row limit."""

    sql: str
    rows: DataFrame
    key: str | None
    columns: tuple[str, ...]
    order: tuple[str, ...]


# A literal of a query (quoted text or a number).
LITERAL = r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b"


def call_template(sql: Column) -> Column:
    """``struct(template, constants)``: the text with every literal as ``?``, upper case, single
    blanks, no closing semicolon; the literals in order, without quotes."""
    constants = F.transform(F.regexp_extract_all(sql, F.lit(f"({LITERAL})"), 1), lambda c: F.when(
        c.startswith("'"), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit("''"), F.lit("'"))).otherwise(c))
    text = F.upper(strip_ws(F.regexp_replace(F.regexp_replace(sql, LITERAL, "?"), r"(?U)\s+", " ")))
    return F.struct(F.regexp_replace(text, r"\s*;+\z", "").alias("template"), constants.alias("constants"))


def execute_calls(classified: DataFrame, templates: list[CallTemplate], max_rows: int = MAX_ROWS) -> DataFrame:
    """Results of classified calls: ``(output_id, call_pos, success, error, row_count,
    execution_time_ms, data_json)``, one row per call.

    Accepted calls are brought to a template and its constants. Each registered template is
    answered by one equi-join for the distinct constants asked for (their first rows by the
    template's order, at most the call's limit and ``max_rows``), and the answers are joined back
    to the calls; so a call made a million times reads its rows once. An accepted call of no
    registered form is an error, as are the guard's refusals.
    """
    ids = ["output_id", "call_pos"]
    accepted = (classified.where(F.col("status").startswith("accepted"))
                .select(*ids, call_template(F.col("effective_sql")).alias("_t"))
                .select(*ids, F.col("_t.template").alias("_template"), F.col("_t.constants").alias("_constants")))
    asked = accepted.select("_template", "_constants").distinct()
    answers = None
    for t in templates:
        own = asked.where(F.col("_template") == t.sql)
        limit = F.least(F.lit(max_rows), F.coalesce(F.expr(f"try_cast(try_element_at(_constants, {2 if t.key else 1}) as int)"), F.lit(max_rows)))
        line = F.struct(*[F.col(c) for c in t.columns])
        by = Window.orderBy(*t.order) if t.key is None else Window.partitionBy("_key").orderBy(*t.order)
        rows = t.rows.select(*({*t.columns, *t.order} | ({t.key} if t.key else set())))
        if t.key:
            rows = rows.withColumn("_key", F.col(t.key).cast("string"))
            keys = own.select(F.try_element_at("_constants", F.lit(1)).alias("_key")).distinct()
            first = rows.join(keys, "_key", "left_semi").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= max_rows)
            found = (own.withColumn("_key", F.try_element_at("_constants", F.lit(1))).withColumn("_limit", limit)
                     .join(first.select("_key", "_r", line.alias("_row")), "_key", "left"))
        else:
            top = rows.orderBy(*t.order).limit(max_rows).agg(F.collect_list(line).alias("_top")).scalar()
            found = (own.withColumn("_limit", limit).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(max_rows))))
                     .withColumn("_row", F.try_element_at(top, F.col("_r"))))
        shown = F.when(F.col("_r") <= F.col("_limit"), F.struct("_r", "_row"))
        lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("_row").isNotNull(), shown))), lambda x: x["_row"])
        part = found.groupBy("_template", "_constants").agg(lines.alias("_rows")).select(
            "_template", "_constants", F.size("_rows").alias("row_count"), F.to_json("_rows").alias("data_json"))
        answers = part if answers is None else answers.unionByName(part)
    executed = accepted if answers is None else accepted.join(answers, ["_template", "_constants"], "left")
    count, data = (F.lit(None).cast("int"), F.lit(None).cast("string")) if answers is None else (F.col("row_count"), F.col("data_json"))
    done = executed.select(*ids, count.isNotNull().alias("success"),
                           F.when(count.isNull(), F.concat(F.lit("No registered call of the form "), "_template")).alias("error"),
                           count.alias("row_count"), F.lit(0.0).alias("execution_time_ms"), data.alias("data_json"))
    refused = classified.where(~F.col("status").startswith("accepted")).select(
        *ids, F.lit(False).alias("success"), "error", F.lit(None).cast("int").alias("row_count"), F.lit(0.0).alias("execution_time_ms"),
        F.lit(None).cast("string").alias("data_json"))
    return done.unionByName(refused)


# --- J10 / F18 / F19 ----------------------------------------------------------
def call_result_pairs(calls: DataFrame, results: DataFrame) -> DataFrame:
    """i-th parsed call with i-th result of the same output (positions among parsed calls)."""
    return calls.join(results, ["output_id", "call_pos"])


def tool_message(pairs: DataFrame) -> Column:
    """``role = tool`` payload: status, counts, rows and the SQL trace cut to 200 characters."""
    trace = json_string(F.substring(F.col("sql"), 1, TRACE_SQL_CHARS))
    ok = F.concat(F.lit('{"status":"success","row_count":'), F.coalesce(F.col("row_count").cast("string"), F.lit("0")),
                  F.lit(',"execution_time_ms":'), F.round(F.coalesce("execution_time_ms", F.lit(0.0)), 2).cast("string"),
                  F.lit(',"data":'), F.coalesce("data_json", F.lit("[]")), F.lit(',"_tool_call_sql":'), trace, F.lit("}"))
    bad = F.concat(F.lit('{"status":"error","error":'), json_string(F.col("error")),
                   F.lit(',"_tool_call_sql":'), trace, F.lit("}"))
    return F.when(F.col("success"), ok).otherwise(bad)


def results_context(pairs: DataFrame) -> DataFrame:
    """One text block per output: data, error or empty section with ``i/n`` numbering,
    sections in call order separated by a blank line."""
    arr = F.array_sort(F.collect_list(F.struct("call_pos", "success", "row_count", "error", "data_json")))

    def section(x, n):
        i = (x["call_pos"] + 1).cast("string")
        total = n.cast("string")
        has_rows = F.coalesce(x["row_count"], F.lit(0)) > 0
        # Section headers of the results summary.
        return (F.when(x["success"] & has_rows, F.concat(
                    F.lit("[Données récupérées "), i, F.lit("/"), total, F.lit(" — "),
                    x["row_count"].cast("string"), F.lit(" résultat(s)]\n"), x["data_json"]))
                .when(~x["success"], F.concat(F.lit("[Erreur requête "), i, F.lit("/"), total, F.lit("]\n"),
                                             F.coalesce(x["error"], F.lit("None"))))
                .otherwise(F.concat(F.lit("[Requête "), i, F.lit("/"), total, F.lit(" — aucun résultat]"))))

    per = pairs.groupBy("output_id").agg(arr.alias("_r"))
    return per.select("output_id", F.array_join(F.transform("_r", lambda x: section(x, F.size("_r"))), "\n\n")
                      .alias("context"))


# --- A17 -------------------------------------------------------------------
def tool_use_stats(outputs: DataFrame, results: DataFrame, key: str = "output_id", text: str = "output") -> DataFrame:
    """Per output: parsed calls made, successful results, source tables in first-seen order.

    Calls and their tables are read off the output's own row; only the successes come from
    ``results``, counted per output.
    """
    contents = F.transform(F.regexp_extract_all(F.col(text), F.lit(BLOCK), 1), lambda body: parse_call(_block_content(body)[1]))
    calls = F.filter(contents, lambda c: c["parse_path"] != "none")
    tables = F.array_distinct(F.array_compact(F.transform("_calls", lambda c: source_table(c["sql"]))))
    good = results.groupBy(F.col("output_id").alias(key)).agg(F.count_if("success").alias("tool_calls_successful"))
    return (outputs.select(key, calls.alias("_calls"))
            .select(key, F.size("_calls").cast("bigint").alias("tool_calls_made"), tables.alias("data_sources_used"))
            .join(good, key, "left")
            .select(key, "tool_calls_made", F.coalesce("tool_calls_successful", F.lit(0).cast("bigint")).alias("tool_calls_successful"),
                    "data_sources_used"))


def calls_made(output: Column) -> Column:
    """Parsed calls of an output (a whole number), without leaving its row."""
    contents = F.transform(F.regexp_extract_all(output, F.lit(BLOCK), 1), lambda body: parse_call(_block_content(body)[1])["parse_path"])
    return F.size(F.filter(contents, lambda p: p != "none"))


# --- F5 / F6 ---------------------------------------------------------------
def json_string(c: Column) -> Column:
    """``c`` as a JSON string literal (quoted and escaped), ``null`` for NULL."""
    body = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.coalesce(F.nullif(body, F.lit("")), F.lit("null"))


def _json_string_body(c: Column) -> Column:
    """JSON-escaped body of a string (without the surrounding quotes)."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":"(.*)"\}$', 1)


def format_tool_call(sql: Column) -> Column:
    """Marked JSON call ``{"name": "query_postgresql", "parameters": {"sql": ...}}``."""
    return F.concat(F.lit(TOOL_CALL_START + '{"name": "query_postgresql", "parameters": {"sql": "'),
                    _json_string_body(sql), F.lit('"}}' + TOOL_CALL_END))


def tool_result_payload(rows: Column, execution_time_ms: float = 8.4) -> Column:
    """JSON of status, row count, time and rows (``rows`` = array of structs)."""
    return F.to_json(F.struct(F.lit("success").alias("status"), F.size(rows).alias("row_count"),
                              F.lit(execution_time_ms).alias("execution_time_ms"), rows.alias("data")))


def tool_error_payload(error: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("status"), error.alias("error")))
