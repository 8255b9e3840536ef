"""Tool-call extraction, parsing and guard rules on hand-made model texts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import outputs as O
from ledgerline.sources import sql as SQ

S, E = "<|tool_call_start|>", "<|tool_call_end|>"
TEXTS = [
    "no call here",
    f"intro {S}[query_postgresql(sql=\"SELECT * FROM risk_patterns WHERE id = 1\")]{E} outro",
    f"{S}[query_postgresql(sql=\"SELECT a\nFROM startups\nWHERE x = 1\")]{E}",                       # multi-line
    f"{S}[query_postgresql(sql='SELECT 1')]{E} and {S}[other(sql=\"SELECT 2\")]{E}",                   # two calls
    f"{S}{{\"name\": \"query_postgresql\", \"parameters\": {{\"sql\": \"SELECT b FROM t LIMIT 3\"}}}}{E}",
    f"{S}{{\"name\": \"query_postgresql\"}}{E}",                                                       # JSON w/o parameters
    f"{S}[[query_postgresql(sql=\"SELECT c FROM pivot_cases\")]]{E}",                                  # nested brackets
    f"{S}[query_postgresql(sql=\"DROP TABLE startups\")]{E}",
    f"{S}[query_postgresql(sql=\"WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x\")]{E}",
    f"{S}[query_postgresql(sql=\"SELECT credit_limit FROM t;\")]{E}",
    f"{S}junk sql=select d from u{E}",                                                                 # bare form
    f"{S}[oops]{E}",
    f"text {S}[query_postgresql(sql=\"SELECT 9\")] never closed",                                     # unclosed
]


Q = "query_postgresql"
# The calls of each text (by its place in TEXTS), written out by hand.
CALLS = {
    1: [("function", Q, "SELECT * FROM risk_patterns WHERE id = 1")],
    2: [("function", Q, "SELECT a\nFROM startups\nWHERE x = 1")],
    3: [("function", Q, "SELECT 1"), ("function", "other", "SELECT 2")],
    4: [("json", Q, "SELECT b FROM t LIMIT 3")],
    6: [("function", Q, "SELECT c FROM pivot_cases")],
    7: [("function", Q, "DROP TABLE startups")],
    8: [("function", Q, "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x")],
    9: [("function", Q, "SELECT credit_limit FROM t;")],
    10: [("bare_sql", Q, "select d from u")],
}


@pytest.fixture(scope="module")
def outputs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "output_id long, output string")


def test_parsed_calls_of_each_text(outputs):
    got = {}
    for r in O.parsed_calls(outputs).collect():
        got.setdefault(r.output_id, []).append((r.call_pos, r.parse_path, r.function_name, r.sql))
    for i, text in enumerate(TEXTS):
        want = [(k, *c) for k, c in enumerate(CALLS.get(i, []))]
        assert sorted(got.get(i, [])) == want, text


def test_marker_presence_and_free_text(outputs):
    rows = {r.output_id: r for r in outputs.select(
        "output_id", O.has_tool_call(F.col("output")).alias("m"), O.free_text(F.col("output")).alias("t"),
        O.clean_answer(F.col("output")).alias("c")).collect()}
    assert rows[12].m is True and rows[0].m is False
    assert rows[1].t == "intro outro" and rows[3].t == "and"
    assert rows[12].c == 'text [query_postgresql(sql="SELECT 9")] never closed'


def test_guard_classification(outputs):
    c = {(r.output_id, r.call_pos): r for r in O.classify_calls(O.parsed_calls(outputs)).collect()}
    assert c[(1, 0)].status == "accepted_capped"
    assert c[(1, 0)].effective_sql.endswith(" LIMIT 20")
    assert c[(3, 1)].status == "unknown_tool" and "non disponible" in c[(3, 1)].error
    assert c[(4, 0)].status == "accepted"                       # has its own LIMIT
    assert c[(7, 0)].status == "rejected_non_select"
    assert c[(8, 0)].status == "accepted_capped"                # WITH passes the text guard ...
    assert c[(9, 0)].status == "accepted"                       # ... and credit_limit turns the cap off
    assert c[(10, 0)].function_name == "query_postgresql"


def test_guarded_sql_refuses_writes_and_caps(spark):
    spark.range(100).createOrReplaceTempView("guard_t")
    assert SQ.guarded_sql(spark, "SELECT id FROM guard_t").count() == 20
    assert SQ.guarded_sql(spark, "select id from guard_t limit 50;").count() == 20
    with pytest.raises(ValueError):
        SQ.guarded_sql(spark, "DROP TABLE guard_t")
    for bad in ("WITH x AS (SELECT 1 AS id) INSERT INTO guard_t SELECT * FROM x",
                "SELECT 1; DROP TABLE guard_t"):
        with pytest.raises(Exception):
            SQ.guarded_sql(spark, bad).collect()
    assert SQ.parameterised_query(spark, "SELECT id FROM guard_t WHERE id < ?", [5]).count() == 5
    assert SQ.parameterised_query(spark, "SELECT id FROM guard_t WHERE id > :lo", {"lo": 97}, fetch="one").count() == 1


def test_results_context_and_stats(spark, outputs):
    parsed = O.parsed_calls(outputs)
    results = spark.createDataFrame(
        [(1, 0, True, None, 2, 1.5, '[{"a":1},{"a":2}]'), (3, 0, True, None, 0, 1.0, "[]"),
         (3, 1, False, "boom", 0, 0.0, None)],
        "output_id long, call_pos int, success boolean, error string, row_count int, execution_time_ms double, "
        "data_json string")
    ctx = {r.output_id: r.context for r in O.results_context(results).collect()}
    assert ctx[1] == '[Données récupérées 1/1 — 2 résultat(s)]\n[{"a":1},{"a":2}]'
    assert ctx[3] == "[Requête 1/2 — aucun résultat]\n\n[Erreur requête 2/2]\nboom"
    stats = {r.output_id: r for r in O.tool_use_stats(outputs, results).collect()}
    assert (stats[3].tool_calls_made, stats[3].tool_calls_successful) == (2, 1)
    assert stats[0].tool_calls_made == 0 and stats[0].data_sources_used == []
    assert stats[1].data_sources_used == ["risk_patterns"]
    msg = O.call_result_pairs(parsed, results)
    payloads = {(r.output_id, r.call_pos): json.loads(r.m) for r in msg.select(
        "output_id", "call_pos", O.tool_message(msg).alias("m")).collect()}
    assert payloads[(1, 0)]["row_count"] == 2 and payloads[(3, 1)] == {
        "status": "error", "error": "boom", "_tool_call_sql": "SELECT 2"}


def test_call_templates(spark):
    texts = ["SELECT a FROM t WHERE id = 'it''s' LIMIT 5;", "select  a\nfrom t where id = '12' limit 20", "SELECT 1.5, x1 FROM t2"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    got = [tuple(r.t) for r in df.orderBy("i").select(O.call_template(F.col("sql")).alias("t")).collect()]
    assert got == [("SELECT A FROM T WHERE ID = ? LIMIT ?", ["it's", "5"]), ("SELECT A FROM T WHERE ID = ? LIMIT ?", ["12", "20"]),
                   ("SELECT ?, X1 FROM T2", ["1.5"])]


def test_calls_are_answered_by_template(spark):
    risks = spark.createDataFrame([(i, f"r{i}", "a" if i < 30 else "b") for i in range(40)] + [(99, None, None)], "id long, name string, kind string")
    templates = [O.CallTemplate("SELECT NAME FROM RISKS WHERE KIND = ? LIMIT ?", risks, "kind", ("name",), ("id",)),
                 O.CallTemplate("SELECT ID FROM RISKS LIMIT ?", risks, None, ("id",), ("id",))]
    calls = ["SELECT name FROM risks WHERE kind = 'a'", "SELECT name FROM risks WHERE kind = 'a' LIMIT 2", "SELECT name FROM risks WHERE kind = 'none'",
             "SELECT id FROM risks LIMIT 3", "SELECT id FROM risks", "SELECT other FROM risks", "DROP TABLE risks", "SELECT name FROM risks WHERE kind = 'a' LIMIT 0",
             "SELECT name FROM risks WHERE kind = 'a' LIMIT 99999999999"]
    outputs = spark.createDataFrame([(i, f'{S}[query_postgresql(sql="{c}")]{E}') for i, c in enumerate(calls)] * 1, "output_id long, output string")
    got = {r.output_id: r for r in O.execute_calls(O.classify_calls(O.parsed_calls(outputs)), templates).collect()}
    assert len(got) == len(calls) and [got[i].row_count for i in range(9)] == [20, 2, 0, 3, 20, None, None, 0, 20]
    assert json.loads(got[1].data_json) == [{"name": "r0"}, {"name": "r1"}] and json.loads(got[3].data_json) == [{"id": 0}, {"id": 1}, {"id": 2}]
    assert got[2].success and got[2].data_json == "[]"
    assert not got[5].success and "SELECT OTHER FROM RISKS LIMIT ?" in got[5].error and not got[6].success
    none = {r.output_id: r.success for r in O.execute_calls(O.classify_calls(O.parsed_calls(outputs)), []).collect()}
    assert set(none) == set(got) and not any(none.values())


def test_audit_log_reads_committed_rows_of_a_version(spark, scratch):
    from ledgerline.sources import audit
    spark.range(10).createOrReplaceTempView("guard_t")
    root = f"{scratch}/audit"
    assert SQ.guarded_sql(spark, "SELECT id FROM guard_t;", audit_root=root).count() == 10
    first = audit.versions(spark, root).first().version
    classified = spark.createDataFrame([("accepted", "SELECT 1" + "0" * 400), ("accepted_capped", "SELECT 2"), ("unknown_tool", None)], "status string, effective_sql string")
    SQ.audit_calls(classified, root)
    with pytest.raises(ValueError):
        SQ.guarded_sql(spark, "DELETE FROM guard_t", audit_root=root)
    spark.createDataFrame([("lost", 1)], "sql string, max_rows int").write.parquet(f"{root}/rows/v=uncommitted")      # a writer that failed
    log = audit.read(spark, root, SQ.AUDIT_SCHEMA).collect()
    assert sorted(r.sql for r in log) == ["SELECT 1" + "0" * 292, "SELECT 2", "SELECT id FROM guard_t;"]
    assert [r.sql for r in audit.read(spark, root, SQ.AUDIT_SCHEMA, first).collect()] == ["SELECT id FROM guard_t;"]
    assert sorted(r.n_rows for r in audit.versions(spark, root).collect()) == [1, 2]
