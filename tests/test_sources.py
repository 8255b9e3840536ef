"""JSON-lines readers and writers, all-or-nothing reference loading, streaming ingest."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from ledgerline.sources import jsonl as J
from ledgerline.sources import seeds
from ledgerline.streaming.outputs import start_call_classification


def test_read_examples_skips_blank_and_bad_lines(spark, scratch):
    path = os.path.join(scratch, "ex.jsonl")
    good = {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"},
                         {"role": "assistant", "content": "Label: Mixed"}],
            "metadata": {"example_id": 7, "category": "c", "Label": "Mixed", "Severity": None}}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(good) + "\n\n{not json\n" + json.dumps({**good, "metadata": {"example_id": 8}}) + "\n")
    ex = J.read_examples(spark, path)
    assert sorted(r.example_id for r in ex.collect()) == ["7", "8"]
    assert J.bad_lines(spark, path).count() == 1
    facts = Q.example_facts(ex.select("example_id", "metadata_json"), J.examples_to_long(ex))
    errors = {(r.example_id, r.error) for r in Q.metadata_errors(facts).collect()}
    assert ("7", "invalid:Severity") in errors and ("7", "missing:Severity") not in errors
    assert ("8", "missing:Label") in errors and ("8", "invalid:Label") in errors
    with pytest.raises(AnalysisException):
        J.read_examples(spark, os.path.join(scratch, "missing.jsonl")).count()


def test_read_examples_with_text_ids_and_without_ids(spark, scratch):
    path = os.path.join(scratch, "ids.jsonl")
    rows = [{"messages": [], "metadata": {"example_id": "lean-00001"}}, {"messages": [], "metadata": {"category": "x"}}]
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    first = sorted(r.example_id for r in J.read_examples(spark, path).collect())
    assert len(set(first)) == 2 and "lean-00001" in first and None not in first
    assert first == sorted(r.example_id for r in J.read_examples(spark, path).collect())


def test_write_examples_keeps_nulls_and_splits(spark, scratch):
    nested = spark.createDataFrame(
        [(1, "train", None, [("user", "hi")]), (2, "val", "x", [("assistant", "yo")])],
        "example_id long, split string, Severity string, messages array<struct<role:string,content:string>>")
    out = os.path.join(scratch, "out")
    J.write_examples(nested, out)
    assert sorted(os.listdir(out))[:2] == ["_SUCCESS", "split=train"] or "split=train" in os.listdir(out)
    back = spark.read.text(os.path.join(out, "split=train"))
    line = json.loads(back.first().value)
    assert line["metadata"] == {"example_id": 1, "Severity": None}


def test_reference_load_is_all_or_nothing(spark, scratch):
    root = os.path.join(scratch, "ref")
    v1 = seeds.load_reference_tables(spark, {"lean_concepts": spark.range(3), "risk_patterns": spark.range(5)}, root)
    assert seeds.read_reference_table(spark, root, "risk_patterns").count() == 5
    v2 = seeds.load_reference_tables(spark, {"lean_concepts": spark.range(4), "risk_patterns": spark.range(6)}, root)
    assert v2 > v1 and seeds.current_version(spark, root) == v2
    assert seeds.read_reference_table(spark, root, "lean_concepts").count() == 4
    # a load that fails half-way leaves the last commit in place
    broken = {"lean_concepts": spark.range(9), "risk_patterns": spark.range(1).select(F.col("id").alias("id"))}
    os.makedirs(root, exist_ok=True)
    try:
        seeds.load_reference_tables(spark, {**broken, "zz_bad": spark.range(1).select(F.raise_error(F.lit("x")))}, root)
    except Exception:
        pass
    assert seeds.current_version(spark, root) == v2


def test_streaming_classification_exactly_once(spark, scratch):
    src, sink, ckpt = (os.path.join(scratch, d) for d in ("src", "sink", "ckpt"))
    os.makedirs(src)
    s, e = "<|tool_call_start|>", "<|tool_call_end|>"
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps({"output_id": 1, "output": f'{s}[query_postgresql(sql="SELECT 1")]{e}'}) + "\n")
        f.write(json.dumps({"output_id": 2, "output": f'{s}[query_postgresql(sql="DROP TABLE x")]{e}'}) + "\n")
    start_call_classification(spark, src, sink, ckpt, available_now=True).awaitTermination()
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(json.dumps({"output_id": 3, "output": "no call"}) + "\n")
        f.write(json.dumps({"output_id": 4, "output": f'{s}[x(sql="SELECT 2")]{e}'}) + "\n")
    start_call_classification(spark, src, sink, ckpt, available_now=True).awaitTermination()
    rows = {r.output_id: r.status for r in spark.read.parquet(sink).collect()}
    assert rows == {1: "accepted_capped", 2: "rejected_non_select", 4: "unknown_tool"}
