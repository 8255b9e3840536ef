"""Generator invariants: quotas, domains, reproducibility, and a clean quality report."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.enums import VALID_DIFFICULTIES, VALID_LABELS, VALID_SEVERITIES
from ledgerline.operators import generate as G
from ledgerline.operators import quality as Q
from ledgerline.operators import splits as S


@pytest.fixture(scope="module")
def catalogues(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    branches = [(c, label, "Implicite#Ambigu", evidence, users, f"Label: {{label}} / {{severity}} / {{principle}} / {c}", "SELECT {risk.slug}", "plain", "tools")
                for c, labels, evidence, users in (
                    ("diagnostic_complet", ("Green Flag", "Red Flag", "Mixed"), "{strength.evidence}+{risk.mode}", "A {idx} {evidence} {unheard}"),
                    ("identification_des_dangers", ("Red Flag", "Mixed"), "{risk.mode}+{risk2.mode}", "B {evidence}"),
                    ("evaluation_investissement", ("Green Flag", "Red Flag", "Mixed"), "{risk.mode}", "C {evidence} {profile}"),
                    ("simplification_concept", ("Green Flag",), "", "D1 {concept.name}#D2 {context}")) for label in labels]
    return G.Catalogues(
        rows([(i, f"risk{i}", f"rp{i}", ("Fatal", "Majeur", "Mineur")[i % 3], f"slug{i}", f"explicit{i} {{idx}}", f"implicit{i}", f"why{i}") for i in range(7)],
             "id long, name string, principle string, severity string, slug string, explicit string, implicit string, why string"),
        rows([(i, f"s{i}", f"sp{i}", f"evidence{i}", f"why{i}") for i in range(4)], "id long, name string, principle string, evidence string, why string"),
        rows([(i, f"c{i}", f"cp{i}", f"def{i}", f"like{i}") for i in range(5)], "id long, name string, principle string, simple_def string, analogy string"),
        rows([(i, f"k{i}", "important", f"rule{i}") for i in range(3)], "id long, criterion_name string, weight string, simple_rule string"),
        rows([(i, f"ctx{i}") for i in range(5)], "id long, context string"),
        rows(branches, "category string, label string, implicit_for string, evidence string, users string, answer string, sql string, "
                       "system_plain string, system_tools string"))


@pytest.fixture(scope="module")
def generated(spark, catalogues):
    ids = spark.range(5200).select((F.col("id") * 3 + 11).alias("id"))     # sparse ids
    meta, msgs = G.generate_examples(ids, catalogues)
    return meta.cache(), msgs.cache()


def test_category_quotas(generated):
    meta, _ = generated
    counts = {r.category: r["count"] for r in meta.groupBy("category").count().collect()}
    assert counts == {"diagnostic_complet": 1664, "identification_des_dangers": 1300,
                      "evaluation_investissement": 1456, "simplification_concept": 780}
    assert sorted(r.example_id for r in meta.select("example_id").collect()) == list(range(5200))


def test_domains_and_tool_ratio(generated):
    meta, _ = generated
    rows = meta.collect()
    assert {r.Label for r in rows} <= set(VALID_LABELS)
    assert {r.Severity for r in rows} <= set(VALID_SEVERITIES)
    assert {r.Difficulty for r in rows} <= set(VALID_DIFFICULTIES)
    ratio = sum(r.has_tool_use for r in rows) / len(rows)
    assert 0.30 < ratio < 0.40
    danger = [r for r in rows if r.category == "identification_des_dangers"]
    assert {r.Label for r in danger} == {"Red Flag"} and {r.Severity for r in danger} <= {"Fatal", "Majeur"}
    simple = [r for r in rows if r.category == "simplification_concept"]
    assert {(r.Label, r.Severity, r.Difficulty) for r in simple} == {("Green Flag", "Non applicable", "Explicite")}


def test_generated_set_passes_the_quality_checks(generated):
    meta, msgs = generated
    facts = Q.example_facts(meta, msgs)
    for check in (Q.role_errors, Q.metadata_errors, Q.label_mismatches, Q.tool_flag_errors):
        assert check(facts).count() == 0, check.__name__


def test_reproducible_and_partition_independent(spark, generated, catalogues):
    meta, _ = generated
    ids = spark.range(5200).select((F.col("id") * 3 + 11).alias("id")).repartition(13)
    again, _ = G.generate_examples(ids, catalogues)
    cols = ["example_id", "category", "Label", "Severity", "Difficulty", "sector", "has_tool_use", "lean_principle"]
    assert sorted(map(tuple, meta.select(cols).collect())) == sorted(map(tuple, again.select(cols).collect()))


def test_hard_set_and_split(spark, generated, catalogues):
    meta, _ = generated
    hard, _ = G.generate_examples(spark.range(250), catalogues, hard=True)
    assert hard.count() == 250 and hard.where(~F.col("hard_eval")).count() == 0
    sizes = {r.split: r.n_rows for r in S.split_sizes(S.stratified_split(Q.normalise_metadata(meta))).collect()}
    assert sizes == {"train": 4160, "val": 520, "test": 520}


def test_branches_say_what_their_catalogues_say(generated):
    meta, msgs = generated
    by = {}
    for r in msgs.collect():
        by.setdefault(r.example_id, []).append((r.turn, r.role, r.content))
    forms = set()
    for m in meta.collect():
        turns = sorted(by[m.example_id])
        roles = [r for _, r, _ in turns]
        assert roles == (["system", "user", "assistant", "tool", "assistant"] if m.has_tool_use else ["system", "user", "assistant"])
        assert turns[0][2] == ("tools" if m.has_tool_use else "plain")
        user, answer = turns[1][2], turns[-1][2]
        assert answer == f"Label: {m.Label} / {m.Severity} / {m.lean_principle} / {m.category}"
        implicit = m.Difficulty in ("Implicite", "Ambigu")
        if m.category == "identification_des_dangers":
            a, b = re.fullmatch(r"B (\w+?\d(?: \{idx\})?)\+(\w+?\d(?: \{idx\})?)", user).groups()      # {idx} of a catalogue stays as it is
            assert a != b and all(("implicit" in x) == implicit for x in (a, b))
            if m.has_tool_use:
                data = json.loads(turns[3][2])
                assert data["row_count"] == 2 and len({x["pattern_name"] for x in data["data"]}) == 2
        elif m.category == "diagnostic_complet":
            assert user.startswith(f"A {m.example_id} evidence") and user.endswith(" ") and ("implicit" in user) == implicit
        elif m.category == "simplification_concept":
            forms.add(user[:2])
        elif m.has_tool_use:
            first, second = json.loads(turns[3][2])["data"]
            assert first["criterion_name"] != second["criterion_name"]
            assert first["weight"] == ("critical" if m.Severity == "Fatal" else "important") and second["weight"] == "important"
    assert forms == {"D1", "D2"}


def test_both_sets_of_one_frame(spark, catalogues):
    ids = spark.range(200).select("id", F.lit(False).alias("hard")).unionByName(spark.range(100).select("id", F.lit(True).alias("hard")))
    meta, msgs = G.generate_examples(ids, catalogues)
    for hard, n in ((False, 200), (True, 100)):
        alone, said = G.generate_examples(spark.range(n), catalogues, hard=hard)
        assert sorted(map(tuple, meta.where(F.col("hard_eval") == hard).collect())) == sorted(map(tuple, alone.collect()))
        assert sorted(map(tuple, msgs.where(F.col("hard_eval") == hard).collect())) == sorted(map(tuple, said.collect()))


def test_short_catalogues(spark, catalogues):
    one = G.Catalogues(catalogues.risks.where("id = 3"), catalogues.strengths, catalogues.concepts, catalogues.criteria.limit(0),
                       catalogues.contexts, catalogues.branches)
    meta, msgs = G.generate_examples(spark.range(50), one)
    assert meta.count() == 50 and {r.Severity for r in meta.where("category = 'identification_des_dangers'").collect()} == {"Fatal"}
    assert G.generate_examples(spark.range(0), catalogues)[1].count() == 0


def test_slug(spark):
    df = spark.createDataFrame([("Série A-b",), ("Idéation",), ("Post-Pivot",)], "v string")
    assert [r.s for r in df.select(G.slug(F.col("v")).alias("s")).collect()] == ["serie_a_b", "ideation", "post_pivot"]
