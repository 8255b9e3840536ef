"""Seeded chat-example generation as a Spark job (G1-G7, F1, F20).

One example per input id. Every random draw is a uniform number taken from
``sha1("<seed>:<field>:<id>")``, so the result is reproducible and independent of
partitioning and retries. Category quotas follow the example's position in id order.

All wording comes from input tables (``Catalogues``): what risks, strengths, concepts and
criteria say, the contexts of a question, and for each branch (category and label) its prompts,
evidence, answer and SQL with ``{field}`` places. A pick from a catalogue is a place in it, drawn
per example, and an equi-join on the place; several distinct rows of one catalogue are drawn as
offsets from the first, so there is no window over examples and a catalogue may be of any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.outputs import format_tool_call, tool_result_payload
from ledgerline.operators.ranking import running_sum
from ledgerline.operators.splits import positions_by_order

SEED = 42
HARD_SEED = SEED + 99

# Vocabularies and weights of the dataset generator.
LABELS = ("Green Flag", "Red Flag", "Mixed")
DIFFICULTIES = ("Explicite", "Implicite", "Ambigu", "Mixte")
LABEL_WEIGHTS = (0.36, 0.39, 0.25)
LABEL_WEIGHTS_HARD = (0.31, 0.37, 0.32)
DIFFICULTY_WEIGHTS = (0.30, 0.38, 0.18, 0.14)
DIFFICULTY_WEIGHTS_HARD = (0.15, 0.40, 0.30, 0.15)
TOOL_USE_RATIO = 0.35
CATEGORY_SHARES = (("diagnostic_complet", 0.32), ("identification_des_dangers", 0.25),
                   ("evaluation_investissement", 0.28))
LAST_CATEGORY = "simplification_concept"
SECTORS = ("SaaS B2B", "Marketplace", "Fintech", "Healthtech", "Edtech", "Agritech", "E-commerce",
           "Deeptech", "Web3", "Cleantech", "Proptech", "Adtech", "Insurtech", "Logistique", "Foodtech")
STAGES = ("Idéation", "Pre-Seed", "Seed", "Series A", "Post-Pivot")
INVESTOR_PROFILES = ("angel", "vc", "impact", "strategic", "entrepreneur")
REGIONS = ("France", "Afrique subsaharienne", "Maroc", "USA", "Europe", "Asie du Sud-Est")
LABELS_OF_DANGERS = ("Red Flag", "Mixed")
RED_SHARE_HARD = 0.75          # of the dangers in the hard set


@dataclass(frozen=True)
class Catalogues:
    """Input tables of the generator; ``id`` orders each one, so that a drawn place means the
    same row on every run.

    ``risks(id, name, principle, severity, slug, explicit, implicit, why)``,
    ``strengths(id, name, principle, evidence, why)``, ``concepts(id, name, principle, simple_def,
    analogy)``, ``criteria(id, criterion_name, weight, simple_rule)``, ``contexts(id, context)``,
    ``branches(category, label, implicit_for, evidence, users, answer, sql, system_plain,
    system_tools)``: ``users`` holds the forms of the question and ``implicit_for`` the
    difficulties that state a risk implicitly, both joined by ``#``; in the texts ``{field}`` is
    replaced, ``{risk.mode}`` by the implicit or explicit statement.
    """

    risks: DataFrame
    strengths: DataFrame
    concepts: DataFrame
    criteria: DataFrame
    contexts: DataFrame
    branches: DataFrame


def uniform(field: str, id_col: str = "id", seed: int | Column = SEED) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of ``sha1("seed:field:id")``."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    h = F.sha1(F.concat(seed.cast("string"), F.lit(f":{field}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def cumulative(weights) -> list[float]:
    return list(accumulate(weights))


def weighted_choice(u: Column, values, weights) -> Column:
    """The first value whose cumulative weight exceeds ``u`` (last value otherwise)."""
    out = F.lit(values[-1])
    for v, edge in reversed(list(zip(values[:-1], cumulative(weights)[:-1]))):
        out = F.when(u < edge, F.lit(v)).otherwise(out)
    return out


def pick(values, u: Column) -> Column:
    """Uniform pick from a small fixed list."""
    idx = F.floor(u * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)


def slug(c: Column) -> Column:
    """lower-case, accented e forms to ``e``, blanks and dashes to ``_``."""
    return F.translate(F.lower(c), "éèê -", "eee__")


def category_quotas(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """G1: category by position in id order: 32 % / 25 % / 28 % (floors), rest to the last.

    Ids with a ``hard`` column make two sets (plain and hard) with quotas of their own."""
    sets = ["hard"] if "hard" in ids.columns else []
    j = running_sum(ids.select(id_col, *sets), sets, [id_col], F.lit(1), "pos", total="_n")
    out = F.lit(LAST_CATEGORY)
    edge = F.lit(0).cast("bigint")
    edges = []
    for name, share in CATEGORY_SHARES:
        edge = edge + F.floor(F.col("_n") * F.lit(share)).cast("bigint")
        edges.append((name, edge))
    for name, e in reversed(edges):
        out = F.when(F.col("pos") < e, F.lit(name)).otherwise(out)
    return j.select(id_col, *sets, "pos", out.alias("category"), F.col("_n").alias("n_total"))


def _seed() -> Column:
    return F.when(F.col("hard"), HARD_SEED).otherwise(SEED)


def draws(quotas: DataFrame, id_col: str = "id") -> DataFrame:
    """G2: tool flag, label and difficulty draws (weights of the hard set where ``hard``)."""
    q = quotas if "hard" in quotas.columns else quotas.withColumn("hard", F.lit(False))
    label, difficulty = uniform("label", id_col, _seed()), uniform("difficulty", id_col, _seed())
    out = q.select(
        "*",
        (uniform("tool", id_col, _seed()) < TOOL_USE_RATIO).alias("has_tool_use"),
        F.when(F.col("hard"), weighted_choice(label, LABELS, LABEL_WEIGHTS_HARD))
        .otherwise(weighted_choice(label, LABELS, LABEL_WEIGHTS)).alias("drawn_label"),
        F.when(F.col("hard"), weighted_choice(difficulty, DIFFICULTIES, DIFFICULTY_WEIGHTS_HARD))
        .otherwise(weighted_choice(difficulty, DIFFICULTIES, DIFFICULTY_WEIGHTS)).alias("drawn_difficulty"))
    return out if "hard" in quotas.columns else out.drop("hard")


def drawn_rows(examples: DataFrame, catalogue: DataFrame, field: str, names: list[str], id_col: str = "id") -> DataFrame:
    """Adds a struct column for each of the one or two ``names``: rows of ``catalogue`` (all its
    columns), drawn per example by ``field`` and ``field2``. The second one's place is the first
    one's plus 1 + an offset below n - 1, so the two are distinct (unless the catalogue has a single
    row). An empty catalogue gives NULLs."""
    place = positions_by_order(catalogue, ["id"], out="_place")
    rows = place.select("_place", F.struct(*catalogue.columns).alias("_row"))
    n = catalogue.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = F.floor(uniform(field, id_col, _seed()) * n).cast("bigint")
    offset = F.floor(uniform(f"{field}2", id_col, _seed()) * F.greatest(n - 1, F.lit(1))).cast("bigint")
    places = [first, F.pmod(first + 1 + offset, F.greatest(n, F.lit(1)))]
    out = examples
    for name, at in zip(names, places, strict=False):
        out = (out.withColumn("_place", at).join(rows.withColumnRenamed("_row", name), "_place", "left").drop("_place"))
    return out


def _fields(g: DataFrame) -> Column:
    """What ``{field}`` may name, as a map."""
    named = {"idx": F.col("pos"), "sector": F.col("sector_pick"), "stage": F.col("stage_pick"), "region": F.col("region_pick"),
             "profile": F.col("profile_pick"), "sector_slug": slug(F.col("sector_pick")), "stage_slug": slug(F.col("stage_pick")),
             "label": F.col("label"), "severity": F.col("severity"), "difficulty": F.col("difficulty"), "principle": F.col("lean_principle"),
             "context": F.col("context.context")}
    for struct, columns in (("risk", ("name", "principle", "severity", "slug", "explicit", "implicit", "why")),
                            ("risk2", ("name", "principle", "severity", "slug", "explicit", "implicit", "why")),
                            ("strength", ("name", "principle", "evidence", "why")),
                            ("concept", ("name", "principle", "simple_def", "analogy"))):
        named |= {f"{struct}.{c}": F.col(f"{struct}.{c}") for c in columns}
    return F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])


def fill(template: Column, fields: Column) -> Column:
    """``template`` with every ``{field}`` replaced (an unknown field by nothing); what is put in
    is not looked at again."""
    parts = F.split(template, r"[{}]", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(
        i % 2 == 1, F.coalesce(F.try_element_at(fields, x), F.lit(""))).otherwise(x)), "")


def generate_examples(ids: DataFrame, catalogues: Catalogues, id_col: str = "id", hard: bool = False):
    """G3-G7: one example per id. Returns ``(meta, messages)`` in the working form
    ``meta(example_id, ...)`` and ``messages(example_id, turn, role, content)``.

    ``hard`` (or a boolean column of that name) chooses the hard evaluation set; its examples
    count from 0 as well, so a frame with both sets carries ``hard_eval`` beside ``example_id``
    in both tables.
    """
    both = ids if "hard" in ids.columns else ids.withColumn("hard", F.lit(hard))
    base = draws(category_quotas(both, id_col), id_col)
    u = lambda field: uniform(field, id_col, _seed())
    g = base.select(
        "*", pick(SECTORS, u("sector")).alias("sector_pick"), pick(STAGES, u("stage")).alias("stage_pick"),
        pick(REGIONS, u("region")).alias("region_pick"), pick(INVESTOR_PROFILES, u("profile")).alias("profile_pick"),
        u("mixed").alias("_u_mixed"), u("simple_difficulty").alias("_u_sd"), u("form").alias("_u_form"))
    g = drawn_rows(g, catalogues.risks, "risk", ["risk", "risk2"], id_col)
    g = drawn_rows(g, catalogues.strengths, "strength", ["strength"], id_col)
    g = drawn_rows(g, catalogues.concepts, "concept", ["concept"], id_col)
    g = drawn_rows(g, catalogues.criteria, "criterion", ["criterion", "criterion2"], id_col)
    g = drawn_rows(g, catalogues.contexts, "context", ["context"], id_col)
    cat, is_hard = F.col("category"), F.col("hard")
    danger, simple = cat == "identification_des_dangers", cat == LAST_CATEGORY
    label = (F.when(danger, F.when(~is_hard | (F.col("_u_mixed") < RED_SHARE_HARD), LABELS_OF_DANGERS[0]).otherwise(LABELS_OF_DANGERS[1]))
             .when(simple, "Green Flag").otherwise(F.col("drawn_label")))
    difficulty = F.when(simple, F.when(~is_hard | (F.col("_u_sd") < 0.5), "Explicite").otherwise("Implicite")).otherwise(F.col("drawn_difficulty"))
    fatal = (F.col("risk.severity") == "Fatal") | (F.col("risk2.severity") == "Fatal")
    severity = (F.when(danger, F.when(fatal, "Fatal").otherwise("Majeur"))
                .when(simple | (F.col("label") == "Green Flag"), "Non applicable").otherwise(F.col("risk.severity")))
    principle = (F.when(simple, F.col("concept.principle"))
                 .when(~danger & (F.col("label") == "Green Flag"), F.col("strength.principle")).otherwise(F.col("risk.principle")))
    g = (g.withColumn("label", label).withColumn("difficulty", difficulty)
         .withColumn("severity", severity).withColumn("lean_principle", principle))
    has_segment = ~danger & ~simple
    key = [F.col("pos").alias("example_id"), is_hard.alias("hard_eval")]
    meta = g.select(
        *key, F.format_string("lean-%05d", F.col("pos")).alias("example_key"),
        "category", F.col("label").alias("Label"), F.col("severity").alias("Severity"),
        F.col("difficulty").alias("Difficulty"),
        F.when(simple, F.lit("universal")).otherwise(F.col("sector_pick")).alias("sector"),
        F.when(has_segment, F.col("stage_pick")).otherwise(F.lit("non applicable")).alias("stage"),
        F.when(has_segment, F.col("region_pick")).otherwise(F.lit("non applicable")).alias("region"),
        F.col("profile_pick").alias("investor_profile"), "has_tool_use", "lean_principle")
    return meta, _messages(g, catalogues.branches)


def _messages(g: DataFrame, branches: DataFrame) -> DataFrame:
    """The turns of every example: system, question, with tools the call and its result, answer."""
    told = g.withColumn("_fields", _fields(g)).join(branches, ["category", "label"])
    mode = F.when(F.array_contains(F.split("implicit_for", "#"), F.col("difficulty")), "implicit").otherwise("explicit")
    forms = F.split("users", "#")
    form = F.element_at(forms, (F.floor(F.col("_u_form") * F.size(forms)) + 1).cast("int"))
    moded = lambda t: F.regexp_replace(t, r"\.mode\}", F.concat(F.lit("."), mode, F.lit("}")))
    whole = lambda t: fill(moded(F.replace(t, F.lit("{evidence}"), F.col("evidence"))), F.col("_fields"))
    danger, simple, invest = (F.col("category") == c for c in ("identification_des_dangers", LAST_CATEGORY, "evaluation_investissement"))
    risk_line = lambda r, severity: F.struct(
        F.col(f"{r}.name").alias("pattern_name"), severity.alias("criticality"), F.col(f"{r}.why").alias("simple_explain"),
        F.col(f"{r}.principle").alias("lean_principle"))
    criterion_line = lambda c, weight: F.struct(
        F.col(f"{c}.criterion_name").alias("criterion_name"), weight.alias("weight"), F.col(f"{c}.simple_rule").alias("simple_rule"))
    concept_line = F.struct(F.col("concept.name").alias("concept_name"), F.col("concept.simple_def").alias("simple_def"),
                            F.col("concept.analogy").alias("analogy"), F.col("lean_principle").alias("lean_principle"))
    case_line = F.struct(F.col("risk.name").alias("pattern_name"), F.col("severity").alias("criticality"),
                         F.col("risk.why").alias("simple_explain"), F.col("lean_principle").alias("lean_principle"))
    result = (F.when(danger, tool_result_payload(F.array(risk_line("risk", F.col("risk.severity")), risk_line("risk2", F.col("risk2.severity")))))
              .when(invest, tool_result_payload(F.array(
                  criterion_line("criterion", F.when(F.col("severity") == "Fatal", "critical").otherwise(F.col("criterion.weight"))),
                  criterion_line("criterion2", F.col("criterion2.weight")))))
              .when(simple, tool_result_payload(F.array(concept_line)))
              .otherwise(tool_result_payload(F.array(case_line))))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    tools = F.col("has_tool_use")
    turns = F.array(
        turn("system", F.when(tools, F.col("system_tools")).otherwise(F.col("system_plain"))), turn("user", whole(form)),
        F.when(tools, turn("assistant", format_tool_call(whole(F.col("sql"))))), F.when(tools, turn("tool", result)),
        turn("assistant", whole(F.col("answer"))))
    return (told.select(F.col("pos").alias("example_id"), F.col("hard").alias("hard_eval"), F.posexplode(F.array_compact(turns)).alias("turn", "m"))
            .select("example_id", "hard_eval", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content"))


def prompt_batches(requests: DataFrame, instructions: DataFrame, system_text: str) -> DataFrame:
    """``messages`` = system (+ the profile's instruction), history, user text.

    ``requests``: ``(request_id, investor_profile, history ARRAY<STRUCT<role, content>>, user_text)``;
    ``instructions``: ``(investor_profile, instruction)``, one row for each known profile. An unknown
    profile adds no instruction.
    """
    told = requests.join(instructions.select("investor_profile", F.col("instruction").alias("_instr")), "investor_profile", "left")
    system = F.concat(F.lit(system_text), F.when(F.col("_instr").isNotNull(), F.concat(F.lit("\n\n"), "_instr")).otherwise(F.lit("")))
    msg_t = "struct<role:string,content:string>"
    first = F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))).cast(f"array<{msg_t}>")
    last = F.array(F.struct(F.lit("user").alias("role"), F.col("user_text").alias("content"))).cast(f"array<{msg_t}>")
    hist = F.coalesce(F.col("history").cast(f"array<{msg_t}>"), F.array().cast(f"array<{msg_t}>"))
    return told.withColumn("messages", F.concat(first, hist, last)).drop("_instr")


def build_dataset(ids: DataFrame, hard_ids: DataFrame, catalogues: Catalogues, out_root: str, id_col: str = "id") -> str:
    """G7 end to end: the plain set split 80/10/10 and the hard evaluation set, generated as one
    frame and written once per format: ``<out_root>/examples`` and ``<out_root>/training_text``,
    JSON lines in one folder per split (``train``, ``val``, ``test``, ``hard_eval``).

    The examples feed two outputs and the split, so metadata and messages are checkpointed once
    into the cluster's checkpoint folder (lineage cut, survives lost executors). Returns ``out_root``.
    """
    from ledgerline.operators import quality as Q
    from ledgerline.operators.splits import stratified_split
    from ledgerline.session import cut_lineage
    from ledgerline.sources import jsonl as J

    both = ids.select(id_col, F.lit(False).alias("hard")).unionByName(hard_ids.select(id_col, F.lit(True).alias("hard")))
    meta, msgs = generate_examples(both, catalogues, id_col)
    meta, msgs = cut_lineage(meta), cut_lineage(msgs)
    plain = meta.where("not hard_eval")
    split = stratified_split(Q.normalise_metadata(plain)).select("example_id", "split")
    split = (split.select("example_id", F.lit(False).alias("hard_eval"), "split")
             .unionByName(meta.where("hard_eval").select("example_id", "hard_eval", F.lit("hard_eval").alias("split"))))
    keys = ["example_id", "hard_eval"]
    labelled = meta.join(split, keys)
    J.write_examples(Q.examples_nested(labelled, msgs, keys), f"{out_root}/examples")
    J.write_training_text(labelled.join(Q.render_chat_text(msgs, keys), keys), f"{out_root}/training_text")
    return out_root
