"""Chat-dataset quality: distributions, structure checks, duplicates, warnings, gates.

Working form: ``meta`` (one row per example) and the long message table
``messages(example_id, turn, role, content)``. All per-example facts come from a
single ``groupBy(example_id)`` whose aggregates (count, sum, min_by/max_by,
bool_or) combine map-side; message arrays are only built at the edges.

Metadata may be flat columns (``category``, ``label``/``Label``, ...) or the raw JSON
object text in ``metadata_json``; ``normalise_metadata`` gives both one shape that
keeps "field missing" (-> ``unknown``) apart from "field is null".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.sizing import attach_one_row
from ledgerline.functions.enums import (
    IMPLICIT_DIFFICULTIES, REQUIRED_METADATA, VALID_DIFFICULTIES, VALID_LABELS, VALID_ROLES,
    VALID_SEVERITIES,
)

# Fields of the metadata.
DIMENSIONS = ("category", "Label", "Severity", "Difficulty", "sector", "investor_profile", "lean_principle")
META_FIELDS = ("category", "Label", "Severity", "Difficulty", "sector", "stage", "region",
               "investor_profile", "has_tool_use", "lean_principle", "hard_eval")


def _flat_name(df: DataFrame, field: str) -> str | None:
    for cand in (field, field.lower()):
        if cand in df.columns:
            return cand
    return None


def normalise_metadata(meta: DataFrame) -> DataFrame:
    """Adds ``m_<field>`` (value) and ``p_<field>`` (present) for every metadata field."""
    out = meta
    raw = "metadata_json" in meta.columns
    keys = F.json_object_keys("metadata_json") if raw else None
    for field in META_FIELDS:
        if raw:
            present = F.coalesce(F.array_contains(keys, F.lit(field)), F.lit(False))
            value = F.get_json_object("metadata_json", f"$.{field}")
        else:
            name = _flat_name(meta, field)
            present = F.lit(name is not None)
            value = F.col(name).cast("string") if name else F.lit(None).cast("string")
        out = out.withColumn(f"p_{field}", present).withColumn(f"m_{field}", value)
    truthy = F.lower(F.coalesce(F.col("m_has_tool_use"), F.lit("false"))).isin("true", "1")
    return out.withColumn("tool_flag", truthy)


def message_facts(messages: DataFrame) -> DataFrame:
    """One row per example with every per-example fact the checks need."""
    role, turn = F.col("role"), F.col("turn")
    content = F.coalesce(F.col("content"), F.lit(""))
    valid_role = F.coalesce(role.isin(*VALID_ROLES), F.lit(False))
    user_parts = F.collect_list(F.when(role == "user", F.struct(turn.alias("t"), content.alias("c"))))
    bad_roles = F.collect_list(F.when(~valid_role, F.struct(turn.alias("t"), F.coalesce(role, F.lit("NULL")).alias("r"))))
    return messages.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.length(content)).alias("n_chars"),
        F.min_by(role, turn).alias("first_role"),
        F.max_by(role, turn).alias("last_role"),
        F.coalesce(F.bool_or(role == "user"), F.lit(False)).alias("has_user"),
        F.coalesce(F.bool_or(role == "tool"), F.lit(False)).alias("has_tool_message"),
        F.max_by(content, F.when(role == "assistant", turn)).alias("last_assistant"),
        F.array_join(F.transform(F.array_sort(user_parts), lambda x: x["c"]), " ").alias("user_text"),
        F.transform(F.array_sort(bad_roles), lambda x: x["r"]).alias("invalid_roles"),
        F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct(turn.alias("t"), role.alias("r"), F.col("content").alias("c"))))))
        .alias("messages_hash"),
    )


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order, at every depth, and no blanks: equal for two
    texts that hold the same values. Text that isn't JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def metadata_text(meta: DataFrame) -> Column:
    """All metadata of an example in one canonical text: the raw JSON, or every flat column by name
    (listed or not, its id too, NULLs written)."""
    if "metadata_json" in meta.columns:
        return canonical_json(F.col("metadata_json"))
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(meta.columns)]), {"ignoreNullFields": "false"})


def line_hash(examples: DataFrame) -> Column:
    """A3: digest of a whole example line in nested form ``(messages, metadata_json)``."""
    said = F.to_json(F.transform("messages", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))), {"ignoreNullFields": "false"})
    return F.sha1(F.concat_ws("|", F.coalesce(said, F.lit("")), F.coalesce(metadata_text(examples), F.lit(""))))


def normalise_prompt(text: Column) -> Column:
    """Lower-case, every run of (Unicode) blanks to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def example_facts(meta: DataFrame, messages: DataFrame) -> DataFrame:
    """``normalise_metadata(meta)`` joined with ``message_facts``; examples without messages kept."""
    facts = message_facts(messages)
    j = normalise_metadata(meta.withColumn("_meta_text", metadata_text(meta))).join(facts, "example_id", "left")
    return (j.withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
            .withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
            .withColumn("has_user", F.coalesce("has_user", F.lit(False)))
            .withColumn("has_tool_message", F.coalesce("has_tool_message", F.lit(False)))
            .withColumn("user_text", F.coalesce("user_text", F.lit("")))
            .withColumn("invalid_roles", F.coalesce("invalid_roles", F.array().cast("array<string>")))
            .withColumn("prompt_hash", F.sha1(normalise_prompt(F.col("user_text"))))
            .withColumn("example_hash", F.sha1(F.concat_ws("|", F.coalesce("messages_hash", F.lit("")), "_meta_text")))
            .drop("_meta_text"))


# --- A1 --------------------------------------------------------------------
def value_distributions(facts: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """Count and share of every value per dimension in one scan (exploded pairs)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"),
                               F.when(F.col(f"p_{d}"), F.col(f"m_{d}")).otherwise(F.lit("unknown")).alias("value"))
                      for d in dimensions])
    exploded = facts.select(F.explode(pairs).alias("p")).select("p.dimension", "p.value")
    counts = exploded.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))
    total = facts.agg(F.count(F.lit(1)).alias("_total"))
    return (attach_one_row(counts, total)
            .withColumn("ratio", F.col("count") / F.col("_total")).drop("_total"))


# --- A2 --------------------------------------------------------------------
def dataset_overview(facts: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return facts.agg(
        n.alias("total"),
        F.count_if(F.col("tool_flag")).alias("tool_use_count"),
        (F.count_if(F.col("tool_flag")) / n).alias("tool_use_ratio"),
        (F.count_if(F.col("m_Difficulty").isin(*IMPLICIT_DIFFICULTIES)) / n).alias("implicit_ratio"),
        F.round(F.sum("n_messages") / n, 1).alias("avg_messages_per_example"),
        F.round(F.sum("n_chars") / n, 0).cast("bigint").alias("avg_chars_per_example"),
        F.min("n_chars").cast("bigint").alias("min_chars"),
        F.max("n_chars").cast("bigint").alias("max_chars"),
    )


# --- A3 / A4 ---------------------------------------------------------------
def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Sum of ``n - 1`` over key groups holding ``n > 1`` rows (only digests shuffle)."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("bigint")
                      .alias("duplicates"))


# --- A5 .. A8: error entries --------------------------------------------------
def _entry(error: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(error).alias("error"),
                    (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def role_entries() -> Column:
    """Bad first/last role (or no message), no user message, invalid roles."""
    seq = (F.col("n_messages") == 0) | ~F.coalesce(F.col("first_role") == "system", F.lit(False)) \
        | ~F.coalesce(F.col("last_role") == "assistant", F.lit(False))
    return F.array(F.when(seq, _entry("sequence")), F.when(~F.col("has_user"), _entry("no_user")),
                   F.when(F.size("invalid_roles") > 0, _entry("invalid_roles", F.array_join("invalid_roles", ","))))


def metadata_entries() -> Column:
    """Each required field missing; Label / Severity / Difficulty outside their domain."""
    items = [F.when(~F.col(f"p_{f}"), _entry(f"missing:{f}")) for f in REQUIRED_METADATA]
    for f, dom in (("Label", VALID_LABELS), ("Severity", VALID_SEVERITIES), ("Difficulty", VALID_DIFFICULTIES)):
        ok = F.col(f"p_{f}") & F.coalesce(F.col(f"m_{f}").isin(*dom), F.lit(False))
        items.append(F.when(~ok, _entry(f"invalid:{f}", F.col(f"m_{f}"))))
    return F.array(*items)


def label_entries() -> Column:
    """The last assistant message lacks ``Label: <label>`` while a label is set."""
    label = F.col("m_Label")
    needed = F.concat(F.lit("Label: "), label)
    bad = label.isNotNull() & (label != "") & (F.instr(F.coalesce("last_assistant", F.lit("")), needed) == 0)
    return F.array(F.when(bad, _entry("label_mismatch", label)))


def tool_entries() -> Column:
    """Tool flag without a tool message, or a tool message without the flag."""
    return F.array(F.when(F.col("tool_flag") & ~F.col("has_tool_message"), _entry("flag_without_tool")),
                   F.when(~F.col("tool_flag") & F.col("has_tool_message"), _entry("tool_without_flag")))


ENTRY_KINDS = (("roles", role_entries), ("metadata", metadata_entries), ("label", label_entries),
               ("tool", tool_entries))


def _kept(entries: Column) -> Column:
    return F.filter(entries, lambda e: e.isNotNull())


def _explode_entries(facts: DataFrame, entries: Column) -> DataFrame:
    return facts.select("example_id", F.explode(_kept(entries)).alias("e")).select("example_id", "e.error", "e.detail")


def role_errors(facts: DataFrame) -> DataFrame:
    return _explode_entries(facts, role_entries())


def metadata_errors(facts: DataFrame) -> DataFrame:
    return _explode_entries(facts, metadata_entries())


def label_mismatches(facts: DataFrame) -> DataFrame:
    return _explode_entries(facts, label_entries())


def tool_flag_errors(facts: DataFrame) -> DataFrame:
    return _explode_entries(facts, tool_entries())


def all_error_entries(facts: DataFrame) -> DataFrame:
    """Every entry of the four checks in one pass: ``(example_id, error, detail, kind)``."""
    def tag(kind):
        return lambda e: F.struct(e["error"].alias("error"), e["detail"].alias("detail"), F.lit(kind).alias("kind"))

    tagged = F.flatten(F.array(*[F.transform(_kept(fn()), tag(kind)) for kind, fn in ENTRY_KINDS]))
    return facts.select("example_id", F.explode(tagged).alias("e")).select(
        "example_id", "e.error", "e.detail", "e.kind")


# --- A9 / A10 ----------------------------------------------------------------
def quality_metrics(facts: DataFrame) -> DataFrame:
    """One row: every number the warning rules read, from one grouping pass over the facts.

    Each example gives two digests, of itself and of its prompt; both kinds are grouped together
    (so only digests and counts are shuffled), the example's own figures travel with its first
    digest, and a last aggregation sums groups and figures.
    """
    figures = {"tool_use_count": F.col("tool_flag").cast("int"),
               "implicit": F.coalesce(F.col("m_Difficulty").isin(*IMPLICIT_DIFFICULTIES), F.lit(False)).cast("int"),
               **{f"{kind}_errors": F.size(_kept(fn())) for kind, fn in ENTRY_KINDS}}
    per = facts.select("example_hash", "prompt_hash", *[c.alias(n) for n, c in figures.items()])
    digests = F.array(F.struct(F.lit(True).alias("full"), F.col("example_hash").alias("h")),
                      F.struct(F.lit(False).alias("full"), F.col("prompt_hash").alias("h")))
    groups = (per.select(F.explode(digests).alias("d"), *figures).groupBy("d.full", "d.h")
              .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("d.full"), F.col(f))).alias(f) for f in figures]))
    n = F.coalesce(F.sum(F.when(F.col("full"), F.col("n"))), F.lit(0))
    again = lambda full: F.coalesce(F.sum(F.when(F.col("full") == full, F.col("n") - 1)), F.lit(0)).cast("bigint")
    total = lambda f: F.coalesce(F.sum(f), F.lit(0)).cast("bigint")
    share = lambda f: F.when(n > 0, total(f) / n)
    return groups.agg(n.alias("total"), total("tool_use_count").alias("tool_use_count"), share("tool_use_count").alias("tool_use_ratio"),
                      share("implicit").alias("implicit_ratio"), *[total(f"{kind}_errors").alias(f"{kind}_errors") for kind, _ in ENTRY_KINDS],
                      again(True).alias("duplicate_full"), again(False).alias("duplicate_user"))


# Warning thresholds of the dataset report.
MIN_EXAMPLES = 5000
TOOL_RATIO_RANGE = (0.25, 0.45)
MIN_IMPLICIT_RATIO = 0.55
MAX_DUPLICATE_PROMPT_SHARE = 0.03


def failed_rules() -> Column:
    """The failed rules of a metrics row: array of ``(rule, observed)``."""
    lo, hi = TOOL_RATIO_RANGE
    rules = [
        ("volume", F.col("total").cast("double"), F.col("total") < MIN_EXAMPLES),
        ("tool_ratio", F.col("tool_use_ratio"), ~F.col("tool_use_ratio").between(lo, hi)),
        ("implicit_ratio", F.col("implicit_ratio"), F.col("implicit_ratio") < MIN_IMPLICIT_RATIO),
        ("duplicate_full", F.col("duplicate_full").cast("double"), F.col("duplicate_full") > 0),
        ("duplicate_user", F.col("duplicate_user").cast("double"),
         F.col("duplicate_user") / F.col("total") > MAX_DUPLICATE_PROMPT_SHARE),
        ("role_errors", F.col("roles_errors").cast("double"), F.col("roles_errors") > 0),
        ("metadata_errors", F.col("metadata_errors").cast("double"), F.col("metadata_errors") > 0),
        ("label_mismatches", F.col("label_errors").cast("double"), F.col("label_errors") > 0),
        ("tool_flag_errors", F.col("tool_errors").cast("double"), F.col("tool_errors") > 0),
    ]
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), v.alias("observed"))) for n, v, c in rules]))


def dataset_warnings(metrics: DataFrame) -> DataFrame:
    """Failed rules only: ``(rule, observed)``."""
    return metrics.select(F.explode(failed_rules()).alias("r")).select("r.*")


# Stop rules of the build gate.
GATE_MIN_EXAMPLES = 5000
GATE_TOOL_RATIO = (0.20, 0.85)
GATE_MAX_WARNINGS = 0


def build_stats(facts: DataFrame) -> DataFrame:
    """Per category count, with total, tool count and tool ratio (3 decimals) on every row."""
    totals = facts.agg(F.count(F.lit(1)).alias("total_examples"),
                       F.count_if("tool_flag").alias("tool_use_count"))
    totals = totals.withColumn("tool_use_ratio", F.round(F.col("tool_use_count") / F.col("total_examples"), 3))
    cats = facts.groupBy(F.when(F.col("p_category"), F.col("m_category")).otherwise("unknown").alias("category")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return attach_one_row(cats, totals)


def dataset_gate(metrics: DataFrame) -> DataFrame:
    """One verdict row from the one metrics row: valid, total, tool ratio (3 dp), warning count and
    failed rules."""
    lo, hi = GATE_TOOL_RATIO
    m = metrics.select("total", F.round("tool_use_ratio", 3).alias("tool_ratio"), F.size(failed_rules()).cast("bigint").alias("warning_count"))
    errors = F.array_compact(F.array(
        F.when(F.col("total") < GATE_MIN_EXAMPLES, F.lit("volume")),
        F.when(F.col("tool_ratio") < lo, F.lit("tool_ratio_low")),
        F.when(F.col("tool_ratio") > hi, F.lit("tool_ratio_high")),
        F.when(F.col("warning_count") > GATE_MAX_WARNINGS, F.lit("warnings"))))
    return m.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


# --- W3 / F4 ---------------------------------------------------------------
def last_message_by_role(messages: DataFrame, key: str = "example_id", text: str = "content") -> DataFrame:
    """Last user and last assistant text per conversation (prompt / expected pairs)."""
    role, turn = F.col("role"), F.col("turn")
    return messages.groupBy(key).agg(
        F.max_by(text, F.when(role == "user", turn)).alias("last_user"),
        F.max_by(text, F.when(role == "assistant", turn)).alias("last_assistant"))


def render_chat_text(messages: DataFrame, key: str | list[str] = "example_id", text: str = "content") -> DataFrame:
    """``<|im_start|>role\\ncontent<|im_end|>`` per message, joined by newlines in turn order."""
    part = F.concat(F.lit("<|im_start|>"), F.coalesce(F.col("role"), F.lit("")), F.lit("\n"),
                    F.coalesce(F.col(text), F.lit("")), F.lit("<|im_end|>"))
    return messages.groupBy(*([key] if isinstance(key, str) else key)).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("t"), part.alias("p")))),
                                 lambda x: x["p"]), "\n").alias("text"))


def examples_nested(meta: DataFrame, messages: DataFrame, key: str | list[str] = "example_id") -> DataFrame:
    """Edge form: ``messages ARRAY<STRUCT<role, content>>`` in turn order + metadata columns."""
    keys = [key] if isinstance(key, str) else key
    arr = messages.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("turn").alias("t"), F.col("role"), F.col("content")))),
        lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return meta.join(arr, keys, "left").withColumn(
        "messages", F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")))


# --- W7 / U3 ---------------------------------------------------------------
def first_n_per_kind(entries: DataFrame, kinds, n: int = 20, order=("example_id", "error")) -> DataFrame:
    """First ``n`` entries of each kind plus how many more there are.

    ``row_number() <= n`` per kind is planned as a partial top-n before the shuffle
    (``WindowGroupLimit``), so a kind holding most entries sends at most ``n`` rows per
    partition; the totals are a partial-aggregated count.
    """
    kept = entries.where(F.col("kind").isin(*kinds))
    w = Window.partitionBy("kind").orderBy(*order)
    shown = kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    totals = kept.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return (shown.join(F.broadcast(totals), "kind")          # one row per kind
            .withColumn("n_more", F.greatest(F.col("total") - F.lit(n), F.lit(0))))


def missing_values(present: DataFrame, col: str, expected) -> DataFrame:
    """Expected values that never occur in ``present[col]``."""
    spark = present.sparkSession
    exp = spark.createDataFrame([(v,) for v in expected], [col])
    return exp.join(present.select(col).distinct(), col, "left_anti")


def table_volumes(tables: dict[str, DataFrame]) -> DataFrame:
    """``UNION ALL`` of per-table row counts, with a non-empty flag."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in tables.items()]
    out = reduce(DataFrame.unionByName, counts)
    return out.withColumn("non_empty", F.col("n_rows") > 0)
