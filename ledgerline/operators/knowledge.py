"""Knowledge-base queries as set-based DataFrame jobs.

The reference answers one request per database call; here every operator takes
whole tables (and, for the batch forms, a table of requests) so one Spark job
answers all requests. Enum columns sort by declaration order (``enum_rank``),
every top-k breaks ties on ``id`` so results are deterministic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.enums import (
    CRITERION_WEIGHTS, CRITICALITIES, INVESTOR_PROFILES, OUTCOMES, STAGES, enum_rank,
)
from ledgerline.operators.ranking import _null_safe_join, positions_within
from ledgerline.session import keep

# Columns of the risk listing.
RISK_COLUMNS = ("id", "pattern_name", "sector", "stage", "criticality", "category",
                "simple_explain", "warning_signals", "mitigation_simple",
                "impact_on_runway", "time_to_impact")


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def _and_all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def wildcard_match(col: str, value) -> Column:
    """``col = value OR col IS NULL``: a NULL segment column applies to everything."""
    return (F.col(col) == F.lit(value)) | F.col(col).isNull()


def risk_order(df: DataFrame) -> list[Column]:
    """Criticality rank, sector-specific before universal, then id."""
    return [enum_rank("criticality", CRITICALITIES).asc_nulls_last(),
            F.col("sector").isNull().cast("int").asc(), F.col("id").asc()]


# --- P1 --------------------------------------------------------------------
def risk_patterns_filter(risks: DataFrame, sector=None, stage=None, criticality=None,
                         category=None, limit: int = 10) -> DataFrame:
    """Top ``limit`` risks for optional filters; NULL sector/stage act as wildcards."""
    conds = []
    if sector:
        conds.append(wildcard_match("sector", sector))
    if stage:
        conds.append(wildcard_match("stage", stage))
    if criticality:
        conds.append(F.col("criticality") == criticality)
    if category:
        conds.append(F.col("category") == category)
    picked = risks.where(_and_all(conds)).select(*_present(risks, RISK_COLUMNS))
    return picked.orderBy(*risk_order(picked)).limit(limit)


def risk_cards(top: DataFrame) -> DataFrame:
    """Public shape of P1: display fields with "" for missing text, plus the count."""
    out = [F.coalesce(F.col("pattern_name"), F.lit("")).alias("name"),
           F.coalesce(F.col("criticality"), F.lit("")).alias("criticality")]
    for src, dst in (("simple_explain", "explanation"), ("warning_signals", "warning_signs"),
                     ("mitigation_simple", "mitigation")):
        out.append(F.coalesce(F.col(src), F.lit("")).alias(dst) if src in top.columns
                   else F.lit("").alias(dst))
    out.append(F.col("time_to_impact") if "time_to_impact" in top.columns
               else F.lit(None).cast("string").alias("time_to_impact"))
    return top.select(F.col("id"), *out, F.count(F.lit(1)).over(Window.partitionBy()).alias("count"))


# --- P2 --------------------------------------------------------------------
def risk_pattern_search(risks: DataFrame, text: str, name_col: str = "pattern_name",
                        first_only: bool = True) -> DataFrame:
    """Rows whose name contains ``text`` (case-insensitive, LIKE wildcards kept).

    ``first_only`` gives the one-shot lookup (lowest id); otherwise every match.
    """
    hits = risks.where(F.col(name_col).ilike(f"%{text}%"))
    return hits.orderBy("id").limit(1) if first_only else hits


# --- P3 --------------------------------------------------------------------
def critical_risks(risks: DataFrame) -> DataFrame:
    """View: critical and high risks with their rank (sorting happens at the output)."""
    return (risks.where(F.col("criticality").isin("critical", "high"))
            .select(*_present(risks, RISK_COLUMNS))
            .withColumn("criticality_rank", enum_rank("criticality", CRITICALITIES)))


# --- P4 --------------------------------------------------------------------
# Columns of the benchmark listing.
BENCHMARK_COLUMNS = ("sector", "stage", "metric_name", "value_median", "value_good",
                     "value_excellent", "value_warning", "unit", "context",
                     "interpretation_good", "interpretation_bad")


def benchmarks_with_context(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.select(*_present(benchmarks, BENCHMARK_COLUMNS))


def benchmarks_for_requests(requests: DataFrame, benchmarks: DataFrame,
                            metric_name: str | None = None) -> DataFrame:
    """Per (sector, stage) request: its benchmark rows, their count and a found flag.

    Requests without a benchmark keep one row with NULL metric and ``found = false``.
    """
    ctx = benchmarks_with_context(benchmarks)
    if metric_name:
        ctx = ctx.where(F.col("metric_name") == metric_name)
    joined = requests.select("sector", "stage").join(ctx, ["sector", "stage"], "left")
    w = Window.partitionBy("sector", "stage")
    n = F.count("metric_name").over(w)
    return joined.withColumn("count", n).withColumn("found", n > 0)


# --- P5 / J6 ---------------------------------------------------------------
def concept_lookup(concepts: DataFrame, term: str) -> DataFrame:
    """First concept (lowest id) whose name contains ``term`` or whose aliases hold it exactly."""
    hit = F.col("concept_name").ilike(f"%{term}%") | F.coalesce(
        F.array_contains("aliases", F.lit(term)), F.lit(False))
    return concepts.where(hit).orderBy("id").limit(1)


MAX_GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """Every substring of length ``n`` of ``text`` (none when shorter)."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, n))


def gram_places(names: DataFrame, grams: DataFrame) -> DataFrame:
    """``names`` (id, ``_lname``), a row for every place of a gram of the sizes found in ``grams``.

    Names are dealt anew: a file of few blocks holds many names, and each makes many rows."""
    sizes = grams.agg(F.array_sort(F.collect_set(F.length("gram"))).alias("_s")).scalar()
    sized = names.repartition("id", "_lname").withColumn("_size", F.explode(sizes)).where(F.length("_lname") >= F.col("_size"))
    return (sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_lname") - F.col("_size") + 1)))
            .withColumn("gram", F.substring("_lname", F.col("_at"), F.col("_size"))).drop("_at", "_size"))


def concept_mentions(requests: DataFrame, concepts: DataFrame, term_col: str = "term") -> DataFrame:
    """Batch P5: for each request term, the first matching concept (or none).

    Alias match: exact equi-join on exploded aliases. Name match: the lower-cased name is
    ``LIKE '%' || lower(term) || '%'`` (wildcards in the term keep their meaning; for a plain
    term this is ``contains``). A term is found by one gram of up to three characters of its
    longest literal piece, the one that it shares with the fewest other terms. One pass cuts the
    names into grams of the sizes that the terms have, and verifies each term on the names that
    hold its gram; no gram is stored, and a pair leaves the task only as a lowest id.

    A term of wildcards only matches every name of at least as many characters as it has ``_``;
    that case reads a per-length table.

    Only equi-joins, no nested loop. Terms and their grams are written to the checkpoint folder
    as Parquet, so planning knows their sizes.
    """
    terms = keep(requests.select(F.col(term_col).alias("term")).where(F.col("term").isNotNull()).distinct(), "terms")
    by_alias = (concepts.select("id", F.explode("aliases").alias("term"))
                .join(terms, "term").select("term", "id"))

    lt = F.lower("term")
    pieces = F.filter(F.split(lt, "[%_]+"), lambda x: x != "")
    longest = F.try_element_at(F.array_sort(pieces, lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    t = (terms.withColumn("_probe", F.coalesce(longest, F.lit("")))
         .withColumn("_wild", F.col("term").rlike("[%_]")))
    probes = t.where(F.col("_probe") != "").select("term", "_wild", F.explode(F.array_distinct(
        _grams(F.col("_probe"), F.least(F.length("_probe"), F.lit(MAX_GRAM))))).alias("gram"))
    shared = probes.groupBy("gram").agg(F.count(F.lit(1)).alias("_terms"))
    wanted = keep(probes.join(shared, "gram").groupBy("term", "_wild").agg(F.min(F.struct("_terms", "gram")).alias("_one"))
                  .select("term", "_wild", "_one.gram"), "wanted")
    names = concepts.select("id", F.lower("concept_name").alias("_lname"))
    verify = F.when(F.col("_wild"), F.expr("_lname LIKE concat('%', lower(term), '%')")) \
        .otherwise(F.col("_lname").contains(F.lower("term")))
    by_name = (gram_places(names.where(F.col("id").isNotNull() & F.col("_lname").isNotNull()), wanted)
               .join(wanted, "gram").where(verify).select("term", "id"))

    # Wildcard-only (or empty) terms: the first concept among names with length >= #'_'.
    by_len = names.groupBy(F.length("_lname").alias("_len")).agg(F.min("id").alias("_mid"))
    max_len = by_len.agg(F.max("_len").alias("_m")).scalar()
    suffix_min = (by_len.select(F.explode(F.sequence(F.lit(0), F.col("_len"))).alias("_k"), "_mid")
                  .groupBy("_k").agg(F.min("_mid").alias("id")))
    only_wild = (t.where(F.col("_probe") == "")
                 .withColumn("_k", F.length("term") - F.length(F.regexp_replace("term", "_", "")))
                 .where(F.col("_k") <= F.coalesce(max_len, F.lit(-1))))
    by_wild = only_wild.join(suffix_min, "_k").select("term", "id")

    hits = by_name.unionByName(by_wild).unionByName(by_alias)
    first = hits.groupBy("term").agg(F.min("id").alias("id"))
    return (terms.join(first, "term", "left")
            .join(concepts, "id", "left")
            .withColumn("found", F.col("id").isNotNull()))


# --- P6 --------------------------------------------------------------------
def concepts_by_category(concepts: DataFrame, category: str) -> DataFrame:
    cols = _present(concepts, ("concept_name", "category", "simple_def", "example", "related_risks"))
    return concepts.where(F.col("category") == category).select(*cols)


# --- P7 --------------------------------------------------------------------
def investment_criteria_filter(criteria: DataFrame, profile: str, stage: str,
                               weight: str | None = None) -> DataFrame:
    conds = [F.col("investor_profile") == profile, F.col("stage") == stage]
    if weight:
        conds.append(F.col("weight") == weight)
    return criteria.where(_and_all(conds)).withColumn("weight_rank", enum_rank("weight", CRITERION_WEIGHTS))


def criteria_for_requests(requests: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per (investor_profile, stage) request: a row for each criterion with its place
    (``criterion_rank`` from 1, by weight, unknown weights last, then id), their count and a
    found flag. A request without criteria keeps one row with NULLs and ``found = false``.

    Places come from block scans, so a profile that holds a third of the criteria is neither
    sorted in one task nor gathered into one row.
    """
    keys = ["investor_profile", "stage"]
    ranked = criteria.withColumn("weight_rank", enum_rank("weight", CRITERION_WEIGHTS)) \
        .withColumn("_unknown", F.col("weight_rank").isNull())
    placed = positions_within(ranked, keys, ["_unknown", "weight_rank", "id"], out="_pos")
    counts = criteria.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    out = (requests.select(*keys).distinct().join(counts, keys, "left")
           .join(placed.select(*keys, (F.col("_pos") + 1).alias("criterion_rank"), "id", "criterion_name", "weight"), keys, "left"))
    n = F.coalesce("count", F.lit(0).cast("bigint"))
    return out.withColumn("count", n).withColumn("found", n > 0)


# --- P9 --------------------------------------------------------------------
def concept_cards(requests: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per request (term, detail_level): found flag, definition by level, fallback sentence."""
    hits = concept_mentions(requests.select("term"), concepts)
    tech = F.col("technical_def") if "technical_def" in concepts.columns else F.lit(None).cast("string")
    # Fixed value: the sentence for a concept that isn't there.
    fallback = F.format_string(
        "Concept '%s' non trouvé dans la base. Essayez avec un terme différent (ex: 'MVP', 'churn', 'pivot').",
        F.col("term"))
    return (requests.select("term", "detail_level").join(hits, "term", "left")
            .select("term", "detail_level", "found",
                    F.coalesce(F.col("concept_name"), F.col("term")).alias("concept_name"),
                    F.when(F.col("found"), F.col("simple_def")).otherwise(fallback).alias("simple_def"),
                    F.when(F.col("found") & (F.col("detail_level") == "technical"), tech).alias("technical_def")))


# --- P12 -------------------------------------------------------------------
# Request domains of the public API.
API_PROFILES = ("angel", "vc", "impact", "strategic", "entrepreneur", "both")
API_STAGES = ("idea", "pre-seed", "seed", "series-a", "series-b", "growth")
DETAIL_LEVELS = ("simple", "technical")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``reasons`` (array of broken rules) and ``valid``; only present fields are checked."""
    rules: list[Column] = []
    cols = requests.columns
    if "description" in cols:
        n = F.length("description")
        rules.append(F.when(F.col("description").isNull() | (n < 50), F.lit("description_too_short")))
        rules.append(F.when(n > 5000, F.lit("description_too_long")))
    if "concept_name" in cols:
        n = F.length("concept_name")
        rules.append(F.when(F.col("concept_name").isNull() | (n < 2), F.lit("concept_too_short")))
        rules.append(F.when(n > 100, F.lit("concept_too_long")))
    if "investor_profile" in cols:
        rules.append(F.when(~F.coalesce(F.col("investor_profile").isin(*API_PROFILES), F.lit(False)),
                            F.lit("bad_profile")))
    if "stage" in cols:
        rules.append(F.when(~F.coalesce(F.col("stage").isin(*API_STAGES), F.lit(False)), F.lit("bad_stage")))
    if "detail_level" in cols:
        rules.append(F.when(~F.coalesce(F.col("detail_level").rlike("^(simple|technical)$"), F.lit(False)),
                            F.lit("bad_detail_level")))
    if "limit" in cols:
        rules.append(F.when(~F.coalesce(F.col("limit").between(1, 50), F.lit(False)), F.lit("bad_limit")))
    reasons = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return requests.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


# --- J1 / J2 / J3 ----------------------------------------------------------
def startups_with_pivot_count(startups: DataFrame, pivots: DataFrame, prefilter: bool = False) -> DataFrame:
    """Every startup with its number of pivots (zero kept).

    Pivots are counted per startup first (partial + final aggregation), so the join
    sees one row per startup instead of every pivot. With ``prefilter`` (a filtered
    startup set), pivots are first cut to those startups by a semi-join.
    """
    p = pivots.where(F.col("startup_id").isNotNull())
    if prefilter:
        p = p.join(startups.select(F.col("id").alias("startup_id")).distinct(), "startup_id", "left_semi")
    counts = p.groupBy(F.col("startup_id").alias("id")).agg(F.count("id").alias("pivot_count"))
    return (startups.join(counts, "id", "left")
            .withColumn("pivot_count", F.coalesce("pivot_count", F.lit(0)).cast("bigint")))


def similar_startups(startups: DataFrame, pivots: DataFrame, sector: str, stage=None,
                     outcome=None, limit: int = 5) -> DataFrame:
    """Most-pivoted startups of a sector; newest founding year first, NULL years first."""
    conds = [F.col("sector") == sector]
    if stage:
        conds.append(F.col("stage") == stage)
    if outcome:
        conds.append(F.col("outcome") == outcome)
    base = startups_with_pivot_count(startups.where(_and_all(conds)), pivots, prefilter=True)
    return base.orderBy(F.col("pivot_count").desc(), F.col("founding_year").desc_nulls_first(),
                        F.col("id").asc()).limit(limit)


def pivot_case_search(pivots: DataFrame, startups: DataFrame, pivot_type=None, outcome=None,
                      sector=None, limit: int = 5) -> DataFrame:
    """Pivots with their startup's sector/region, by outcome in reverse declaration order."""
    conds = []
    if pivot_type:
        conds.append(F.col("pivot_type") == pivot_type)
    if outcome:
        conds.append(F.col("p.outcome") == outcome)
    if sector:
        conds.append(F.col("s.sector") == sector)
    joined = (pivots.alias("p")
              .join(startups.select("id", "sector", "region").alias("s"),
                    F.col("p.startup_id") == F.col("s.id"))
              .where(_and_all(conds)))
    cols = [F.col(f"p.{c}") for c in pivots.columns if c != "created_at"] + [F.col("s.sector"), F.col("s.region")]
    return (joined.select(*cols)
            .orderBy(enum_rank("outcome", OUTCOMES).desc(), F.col("id").asc()).limit(limit))


# --- J4 / W6 ---------------------------------------------------------------
def segment_classes(segments: DataFrame) -> DataFrame:
    """For each (sector, stage) the risk classes that apply to it: ``(c_sector, c_stage)`` with
    the segment's own values or NULL (a wildcard), four at most."""
    nothing = F.lit(None).cast("string")
    pairs = [(F.col("sector"), F.col("stage")), (F.col("sector"), nothing), (nothing, F.col("stage")), (nothing, nothing)]
    classes = F.array_distinct(F.array(*[F.struct(a.alias("c_sector"), b.alias("c_stage")) for a, b in pairs]))
    return (segments.select("sector", "stage").distinct()
            .select("sector", "stage", F.explode(classes).alias("c")).select("sector", "stage", "c.c_sector", "c.c_stage"))


def _of_class(risks: DataFrame) -> DataFrame:
    return risks.withColumnRenamed("sector", "c_sector").withColumnRenamed("stage", "c_stage")


def segment_risk_join(startups: DataFrame, risks: DataFrame) -> DataFrame:
    """Batch P1 without a limit, answered per segment: every (sector, stage) that has
    startups, with every risk that applies to it and the number of startups there.

    The theta join ``(r.sector = s.sector OR r.sector IS NULL) AND (...)`` is one equi-join on
    the risk's class, where a segment belongs to at most four classes. The request is the
    segment; startups x risks is never spelled out (see ``startup_risk_exposure`` and
    ``top_risks_per_startup``).
    """
    counts = startups.groupBy("sector", "stage").agg(F.count(F.lit(1)).alias("n_startups"))
    per_seg = _null_safe_join(segment_classes(counts), _of_class(risks), ["c_sector", "c_stage"])
    return _null_safe_join(per_seg, counts, ["sector", "stage"]).select(
        "sector", "stage", F.col("id").alias("risk_id"), "criticality", "category",
        F.col("c_sector").isNull().alias("universal_sector"), "n_startups")


def startup_risk_exposure(startups: DataFrame, risks: DataFrame) -> DataFrame:
    """Per startup: how many risks apply, and how many per criticality.

    Risks are counted per class, a segment sums at most four of those counts, and startups
    meet one row per segment.
    """
    figures = ["n_risks"] + [f"n_{c}" for c in CRITICALITIES]
    per_class = _of_class(risks).groupBy("c_sector", "c_stage").agg(
        F.count(F.lit(1)).alias("n_risks"), *[F.count_if(F.col("criticality") == c).alias(f"n_{c}") for c in CRITICALITIES])
    per_seg = (_null_safe_join(segment_classes(startups), per_class, ["c_sector", "c_stage"])
               .groupBy("sector", "stage").agg(*[F.sum(f).alias(f) for f in figures]))
    return _null_safe_join(startups.select(F.col("id").alias("startup_id"), "sector", "stage"), per_seg,
                           ["sector", "stage"], "left").na.fill(0, figures)


def top_risks_per_segment(segments: DataFrame, risks: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` first risks of each segment: the ``k`` first of each class (a partial top-k
    before the shuffle), then a merge of at most 4 * k rows per segment."""
    order = [enum_rank("criticality", CRITICALITIES).asc_nulls_last(), F.col("c_sector").isNull().cast("int"), F.col("id")]
    in_class = Window.partitionBy("c_sector", "c_stage").orderBy(*order)
    tops = (_of_class(risks).select("c_sector", "c_stage", "id", "criticality")
            .withColumn("_r", F.row_number().over(in_class)).where(F.col("_r") <= k).drop("_r"))
    merged = Window.partitionBy("sector", "stage").orderBy(*order)
    return (_null_safe_join(segment_classes(segments), tops, ["c_sector", "c_stage"])
            .withColumn("risk_rank", F.row_number().over(merged)).where(F.col("risk_rank") <= k)
            .select("sector", "stage", F.col("id").alias("risk_id"), "criticality", "risk_rank"))


def top_risks_per_startup(startups: DataFrame, risks: DataFrame, k: int = 5,
                          criticality: str | None = None) -> DataFrame:
    """P1's top-k for every startup, computed once per segment and joined back (k rows a segment)."""
    r = risks.where(F.col("criticality") == criticality) if criticality else risks
    return _null_safe_join(startups.select(F.col("id").alias("startup_id"), "sector", "stage"),
                           top_risks_per_segment(startups, r, k), ["sector", "stage"])


# --- J5 / F16 --------------------------------------------------------------
def metric_level(value: Column, excellent: Column, good: Column, median: Column, warning: Column) -> Column:
    """excellent / good / median / warning; orientation from excellent vs warning.

    Higher is better iff ``coalesce(excellent, 0) > coalesce(warning, 0)``; the warning
    threshold itself is never compared; NULL thresholds are skipped; ties count.
    """
    hib = F.coalesce(excellent, F.lit(0.0)) > F.coalesce(warning, F.lit(0.0))

    def cascade(better):
        return (F.when(excellent.isNotNull() & better(value, excellent), "excellent")
                .when(good.isNotNull() & better(value, good), "good")
                .when(median.isNotNull() & better(value, median), "median")
                .otherwise("warning"))

    return F.when(hib, cascade(lambda v, t: v >= t)).otherwise(cascade(lambda v, t: v <= t))


def evaluate_metrics(observations: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Each observation against its (sector, stage, metric) benchmark; ``unknown`` when none.

    The benchmark table has one row per key; a hot segment of observations is left to the
    adaptive skew handling, which may also turn a small side into a broadcast.
    """
    keys = ["sector", "stage", "metric_name"]
    bench = benchmarks.select(*keys, "value_median", "value_good", "value_excellent", "value_warning",
                              F.lit(True).alias("_has_bench"))
    level = F.when(F.col("_has_bench").isNull(), "unknown").otherwise(
        metric_level(F.col("value"), F.col("value_excellent"), F.col("value_good"),
                     F.col("value_median"), F.col("value_warning")))
    return observations.join(bench, keys, "left").withColumn("level", level).drop("_has_bench")


def interpretation_text(level: Column, metric: Column, value: Column, sector: Column, stage: Column) -> Column:
    """One readable sentence per level."""
    v = value.cast("string")
    # The five sentences of the evaluation response.
    return (F.when(level == "excellent", F.format_string(
                "Votre %s de %s est excellent — dans le top quartile du secteur %s en %s.", metric, v, sector, stage))
            .when(level == "good", F.format_string(
                "Votre %s de %s est bon — au-dessus de la médiane sectorielle.", metric, v))
            .when(level == "median", F.format_string(
                "Votre %s de %s est dans la médiane du secteur %s en %s. Correct, mais améliorable.",
                metric, v, sector, stage))
            .when(level == "warning", F.format_string(
                "Votre %s de %s est en zone d'alerte — en dessous des standards du secteur %s en %s.",
                metric, v, sector, stage))
            .when(level == "unknown", F.format_string(
                "Aucun benchmark disponible pour %s en %s/%s.", metric, sector, stage))
            .otherwise(F.lit("")))


# --- J7 --------------------------------------------------------------------
def diagnosis_context(segments: DataFrame, risks: DataFrame, benchmarks: DataFrame,
                      criteria: DataFrame, startups: DataFrame, pivots: DataFrame,
                      investor_profile: str = "angel") -> DataFrame:
    """Per requested (sector, stage), in long form ``(kind, rank, item_id, item)``: the 5 first
    critical risks, all benchmarks, the critical criteria of the profile and the 3 most similar
    startups; ``kind = 'segment'`` is one row for the request itself. Lists of any length come as
    rows, never as one array.
    """
    seg = segments.select("sector", "stage").distinct()
    shape = lambda df, kind, rank, item_id, item: df.select(
        "sector", "stage", F.lit(kind).alias("kind"), rank.cast("bigint").alias("rank"), item_id.cast("bigint").alias("item_id"),
        item.cast("string").alias("item"))
    null = F.lit(None)
    risk = shape(top_risks_per_segment(seg, risks.where(F.col("criticality") == "critical"), k=5), "risk", F.col("risk_rank"),
                 F.col("risk_id"), null)
    named = positions_within(_null_safe_join(benchmarks_with_context(benchmarks), seg, ["sector", "stage"]).select("sector", "stage", "metric_name"),
                             ["sector", "stage"], ["metric_name"], out="_pos")
    bench = shape(named, "benchmark", F.col("_pos") + 1, null, F.col("metric_name"))
    wanted = criteria.where((F.col("investor_profile") == investor_profile) & (F.col("weight") == "critical")).select("stage", "id")
    crit = shape(seg.join(positions_within(wanted, ["stage"], ["id"], out="_pos"), "stage"), "criterion", F.col("_pos") + 1, F.col("id"), null)
    counted = startups_with_pivot_count(startups.join(seg, ["sector", "stage"], "left_semi"), pivots, prefilter=True)
    w = Window.partitionBy("sector", "stage").orderBy(
        F.col("pivot_count").desc(), F.col("founding_year").desc_nulls_first(), F.col("id"))
    similar = shape(counted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3), "startup", F.col("_r"), F.col("id"), F.col("name"))
    return (shape(seg, "segment", F.lit(0), null, null).unionByName(risk).unionByName(bench)
            .unionByName(crit).unionByName(similar))


# --- W9 --------------------------------------------------------------------
def priority_sort(df: DataFrame) -> DataFrame:
    """Adds declaration-order rank columns for every enum column present and sorts by them."""
    ranks = []
    for col, dom in (("weight", CRITERION_WEIGHTS), ("criticality", CRITICALITIES),
                     ("stage", STAGES), ("investor_profile", INVESTOR_PROFILES), ("outcome", OUTCOMES)):
        if col in df.columns:
            df = df.withColumn(f"{col}_rank", enum_rank(col, dom))
            ranks.append(F.col(f"{col}_rank").asc_nulls_last())
    return df.orderBy(*ranks, F.col("id"))
