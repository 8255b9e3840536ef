"""Closed vocabularies and declaration-order ranks.

The knowledge tables store enums; ``ORDER BY`` on them follows declaration order,
not text order. ``enum_rank`` turns a string column into that order (1-based; NULL for
NULL and for a value outside the domain, which sorts last: use ``asc_nulls_last``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enum domains in declaration order.
STAGES = ("idea", "pre-seed", "seed", "series-a", "series-b", "growth", "mature")
OUTCOMES = ("success", "failure", "pivot", "acquired", "ongoing")
CRITICALITIES = ("critical", "high", "medium", "low")
INVESTOR_PROFILES = ("angel", "vc", "impact", "strategic", "crowdfunding")
CRITERION_WEIGHTS = ("critical", "important", "nice-to-have")
LEAN_CATEGORIES = ("framework", "metric", "strategy", "principle", "tool")

# Dataset vocabularies checked by the quality report.
VALID_ROLES = ("system", "user", "assistant", "tool")
VALID_LABELS = ("Green Flag", "Red Flag", "Mixed")
VALID_SEVERITIES = ("Mineur", "Majeur", "Fatal", "Non applicable")
VALID_DIFFICULTIES = ("Explicite", "Implicite", "Ambigu", "Mixte")
REQUIRED_METADATA = ("category", "Label", "Severity", "Difficulty", "has_tool_use", "lean_principle")
IMPLICIT_DIFFICULTIES = ("Implicite", "Ambigu", "Mixte")


def enum_rank(col: Column | str, domain: tuple[str, ...]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in domain]), c).cast("int"), F.lit(0))


def sql_enum_rank(expr: str, domain: tuple[str, ...]) -> str:
    """Same rank as SQL text (used by oracles): ``CASE expr WHEN .. THEN i .. END``."""
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(domain, 1))
    return f"(CASE {expr} {whens} END)"
