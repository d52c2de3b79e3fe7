"""Ordered categories: a text value plus an integer code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditional import as_col

# Level orders used by the model tables.
STUDY_DESIGN_LEVELS = ("Before", "After_Unburnt", "After_Burnt")
SEVERITY_LEVELS = (
    "Low (burnt understory, unburnt canopy)",
    "Moderate (partial canopy scorch)",
    "High (full canopy scorch)",
    "Extreme (full canopy consumption)",
)
FIRE_COUNT_LEVELS = ("0", "1", "2+")


def level_code(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in the level list; NULL for an unknown level."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.nullif(position, F.lit(0)).cast("int")


def relevel(levels: Sequence[str], reference: str) -> list[str]:
    """The same levels with ``reference`` first."""
    if reference not in levels:
        raise ValueError(f"{reference!r} is not a level")
    return [reference] + [v for v in levels if v != reference]
