"""Categorical encoding and design tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import attach, complete_cases, ordered_levels

LUMP_MIN = 100
REFERENCE_TAXON = "Bird"


def lump_min(
    df: DataFrame, col: str, least: int = LUMP_MIN, other: str = "Other", name: str | None = None
) -> DataFrame:
    """Levels with fewer than ``least`` rows become ``other``.

    Counts are aggregated first and joined back, so a common level is never
    gathered in one task. A missing value stays missing.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    out = attach(df, counts, [col])
    lumped = F.when(F.col(col).isNotNull(), F.when(F.col("__n") < least, other).otherwise(F.col(col)))
    return out.withColumn(name or col, lumped).drop("__n")


def index_levels(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Text to a 1-based index, levels in sort order; missing stays missing."""
    levels = ordered_levels(df, col).withColumnRenamed("level_index", name or f"{col}_index")
    return df.join(levels, col, "left")


@dataclass(frozen=True)
class Formula:
    """What a fit is made of.

    ``terms`` are column names or products such as ``"a*b"``; a product stands for
    the interaction alone, its parts are listed too. ``levels`` gives the level
    order of the categorical columns, reference first. ``groups`` have a random
    intercept each; ``slopes`` adds a random slope on a numeric column per group.
    """

    response: str
    terms: Sequence[str]
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    groups: Sequence[str] = ()
    slopes: Mapping[str, str] = field(default_factory=dict)
    offset: str | None = None
    trials: str | None = None


def term_columns(formula: Formula) -> list[tuple[str, Column]]:
    """Design columns in order: intercept, contrasts, numbers, interactions."""

    def plain(name: str) -> list[tuple[str, Column]]:
        if name not in formula.levels:
            return [(name, F.col(name).cast("double"))]
        return [
            (f"{name}[{v}]", (F.col(name) == F.lit(v)).cast("double"))
            for v in list(formula.levels[name])[1:]
        ]

    out = [("Intercept", F.lit(1.0))]
    for term in formula.terms:
        parts = [plain(p.strip()) for p in term.split("*")]
        made = parts[0]
        for nxt in parts[1:]:
            made = [(f"{a}:{b}", x * y) for a, x in made for b, y in nxt]
        out += [c for c in made if c[0] not in {n for n, _ in out}]
    return out


def design_matrix(df: DataFrame, formula: Formula, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the model: ``y``, ``x`` (one number per term), ``offset``, ``trials``
    and the group keys. Rows with a missing part, or with a category outside its
    level list, are dropped: they belong to no level, not to the reference."""
    terms = term_columns(formula)
    x = F.array(*[c for _, c in terms])
    # Tested on the source columns, so the filter reaches the scan.
    parts = [p.strip() for t in formula.terms for p in t.split("*")]
    used = [formula.response, *parts, formula.offset, formula.trials, *formula.groups]
    known = [F.col(p).isin(list(formula.levels[p])) for p in dict.fromkeys(parts) if p in formula.levels]
    return complete_cases(df, list(dict.fromkeys(c for c in used if c)), *known).select(
        *keep,
        F.col(formula.response).cast("double").alias("y"),
        x.alias("x"),
        (F.col(formula.offset) if formula.offset else F.lit(0.0)).cast("double").alias("offset"),
        (F.col(formula.trials) if formula.trials else F.lit(1.0)).cast("double").alias("trials"),
        *[F.col(g).cast("string").alias(f"g_{g}") for g in formula.groups],
    )
