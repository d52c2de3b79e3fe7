"""Data-quality checks. Each returns the offending rows or a table of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_null, round_even
from .aggregates import n_distinct
from .relational import top_k
from .survey import PROJECT, REBUILT_PROJECTS

MEASURES = {
    "hours": "survey_effort_hours",
    "traps": "survey_effort_traps",
    "area": "survey_area",
    "response": "response_value",
}


class AuditError(ValueError):
    """A table failed a check; the message shows the findings."""


def inspect_projects(obs: DataFrame, key: str = PROJECT) -> DataFrame:
    """Size, extremes and distinct responses of every project, with flags, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), n_distinct("site_name").alias("n_sites")]
    for short, col in MEASURES.items():
        v = finite_or_null(F.col(col).cast("double"))
        aggs += [F.min(v).alias(f"{short}_min"), F.max(v).alias(f"{short}_max")]
    aggs.append(n_distinct("response_value").alias("response_unique"))
    return effort_flags(obs.groupBy(key).agg(*aggs))


def effort_flags(inspected: DataFrame) -> DataFrame:
    """Constant effort and near-binary responses."""
    flags = {
        f"{m}_constant": F.coalesce(F.col(f"{m}_min") == F.col(f"{m}_max"), F.lit(False))
        for m in ("hours", "traps", "area")
    }
    return inspected.withColumns({**flags, "near_binary": F.col("response_unique") <= 2})


def sample_rows(
    df: DataFrame, project: str, order: Sequence[str], columns: Sequence[str], n: int = 20
) -> DataFrame:
    """The first rows of one project, for reading."""
    rows = df.filter(F.col(PROJECT) == project)
    return top_k(rows, [F.col(c).asc_nulls_last() for c in order], n).select(*columns)


def bad_pa(table: DataFrame) -> DataFrame:
    """Presence rows that are neither 0 nor 1, counted by project and value."""
    r = F.col("model_response")
    return table.filter(r.isNull() | ~r.isin(0, 1)).groupBy(PROJECT, "model_response").count()


def bad_abundance(table: DataFrame) -> DataFrame:
    """Abundance rows that are missing, negative or not finite, counted by project."""
    r = F.col("model_response").cast("double")
    bad = r.isNull() | (r < 0) | finite_or_null(r).isNull()
    return table.filter(bad).groupBy(PROJECT).count()


def effort_positive(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose effort is not above zero, one count per column."""
    return table.agg(
        *[F.count_if(F.col(c).isNull() | (F.col(c) <= 0)).alias(f"{c}_bad") for c in cols]
    )


def rules_consistent(rules: DataFrame) -> DataFrame:
    """Abundance projects that are not in the presence data."""
    return rules.filter(F.col("include_abundance") & ~F.col("include_pa"))


def integer_check(table: DataFrame, projects: Sequence[str] = REBUILT_PROJECTS) -> DataFrame:
    """Largest distance from a whole number among rebuilt counts."""
    v = F.col("model_response").cast("double")
    return (
        table.filter(F.col(PROJECT).isin(*projects))
        .groupBy(PROJECT)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.abs(v - round_even(v))).alias("max_diff_from_integer"),
        )
    )


def funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each filter, applied in order, counted in one pass."""
    passed = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("all_rows")]
    for name, cond in stages.items():
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    return df.agg(*aggs)


def require_empty(findings: DataFrame, message: str, show: int = 20) -> None:
    """Raise with the first findings if there are any."""
    rows = findings.limit(show).collect()
    if rows:
        raise AuditError(f"{message}: {[r.asDict() for r in rows]}")


def require_zero(counts: DataFrame, message: str) -> None:
    """Raise if any count in the single row is above zero."""
    row = counts.first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise AuditError(f"{message}: {bad}")
