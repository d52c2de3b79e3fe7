"""Projection, filtering, joins, ranking and unions.

Nothing here ranks raw rows inside a window: the best row of a group is an
aggregate (combined before the shuffle), and a group statistic is aggregated and
joined back, so a key that holds a third of all rows costs no single task more
than its share. Joins carry no broadcast hint unless the side is bounded by
construction; adaptive execution broadcasts a side after measuring it and splits
skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditional import as_col
from ..session import materialize


MAX_RULES = 10_000


def derive(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add columns in order; a later expression sees the earlier ones.

    Steps that do not refer to each other share one projection.
    """
    batch: dict[str, Column] = {}
    for name, expr in steps:
        if name in batch or any(_mentions(expr, made) for made in batch):
            df, batch = df.withColumns(batch), {}
        batch[name] = expr
    return df.withColumns(batch) if batch else df


def _mentions(expr: Column, name: str) -> bool:
    return name in str(expr)


def complete_cases(df: DataFrame, cols: Sequence[str], *predicates: Column) -> DataFrame:
    """Rows where every listed column is present and every predicate is true."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull()
    for p in predicates:
        keep = keep & p
    return df.filter(keep)


def time_window(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Rows whose date or instant lies in the closed interval.

    The bounds are cast to the column's own type, so the comparison reaches the scan.
    """
    kind = df.schema[col].dataType
    return df.filter(F.col(col).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def positive_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every listed number is finite and above zero."""
    keep = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        keep = keep & (v > 0) & (v < F.lit(float("inf"))) & ~F.isnan(v)
    return df.filter(keep)


def min_key(*order: Column) -> list[Column]:
    """Fields whose least struct is the first row of ``order``.

    Each entry is ``asc(c)`` or ``desc(c)``; missing values come last either way.
    """
    return [f for fields in order for f in fields]


def asc(c: Column | str) -> list[Column]:
    c = as_col(c)
    return [c.isNull(), c]


def desc(c: Column | str) -> list[Column]:
    """Numeric columns only: the order is reversed by sign."""
    c = as_col(c)
    return [c.isNull(), -c]


def desc_last(*cols: str) -> list[Column]:
    """Sort order: descending, missing values last."""
    return [F.col(c).desc_nulls_last() for c in cols]


def first_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Sequence[Column]], keep: Sequence[str]
) -> DataFrame:
    """The first row of each group in ``order`` (entries from ``asc`` / ``desc``).

    Computed as a minimum of (order fields, kept columns): partial results are
    combined before the shuffle and no group is ever gathered in one place.
    """
    fields = [f.alias(f"o{i}") for i, f in enumerate(min_key(*order))]
    payload = F.struct(*[F.col(c) for c in keep]).alias("row")
    best = F.min(F.struct(*fields, payload)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.row.*")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Sequence[Column]]) -> DataFrame:
    """One row per key, all columns kept."""
    rest = [c for c in df.columns if c not in keys]
    return first_per(df, keys, order, rest).select(*df.columns)


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def left_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join in which a missing key matches a missing key."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, cond, "left").drop(*[f"__{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of an aggregated table onto detail rows.

    An aggregate is estimated as large as its input, so an unhinted join would
    shuffle the detail rows by a key that may have three values. Stored first, it
    has its real size: a small one is broadcast by the planner, a large one is
    joined by key with skewed partitions split.
    """
    return left_on(df, materialize(stats, "stats"), keys)


def join_metrics(obs: DataFrame, metrics: DataFrame, key: str = "fired_key") -> DataFrame:
    """Attach the match of each location to its survey rows."""
    return obs.join(metrics, key, "left")


def join_rules(obs: DataFrame, rules: DataFrame, key: str = "unique_project_id") -> DataFrame:
    """Attach the project rules; projects without a rule keep NULLs.

    The rule table is counted first. Up to MAX_RULES rows it is broadcast, so the
    wide survey rows are not shuffled for it; a larger one is joined by key.
    """
    if rules.limit(MAX_RULES + 1).count() <= MAX_RULES:
        rules = F.broadcast(rules)
    return obs.join(rules, key, "left")


def missing_rules(
    obs: DataFrame, rules: DataFrame, *cols: str, key: str = "unique_project_id"
) -> DataFrame:
    """Projects that have survey rows but no rule.

    Reduced to distinct projects before the join, so the join is small.
    """
    return distinct_keys(obs, key, *cols).join(rules.select(key), key, "left_anti")


def event_area_join(points: DataFrame, areas: DataFrame, key: str = "id") -> DataFrame:
    return attach(points, areas, [key])


def join_class_stat(df: DataFrame, stat: DataFrame, key: str) -> DataFrame:
    """Attach a per-class statistic to the detail rows."""
    return attach(df, stat, [key])


def unmatched(points: DataFrame, matches: DataFrame, key: str = "fired_key") -> DataFrame:
    return points.join(matches.select(key), key, "left_anti")


def union_matches(exact: DataFrame, near: DataFrame, key: str = "fired_key") -> DataFrame:
    """Both kinds of match, one row per location; a containing polygon beats a near one."""
    both = exact.unionByName(near, allowMissingColumns=True)
    return dedupe_first(both, [key], [asc("match_type")])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of a total order (add a unique column to the order)."""
    return df.orderBy(*order).limit(k)


def flag_top(df: DataFrame, by: str, key: str, n: int = 100, name: str = "top_100") -> DataFrame:
    """Mark the n rows with the largest ``by``; ``key`` is unique and breaks ties.

    A bounded sort finds the n keys; at most n rows are then broadcast.
    """
    top = top_k(df.select(key, by), [F.col(by).desc_nulls_last(), F.col(key)], n)
    marks = F.broadcast(top.select(key, F.lit(True).alias(name)))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def first_day_rows(df: DataFrame, key: str, day: str) -> DataFrame:
    """All rows on the first day of their group."""
    first = df.groupBy(key).agg(F.min(day).alias("__first"))
    return df.join(first, key).filter(F.col(day) == F.col("__first")).drop("__first")


def day_index(df: DataFrame, key: str, day: str, name: str = "day_index") -> DataFrame:
    """Rank of the distinct day within its group, from 1.

    Ranking runs on distinct (group, day) pairs. A group cannot hold more of
    those than there are days in the record, however many rows it has.
    """
    from pyspark.sql import Window

    days = df.select(key, day).distinct()
    order = Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last())
    return attach(df, days.withColumn(name, F.row_number().over(order)), [key, day])


def ordered_levels(df: DataFrame, col: str, buckets: int = 256) -> DataFrame:
    """Distinct non-NULL values of ``col`` with their 1-based rank in sort order.

    The values are cut into ranges at boundaries drawn by hash (a fixed sample
    of the distinct values), ranked inside each range, and shifted by the sizes
    of the ranges before it. No task sees more than about 1/buckets of them.
    """
    from pyspark.sql import Window

    if buckets < 1:
        raise ValueError("buckets must be positive")
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    drawn = (
        values.orderBy(F.xxhash64(col), F.col(col)).limit(buckets - 1).agg(
            F.sort_array(F.collect_list(col)).alias("cuts")
        )
    )
    cuts = drawn.first()["cuts"]
    if not cuts:
        return values.withColumn("level_index", F.row_number().over(_all_rows(col)))
    bounds = F.array(*[F.lit(c) for c in cuts])
    bucket = F.size(F.filter(bounds, lambda b: b <= F.col(col)))
    ranged = values.withColumn("__bucket", bucket)
    sizes = ranged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        "__bucket",
        (F.sum("__n").over(_all_rows("__bucket")) - F.col("__n")).alias("__before"),
    )
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(col))
    return (
        ranged.withColumn("__inside", inside)
        .join(F.broadcast(before), "__bucket")
        .select(col, (F.col("__before") + F.col("__inside")).alias("level_index"))
    )


def _all_rows(col: str):
    """Whole-table order; used only on tables of at most ``buckets`` rows."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(col)
