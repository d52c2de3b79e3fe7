"""Summaries, quantiles, histograms and small regressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditional import as_col
from ..functions.numeric import standardize, t975
from ..session import materialize
from .relational import asc, attach, left_on

SKETCH_ACCURACY = 10_000
# Ranges that the values of a quantile are cut into.
RANGES = 256


def n_distinct(c: Column | str) -> Column:
    """Distinct count in which a missing value counts as one value."""
    c = as_col(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def summary_all(df: DataFrame, spec: Mapping[str, Column]) -> DataFrame:
    """One row of named aggregates."""
    return df.agg(*[c.alias(n) for n, c in spec.items()])


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key; a missing key is a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def crosstab(df: DataFrame, a: str, b: str | None = None, name: str = "n") -> DataFrame:
    """Contingency table in long form, missing levels included."""
    return count_by(df, *([a] if b is None else [a, b]), name=name)


def prevalence(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, share of zeros and share above zero."""
    c = F.col(col)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"),
        F.avg((c == 0).cast("int")).alias("prop_zero"),
        F.avg((c > 0).cast("int")).alias("prevalence"),
    )


def mean_var(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(col).alias("mean"), F.var_samp(col).alias("variance"))


def mean_ci(df: DataFrame, value: str, by: str | None = None, extremes: bool = False) -> DataFrame:
    """n, mean, sd, standard error and 95 % t interval, per class or overall.

    Overall, n counts known values; per class it counts rows.
    """
    aggs = [
        F.count(F.lit(1) if by else value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
    ]
    if extremes:
        aggs += [F.min(value).alias("min"), F.max(value).alias("max")]
    out = (df.groupBy(by) if by else df.groupBy()).agg(*aggs)
    out = out.withColumn("se", F.col("sd") / F.sqrt("n"))
    out = out.withColumn("ci95", t975(F.col("n") - 1) * F.col("se"))
    return out.withColumns(
        {"lower_ci": F.col("mean") - F.col("ci95"), "upper_ci": F.col("mean") + F.col("ci95")}
    )


def rank_classes(stat: DataFrame, col: str, key: str) -> DataFrame:
    """Position of each class by its statistic; one row per class goes in."""
    order = Window.orderBy(F.col(col).desc_nulls_last(), F.col(key).asc_nulls_last())
    return stat.withColumn("class_rank", F.row_number().over(order))


def quantile(
    df: DataFrame, value: str, p: float, by: str | None = None, name: str = "q", exact: bool = True
) -> DataFrame:
    """Interpolated quantile (linear between order statistics), per class or overall."""
    return quantiles(df, value, {name: p}, by, exact)


def quantiles(
    df: DataFrame, value: str, ps: Mapping[str, float], by: str | None = None, exact: bool = True
) -> DataFrame:
    """Several quantiles in the same passes, one column each.

    Equal values are counted first. The values are cut into ranges at bounds from
    a sketch; the sizes of the ranges tell which of them hold the wanted ranks,
    and only those are put in order. No task orders more than about one range,
    whatever the size of a class, and the result is exact. With ``exact`` off the
    sketch alone answers.
    """
    keys = [by] if by else ["__all"]
    v = F.col(value).cast("double").alias("v")
    data = df.select(F.col(by) if by else F.lit(0).alias("__all"), v).filter(F.col("v").isNotNull())
    out = [c for c in keys if c != "__all"]
    if not exact:
        found = data.groupBy(*keys).agg(*[F.percentile_approx("v", p, SKETCH_ACCURACY).alias(n) for n, p in ps.items()])
        return found.select(*out, *ps)
    counts = materialize(data.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")), "counts")
    steps = [i / RANGES for i in range(1, RANGES)]
    # One row of RANGES - 1 numbers.
    bounds = counts.agg(F.percentile_approx("v", steps, SKETCH_ACCURACY).alias("b")).first()["b"]
    cuts = F.array(*[F.lit(x) for x in sorted(set(bounds or [0.0]))])
    ranged = counts.withColumn("__range", F.size(F.filter(cuts, lambda b: b <= F.col("v"))))
    order = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = ranged.groupBy(*keys, "__range").agg(F.sum("c").alias("m"))
    sizes = sizes.withColumns({"before": F.sum("m").over(order) - F.col("m"), "n": F.sum("m").over(Window.partitionBy(*keys))})
    ranks = {n: (F.col("n") - 1) * F.lit(float(p)) for n, p in ps.items()}
    ends = [k for r in ranks.values() for k in (F.floor(r), F.ceil(r))]
    wanted = F.lit(False)
    for k in ends:
        wanted = wanted | k.between(F.col("before"), F.col("before") + F.col("m") - 1)
    inside = left_on(ranged, sizes.filter(wanted).withColumn("__found", F.lit(True)), [*keys, "__range"]).filter("__found")
    within = Window.partitionBy(*keys, "__range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("last", F.col("before") + F.sum("c").over(within) - 1)
    first = F.col("last") - F.col("c") + 1
    aggs = [F.max("n").alias("n")]
    for i, r in enumerate(ranks.values()):
        for side, k in (("a", F.floor(r)), ("b", F.ceil(r))):
            aggs.append(F.max(F.when(k.between(first, F.col("last")), F.col("v"))).alias(f"{side}{i}"))
    found = inside.groupBy(*keys).agg(*aggs)
    values = [
        F.when(F.ceil(r) == F.floor(r), F.col(f"a{i}"))
        .otherwise((F.ceil(r) - r) * F.col(f"a{i}") + (r - F.floor(r)) * F.col(f"b{i}"))
        .alias(n)
        for i, (n, r) in enumerate(ranks.items())
    ]
    return found.select(*out, *values)


def exceedance(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows strictly above the quantile, non-missing rows, and the percentage."""
    cut = quantile(df, value, p, name="threshold")
    return (
        df.select(value)
        .join(F.broadcast(cut))
        .groupBy("threshold")
        .agg(
            F.count(value).alias("n_total"),
            F.sum((F.col(value) > F.col("threshold")).cast("long")).alias("n_above"),
        )
        .withColumn("percent_above", F.try_divide(F.col("n_above"), F.col("n_total")) * 100)
    )


def five_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Least, quartiles, mean, greatest and missing count, one row per column.

    The columns are stacked, so all moments are one aggregation and all quartiles
    share their passes.
    """
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols]
    long = df.select(F.inline(F.array(*entries)))
    base = long.groupBy("column_name").agg(
        F.min("v").alias("min"),
        F.avg("v").alias("mean"),
        F.max("v").alias("max"),
        F.sum(F.col("v").isNull().cast("long")).alias("n_missing"),
    )
    middle = quantiles(long, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "column_name")
    return left_on(base, middle, ["column_name"]).select(
        "column_name", "min", "q1", "median", "mean", "q3", "max", "n_missing"
    )


def group_profile(
    df: DataFrame, by: str, order: str, first: Mapping[str, str], value: str
) -> DataFrame:
    """First values in row order, extremes of ``value`` and rows, per group: one aggregation."""
    fields = [f.alias(f"o{i}") for i, f in enumerate(asc(order))]
    row = F.struct(*[F.col(c).alias(n) for c, n in first.items()]).alias("row")
    return (
        df.groupBy(by)
        .agg(
            F.min(value).alias("min_val"),
            F.max(value).alias("max_val"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(*fields, row)).alias("best"),
        )
        .select(by, "min_val", "max_val", "n", "best.row.*")
    )


def event_area(polys: DataFrame, area: str, key: str = "id") -> DataFrame:
    """Total per event; an event with no known area has 0."""
    return polys.groupBy(key).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("fire_size_ha"))


def zscore(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """z-scores with the sample spread, missing values skipped.

    One aggregation finds every mean and spread; the single row is broadcast. A
    column without spread gives NULL.
    """
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"__m{i}"), F.stddev_samp(v).alias(f"__s{i}")]
    moments = F.broadcast(df.agg(*aggs))
    # A column that is about to be replaced must not be carried along.
    out = df.drop(*[z for z in cols.values() if z in df.columns]).join(moments)
    out = out.withColumns(
        {
            z: standardize(F.col(c).cast("double"), F.col(f"__m{i}"), F.col(f"__s{i}"))
            for i, (c, z) in enumerate(cols.items())
        }
    )
    return out.drop(*[f"__{k}{i}" for i in range(len(cols)) for k in ("m", "s")])


def with_group_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Group n, mean and spread on every row: aggregated first, then joined back."""
    stats = df.groupBy(*by).agg(
        F.count(col).alias("n_nonmiss"),
        F.avg(col).alias("mean_resp"),
        F.stddev_samp(col).alias("sd_resp"),
    )
    return attach(df, stats, list(by))


def group_zscore(df: DataFrame, col: str, by: Sequence[str], name: str = "response_std") -> DataFrame:
    """z-score within the group; NULL for fewer than two values or no spread."""
    z = F.when(
        (F.col("n_nonmiss") >= 2) & (F.col("sd_resp") > 0),
        standardize(col, F.col("mean_resp"), F.col("sd_resp")),
    )
    return with_group_stats(df, col, by).withColumn(name, z).drop("n_nonmiss", "mean_resp", "sd_resp")


def _range(df: DataFrame, v: Column) -> DataFrame:
    return F.broadcast(df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi")))


def bin_peak(df: DataFrame, value: str, by: str, bins: int = 50) -> DataFrame:
    """Largest bin count per class, over equal bins of the whole table's range.

    Bins are closed on the right and the least value belongs to the first.
    """
    v = F.col(value).cast("double")
    known = df.select(by, v.alias("v")).filter(F.col("v").isNotNull())
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.ceil(F.try_divide(F.col("v") - F.col("__lo"), width))
    binned = known.join(_range(known, F.col("v"))).withColumn(
        "bin", F.greatest(F.lit(1), F.least(F.lit(bins), F.coalesce(index, F.lit(1))))
    )
    counts = binned.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.max("n").alias("y"))


def histogram(
    df: DataFrame, value: str, bins: int = 50, log10: bool = False, by: str | None = None
) -> DataFrame:
    """Counts in ``bins`` bins centred on a regular grid from least to greatest value."""
    keys = [by] if by else []
    v = F.col(value).cast("double")
    v = F.when(v > 0, F.log10(v)) if log10 else v
    known = df.select(*keys, v.alias("v")).filter(F.col("v").isNotNull())
    width = (F.col("__hi") - F.col("__lo")) / (bins - 1)
    index = F.floor(F.try_divide(F.col("v") - F.col("__lo"), width) + 0.5)
    binned = known.join(_range(known, F.col("v"))).withColumns(
        {"bin": F.coalesce(index, F.lit(0)).cast("int"), "__w": width}
    )
    return (
        binned.groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("__lo") + F.col("bin") * F.col("__w")).alias("center"))
    )


def loglog_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of ln y on ln x: intercept, slope and adjusted R squared."""
    lx, ly = F.ln(F.col(x)), F.ln(F.col(y))
    fit = df.agg(
        F.regr_intercept(ly, lx).alias("intercept"),
        F.regr_slope(ly, lx).alias("slope"),
        F.regr_r2(ly, lx).alias("r2"),
        F.regr_count(ly, lx).alias("n"),
    )
    adjusted = 1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("n") - 2)
    return fit.withColumn("adj_r2", adjusted)


def ols_band(df: DataFrame, x: str, y: str, points: int = 80) -> DataFrame:
    """Fitted log-log line with its 95 % confidence band on a regular grid of ln x."""
    lx, ly = F.ln(F.col(x)), F.ln(F.col(y))
    fit = df.agg(
        F.regr_intercept(ly, lx).alias("b0"),
        F.regr_slope(ly, lx).alias("b1"),
        F.regr_count(ly, lx).alias("n"),
        F.regr_avgx(ly, lx).alias("mx"),
        F.regr_sxx(ly, lx).alias("sxx"),
        F.regr_syy(ly, lx).alias("syy"),
        F.regr_sxy(ly, lx).alias("sxy"),
        F.min(lx).alias("lo"),
        F.max(lx).alias("hi"),
    )
    grid = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    rss = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    sigma2 = F.try_divide(F.greatest(rss, F.lit(0.0)), F.col("n") - 2)
    spread = 1 / F.col("n") + F.try_divide(F.pow(F.col("log_x") - F.col("mx"), 2), F.col("sxx"))
    se = F.sqrt(sigma2 * spread)
    grid = grid.withColumn("log_x", at).withColumns(
        {"fit": F.col("b0") + F.col("b1") * F.col("log_x"), "half": t975(F.col("n") - 2) * se}
    )
    return grid.select(
        "i", "log_x", "fit", (F.col("fit") - F.col("half")).alias("lower"),
        (F.col("fit") + F.col("half")).alias("upper"),
    )


def match_rate(obs: DataFrame) -> DataFrame:
    """Share of eligible burnt locations with a fire speed, per project."""
    locations = (
        obs.select("fired_key", "unique_project_id", "eligible_fire_speed", "fire_speed")
        .distinct()
        .filter(F.col("eligible_fire_speed"))
    )
    return (
        locations.groupBy("unique_project_id")
        .agg(
            F.count(F.lit(1)).alias("n_eligible_burnt_locations"),
            F.count("fire_speed").alias("n_matched"),
        )
        .withColumn(
            "match_rate", F.try_divide(F.col("n_matched"), F.col("n_eligible_burnt_locations"))
        )
    )


def missing_share(obs: DataFrame) -> DataFrame:
    """Eligible rows without a fire speed, per project."""
    return (
        obs.filter(F.col("eligible_fire_speed"))
        .groupBy("unique_project_id")
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.sum((~F.col("has_fire_speed")).cast("long")).alias("n_missing"),
            F.sum(F.col("has_fire_speed").cast("long")).alias("n_matched"),
        )
        .withColumn("prop_missing", F.try_divide(F.col("n_missing"), F.col("n_total")))
    )


def event_growth(polys: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Days, extent and size of the listed events, in one pass over the layer."""
    from ..functions.text import lookup

    chosen = polys.filter(F.col("id").cast("string").isin(list(names)))
    return (
        chosen.groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("event_day").alias("first_day"),
            F.max("event_day").alias("last_day"),
            F.count_distinct("event_day").alias("n_days"),
            (F.max("mx_grw_km2") * 100).alias("mx_grw_ha"),
        )
        .withColumn("fire_name", lookup(F.col("id"), names))
    )
