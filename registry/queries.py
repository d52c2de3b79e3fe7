"""Queries over the driver's tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import category, conditional, dates, geometry, numeric, text
from emberline.operators import aggregates as agg
from emberline.operators import audit, encode, spatial, survey
from emberline.operators import relational as rel
from emberline.plans import linkage
from emberline.session import materialize, scratch_path
from emberline.sources import polygons, rules, tables
from emberline.sources.schemas import SURVEY_SCHEMA

from . import standins
from .standins import fires, obs, polys

QUERIES = {}
SURVEY_COLUMNS = [line.split()[0] for line in SURVEY_SCHEMA.replace("\n", " ").split(",")]
TOP_EVENTS = {str(i): f"Event {i}" for i in (1, 5, 7, 11, 101)}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r(c: Column | str, n: int = 6) -> Column:
    """Rounded for comparison."""
    return numeric.round_even(c, n)


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, n) for c in cols})


# Stages shared by several queries ------------------------------------------


def labelled(spark: SparkSession, sf: str, even: bool = False) -> DataFrame:
    return survey.with_burn_status(survey.clean_labels(obs(spark, sf, even)))


def keyed(spark: SparkSession, sf: str, even: bool = False) -> DataFrame:
    return polygons.with_point(survey.with_location_key(labelled(spark, sf, even)), "px", "py")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(spatial.burnt_locations(keyed(spark, sf)), "locations")


def layer(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.read_polygons(polys(spark, sf))


def season(spark: SparkSession, sf: str) -> DataFrame:
    raw = rel.time_window(polys(spark, sf), "date_day", *linkage.WINDOW)
    keep = [*spatial.POLYGON_FIELDS, "wkt"]
    return spatial.prepare_polygons(polygons.read_polygons(polygons.spread(raw.select(*keep))))


#: What the model tables read of a cleaned survey row. The rest would be stored and dealt out three times over.
MODEL_INPUT = (
    "row_ord", "order_key", survey.PROJECT, "site_name", "species", "broad_taxon", "ecosystem_group", "date_survey",
    "response_value", "response_variable_text", "survey_effort_hours", "survey_effort_traps", "survey_area",
    "is_before", "is_after", "burn_status_clean", "eligible_fire_speed", "fire_severity_clean", "ts_fire", "no_fires",
    "unburnt5", "mean_temp_final", "mean_rainfall_final", "drought_spi_final", "disturb_landuse_final_5km_pc_naturalenv",
)
#: What ``survey.model_columns`` and the steps after it read.
MODEL_CLEAN = (
    "row_ord", survey.PROJECT, "site_id", "study_design", "species", "broad_taxon", "ecosystem_group", "include_pa",
    "include_abundance", "response_pa", "response_count", "eligible_fire_speed", "has_fire_speed", "fire_speed",
    "days_since_fire", "fire_severity_clean", "ts_fire", "no_fires", "unburnt5", "mean_temp_final",
    "mean_rainfall_final", "drought_spi_final", "disturb_landuse_final_5km_pc_naturalenv", *survey.EFFORT,
)
#: What the burnt rows are made of, with the keys and effort terms of their kind.
BURNT_INPUT = ("row_ord", "fire_speed_z", "days_since_fire_z", "fire_severity_model", "unburnt5", "drought_spi_final")


def matched(spark: SparkSession, sf: str, columns: Sequence[str] = ()) -> DataFrame:
    """Survey rows with a fire attached by order number, gated and timed; of the survey only ``columns`` where given."""
    metrics = polys(spark, sf).select(
        F.col("poly_ord").alias("order_key"),
        F.col("date_day").alias("burn_date"),
        F.col("id").alias("fire_id"),
        "fsr_km2_dy",
        F.when(F.col("poly_ord") % 5 != 0, F.col("dy_ar_km2")).alias("dy_ar_km2"),
    )
    rows = keyed(spark, sf, even=True)
    base = materialize(rows.select(*columns) if columns else rows, "survey")
    joined = rel.join_metrics(base, metrics, "order_key")
    return survey.with_timing(survey.gate_measures(joined))


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    return rel.join_rules(labelled(spark, sf), rules.project_rules(spark))


def responses(spark: SparkSession, sf: str, columns: Sequence[str] = ()) -> DataFrame:
    master = survey.with_site_id(survey.study_design(matched(spark, sf, columns)))
    return linkage.clean_responses(rel.join_rules(master, rules.project_rules(spark)))


def positive_fires(spark: SparkSession, sf: str) -> DataFrame:
    df = fires(spark, sf)
    df = df.withColumns(
        {
            "mx_grw_ha": numeric.km2_to_ha("mx_grw_km2"),
            "fire_size_ha": numeric.km2_to_ha("tot_ar_km2"),
        }
    )
    return rel.positive_rows(df, ["mx_grw_ha", "fire_size_ha"])


# Sources and sinks ----------------------------------------------------------


@query
def scan_survey(spark, sf):
    """Survey CSV written from the rows, then read with the declared schema."""
    path = scratch_path(spark, "survey")
    raw = obs(spark, sf).withColumn("date_survey", F.col("date_text"))
    present = [c for c in SURVEY_COLUMNS if c in raw.columns]
    named = raw.select(*present).withColumnsRenamed({"ts_fire": "ts.fire", "no_fires": "no.fires"})
    named.write.option("header", True).option("nullValue", "NA").csv(path)
    return tables.read_survey(spark, path).select(
        "unique_project_id", "site_name", "burnt_unburnt", "date_survey", "latitude",
        "response_value", "survey_effort_hours", "ts_fire", "no_fires", "response_variable_text",
    )


@query
def scan_polygons(spark, sf):
    df = layer(spark, sf)
    return df.select(
        "poly_ord",
        F.size("geom").alias("n_parts"),
        F.size(F.col("geom")[0][0]).alias("n_vertices"),
        F.col("geom")[0][0][1]["x"].alias("second_x"),
        F.col("geom")[0][0][1]["y"].alias("second_y"),
        "xmin", "ymin", "xmax", "ymax",
    )


@query
def describe(spark, sf):
    df = obs(spark, sf).select("unique_project_id", "site_name", "px", "fire_severity", "date_survey")
    return tables.describe_table(df).drop("data_type")


@query
def rules_table(spark, sf):
    """The rule table with the survey rows each rule governs."""
    n = agg.count_by(obs(spark, sf), "unique_project_id", name="n_rows")
    return rules.project_rules(spark).join(n, "unique_project_id", "left")


@query
def roundtrip(spark, sf):
    """Derived rows written as CSV, read back, and summarised."""
    df = keyed(spark, sf).select(
        "unique_project_id", "site_name", "burn_status_clean", "fired_key", "response_value", "date_survey"
    )
    paths = tables.write_outputs({"clean": df}, scratch_path(spark, "outputs"))
    back = tables.read_derived(spark, paths["clean.csv"], df.schema)
    again = tables.read_derived(spark, paths["clean.parquet"])
    both = back.unionByName(again)
    return both.groupBy("unique_project_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("site_name").alias("n_site"),
        F.count_distinct("fired_key").alias("n_keys"),
        r(F.sum("response_value"), 3).alias("total"),
        F.max("date_survey").alias("last_day"),
    )


# Projection, filter, predicates ----------------------------------------------


@query
def derive(spark, sf):
    steps = [
        ("area_clean", conditional.if_else(
            F.col("unique_project_id") == "UP_056", 0.000014, F.col("survey_area"))),
        ("area_km", F.col("area_clean") / 1000),
        ("traps_plus", F.col("survey_effort_traps") + 1),
        ("effort", F.col("area_km") * F.col("traps_plus")),
    ]
    df = rel.derive(obs(spark, sf), steps)
    df = tables.rename(df, {"mean_temp_final": "mean_temp_model"})
    return df.select("row_ord", "mean_temp_model", r("effort", 9).alias("effort"))


@query
def select_cols(spark, sf):
    return tables.select_cols(
        obs(spark, sf), ["unique_project_id", "species"], ["nearest_dist_m", "fire_severity"]
    )


@query
def complete_cases(spark, sf):
    df = rel.complete_cases(
        obs(spark, sf), ["site_name", "response_value", "survey_effort_hours"],
        F.col("response_value") > 2, F.col("latlongres") == "original",
    )
    return df.select("row_ord", "site_name", "response_value")


@query
def time_window(spark, sf):
    df = rel.time_window(fires(spark, sf), "ig_date", "2024-01-05", "2024-01-20")
    season_rows = rel.time_window(polys(spark, sf), "date_day", *linkage.WINDOW)
    return (
        df.select(F.lit("fires").alias("source"), dates.to_day("ig_date").alias("day"))
        .unionByName(season_rows.select(F.lit("polys").alias("source"), F.col("date_day").alias("day")))
        .groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))
    )


@query
def membership(spark, sf):
    hit = conditional.is_in("response_variable_text", ["1", "2", "n/a"])
    return obs(spark, sf).select("row_ord", hit.alias("hit"))


@query
def rule_filter(spark, sf):
    return survey.rule_filter(ruled(spark, sf)).select(
        "row_ord", "unique_project_id", "response_variable_text"
    )


@query
def required_effort(spark, sf):
    return survey.required_effort(ruled(spark, sf).filter("include_pa")).select(
        "row_ord", "unique_project_id", "survey_effort_hours"
    )


@query
def matched_only(spark, sf):
    return survey.matched_only(matched(spark, sf)).select(
        "row_ord", "eligible_fire_speed", r("fire_speed").alias("fire_speed")
    )


@query
def positive_rows(spark, sf):
    df = rel.positive_rows(obs(spark, sf), ["survey_effort_hours", "survey_effort_traps"])
    return df.select("row_ord", r("survey_effort_traps").alias("traps"))


# Joins ------------------------------------------------------------------------


@query
def pip_join(spark, sf):
    return spatial.pip_join(points(spark, sf), season(spark, sf)).select("fired_key", "poly_ord", "date_day")


@query
def pip_best(spark, sf):
    pairs = spatial.pip_join(points(spark, sf), season(spark, sf), cells=True)
    return rounded(spatial.pip_best(pairs), "dy_ar_km2")


@query
def first_burn(spark, sf):
    return rounded(spatial.first_burn(points(spark, sf), season(spark, sf)), "dy_ar_km2")


@query
def nearest_within(spark, sf):
    near = spatial.recover_near(points(spark, sf), season(spark, sf))
    return rounded(near, "dy_ar_km2", "nearest_dist_m")


@query
def nearest_any(spark, sf):
    """How far each location that no polygon contains is from the nearest one, without a bound."""
    pts, layer_ = points(spark, sf), season(spark, sf)
    free = materialize(rel.unmatched(pts, spatial.first_burn(pts, layer_)), "free")
    return rounded(spatial.nearest_polygon(free, layer_).select("fired_key", "nearest_dist_m"), "nearest_dist_m")


@query
def unmatched(spark, sf):
    pts = points(spark, sf)
    return rel.unmatched(pts, spatial.first_burn(pts, season(spark, sf))).select("fired_key")


@query
def union_matches(spark, sf):
    both = spatial.match_locations(points(spark, sf), season(spark, sf))
    return rounded(both, "dy_ar_km2", "nearest_dist_m")


@query
def join_metrics(spark, sf):
    """The whole linkage: survey rows with the match of their location."""
    base = keyed(spark, sf)
    both = spatial.match_locations(points(spark, sf), season(spark, sf))
    out = rel.join_metrics(base, both)
    return out.select("row_ord", "fired_key", "burn_date", "did", "match_type")


@query
def join_rules(spark, sf):
    return ruled(spark, sf).select("row_ord", "unique_project_id", "include_pa", "response_type")


@query
def missing_rules(spark, sf):
    return rel.missing_rules(obs(spark, sf), rules.project_rules(spark), "project_name")


@query
def event_area_join(spark, sf):
    areas = agg.event_area(
        layer(spark, sf).select("id", numeric.m2_to_ha(geometry.poly_area("geom")).alias("ha")), "ha"
    )
    return rel.event_area_join(fires(spark, sf).select("row_ord", "id"), rounded(areas, "fire_size_ha", n=4))


@query
def p97_joinback(spark, sf):
    df = positive_fires(spark, sf)
    p97 = agg.quantile(df, "mx_grw_ha", 0.97, "lc_name", "p97")
    out = rel.join_class_stat(df.select("row_ord", "lc_name"), p97, "lc_name")
    return out.select(
        "row_ord", "lc_name", r("p97").alias("p97"), text.label("p97", 1, " ha/day").alias("label")
    )


# Spatial ----------------------------------------------------------------------


@query
def reproject(spark, sf):
    df = polygons.with_point(obs(spark, sf), "longitude", "latitude", geometry.WGS84)
    df = polygons.with_lonlat(df)
    return df.select(
        "row_ord", r("x", 3).alias("x"), r("y", 3).alias("y"), r("lon").alias("lon"), r("lat").alias("lat")
    )


@query
def point_seg_dist(spark, sf):
    """Distance from each event's ignition coordinates to each of its polygons."""
    d = geometry.point_poly_dist("geom", "ig_utm_x", "ig_utm_y")
    return layer(spark, sf).select("poly_ord", r(d).alias("dist"))


@query
def poly_area(spark, sf):
    return layer(spark, sf).select(
        "poly_ord", r(numeric.m2_to_ha(geometry.poly_area("geom"))).alias("area_ha")
    )


@query
def first_day_centroid(spark, sf):
    return rounded(spatial.first_day_centroid(layer(spark, sf)), "x", "y")


@query
def ignition_point(spark, sf):
    return spatial.ignition_point(polys(spark, sf))


# Aggregation --------------------------------------------------------------------


@query
def summary_all(spark, sf):
    df = obs(spark, sf)
    return agg.summary_all(df, {
        "n": F.count(F.lit(1)),
        "n_projects": agg.n_distinct("unique_project_id"),
        "n_sites": agg.n_distinct("site_name"),
        "n_species": agg.n_distinct("species"),
        "first_day": F.min("date_survey"),
        "last_day": F.max("date_survey"),
        "mean_response": r(F.avg("response_value")),
        "max_scaled": r(F.max(F.col("response_value") * 100)),
    })


@query
def inspect_projects(spark, sf):
    return audit.inspect_projects(obs(spark, sf))


@query
def count_by(spark, sf):
    return agg.count_by(obs(spark, sf), "unique_project_id", "fire_severity", "no_fires", name="n_rows")


@query
def crosstab(spark, sf):
    return agg.crosstab(labelled(spark, sf), "before_after_clean", "fire_severity_clean")


@query
def distinct_locations(spark, sf):
    return spatial.burnt_locations(keyed(spark, sf))


@query
def dedupe_first(spark, sf):
    df = keyed(spark, sf).select("fired_key", "date_survey", "order_key", "fire_severity")
    return rel.dedupe_first(
        df, ["fired_key"], [rel.asc("date_survey"), rel.desc("order_key"), rel.asc("fire_severity")]
    )


@query
def ndistinct_null(spark, sf):
    return obs(spark, sf).groupBy("unique_project_id").agg(
        agg.n_distinct("site_name").alias("n_sites"), agg.n_distinct("response_value").alias("n_values")
    )


@query
def match_rate(spark, sf):
    base = keyed(spark, sf)
    both = spatial.match_locations(points(spark, sf), season(spark, sf))
    gated = survey.gate_measures(rel.join_metrics(base, both))
    return rounded(agg.match_rate(gated), "match_rate")


@query
def missing_share(spark, sf):
    return rounded(agg.missing_share(matched(spark, sf)), "prop_missing")


@query
def integer_check(spark, sf):
    df = survey.rebuild_counts(ruled(spark, sf)).withColumn("model_response", F.col("response_count"))
    return rounded(audit.integer_check(df), "max_diff_from_integer")


@query
def event_area(spark, sf):
    return rounded(agg.event_area(polys(spark, sf), "dy_ar_km2"), "fire_size_ha")


@query
def class_mean_ci(spark, sf):
    out = agg.rank_classes(agg.mean_ci(positive_fires(spark, sf), "mx_grw_ha", "lc_name"), "mean", "lc_name")
    return rounded(out, "mean", "sd", "se", "ci95", "lower_ci", "upper_ci")


@query
def global_mean_ci(spark, sf):
    out = agg.mean_ci(positive_fires(spark, sf), "mx_grw_ha", extremes=True)
    return rounded(out, "mean", "sd", "se", "ci95", "lower_ci", "upper_ci", "min", "max")


@query
def p97(spark, sf):
    df = positive_fires(spark, sf)
    whole = agg.quantile(df, "mx_grw_ha", 0.97, name="p97").select(F.lit("all").alias("lc_name"), "p97")
    return rounded(agg.quantile(df, "mx_grw_ha", 0.97, "lc_name", "p97").unionByName(whole), "p97")


@query
def exceedance(spark, sf):
    return rounded(agg.exceedance(positive_fires(spark, sf), "mx_grw_ha", 0.97), "threshold", "percent_above")


@query
def group_profile(spark, sf):
    df = obs(spark, sf).withColumn("ord", F.struct("row_ord", "species", "px", "survey_method"))
    return agg.group_profile(
        df, "unique_project_id", "ord", {"survey_method": "method", "species": "first_species"}, "response_value"
    )


@query
def five_number(spark, sf):
    out = agg.five_number(obs(spark, sf), ["response_value", "unburnt5", "drought_spi_final"])
    return rounded(out, "min", "q1", "median", "mean", "q3", "max")


@query
def mean_var(spark, sf):
    return rounded(agg.mean_var(obs(spark, sf), "response_value"), "mean", "variance")


@query
def prevalence(spark, sf):
    df = obs(spark, sf).withColumn("found", F.col("survey_effort_traps"))
    return rounded(agg.prevalence(df, "found", ["broad_taxon"]), "prop_zero", "prevalence")


@query
def bin_peak(spark, sf):
    return agg.bin_peak(positive_fires(spark, sf), "mx_grw_ha", "lc_name")


@query
def hist_log10(spark, sf):
    df = positive_fires(spark, sf)
    whole = agg.histogram(df, "mx_grw_ha", log10=True).withColumn("lc_name", F.lit("all"))
    return rounded(agg.histogram(df, "mx_grw_ha", log10=True, by="lc_name").unionByName(whole), "center")


@query
def loglog_ols(spark, sf):
    return rounded(agg.loglog_ols(positive_fires(spark, sf), "mx_grw_ha", "fire_size_ha"),
                   "intercept", "slope", "r2", "adj_r2")


@query
def ols_band(spark, sf):
    return rounded(agg.ols_band(positive_fires(spark, sf), "mx_grw_ha", "fire_size_ha"),
                   "log_x", "fit", "lower", "upper")


# Ranking, windows -----------------------------------------------------------------


@query
def top100_flag(spark, sf):
    df = rel.flag_top(fires(spark, sf), "mx_grw_km2", "row_ord", 100)
    return df.select("row_ord", "lc_name", "top_100")


@query
def top5(spark, sf):
    order = [*rel.desc_last("mx_grw_km2"), F.col("row_ord")]
    return rel.top_k(fires(spark, sf), order, 5).select("row_ord", "id", r("mx_grw_km2").alias("mx_grw_km2"))


@query
def group_zscore(spark, sf):
    out = agg.group_zscore(obs(spark, sf), "response_value", ["unique_project_id", "broad_taxon"])
    return out.select("row_ord", "broad_taxon", r("response_std").alias("response_std"))


@query
def day_index(spark, sf):
    return rel.day_index(polys(spark, sf), "id", "event_day").select("poly_ord", "id", "day_index")


@query
def event_growth(spark, sf):
    return rounded(agg.event_growth(polys(spark, sf), TOP_EVENTS), "mx_grw_ha")


# Conditional and domain rules -------------------------------------------------------


@query
def burn_status(spark, sf):
    return labelled(spark, sf).select(
        "row_ord", "burn_status_clean", "eligible_fire_speed", "fire_severity_clean"
    )


@query
def strict_if_else(spark, sf):
    df = survey.fix_area(obs(spark, sf))
    few = conditional.if_else(F.col("response_value") > 5, F.lit("many"), F.lit("few"))
    return df.select("row_ord", F.round("survey_area", 8).alias("survey_area"), few.alias("size_class"))


@query
def study_design(spark, sf):
    return survey.study_design(labelled(spark, sf)).select("row_ord", "study_design", "study_design_code")


@query
def gate_measures(spark, sf):
    df = matched(spark, sf)
    return rounded(df, "fire_speed", "fire_daily_area_km2").select(
        "row_ord", "fire_speed", F.col("fire_event_growth_rate").cast("double").alias("growth"),
        "fire_daily_area_km2", "has_fire_speed",
    )


@query
def rebuild_counts(spark, sf):
    return survey.rebuild_counts(obs(spark, sf)).select(
        "row_ord", "unique_project_id", r("response_count").alias("response_count")
    )


@query
def presence(spark, sf):
    df = survey.presence(survey.rebuild_counts(ruled(spark, sf)))
    return df.select("row_ord", "response_type", "response_pa")


@query
def effort(spark, sf):
    df = survey.assign_effort(obs(spark, sf))
    return df.select("row_ord", *[r(c, 9).alias(c) for c in survey.EFFORT])


@query
def sentinel(spark, sf):
    return obs(spark, sf).select(
        "row_ord", conditional.drop_sentinel("ts_fire", 999).alias("ts_fire_model")
    )


@query
def levels(spark, sf):
    fire = conditional.limit_levels("no_fires", category.FIRE_COUNT_LEVELS)
    severity = conditional.limit_levels("fire_severity", category.SEVERITY_LEVELS)
    return obs(spark, sf).select(
        "row_ord", fire.alias("no_fires_model"), severity.alias("severity"),
        category.level_code("fire_severity", category.SEVERITY_LEVELS).alias("severity_code"),
    )


@query
def pa_table(spark, sf):
    return survey.pa_table(responses(spark, sf)).select(
        "row_ord", "site_id", "study_design", "model_response"
    )


@query
def abundance_table(spark, sf):
    return survey.abundance_table(responses(spark, sf)).select(
        "row_ord", "site_id", "study_design", "model_response"
    )


#: What the whole path reads of a cleaned survey row: places and names beside what the model tables read, and no order number.
WHOLE_INPUT = (*[c for c in MODEL_INPUT if c != "order_key"], "project_name", "fired_key", "x", "y")
WHOLE_CLEAN = (*MODEL_CLEAN, "project_name", "response_type")


def whole_path(spark, sf):
    """The result tables with fires attached by place: cleaned survey and polygon layer in, six tables out."""
    base = materialize(keyed(spark, sf).select(*WHOLE_INPUT), "survey")
    return linkage.model_tables(base, season(spark, sf), rules.project_rules(spark), WHOLE_CLEAN, last=True)


@query
def master(spark, sf):
    """Every survey row with its fire by containment or nearness, gated, timed and with its design."""
    out = whole_path(spark, sf).master
    return rounded(out, "fire_speed").select("row_ord", "site_id", "study_design", "match_type", "fire_speed", "has_fire_speed", "days_since_fire", "timing_rel_fire")


@query
def model_tables(spark, sf):
    """Presence and abundance model tables of the whole path, one below the other."""
    tables_ = whole_path(spark, sf)
    one = lambda df, kind: df.select("row_ord", F.lit(kind).alias("kind"), "study_design", F.col("model_response").cast("double").alias("model_response"))
    return one(tables_.pa, "pa").unionByName(one(tables_.abundance, "abundance"))


@query
def match_summary(spark, sf):
    return rounded(whole_path(spark, sf).match_summary, "match_rate")


@query
def burnt_tables_abundance(spark, sf):
    clean = materialize(responses(spark, sf, MODEL_INPUT).select(*MODEL_CLEAN), "clean")
    table = survey.abundance_table(survey.model_columns(clean))
    table = table.select(*dict.fromkeys([*BURNT_INPUT, *survey.MODEL_KEYS, *survey.EFFORT_TERMS["abundance"]]))
    _, burnt = linkage.burnt_tables(table, "abundance")
    return burnt.select(
        "row_ord", "model_response", "fire_severity_code", "broad_taxon",
        *[r(c).alias(c) for c in ("fire_speed_z", "days_since_fire_z", "unburnt5_z", "drought_spi_z")],
    )


@query
def burnt_tables(spark, sf):
    clean = materialize(responses(spark, sf, MODEL_INPUT).select(*MODEL_CLEAN), "clean")
    table = survey.pa_table(survey.model_columns(clean))
    table = table.select(*dict.fromkeys([*BURNT_INPUT, *survey.MODEL_KEYS, *survey.EFFORT_TERMS["pa"]]))
    _, burnt = linkage.burnt_tables(table, "pa")
    return burnt.select(
        "row_ord", "model_response", "fire_severity_code", "broad_taxon",
        *[r(c).alias(c) for c in ("fire_speed_z", "days_since_fire_z", "unburnt5_z", "drought_spi_z")],
    )


# Dates, text, numbers ----------------------------------------------------------------


@query
def parse_dates(spark, sf):
    return obs(spark, sf).select("row_ord", "date_text", dates.parse_date("date_text").alias("day"))


@query
def days_since(spark, sf):
    return matched(spark, sf).select("row_ord", "days_since_fire_raw", "days_since_fire", "timing_rel_fire")


@query
def squish(spark, sf):
    return obs(spark, sf).select(
        "row_ord", text.squish("before_after").alias("a"), text.squish("burnt_unburnt").alias("b")
    )


@query
def coord_precision(spark, sf):
    return survey.coord_precision(obs(spark, sf)).select("row_ord", "lat_decimals", "lon_decimals")


@query
def composite_key(spark, sf):
    return survey.with_site_id(keyed(spark, sf)).select("row_ord", "fired_key", "site_id")


@query
def safe_num(spark, sf):
    return obs(spark, sf).select("row_ord", text.safe_num("response_variable_text").alias("number"))


@query
def logs(spark, sf):
    return obs(spark, sf).select(
        "row_ord",
        r(numeric.safe_log("survey_effort_traps")).alias("ln_traps"),
        r(numeric.safe_log1p("unburnt5")).alias("ln1_unburnt5"),
    )


@query
def zscore(spark, sf):
    cols = {
        "survey_effort_hours": "hours_z", "survey_effort_traps": "traps_z", "survey_area": "area_z",
        "response_value": "response_z", "ts_fire": "ts_fire_z", "unburnt5": "unburnt5_z",
        "mean_temp_final": "mean_temp_z", "mean_rainfall_final": "mean_rainfall_z",
        "drought_spi_final": "drought_spi_z",
        "disturb_landuse_final_5km_pc_naturalenv": "natural_env_5km_z",
    }
    return agg.zscore(obs(spark, sf), cols).select("row_ord", *[r(z).alias(z) for z in cols.values()])


# Encoding ---------------------------------------------------------------------------


@query
def lump_min(spark, sf):
    df = encode.lump_min(obs(spark, sf), "broad_taxon", name="taxon")
    order = category.relevel(["Bird", "Mammal", "Other", "Plant"], encode.REFERENCE_TAXON)
    return df.select("row_ord", "taxon", category.level_code("taxon", order).alias("taxon_code"))


@query
def index_levels(spark, sf):
    df = encode.index_levels(obs(spark, sf), "species")
    return df.select("row_ord", "species", F.col("species_index").cast("bigint").alias("species_index"))


@query
def design_matrix(spark, sf):
    formula = encode.Formula(
        response="response_value",
        terms=["unburnt5", "fire_severity", "ecosystem_group", "unburnt5*ecosystem_group"],
        levels={
            "fire_severity": category.SEVERITY_LEVELS,
            "ecosystem_group": [f"eco {i}" for i in range(5)],
        },
    )
    df = encode.design_matrix(obs(spark, sf), formula, keep=["row_ord"])
    names = [n for n, _ in encode.term_columns(formula)]
    return df.select("row_ord", "y", *[F.col("x")[i].alias(f"x{i}") for i in range(len(names))])


# Data quality ------------------------------------------------------------------------


@query
def bad_pa(spark, sf):
    df = obs(spark, sf).withColumn("model_response", F.col("response_value").cast("int"))
    return audit.bad_pa(df)


@query
def bad_abundance(spark, sf):
    df = obs(spark, sf).withColumn("model_response", F.col("response_value") - 3)
    return audit.bad_abundance(df)


@query
def effort_positive(spark, sf):
    return audit.effort_positive(obs(spark, sf), ["survey_effort_hours", "survey_effort_traps", "survey_area"])


@query
def rules_consistent(spark, sf):
    """Rules turned against each other where the survey rows say so, then checked."""
    few = agg.count_by(obs(spark, sf), "unique_project_id", name="n_rows")
    table = rules.project_rules(spark).join(few, "unique_project_id")
    table = table.withColumn("include_pa", F.col("include_pa") & (F.col("n_rows") % 2 == 0))
    return audit.rules_consistent(table).select("unique_project_id", "n_rows")


@query
def funnel(spark, sf):
    df = labelled(spark, sf)
    return audit.funnel(df, {
        "located": F.col("latlongres") == "original",
        "eligible": F.col("eligible_fire_speed"),
        "with_response": F.col("response_value").isNotNull(),
        "with_effort": F.col("survey_effort_hours") > 2,
    })


@query
def sample_rows(spark, sf):
    return audit.sample_rows(
        obs(spark, sf), "UP_010", ["row_ord", "px", "py", "response_value"],
        ["row_ord", "site_name", "response_value"],
    )


def all_queries():
    from . import fits

    out = dict(QUERIES)
    out["rules"] = out.pop("rules_table")
    return {**out, **fits.QUERIES}
