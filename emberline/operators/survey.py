"""The survey's own rules: cleaning, burn status, counts, effort, model tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.category import FIRE_COUNT_LEVELS, SEVERITY_LEVELS, STUDY_DESIGN_LEVELS, level_code
from ..functions.conditional import (
    as_col,
    case_when,
    drop_sentinel,
    if_else,
    is_in,
    limit_levels,
    positive_or_one,
)
from ..functions.dates import DEFAULT_ORDER, clamp_days, days_since, parse_date, timing_class
from ..functions.numeric import is_whole, round_even, safe_log, safe_log1p
from ..functions.text import lower, n_decimals, number_text, paste_key, safe_num, squish, text_matches
from .aggregates import zscore
from .relational import complete_cases

PROJECT = "unique_project_id"

# Thresholds, project numbers and texts the review decided on.
MIN_DECIMALS = 3
KEY_DIGITS = 5
FIXED_AREA = {"UP_056": 0.000014}
TEXT_RULES = {"UP_008": "alive", "UP_010": "all plants|mature|juvenile"}
EXACT_TEXT_RULES = {"UP_062": "nest occupancy and reproduction"}
EFFORT_REQUIRED = ("UP_010", "UP_079")
RAW_BINARY_TYPES = ("binary", "binary_raw")
NEVER_BURNT = 999
METRES_PER_KM = 1000

# How recorded responses become counts, by project.
COUNT_TIMES_TRAPS = ("UP_030", "UP_070")
COUNT_TIMES_KM = ("UP_040",)
COUNT_FROM_TEXT = ("UP_068", "UP_082")
COUNT_DOUBLED = ("UP_069",)
REBUILT_PROJECTS = ("UP_030", "UP_040", "UP_068", "UP_069", "UP_070", "UP_082")

# The projects that use each effort measure, by effort column.
# A project that is not listed has effort 1.
EFFORT = {
    "effort_offset_abundance": {
        "area": ("UP_005", "UP_065", "UP_068"),
        "hours": ("UP_007",),
        "km": ("UP_040",),
        "traps": ("UP_070", "UP_082", "UP_083"),
    },
    "effort_covariate_abundance": {"hours": ("UP_010", "UP_011", "UP_067")},
    "effort_covariate2_abundance": {"area": ("UP_010", "UP_011")},
    "effort_covariate_pa": {
        "hours": (
            "UP_007", "UP_010", "UP_011", "UP_018", "UP_031", "UP_066", "UP_067", "UP_079",
        ),
        "traps": ("UP_020", "UP_021", "UP_030", "UP_060", "UP_070", "UP_082", "UP_083"),
        "km": ("UP_040",),
        "area": ("UP_005", "UP_065", "UP_068"),
    },
    "effort_covariate2_pa": {"area": ("UP_010", "UP_011")},
}

SCALED = {
    "fire_speed_log": "fire_speed_z",
    "days_since_fire_log": "days_since_fire_z",
    "ts_fire_model": "ts_fire_z",
    "unburnt5_model": "unburnt5_z",
    "mean_temp_model": "mean_temp_z",
    "mean_rainfall_model": "mean_rainfall_z",
    "drought_spi_model": "drought_spi_z",
    "natural_env_5km_model": "natural_env_5km_z",
    "log_effort_pa": "log_effort_pa_z",
    "log_effort2_pa": "log_effort2_pa_z",
    "log_effort_offset_abundance": "log_effort_offset_abundance_z",
    "log_effort_covariate_abundance": "log_effort_covariate_abundance_z",
    "log_effort_covariate2_abundance": "log_effort_covariate2_abundance_z",
}


def clean_dates(df: DataFrame, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """Both date columns parsed; ``order`` may come from ``dates.trained_order``."""
    return df.withColumns({c: parse_date(c, order) for c in ("date_survey", "date_previous_record")})


def fix_area(df: DataFrame) -> DataFrame:
    """One project recorded a constant area in two ways."""
    for project, area in FIXED_AREA.items():
        df = df.withColumn(
            "survey_area", if_else(F.col(PROJECT) == project, area, F.col("survey_area"))
        )
    return df


def clean_labels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "before_after_clean": squish("before_after"),
            "burnt_unburnt_clean": squish("burnt_unburnt"),
        }
    )


def coord_precision(df: DataFrame, digits: int = MIN_DECIMALS) -> DataFrame:
    """Rows with originally recorded coordinates of at least ``digits`` decimals."""
    df = df.withColumns(
        {"lat_decimals": n_decimals("latitude"), "lon_decimals": n_decimals("longitude")}
    )
    return complete_cases(
        df,
        ["latitude", "longitude"],
        F.col("latlongres") == "original",
        F.col("lat_decimals") >= digits,
        F.col("lon_decimals") >= digits,
    )


def burn_status(before_after: Column | str, burnt: Column | str) -> Column:
    """Before the fire everything is unburnt; afterwards the record decides."""
    before_after, burnt = as_col(before_after), as_col(burnt)
    after = before_after == "After Fire"
    return case_when(
        [
            (before_after == "Before Fire", "Unburnt"),
            (after & (burnt == "Burnt"), "Burnt"),
            (after & (burnt == "Unburnt"), "Unburnt"),
        ]
    )


def severity_clean(status: Column | str, severity: Column | str) -> Column:
    status = as_col(status)
    return case_when(
        [(status == "Unburnt", "Unburnt/None"), (status == "Burnt", as_col(severity))]
    )


def with_burn_status(df: DataFrame) -> DataFrame:
    """Flags, status, eligibility for a fire speed, and severity."""
    df = df.withColumns(
        {
            "is_before": F.col("before_after_clean") == "Before Fire",
            "is_after": F.col("before_after_clean") == "After Fire",
            "burn_status_clean": burn_status("before_after_clean", "burnt_unburnt_clean"),
        }
    )
    return df.withColumns(
        {
            "eligible_fire_speed": F.col("burn_status_clean") == "Burnt",
            "fire_severity_clean": severity_clean("burn_status_clean", "fire_severity"),
        }
    )


def with_location_key(df: DataFrame) -> DataFrame:
    """Rounded coordinates and the text key of a survey location."""
    df = df.withColumns(
        {
            "lat_r": round_even("latitude", KEY_DIGITS),
            "lon_r": round_even("longitude", KEY_DIGITS),
        }
    )
    return df.withColumn(
        "fired_key",
        paste_key(
            PROJECT, "site_name", "burn_status_clean", number_text("lat_r"), number_text("lon_r")
        ),
    )


def study_design(df: DataFrame) -> DataFrame:
    """Before/after-control/impact label; rows without one are dropped."""
    status = F.col("burn_status_clean")
    before, unburnt, burnt = STUDY_DESIGN_LEVELS
    label = case_when(
        [
            (F.col("is_before"), before),
            (F.col("is_after") & (status == "Burnt"), burnt),
            (F.col("is_after") & (status == "Unburnt"), unburnt),
        ]
    )
    return (
        df.withColumn("study_design", label)
        .filter(F.col("study_design").isNotNull())
        .withColumn("study_design_code", level_code("study_design", STUDY_DESIGN_LEVELS))
    )


def with_site_id(df: DataFrame) -> DataFrame:
    """Site names repeat between projects, so the project is part of the id."""
    return df.withColumn("site_id", paste_key(PROJECT, "site_name"))


def gate_measures(df: DataFrame) -> DataFrame:
    """Fire measures only for eligible rows; a control row has none."""
    eligible = F.col("eligible_fire_speed")
    return df.withColumns(
        {
            "fire_speed": if_else(eligible, F.col("dy_ar_km2"), F.lit(None).cast("double")),
            "fire_event_growth_rate": if_else(
                eligible, F.col("fsr_km2_dy"), F.lit(None).cast("double")
            ),
            "fire_daily_area_km2": if_else(
                eligible, F.col("dy_ar_km2"), F.lit(None).cast("double")
            ),
            "has_fire_speed": eligible & F.col("dy_ar_km2").isNotNull(),
        }
    )


def with_timing(df: DataFrame) -> DataFrame:
    """Days since the burn, raw and clamped, and the timing class."""
    eligible = F.col("eligible_fire_speed")
    df = df.withColumn("days_since_fire_raw", days_since("date_survey", "burn_date", eligible))
    return df.withColumns(
        {
            "days_since_fire": clamp_days("days_since_fire_raw", eligible),
            "timing_rel_fire": timing_class("days_since_fire_raw", eligible),
        }
    )


def rule_filter(df: DataFrame) -> DataFrame:
    """Rows of included projects that pass their project's text rule.

    A missing text fails the rule, but only in the projects that have one.
    """
    text = F.col("response_variable_text")
    keep = F.col("include_pa") | F.col("include_abundance")
    for project, regex in TEXT_RULES.items():
        keep = keep & ~((F.col(PROJECT) == project) & ~text_matches(lower(text), regex))
    for project, wanted in EXACT_TEXT_RULES.items():
        keep = keep & ~((F.col(PROJECT) == project) & (text != wanted))
    return df.filter(keep)


def rebuild_counts(df: DataFrame) -> DataFrame:
    """Counts behind recorded rates, indices and texts."""
    project, value = F.col(PROJECT), F.col("response_value")
    return df.withColumn(
        "response_count",
        case_when(
            [
                (project.isin(*COUNT_TIMES_TRAPS), round_even(value * F.col("survey_effort_traps"))),
                (
                    project.isin(*COUNT_TIMES_KM),
                    round_even(value * (F.col("survey_area") / METRES_PER_KM)),
                ),
                (project.isin(*COUNT_FROM_TEXT), safe_num("response_variable_text")),
                (project.isin(*COUNT_DOUBLED), value * 2),
            ],
            value,
        ),
    )


def presence(df: DataFrame) -> DataFrame:
    """Presence: recorded 0/1 responses keep a missing value, derived ones give 0."""
    recorded = (F.col("response_value") > 0).cast("int")
    derived = F.coalesce(F.col("response_count") > 0, F.lit(False)).cast("int")
    return df.withColumn(
        "response_pa",
        F.when(is_in("response_type", RAW_BINARY_TYPES), recorded).otherwise(derived),
    )


def assign_effort(df: DataFrame) -> DataFrame:
    """Five effort columns; missing or non-positive effort is 1."""
    measures = {
        "hours": F.col("survey_effort_hours"),
        "traps": F.col("survey_effort_traps"),
        "area": F.col("survey_area"),
        "km": F.col("survey_area") / METRES_PER_KM,
    }
    made = {}
    for name, uses in EFFORT.items():
        branches = [(F.col(PROJECT).isin(*ids), measures[m]) for m, ids in uses.items()]
        made[name] = positive_or_one(case_when(branches, F.lit(1.0)))
    return df.withColumns(made)


def required_effort(df: DataFrame) -> DataFrame:
    """Drop rows of projects that need hours of effort and lack them."""
    needs = is_in(PROJECT, EFFORT_REQUIRED) & F.col("include_pa")
    return df.filter(~(needs & F.col("survey_effort_hours").isNull()))


def matched_only(df: DataFrame) -> DataFrame:
    """Drop eligible rows without a fire speed."""
    return df.filter(~F.col("eligible_fire_speed") | F.col("has_fire_speed"))


def model_columns(df: DataFrame) -> DataFrame:
    """Model versions of the measures, their logs, and z-scores over the whole table."""
    matched = F.col("eligible_fire_speed") & F.col("has_fire_speed")
    df = df.withColumns(
        {
            "fire_speed_model": if_else(matched, F.col("fire_speed"), F.lit(None).cast("double")),
            "days_since_fire_model": if_else(
                matched, F.col("days_since_fire"), F.lit(None).cast("int")
            ),
            "fire_severity_model": F.when(
                matched, limit_levels("fire_severity_clean", SEVERITY_LEVELS)
            ),
            "ts_fire_model": drop_sentinel("ts_fire", NEVER_BURNT).cast("double"),
            "no_fires_model": limit_levels("no_fires", FIRE_COUNT_LEVELS),
            "unburnt5_model": if_else(matched, F.col("unburnt5"), F.lit(None).cast("double")),
            "mean_temp_model": F.col("mean_temp_final"),
            "mean_rainfall_model": F.col("mean_rainfall_final"),
            "drought_spi_model": F.col("drought_spi_final"),
            "natural_env_5km_model": F.col("disturb_landuse_final_5km_pc_naturalenv"),
        }
    )
    df = df.withColumns(
        {
            "fire_speed_log": safe_log("fire_speed_model"),
            "days_since_fire_log": safe_log1p("days_since_fire_model"),
            "log_effort_pa": safe_log("effort_covariate_pa"),
            "log_effort2_pa": safe_log("effort_covariate2_pa"),
            "log_effort_offset_abundance": safe_log("effort_offset_abundance"),
            "log_effort_covariate_abundance": safe_log("effort_covariate_abundance"),
            "log_effort_covariate2_abundance": safe_log("effort_covariate2_abundance"),
        }
    )
    return zscore(df, SCALED)


def pa_table(clean: DataFrame) -> DataFrame:
    """Presence/absence model table."""
    return clean.filter(F.col("include_pa")).withColumn("model_response", F.col("response_pa"))


def abundance_table(clean: DataFrame) -> DataFrame:
    """Abundance model table; a fractional response is rounded, ties to even."""
    count = F.col("response_count")
    return clean.filter(F.col("include_abundance")).withColumn(
        "model_response", if_else(is_whole(count), count, round_even(count))
    )


MODEL_KEYS = (
    "model_response", "study_design", PROJECT, "site_id", "species", "broad_taxon", "ecosystem_group",
)
EFFORT_TERMS = {
    "pa": ("log_effort_pa_z", "log_effort2_pa_z"),
    "abundance": (
        "log_effort_offset_abundance",
        "log_effort_covariate_abundance_z",
        "log_effort_covariate2_abundance_z",
    ),
}


def complete_model_rows(table: DataFrame, kind: str) -> DataFrame:
    """Rows that have a response, every key and the effort terms of ``kind``."""
    table = complete_cases(table, [*MODEL_KEYS, *EFFORT_TERMS[kind]])
    if kind == "pa":
        return table
    return table.filter(F.col("model_response") >= 0).withColumn(
        "model_response", round_even("model_response").cast("int")
    )


def burnt_table(model: DataFrame) -> DataFrame:
    """Burnt rows with speed, days and severity."""
    return complete_cases(
        model,
        ["fire_speed_z", "days_since_fire_z", "fire_severity_model"],
        F.col("study_design") == "After_Burnt",
    ).withColumn("fire_severity_code", level_code("fire_severity_model", SEVERITY_LEVELS))


def rescale_burnt(burnt: DataFrame) -> DataFrame:
    """Refuge and drought scores scaled again on the burnt rows alone."""
    burnt = burnt.withColumn("unburnt5_log", safe_log1p("unburnt5"))
    return zscore(burnt, {"unburnt5_log": "unburnt5_z", "drought_spi_final": "drought_spi_z"})
