"""The per-project rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import RULE_SCHEMA
from .tables import read_derived

# The reviewed projects. Columns: project, in the presence data,
# in the abundance data, effort columns used, use of effort, kind of response.
# The review's remarks are prose and belong in the user's own rule file, which
# project_rules(path=...) reads.
PROJECT_RULES = (
    ("UP_003", False, False, None, "none", "other"),
    ("UP_004", True, False, "survey_effort_traps", "none", "binary_derived_from_index"),
    ("UP_005", True, True, "survey_area", "offset_abundance_covariate_pa", "count"),
    ("UP_006", True, True, "none", "none", "count"),
    ("UP_007", True, True, "survey_effort_hours", "offset_abundance_covariate_pa", "count"),
    ("UP_008", True, True, "none", "none", "count"),
    ("UP_010", True, True, "survey_area + survey_effort_hours", "covariate", "count"),
    ("UP_011", True, True, "survey_area + survey_effort_hours", "covariate", "count"),
    ("UP_012", False, False, None, "none", "other"),
    ("UP_013", False, False, None, "none", "other"),
    ("UP_014", True, True, "none", "none", "count_activity"),
    ("UP_015", False, False, None, "none", "other"),
    ("UP_017", False, False, None, "none", "other"),
    ("UP_018", True, False, "survey_effort_hours", "covariate", "binary_raw"),
    ("UP_020", True, False, "survey_effort_traps", "covariate", "binary_raw"),
    ("UP_021", True, False, "survey_effort_traps", "covariate", "binary_raw"),
    ("UP_024", True, True, "none", "none", "count"),
    ("UP_025", False, False, None, "none", "other"),
    ("UP_026", True, False, "none", "none", "binary_raw"),
    ("UP_027", False, False, None, "none", "other"),
    ("UP_028", True, False, "none", "none", "binary_derived"),
    ("UP_029", True, False, "none", "none", "binary_raw"),
    ("UP_030", True, False, "survey_effort_traps", "covariate", "binary_derived"),
    ("UP_031", True, False, "survey_effort_hours", "covariate", "binary_raw"),
    ("UP_032", True, True, "none", "none", "count_activity"),
    ("UP_034", True, False, "none", "none", "binary_derived"),
    ("UP_036", True, True, "none", "none", "count_activity"),
    ("UP_037", True, False, "none", "none", "binary_derived"),
    ("UP_039", False, False, None, "none", "other"),
    ("UP_040", True, True, "survey_area", "offset_abundance_covariate_pa", "count_reconstructed"),
    ("UP_041", False, False, None, "none", "other"),
    ("UP_042", True, False, "none", "none", "binary_derived"),
    ("UP_043", True, True, "none", "none", "count"),
    ("UP_045", False, False, None, "none", "other"),
    ("UP_046", True, False, "none", "none", "binary_raw"),
    ("UP_048", True, False, "none", "none", "binary_derived"),
    ("UP_050", False, False, None, "none", "cover"),
    ("UP_051", True, False, "none", "none", "binary_derived"),
    ("UP_052", True, False, "none", "none", "binary_raw"),
    ("UP_053", True, False, "none", "none", "binary_raw"),
    ("UP_055", False, False, None, "none", "unknown"),
    ("UP_056", True, True, "none", "none", "count"),
    ("UP_059", True, True, "none", "none", "count_activity"),
    ("UP_060", True, False, "survey_effort_traps", "covariate", "binary_raw"),
    ("UP_061", True, False, "none", "none", "binary_raw"),
    ("UP_062", True, True, "none", "none", "count"),
    ("UP_065", True, True, "survey_area", "offset_abundance_covariate_pa", "count"),
    ("UP_066", True, False, "survey_effort_hours", "covariate", "binary_raw"),
    ("UP_067", True, True, "survey_effort_hours", "covariate", "count_detection"),
    ("UP_068", True, True, "survey_area", "offset_abundance_covariate_pa", "count_reconstructed"),
    ("UP_069", True, True, "none", "none", "count_reconstructed"),
    ("UP_070", True, True, "survey_effort_traps", "offset_abundance_covariate_pa", "count_reconstructed_activity"),
    ("UP_071", True, False, "none", "none", "binary_raw"),
    ("UP_074", True, False, "none", "none", "binary_raw"),
    ("UP_075", True, True, "none", "none", "count_detection"),
    ("UP_078", True, True, "none", "none", "count"),
    ("UP_079", True, False, "survey_effort_hours", "covariate", "binary_derived"),
    ("UP_080", False, False, None, "none", "other"),
    ("UP_082", True, True, "survey_effort_traps", "offset_abundance_covariate_pa", "count_detection_frequency"),
    ("UP_083", True, True, "survey_effort_traps", "offset_abundance_covariate_pa", "count_activity"),
    ("UP_084", True, True, "none", "none", "count_time_standardized"),
    ("UP_085", True, True, "none", "none", "count_time_standardized"),
)


def project_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row per project: the built-in table, or a CSV of the same columns."""
    if path is not None:
        return read_derived(spark, path, RULE_SCHEMA)
    return spark.createDataFrame(PROJECT_RULES, RULE_SCHEMA)
