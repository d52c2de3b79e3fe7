"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

SURVEY_SCHEMA = """
    unique_project_id string, project_name string, site_name string,
    survey_method string, survey_effort_text string,
    survey_effort_hours double, survey_effort_traps double, survey_area double,
    response_variable string, response_variable_text string, response_units string,
    response_value double, broad_taxon string, species string, ecosystem_group string,
    date_survey string, date_previous_record string,
    before_after string, burnt_unburnt string,
    latitude double, longitude double, latlongres string, fire_severity string,
    ts_fire double, no_fires string, unburnt5 double,
    mean_temp_final double, mean_rainfall_final double, drought_spi_final double,
    disturb_landuse_final_5km_pc_naturalenv double
"""

RULE_SCHEMA = """
    unique_project_id string, include_pa boolean, include_abundance boolean,
    effort_variable string, effort_use_type string, response_type string
"""
