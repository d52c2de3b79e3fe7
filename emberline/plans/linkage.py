"""Survey and polygons to model tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, survey
from ..operators.aggregates import count_by, match_rate
from ..operators.relational import join_metrics, join_rules, time_window
from ..operators.spatial import burnt_locations, match_locations, prepare_polygons
from ..session import brief_shuffles, discard, materialize
from ..sources.polygons import read_polygons, spread

# The study season, both days included.
WINDOW = ("2019-06-01", "2020-05-31")


@dataclass
class ModelTables:
    master: DataFrame
    pa: DataFrame
    abundance: DataFrame
    pa_summary: DataFrame
    abundance_summary: DataFrame
    match_summary: DataFrame


def clean_survey(obs: DataFrame, dates: bool = True) -> DataFrame:
    """Dates, labels, precise coordinates, burn status and location key.

    Stored, because the locations and the join-back both read it, and because
    filters on the derived labels would otherwise repeat the text cleaning many
    times per row when the optimizer pushes them down.
    """
    if dates:
        obs = survey.clean_dates(obs)
    obs = survey.clean_labels(survey.fix_area(obs))
    obs = survey.with_burn_status(survey.coord_precision(obs))
    return materialize(survey.with_location_key(obs), "survey")


def polygons_in_season(
    polys: DataFrame, window: tuple[str, str] = WINDOW, wkt_col: str = "wkt"
) -> DataFrame:
    """Polygons of the season, parsed and stored.

    ``polys`` is the raw layer: filtering it before parsing lets the window reach
    the scan.
    """
    season = time_window(polys, "date_day", *window)
    return prepare_polygons(read_polygons(spread(season), wkt_col))


def match_survey(base: DataFrame, polys: DataFrame, last: bool = False) -> DataFrame:
    """Fire measures, timing and design for every cleaned survey row.

    Matching runs on distinct locations, which are stored first because several
    steps read them; the matches are joined back to the rows. Only the matches
    stay: the locations and the shuffle files go, and with ``last`` the polygons.
    """
    spark = base.sparkSession
    with brief_shuffles(spark):
        points = materialize(burnt_locations(base), "locations")
        metrics = materialize(match_locations(points, polys), "matches")
    for table in (points, polys) if last else (points,):
        discard(spark, table.stored_at)
    out = survey.gate_measures(join_metrics(base, metrics))
    out = survey.study_design(survey.with_timing(out))
    return survey.with_site_id(out)


def clean_responses(master: DataFrame) -> DataFrame:
    """Row rules, counts, presence, effort and the drops that follow from them."""
    out = survey.presence(survey.rebuild_counts(survey.rule_filter(master)))
    out = survey.required_effort(survey.assign_effort(out))
    return survey.matched_only(out)


def model_tables(
    base: DataFrame, polys: DataFrame, rules: DataFrame, keep: Sequence[str] = (), last: bool = False
) -> ModelTables:
    """The six result tables. ``base`` has planar ``x``, ``y``; ``polys`` is prepared.

    Of the cleaned rows the columns ``keep`` are stored, or all; ``last`` says that
    nothing else will read the polygons.
    """
    master = join_rules(match_survey(base, polys, last), rules)
    # Read by the z-score moments and by both model tables.
    clean = clean_responses(master)
    with brief_shuffles(base.sparkSession):
        clean = materialize(clean.select(*keep) if keep else clean, "clean")
    model = survey.model_columns(clean)
    pa, abundance = survey.pa_table(model), survey.abundance_table(model)
    keys = (survey.PROJECT, "project_name", "response_type")
    return ModelTables(
        master=master,
        pa=pa,
        abundance=abundance,
        pa_summary=count_by(pa, *keys, name="n_pa_rows"),
        abundance_summary=count_by(abundance, *keys, name="n_abundance_rows"),
        match_summary=match_rate(master),
    )


def check_tables(tables: ModelTables, rules: DataFrame) -> None:
    """Stop on bad responses, bad effort or inconsistent rules."""
    audit.require_empty(audit.bad_pa(tables.pa), "presence responses that are not 0 or 1")
    audit.require_empty(audit.bad_abundance(tables.abundance), "bad abundance responses")
    pa_effort = ["effort_covariate_pa", "effort_covariate2_pa"]
    audit.require_zero(audit.effort_positive(tables.pa, pa_effort), "effort not above zero")
    effort = [c for c in survey.EFFORT if c.endswith("_abundance")]
    audit.require_zero(audit.effort_positive(tables.abundance, effort), "effort not above zero")
    audit.require_empty(audit.rules_consistent(rules), "abundance projects outside the presence data")


def burnt_tables(table: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Model rows of ``kind`` and their burnt subset, scaled again where needed."""
    from ..operators.encode import lump_min

    rows = materialize(lump_min(survey.complete_model_rows(table, kind), "broad_taxon"), "model")
    return rows, survey.rescale_burnt(survey.burnt_table(rows))
