"""The whole path on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import audit
from emberline.plans import linkage
from emberline.session import discard, materialize, scratch_path
from emberline.sources import polygons, rules, tables
from registry import standins


@pytest.fixture(scope="module")
def built(spark, sf_dir):
    base = linkage.clean_survey(standins.obs(spark, sf_dir), dates=False)
    base = polygons.with_point(base, "px", "py")
    layer = linkage.polygons_in_season(standins.polys(spark, sf_dir))
    return base, linkage.model_tables(base, layer, rules.project_rules(spark))


def test_rows_are_neither_lost_nor_multiplied(built):
    base, result = built
    assert result.master.count() == base.filter("burn_status_clean is not null").count()
    matched = result.master.filter("match_type is not null")
    assert matched.count() > 0 and matched.filter("not eligible_fire_speed").count() == 0


def test_controls_have_no_fire_measures(built):
    _, result = built
    controls = result.master.filter("not eligible_fire_speed")
    row = controls.agg(F.count("fire_speed").alias("a"), F.count("days_since_fire").alias("b")).first()
    assert (row["a"], row["b"]) == (0, 0)
    assert result.pa.filter("eligible_fire_speed and fire_speed is null").count() == 0


def test_summaries_add_up(built):
    _, result = built
    assert result.pa_summary.agg(F.sum("n_pa_rows")).first()[0] == result.pa.count()
    assert result.abundance_summary.agg(F.sum("n_abundance_rows")).first()[0] == result.abundance.count()
    assert result.match_summary.filter("match_rate > 1").count() == 0


def test_checks_stop_on_missing_responses(spark, built):
    _, result = built
    with pytest.raises(audit.AuditError):
        linkage.check_tables(result, rules.project_rules(spark))


def test_outputs_are_written(spark, built):
    _, result = built
    small = {"pa_summary": result.pa_summary, "match_summary": result.match_summary}
    paths = tables.write_outputs(small, scratch_path(spark, "derived"))
    assert tables.read_derived(spark, paths["pa_summary.parquet"]).count() == result.pa_summary.count()


@pytest.mark.parametrize("name", ["master", "match_summary", "model_tables"])
def test_whole_path_keeps_what_is_read_again_and_no_more(spark, sf_dir, name, monkeypatch):
    import __spark_entry__ as entry
    from emberline.operators import spatial
    from registry import queries

    stored, gone = {}, []

    def kept(df, what="table"):
        stored[what] = materialize(df, what)
        return stored[what]

    for module in (queries, linkage, spatial):
        monkeypatch.setattr(module, "materialize", kept)
    monkeypatch.setattr(linkage, "discard", lambda spark, path: gone.append(path) or discard(spark, path))
    result = entry.queries()[name](spark, sf_dir)
    unread = {"latitude", "longitude", "date_text", "before_after", "survey_method", "px", "py", "fire_severity"}
    assert all(unread.isdisjoint(stored[t].columns) for t in ("survey", "clean"))
    assert "geom" not in stored["polygons"].columns and "fired_key" not in stored["clean"].columns
    assert set(gone) == {stored["locations"].stored_at, stored["polygons"].stored_at}
    # What went is not read again.
    assert result.count() > 0


def test_shuffle_files_of_the_match_go_with_its_queries(spark, monkeypatch):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(linkage, "match_locations", lambda p, _: seen.append(spark.conf.get(key)) or p.withColumns(
        {c: F.lit(None).cast("double") for c in ("dy_ar_km2", "fsr_km2_dy")} | {"burn_date": F.lit("2020-01-01").cast("date")}))
    row = ("UP_003", "s", "k", True, True, "Burnt", 1.0, 2.0)
    base = spark.createDataFrame([row], "unique_project_id string, site_name string, fired_key string, eligible_fire_speed boolean, is_after boolean, burn_status_clean string, x double, y double")
    base = base.withColumns({"is_before": F.lit(False), "date_survey": F.lit("2020-02-01").cast("date")})
    polys = materialize(spark.range(1), "polygons")
    assert linkage.match_survey(base, polys).count() == 1
    assert seen == ["true"] and spark.conf.get(key) == before
    assert polys.count() == 1
