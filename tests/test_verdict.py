"""Cases that went wrong once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions.dates import parse_date
from emberline.models import compare
from emberline.models import fit as models
from emberline.operators import aggregates as agg
from emberline.operators import relational as rel
from emberline.operators import spatial
from emberline.operators.encode import Formula, design_matrix, lump_min
from emberline.sources import polygons, rules, tables


def test_unknown_levels_are_dropped_not_merged_with_the_reference(spark):
    rows = [(1, "low", 2.0), (0, "high", 3.0), (1, "not recorded", 4.0), (1, None, 5.0)]
    df = spark.createDataFrame(rows, "y int, sev string, size double")
    got = design_matrix(df, Formula("y", ["sev", "size"], {"sev": ["low", "high"]})).collect()
    assert sorted(tuple(r.x) for r in got) == [(1.0, 0.0, 2.0), (1.0, 1.0, 3.0)]


def test_models_scored_on_different_rows_cannot_be_compared(spark):
    score = lambda ids: spark.createDataFrame([(str(i), -1.0) for i in ids], "obs string, elpd double")
    assert compare.loo_compare({"a": score(range(5)), "b": score(range(5))}).count() == 2
    for other in (range(3), range(1, 6), [0, 1, 2, 3, 4, 4]):
        with pytest.raises(ValueError, match="different observations"):
            compare.loo_compare({"a": score(range(5)), "b": score(other)})


def test_a_fit_that_has_not_settled_is_an_error(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(2)), float(rng.normal()), f"g{rng.integers(5)}") for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, x double, g string")
    with pytest.raises(RuntimeError, match="did not settle"):
        models.fit(df, Formula("y", ["x"], groups=("g",)), max_cycles=1)
    loose = models.fit(df, Formula("y", ["x"], groups=("g",)), max_cycles=1, strict=False)
    assert not loose.converged
    assert {r.name: r.value for r in models.scale_table(loose).collect()}["converged"] == 0.0


@pytest.mark.parametrize(
    "text, day",
    [
        ("1/2/20", "2020-01-02"), ("13/1/20", "2020-01-13"), ("12 Jan 2020", "2020-01-12"), ("Jan 12, 2020", "2020-01-12"),
        ("20200112", "2020-01-12"), ("2020-1-12", "2020-01-12"), ("12th January 2020", "2020-01-12"), ("1/2/75", "1975-01-02"),
        ("2020 March 5", "2020-03-05"), ("unknown", None), ("", None), (None, None), ("31/31/2020", None),
    ],
)
def test_date_forms(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(parse_date("t").cast("string")).first()[0]
    assert got == day


def test_survey_text_may_hold_line_breaks_and_unknown_columns_stay(spark, tmp_path):
    path = str(tmp_path / "survey.csv")
    with open(path, "w") as f:
        f.write('unique_project_id,response_variable_text,response_value,no.burns\nUP_1,"two\nlines, one ""row""",3.5,2\nUP_2,plain,NA,NA\n')
    got = [tuple(r) for r in tables.read_survey(spark, path).collect()]
    assert got == [("UP_1", 'two\nlines, one "row"', 3.5, "2"), ("UP_2", "plain", None, None)]
    df = tables.read_survey(spark, path)
    written = tables.write_outputs({"t": df}, str(tmp_path / "out"), "csv")
    again = tables.read_survey(spark, written["t.csv"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_the_rule_table(spark):
    got = rules.project_rules(spark)
    count = lambda c: got.filter(c).count()
    assert got.count() == 62
    assert (count("include_pa and include_abundance"), count("include_pa and not include_abundance"), count("not include_pa")) == (26, 23, 13)
    row = {r.unique_project_id: tuple(r)[1:] for r in got.collect()}
    assert row["UP_010"] == (True, True, "survey_area + survey_effort_hours", "covariate", "count")
    assert row["UP_003"] == (False, False, None, "none", "other")


def test_small_aggregates_do_not_shuffle_the_detail_rows(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("k"), F.rand(1).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (lump_min(df, "k"), agg.group_zscore(df, "v", ["k"]), rel.day_index(df, "k", "id")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize("hot", [3, 10**6])
def test_cells_hot_by_edges_or_points_are_divided(spark, hot):
    polys = [(k, f"POLYGON (({c + 50} {c}, {c} {c + 50}, {c - 50} {c}, {c} {c - 50}, {c + 50} {c}))") for k in range(12) for c in [100 + k]]
    layer = spark.createDataFrame(polys, "poly_ord int, wkt string")
    layer = layer.withColumns({"date_day": F.lit("2020-01-01").cast("date"), "id": F.col("poly_ord"), "did": F.lit("d"), "fsr_km2_dy": F.lit(1.0), "dy_ar_km2": F.lit(1.0)})
    prepared = spatial.prepare_polygons(polygons.read_polygons(layer))
    pts = [(f"p{i}", 90.0 + i, 100.0 + (i % 5)) for i in range(40)]
    points = spark.createDataFrame(pts, "fired_key string, x double, y double")
    got = {(r.fired_key, r.poly_ord) for r in spatial.pip_join(points, prepared, hot_rows=hot).collect()}
    want = {(n, k) for n, x, y in pts for k in range(12) if abs(x - 100 - k) + abs(y - 100 - k) <= 50}
    assert got == want


def test_overall_interval_counts_known_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "v double")
    row = agg.mean_ci(df, "v").first()
    assert row.n == 3 and row.se == pytest.approx(np.std([1, 2, 4], ddof=1) / math.sqrt(3))


def test_helpers_without_a_query(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 5, 4.0)], "k string, day int, v double")
    assert sorted(tuple(r) for r in rel.first_day_rows(df, "k", "day").collect()) == [("a", 1, 1.0), ("a", 1, 2.0), ("b", 5, 4.0)]
    layer = polygons.read_polygons(spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "id int, wkt string"))
    assert polygons.drop_geometry(layer).columns == ["id"] or "geom" not in polygons.drop_geometry(layer).columns


def test_scratch_folder_belongs_to_the_session(spark):
    from emberline.session import materialize

    a, b = (materialize(spark.range(3), "t").stored_at for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
