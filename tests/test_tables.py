"""Aggregates, encoding, audits, sources."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import aggregates as agg
from emberline.operators import audit, encode
from emberline.operators import relational as rel
from emberline.session import scratch_path
from emberline.sources import rules, tables


def test_rule_counts(spark):
    df = rules.project_rules(spark)
    assert df.count() == 62
    assert df.filter("include_pa and include_abundance").count() == 26
    assert df.filter("include_pa and not include_abundance").count() == 23
    assert df.filter("not include_pa").count() == 13
    assert audit.rules_consistent(df).count() == 0


@pytest.mark.parametrize("by", [None, "k"])
@pytest.mark.parametrize("ranges", [3, 256])
def test_quantile_equals_numpy(spark, monkeypatch, by, ranges):
    monkeypatch.setattr(agg, "RANGES", ranges)
    rng = random.Random(1)
    rows = [(f"k{i % 3}", rng.choice([rng.gauss(0, 100), 5.0, rng.expovariate(0.001)])) for i in range(30000)]
    rows += [("k0", None)] * 10
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.0, 0.25, 0.97, 1.0):
        got = {(r["k"] if by else None): r["q"] for r in agg.quantile(df, "v", p, by).collect()}
        for k in {r[0] for r in rows} if by else [None]:
            vals = [v for kk, v in rows if v is not None and (k is None or kk == k)]
            assert got[k] == pytest.approx(np.quantile(vals, p), rel=1e-12)


def test_n_distinct_counts_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert df.agg(agg.n_distinct("v")).first()[0] == 2


def test_lump_boundary(spark):
    rows = [(c,) for c, n in (("a", 99), ("b", 100), ("c", 101)) for _ in range(n)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    got = {r["t"]: r["count"] for r in encode.lump_min(df, "t").groupBy("t").count().collect()}
    assert got == {"Other": 99, "b": 100, "c": 101, None: 1}


@pytest.mark.parametrize("buckets", [1, 2, 7, 256])
def test_ordered_levels(spark, buckets):
    values = sorted({f"s{i * 37 % 101}" for i in range(150)})
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "v string")
    got = {r["v"]: r["level_index"] for r in rel.ordered_levels(df, "v", buckets).collect()}
    assert got == {v: i + 1 for i, v in enumerate(values)}


def test_group_zscore_of_one_row_and_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0)], "g string, v double")
    got = [r["response_std"] for r in agg.group_zscore(df, "v", ["g"]).orderBy("g", "v").collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(-(0.5**0.5))


def test_zscore_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "a double, b double")
    rows = agg.zscore(df, {"a": "a_z", "b": "b_z"}).collect()
    assert {r["a_z"] for r in rows} == {None} and sum(r["b_z"] for r in rows) == 0


def test_csv_missing_rules(spark):
    df = spark.createDataFrame([("a", None, None), ("", 1.0, "x"), ("NA", float("nan"), "y,\"q\"")], "s string, v double, t string")
    path = tables.write_outputs({"t": df}, scratch_path(spark, "t"))
    back = tables.read_derived(spark, path["t.csv"], "s string, v double, t string")
    got = {r["t"]: (r["s"], r["v"]) for r in back.collect()}
    assert got == {None: ("a", None), "x": (None, 1.0), 'y,"q"': (None, None)}


def test_dotted_headers_are_renamed(spark):
    df = spark.createDataFrame([("UP_001", 999.0)], "unique_project_ID string, `ts.fire` double")
    path = scratch_path(spark, "dots")
    df.write.option("header", True).csv(path)
    assert tables.read_survey(spark, path).first().asDict() == {"unique_project_id": "UP_001", "ts_fire": 999.0}


def test_saved_fit_is_reused(spark):
    folder = scratch_path(spark, "fit")
    first = tables.save_fit({"coef": spark.range(3)}, folder)["coef"].count()
    again = tables.save_fit({"coef": spark.range(5)}, folder)["coef"].count()
    assert (first, again) == (3, 3)


def test_audits_raise(spark):
    df = spark.createDataFrame([("UP_1", 2), ("UP_1", None)], "unique_project_id string, model_response int")
    with pytest.raises(audit.AuditError):
        audit.require_empty(audit.bad_pa(df), "bad")
    audit.require_empty(audit.bad_pa(df.filter("false")), "bad")
    with pytest.raises(audit.AuditError):
        audit.require_zero(df.agg(F.count_if(F.col("model_response") > 1).alias("n")), "bad")


def test_top_flag_marks_exactly_n(spark):
    df = spark.range(50).withColumn("v", F.lit(1.0))
    assert rel.flag_top(df, "v", "id", 10).filter("top_100").count() == 10


def test_union_prefers_containment(spark):
    exact = spark.createDataFrame([("a", "intersect", 1)], "fired_key string, match_type string, fire_id int")
    near = spark.createDataFrame([("a", "nearest_1km", 2, 5.0), ("b", "nearest_1km", 3, 6.0)], "fired_key string, match_type string, fire_id int, nearest_dist_m double")
    got = {r["fired_key"]: (r["fire_id"], r["nearest_dist_m"]) for r in rel.union_matches(exact, near).collect()}
    assert got == {"a": (1, None), "b": (3, 6.0)}
