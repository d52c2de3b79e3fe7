"""Traps in scalar functions, on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import category, conditional, dates, numeric, text
from emberline.operators import survey


def one(spark, c, **values):
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean", dt.date: "date"}
    cols = {k: F.lit(v) if v is not None else F.lit(None) for k, v in values.items()}
    for k, v in values.items():
        if type(v) in kinds:
            cols[k] = cols[k].cast(kinds[type(v)])
    return spark.range(1).select(*[c_.alias(k) for k, c_ in cols.items()]).select(c.alias("r")).first()["r"]


@pytest.mark.parametrize("cond,want", [(True, "a"), (False, "b"), (None, None)])
def test_strict_if_else(spark, cond, want):
    c = conditional.if_else(F.lit(cond).cast("boolean"), "a", "b")
    assert one(spark, c, z=1) == want


def test_case_when_null_condition_is_false(spark):
    c = conditional.case_when([(F.lit(None).cast("boolean"), "x"), (F.lit(True), "y")], "z")
    assert one(spark, c, z=1) == "y"


def test_membership_of_null_is_false(spark):
    assert one(spark, conditional.is_in(F.lit(None).cast("string"), ["a"]), z=1) is False


@pytest.mark.parametrize("v,want", [(None, 1.0), (-2.0, 1.0), (0.0, 1.0), (2.5, 2.5)])
def test_positive_or_one(spark, v, want):
    assert one(spark, conditional.positive_or_one(F.lit(v).cast("double")), z=1) == want


@pytest.mark.parametrize(
    "v,want",
    [("12d", None), ("0x1A", 26.0), (" 7 ", 7.0), ("1e3", 1000.0), ("", None), (None, None),
     (".5", 0.5), ("5.", 5.0), ("-3", -3.0), ("n/a", None), ("1 2", None)],
)
def test_safe_num(spark, v, want):
    assert one(spark, text.safe_num(F.lit(v).cast("string")), z=1) == want


@pytest.mark.parametrize("v,want", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (-2.5, -2.0)])
def test_round_even(spark, v, want):
    assert one(spark, numeric.round_even(F.lit(v)), z=1) == want


@pytest.mark.parametrize("v,want", [(-33.120, 2), (-33.1201, 4), (33.0, 0), (1e-4, 4), (None, 0)])
def test_n_decimals(spark, v, want):
    assert one(spark, text.n_decimals(F.lit(v).cast("double")), z=1) == want


def test_paste_key_writes_missing_parts(spark):
    c = text.paste_key(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))
    assert one(spark, c, z=1) == "a__NA__b"


def test_squish(spark):
    assert one(spark, text.squish(F.lit("  Before \t  Fire ")), z=1) == "Before Fire"


def test_lookup(spark):
    assert one(spark, text.lookup(F.lit(5), {"5": "five"}), z=1) == "five"
    assert one(spark, text.lookup(F.lit(6), {"5": "five"}), z=1) is None


@pytest.mark.parametrize(
    "v,want",
    [("3/4/2020", dt.date(2020, 3, 4)), ("25/4/2020", dt.date(2020, 4, 25)), ("2020-12-31", dt.date(2020, 12, 31)),
     ("31.12.2020", dt.date(2020, 12, 31)), ("unknown", None), ("", None), (None, None), ("2/30/2020", None)],
)
def test_parse_date(spark, v, want):
    assert one(spark, dates.parse_date(F.lit(v).cast("string")), z=1) == want


def test_trained_order_prefers_what_parses(spark):
    df = spark.createDataFrame([("25/4/2020",), ("26/4/2020",), ("3/4/2020",)], "d string")
    order = dates.trained_order(df, "d")
    assert order[0] == "dmy"
    got = [r[0] for r in df.select(dates.parse_date("d", order)).collect()]
    assert got[2] == dt.date(2020, 4, 3)


@pytest.mark.parametrize(
    "survey_day,want",
    [(dt.date(2020, 1, 5), (-5, 0, "Near_fire_date")), (dt.date(2020, 1, 10), (0, 0, "DayOf")),
     (dt.date(2020, 1, 12), (2, 2, "After")), (None, (None, None, None))],
)
def test_days_and_timing(spark, survey_day, want):
    df = spark.createDataFrame([(survey_day, dt.date(2020, 1, 10), True)], "date_survey date, burn_date date, eligible_fire_speed boolean")
    r = survey.with_timing(df).first()
    assert (r["days_since_fire_raw"], r["days_since_fire"], r["timing_rel_fire"]) == want


def test_logs_and_infinity(spark):
    assert one(spark, numeric.safe_log(F.lit(0.0)), z=1) is None
    assert one(spark, numeric.safe_log1p(F.lit(-1.0)), z=1) is None
    assert one(spark, numeric.finite_or_null(F.lit(float("inf"))), z=1) is None
    assert one(spark, numeric.finite_or_null(F.lit(float("nan"))), z=1) is None


@pytest.mark.parametrize("df,want", [(1, 12.7062047), (30, 2.0422725), (31, 2.0395134), (100, 1.9839715), (0, None)])
def test_t975(spark, df, want):
    got = one(spark, numeric.t975(F.lit(df)), z=1)
    assert got is None if want is None else math.isclose(got, want, rel_tol=1e-6)


def test_levels(spark):
    c = category.level_code(F.lit("1"), category.FIRE_COUNT_LEVELS)
    assert one(spark, c, z=1) == 2
    assert one(spark, category.level_code(F.lit("?"), category.FIRE_COUNT_LEVELS), z=1) is None
    assert category.relevel(["Ant", "Bird"], "Bird") == ["Bird", "Ant"]


@pytest.mark.parametrize(
    "before,burnt,want",
    [("Before Fire", "Burnt", "Unburnt"), ("After Fire", "Burnt", "Burnt"), ("After Fire", "Unburnt", "Unburnt"),
     ("After Fire", None, None), (None, "Burnt", None), ("Before Fire", None, "Unburnt")],
)
def test_burn_status(spark, before, burnt, want):
    c = survey.burn_status(F.lit(before).cast("string"), F.lit(burnt).cast("string"))
    assert one(spark, c, z=1) == want


def test_presence_and_missing(spark):
    rows = [("binary_raw", None, None), ("binary_raw", 2.0, 2.0), ("count", None, None), ("count", 3.0, 3.0), (None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "response_type string, response_value double, response_count double")
    assert [r["response_pa"] for r in survey.presence(df).collect()] == [None, 1, 0, 1, 0]


def test_text_rules_drop_missing_only_where_they_apply(spark):
    rows = [("UP_008", None), ("UP_008", "ALIVE trees"), ("UP_006", None), ("UP_062", "other"), ("UP_062", None)]
    df = spark.createDataFrame(rows, "unique_project_id string, response_variable_text string")
    df = df.withColumns({"include_pa": F.lit(True), "include_abundance": F.lit(True)})
    kept = [(r[0], r[1]) for r in survey.rule_filter(df).select("unique_project_id", "response_variable_text").collect()]
    assert kept == [("UP_008", "ALIVE trees"), ("UP_006", None)]


def test_dates_are_tried_only_by_patterns_of_their_shape(spark):
    """A pattern that cannot fit costs an exception a row; the odd texts give what trying all of them gave."""
    from emberline.functions import dates

    for order, patterns in dates.ORDERS.items():
        text = dates.parse_date("t", [order])._jc.toString()
        assert text.count("rlike(x") >= len(patterns)
    texts = ["1015 0030", "-20200102", "(2020/1/2", "12th January 2020", "5-jan-70", "unknown", "2/30/2020", "13/2/2020", "001/002/2020", "12345-1-2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(dates.parse_date("t").cast("string")).collect()]
    assert got == ["-0030-10-15", "-2020-01-02", "-2020-01-02", "2020-01-12", "1970-01-05", None, None, "2020-02-13", "2020-01-02", None]
    assert dates.trained_order(df.limit(1), "t")[0] == "mdy"
