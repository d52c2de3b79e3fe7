"""Geometry and spatial joins on hand-made rows and against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import geometry as g
from emberline.operators import spatial
from emberline.sources import polygons

SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
TWO = "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 10, 12 10, 12 10, 12 12, 10 12, 10 10)))"


def layer(spark, rows):
    """rows: (wkt, day, growth, area)"""
    data = [(i, f"d{i}", i, day, fsr, ar, w) for i, (w, day, fsr, ar) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "id bigint, did string, poly_ord bigint, date_day date, fsr_km2_dy double, dy_ar_km2 double, wkt string"
    )
    return spatial.prepare_polygons(polygons.read_polygons(df))


def points(spark, xy):
    return spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "fired_key string, x double, y double")


CASES = [
    (SQUARE, 1, 1, True), (SQUARE, 5, 5, False), (SQUARE, 10, 5, True), (SQUARE, 0, 0, True), (SQUARE, 4, 5, True),
    (SQUARE, 6, 6, True), (SQUARE, 11, 5, False), (SQUARE, -1, 0, False), (SQUARE, 2, 4, True), (SQUARE, 11, 10, False),
    (TWO, 1, 1, True), (TWO, 5, 5, False), (TWO, 11, 11, True), (TWO, 12, 10, True),
]


@pytest.mark.parametrize("wkt,x,y,want", CASES)
def test_covers(spark, wkt, x, y, want):
    df = spark.createDataFrame([(wkt, float(x), float(y))], "wkt string, x double, y double")
    df = df.withColumn("geom", g.parse_wkt("wkt"))
    assert df.select(g.st_covers("geom", "x", "y")).first()[0] is want
    day = dt.date(2020, 1, 1)
    pairs = spatial.pip_join(points(spark, [(x, y)]), layer(spark, [(wkt, day, 1.0, 1.0)]), cell_m=3)
    assert pairs.count() == int(want)


def test_area_and_centroid(spark):
    df = spark.createDataFrame([(SQUARE,), (TWO,), ("POLYGON EMPTY",), ("junk",)], "wkt string")
    got = [r[0] for r in df.select(g.poly_area(g.parse_wkt("wkt"))).collect()]
    assert got == [96.0, 8.0, 0.0, None]
    m = df.limit(2).select(g.poly_moments(g.parse_wkt("wkt")).alias("m")).collect()
    assert (m[0]["m"]["mx"] / 96, m[0]["m"]["my"] / 96) == (5.0, 5.0)
    assert m[1]["m"]["mx"] / 8 == 6.0


def test_distance(spark):
    df = spark.createDataFrame([(SQUARE, 13.0, 14.0), (SQUARE, 5.0, 5.0), (SQUARE, 1.0, 1.0)], "wkt string, x double, y double")
    got = [r[0] for r in df.select(g.point_poly_dist(g.parse_wkt("wkt"), "x", "y")).collect()]
    assert got == [5.0, 1.0, 0.0]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(147.25, -36.5), (113.0, -10.0)], "lon double, lat double")
    x, y = g.to_sinusoidal("lon", "lat")
    lon, lat = g.to_wgs84("x", "y")
    for r in df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert math.isclose(r["lon"], r["lon2"], rel_tol=1e-12) and math.isclose(r["lat"], r["lat2"], rel_tol=1e-12)


def test_unknown_reference_system_is_refused(spark):
    df = spark.createDataFrame([(SQUARE,)], "wkt string")
    with pytest.raises(ValueError):
        polygons.read_polygons(df, crs="EPSG:3577")


def test_earliest_day_then_growth_then_area(spark):
    box = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    late, early = dt.date(2020, 1, 2), dt.date(2020, 1, 1)
    rows = [(box, late, None, 1.0), (box, late, 3.0, None), (box, late, 3.0, 2.0)]
    pts = points(spark, [(5, 5)])
    best = spatial.first_burn(pts, layer(spark, rows)).first()
    assert best["did"] == "d2" and best["match_type"] == "intersect"
    rows.append((box, early, 0.1, 0.1))
    assert spatial.first_burn(pts, layer(spark, rows)).first()["did"] == "d3"


def test_nearest_is_inclusive_at_the_limit(spark):
    box = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    day = dt.date(2020, 1, 1)
    pts = points(spark, [(1010, 5), (1010.001, 5), (5, -400), (5, 5)])
    near = {r["fired_key"]: r for r in spatial.recover_near(pts, layer(spark, [(box, day, 1.0, 1.0)])).collect()}
    assert set(near) == {"p0", "p2"}
    assert near["p0"]["nearest_dist_m"] == 1000.0 and near["p0"]["match_type"] == "nearest_1km"


def test_equally_near_takes_the_earlier_day(spark):
    a = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    b = "POLYGON ((30 0, 40 0, 40 10, 30 10, 30 0))"
    rows = [(a, dt.date(2020, 1, 2), 9.0, 9.0), (b, dt.date(2020, 1, 1), 1.0, 1.0)]
    near = spatial.recover_near(points(spark, [(20, 5)]), layer(spark, rows)).first()
    assert near["did"] == "d1" and near["nearest_dist_m"] == 10.0


def ring_wkt(rng, cx, cy, radius, n):
    pts = []
    for i in range(n):
        a = 2 * math.pi * i / n
        d = radius * rng.uniform(0.4, 1.0)
        pts.append((round(cx + d * math.cos(a)), round(cy + d * math.sin(a))))
    pts.append(pts[0])
    return pts, "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in pts) + "))"


def covers(ring, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            inside = not inside
    return inside


def seg(x1, y1, x2, y2, x, y):
    dx, dy = x2 - x1, y2 - y1
    t = 0 if dx == dy == 0 else max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


@pytest.mark.parametrize("hot", [200_000, 3])
def test_joins_equal_brute_force_over_mixed_sizes(spark, hot):
    """Polygons from metres to hundreds of kilometres, many cells, salted and not."""
    rng = random.Random(7)
    rings, rows = [], []
    day = dt.date(2020, 1, 1)
    for i in range(40):
        ring, w = ring_wkt(rng, rng.randint(-90000, 90000), rng.randint(-90000, 90000), rng.choice([300, 3000, 30000, 200000]), rng.choice([3, 9, 60]))
        rings.append(ring)
        rows.append((w, day + dt.timedelta(days=i % 5), float(i % 4), None))
    xy = [(rng.randint(-100000, 100000), rng.randint(-100000, 100000)) for _ in range(300)]
    xy += [rng.choice(rng.choice(rings)) for _ in range(60)]
    polys = layer(spark, rows)
    pts = points(spark, xy).dropDuplicates(["fired_key"])
    got = {(r["fired_key"], r["poly_ord"]) for r in spatial.pip_join(pts, polys, hot_rows=hot).collect()}
    want = {(f"p{i}", j) for i, (x, y) in enumerate(xy) for j, ring in enumerate(rings) if covers(ring, x, y)}
    assert got == want
    inside = {k for k, _ in want}
    near = {r["fired_key"]: r["nearest_dist_m"] for r in spatial.recover_near(pts, polys, hot_rows=hot).collect()}
    for i, (x, y) in enumerate(xy):
        key = f"p{i}"
        if key in inside:
            assert key not in near
            continue
        d = min(seg(*a, *b, x, y) for ring in rings for a, b in zip(ring, ring[1:]))
        assert (key in near) == (d <= 1000)
        if key in near:
            assert math.isclose(near[key], d, rel_tol=1e-9)


def test_nearest_polygon_equals_brute_force_however_far(spark):
    rng = random.Random(3)
    rings, rows = [], []
    for i in range(12):
        ring, w = ring_wkt(rng, rng.randint(-9000, 9000), rng.randint(-9000, 9000), rng.choice([50, 700]), rng.choice([3, 9]))
        rings.append(ring)
        rows.append((w, dt.date(2020, 1, 1) + dt.timedelta(days=i % 3), float(i), None))
    xy = [(rng.randint(-20000, 20000), rng.randint(-20000, 20000)) for _ in range(80)] + [(400_000, -300_000), (9_000, 2_000_000)]
    xy = [p for p in xy if not any(covers(ring, *p) for ring in rings)]
    polys = layer(spark, rows)
    for start in (10, 1000, 1e7):
        got = {r["fired_key"]: r for r in spatial.nearest_polygon(points(spark, xy), polys, start_m=start).collect()}
        assert len(got) == len(xy)
        for i, (x, y) in enumerate(xy):
            d = min(seg(*a, *b, x, y) for ring in rings for a, b in zip(ring, ring[1:]))
            assert math.isclose(got[f"p{i}"]["nearest_dist_m"], d, rel_tol=1e-9) and got[f"p{i}"]["match_type"] == "nearest"
    assert spatial.nearest_polygon(points(spark, xy), polys.limit(0)).count() == 0


def plan_rows(spark, df):
    """The plan that runs, with the final one of adaptive execution left out."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_dealt_again_after_the_cell_join(spark):
    box = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    polys = layer(spark, [(box, dt.date(2020, 1, 1), 1.0, 1.0)])
    plan = plan_rows(spark, spatial.pip_join(points(spark, [(5, 5)]), polys))
    above = plan.split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_first_burn_meets_few_pairs_where_polygons_lie_deep(spark, monkeypatch):
    """300 squares over each point, in rounds and in one go; repeated and missing keys end in one row."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        x, y = (i % 3) * 1000 + rng.randint(-5, 5), rng.randint(-5, 5)
        wkt = f"POLYGON (({x} {y}, {x + 100} {y}, {x + 100} {y + 100}, {x} {y + 100}, {x} {y}))"
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 3)) if i % 50 else None
        rows.append((wkt, day, rng.choice([None, 1.0, 2.0]), rng.choice([None, 5.0, 6.0])))
    polys = layer(spark, rows)
    data = [(f"p{i % 40}" if i % 9 else None, float((i % 4) * 1000 + rng.randint(-6, 106)), float(rng.randint(-6, 106))) for i in range(60)]
    pts = spark.createDataFrame([*data, ("nowhere", None, 1.0)], "fired_key string, x double, y double")
    met, pairs = [], spatial.pip_join

    def counted(*args, **how):
        found = pairs(*args, **how)
        met.append(found.count())
        return found

    whole = pairs(pts, polys)
    want = {tuple(r) for r in spatial.first_burn(pts, polys, pairs=whole).collect()}
    monkeypatch.setattr(spatial, "pip_join", counted)
    got = spatial.first_burn(pts, polys).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len(met) > 2 and sum(met) * 4 < whole.count()


def test_polygons_of_many_and_of_few_edges_meet_alike(spark, monkeypatch):
    rng = random.Random(5)
    rings = [ring_wkt(rng, rng.randint(-900, 900), rng.randint(-900, 900), 700, n) for n in (3, 8, 9, 40, 64, 65, 200)]
    polys = layer(spark, [(w, dt.date(2020, 1, 1), 1.0, 1.0) for _, w in rings])
    xy = [(rng.randint(-1500, 1500), rng.randint(-1500, 1500)) for _ in range(200)] + [ring[1] for ring, _ in rings]
    want = {(f"p{i}", j) for i, (x, y) in enumerate(xy) for j, (ring, _) in enumerate(rings) if covers(ring, x, y)}
    for listed in (spatial.LISTED, 0, 10**6):
        monkeypatch.setattr(spatial, "LISTED", listed)
        got = {(r["fired_key"], r["poly_ord"]) for r in spatial.pip_join(points(spark, xy), polys, cell_m=300).collect()}
        assert got == want


@pytest.mark.parametrize("sizes,twice,hot", [((1,), False, 200_000), ((1, 40), False, 200_000), ((1,), True, 200_000), ((1,), False, 20)])
def test_best_polygon_of_a_day_is_found_in_its_cell(spark, sizes, twice, hot):
    """Ranked where the join met them, pairs are dealt again only if a location may be in several cells."""
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        cx, cy, r = rng.randrange(60), rng.randrange(60), rng.randrange(2, 9) * rng.choice(sizes)
        wkt = f"POLYGON (({cx + r} {cy}, {cx} {cy + r}, {cx - r} {cy}, {cx} {cy - r}, {cx + r} {cy}))"
        rows.append((wkt, dt.date(2020, 1, rng.randrange(1, 8)), rng.choice([None, 1.0, 2.0]), rng.choice([None, 3.0, 4.0])))
    polys, pts = layer(spark, rows), points(spark, [(rng.randrange(60), rng.randrange(60)) for _ in range(120)])
    if twice:
        pts = pts.withColumn("fired_key", F.when(F.col("fired_key") != "p7", F.concat(F.lit("k"), F.substring("fired_key", 2, 1))))
    plain = spatial.pip_best(spatial.pip_join(pts, polys, cell_m=10, hot_rows=hot))
    pairs = spatial.pip_join(pts, polys, cell_m=10, hot_rows=hot, cells=True)
    best = spatial.pip_best(pairs)
    assert best.columns == plain.columns and best.count() > 50
    assert sorted(map(repr, best.collect())) == sorted(map(repr, plain.collect()))
    alone = len(sizes) == 1 and not twice and hot > 20
    assert pairs.one_cell == alone
    assert ("hashpartitioning(fired_key" in best._jdf.queryExecution().executedPlan().toString()) == (not alone)


@pytest.mark.parametrize("ties", [0, 5])
def test_best_polygon_of_a_day_deals_only_keys_of_several_points_again(spark, ties, monkeypatch):
    """Cells are dealt once; what was met in them is ranked there, whatever other keys need."""
    monkeypatch.setattr(spatial, "PAIRS_PER_TASK", 500)
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        cx, cy, r = rng.randrange(60), rng.randrange(60), rng.randrange(2, 9)
        wkt = f"POLYGON (({cx + r} {cy}, {cx} {cy + r}, {cx - r} {cy}, {cx} {cy - r}, {cx + r} {cy}))"
        rows.append((wkt, dt.date(2020, 1, rng.randrange(1, 5)), rng.choice([None, 1.0, 2.0]), 3.0))
    polys, pts = layer(spark, rows), points(spark, [(rng.randrange(60), rng.randrange(60)) for _ in range(150)])
    names = F.substring("fired_key", 2, 4).cast("int")
    # Keys that stand for several points: one that is missing, and one that is not.
    key = F.when(names < ties, F.lit(None)).when(names < 2 * ties, F.lit("twice")).otherwise(F.col("fired_key"))
    pts = pts.withColumn("fired_key", key)
    want = spatial.pip_best(spatial.pip_join(pts, polys, cell_m=10))
    best = spatial.pip_best(spatial.pip_join(pts, polys, cell_m=10, cells=True))
    plan = best._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in dealt if "date_day" in line]) == (1 if ties else 0)
    assert sorted(map(repr, best.collect())) == sorted(map(repr, want.collect()))


def test_few_edges_are_judged_in_a_compiled_join(spark):
    """The join's code stays under the limit over which it is not compiled."""
    rows = [(f"POLYGON (({i} 0, {i + 9} 0, {i + 9} 9, {i} 9, {i} 0))", dt.date(2020, 1, 1), 1.0, 1.0) for i in range(20)]
    triangle = ("POLYGON ((0 0, 9 0, 0 9, 0 0))", dt.date(2020, 1, 1), 1.0, 1.0)
    pts = points(spark, [(x, y) for x in (0, 1, 4.5, 9, 28, 28.5) for y in (0, 4.5, 9, 9.5)])
    pairs = spatial.pip_join(pts, layer(spark, [*rows, triangle]), cell_m=4)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("lambda" not in line for line in joins)
    got = {(r["fired_key"], r["poly_ord"]) for r in pairs.collect()}
    xy = {r["fired_key"]: (r["x"], r["y"]) for r in pts.collect()}
    square = {(k, i) for k, (x, y) in xy.items() for i in range(20) if i <= x <= i + 9 and 0 <= y <= 9}
    assert got == square | {(k, 20) for k, (x, y) in xy.items() if x + y <= 9}
