"""Point-to-polygon joins on a grid of cells.

Polygons are taken apart into edges. An edge is filed under every grid cell in
which a point could need it, a point under the one cell it lies in, and an
equi-join on the cell brings them together. The verdict per (point, polygon) is
an aggregate over the edges met: an odd number of crossings, or a touch. No row
carries a long ring, so vertex count does not matter, and the aggregate reuses the
join's partitioning because all edges a point meets share its cell. Polygons with
up to LISTED edges are filed whole instead, with the edges that a cell needs in one
row: the verdict is then part of the join and no pair is stored or dealt again.

Cell size grows in steps of four with the polygon's extent, which bounds the
number of cells per edge whatever the size. Cells that hold very many points or
edges are divided. Only ids go through the cell join; attributes join the pairs
that are left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import (
    FEW_EDGES,
    edge_crosses,
    edges,
    edges_cover_listed,
    few_edges,
    few_edges_cover,
    on_edge,
    poly_moments,
    segment_distance,
)
from ..session import materialize
from .relational import asc, desc, distinct_keys, first_per, left_on, min_key, unmatched

CELL_M = 5000
ROWS_PER_CELL = 4
LEVEL_STEP = 4
MAX_LEVEL = 8
HOT_CELL_ROWS = 200_000
SKETCH = 256
NEAR_M = 1000
#: Edges of a polygon that one row may carry.
LISTED = 64
#: Polygons whose boxes a point meets in the first round, and the growth from round to round.
ROUND_BOXES = 8
ROUND_GROWTH = 3
#: Polygons and points from which the rounds are told.
SEEN_POLYGONS = 20_000
SEEN_POINTS = 256
#: Pairs that a task may hold in order, where they are ranked in their cells, and the most tasks made for that.
PAIRS_PER_TASK = 500_000
MOST_TASKS = 20_000

POLYGON_FIELDS = ("date_day", "id", "did", "fsr_km2_dy", "dy_ar_km2", "poly_ord")
BOX = ("xmin", "ymin", "xmax", "ymax")
EDGE = ("x1", "y1", "x2", "y2")
CELL = ("__lv", "__cx", "__cy")
SALT = ("__sp", "__se")


def growth_order() -> list[list[Column]]:
    """Fastest growth first, then the largest daily area, then input order."""
    return [desc("fsr_km2_dy"), desc("dy_ar_km2"), asc("poly_ord")]


def polygon_order() -> list[list[Column]]:
    """Earliest day first, then ``growth_order``."""
    return [asc("date_day"), *growth_order()]


def prepare_polygons(polys: DataFrame) -> DataFrame:
    """The polygon layer as a stored table with its edge lists instead of its geometry, ready to join.

    Parsing happens once here. Left lazy, the optimizer would repeat it in every
    filter it pushes below the projection.
    """
    return materialize(polys.withColumn("sides", edges("geom")).drop("geom"), "polygons")


def _level(width: Column, height: Column, cell_m: float) -> Column:
    """Grid level at which a box spans at most about four cells each way."""
    extent = F.greatest(width, height)
    level = F.lit(0)
    for i in range(MAX_LEVEL):
        level = level + F.when(extent > LEVEL_STEP * cell_m * LEVEL_STEP**i, 1).otherwise(0)
    return level


def _column(v: Column, cell_m: float, level: Column) -> Column:
    return F.floor(v / (F.lit(float(cell_m)) * F.pow(F.lit(float(LEVEL_STEP)), level)))


def _row(v: Column, cell_m: float, level: Column) -> Column:
    return _column(v, cell_m / ROWS_PER_CELL, level)


def _in_range() -> Column:
    return F.col("x").between(F.col("__x0"), F.col("__x1")) & F.col("y").between(F.col("__y0"), F.col("__y1"))


def _grid_join(
    points: DataFrame,
    filed: DataFrame,
    key: str,
    poly: str,
    cell_m: float,
    hot_rows: int,
    trim: Callable[[DataFrame], DataFrame] | None = None,
    tasks: int | None = None,
    judge: Column | None = None,
) -> DataFrame:
    """Pairs in which the point lies in the range an edge is filed for.

    ``filed`` has ``__lv`` and the range ``__x0 .. __x1``, ``__y0 .. __y1``. The cell
    columns and the salts stay in the result for a following aggregate. A cell is
    divided by its points into as many parts as ``hot_rows`` goes into them, and
    likewise by its edges; all edges of one polygon stay in one part. How many
    rows a cell has is told from a sample in which a hot cell has SKETCH rows; a
    wrong guess costs balance, not pairs. ``trim`` cuts the filed rows, which have
    their cells then, down to what a cell needs. ``tasks`` deals the cells to that many.
    ``judge`` is asked of what is in range, and of nothing else.
    A result that holds all pairs of a point in one cell is marked ``one_cell``.
    """
    # At most MAX_LEVEL + 1 values reach the driver.
    levels = sorted(r["__lv"] for r in filed.select("__lv").distinct().collect()) or [0]
    lv = F.col("__lv")

    def point_cells(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__lv", F.explode(F.array(*[F.lit(i) for i in levels])))
        return rows.withColumns({"__cx": _column(F.col("x"), cell_m, lv), "__cy": _row(F.col("y"), cell_m, lv)})

    def edge_cells(rows: DataFrame) -> DataFrame:
        across = F.sequence(_column(F.col("__x0"), cell_m, lv), _column(F.col("__x1"), cell_m, lv))
        along = F.sequence(_row(F.col("__y0"), cell_m, lv), _row(F.col("__y1"), cell_m, lv))
        return rows.withColumn("__cx", F.explode(across)).withColumn("__cy", F.explode(along))

    share = min(1.0, SKETCH / hot_rows)

    def parts(rows: DataFrame, cells, name: str) -> DataFrame:
        seen = cells(rows.sample(share, 7) if share < 1 else rows).groupBy(*CELL)
        counted = seen.agg(F.ceil(F.count(F.lit(1)) / (share * hot_rows)).cast("int").alias(name))
        return counted.filter(F.col(name) > 1)

    # One row per cell with more than hot_rows rows on a side; mostly none.
    hot = materialize(parts(points, point_cells, "__kp").join(parts(filed, edge_cells, "__ke"), list(CELL), "full"), "hot")
    left, right = point_cells(points), edge_cells(filed)
    if trim:
        right = trim(right)
    cool = hot.isEmpty()
    if cool:
        left, right = (side.withColumns({"__sp": F.lit(0), "__se": F.lit(0)}) for side in (left, right))
    else:
        kp, ke = F.coalesce("__kp", F.lit(1)), F.coalesce("__ke", F.lit(1))
        own = lambda c, k: F.pmod(F.xxhash64(c), k).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
        left = left.join(hot, list(CELL), "left").withColumn("__sp", own(key, kp)).withColumn("__se", every(ke))
        right = right.join(hot, list(CELL), "left").withColumn("__se", own(poly, ke)).withColumn("__sp", every(kp))
        left, right = left.drop("__kp", "__ke"), right.drop("__kp", "__ke")
    if tasks:
        # Salts of undivided cells are literals: dealt by these, rows would not count as dealt by their cells in the ranking.
        left, right = (side.repartition(tasks, *(CELL if cool else [*CELL, *SALT])) for side in (left, right))
    # In a conjunction, what is costly may be computed before the range is asked.
    met = _in_range() if judge is None else F.when(_in_range(), judge).otherwise(F.lit(False))
    out = left.join(right, [*CELL, *SALT]).filter(met)
    out.cells, out.one_cell = list(CELL if cool else [*CELL, *SALT]), cool and len(levels) == 1
    return out


def pip_join(
    points: DataFrame,
    polys: DataFrame,
    key: str = "fired_key",
    cell_m: float = CELL_M,
    hot_rows: int = HOT_CELL_ROWS,
    poly: str = "poly_ord",
    cells: bool = False,
) -> DataFrame:
    """Every (point, polygon) pair where the closed polygon contains the point.

    ``points`` has ``key``, ``x``, ``y`` and one row per location; ``polys`` comes
    from ``prepare_polygons`` and ``poly`` is its unique column, the only one that
    goes through the cell join. Both are read more than once, so pass stored
    tables. The result has the key and the polygon's attributes, without geometry.
    With ``cells`` it also has the cell that a pair was met in, for ``pip_best``,
    dealt to so many tasks that each can put its pairs in order in memory.
    """
    attrs = [c for c in polys.columns if c not in ("geom", "sides", *BOX)]
    n = polys.agg(
        F.count(poly).alias("rows"), F.count_distinct(poly).alias("own"), F.max(F.size("sides")).alias("sides")
    ).first()
    if n["rows"] > n["own"]:
        # Rows that share an id are one polygon, whose edges count together.
        return _pip_edges(points, polys, key, cell_m, hot_rows, poly, attrs)
    cells = cells and (n["sides"] or 0) <= LISTED
    listed = polys.filter(F.size("sides") <= LISTED)
    pairs = _pip_listed(points, listed, key, cell_m, hot_rows, poly, attrs, n["sides"] or 0, cells)
    if (n["sides"] or 0) <= LISTED:
        return pairs
    many = polys.filter(F.size("sides") > LISTED)
    return pairs.unionByName(_pip_edges(points, many, key, cell_m, hot_rows, poly, attrs))


def _box_level(cell_m: float) -> Column:
    return _level(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), cell_m)


def _pip_listed(
    points: DataFrame, polys: DataFrame, key: str, cell_m: float, hot_rows: int, poly: str, attrs: list[str], most: int, cells: bool = False
) -> DataFrame:
    """``pip_join`` for polygons of few edges, up to ``most``: each goes to every cell of its box with the edges needed there."""
    renamed = {c: f"__p_{c}" for c in attrs}
    for c in (poly, *BOX):
        polys = polys.filter(F.col(c).isNotNull())
    filed = polys.select(
        *[F.col(c).alias(renamed[c]) for c in attrs], "sides", _box_level(cell_m).alias("__lv"),
        F.col("xmin").alias("__x0"), F.col("xmax").alias("__x1"), F.col("ymin").alias("__y0"), F.col("ymax").alias("__y1"),
    )
    lv, cx, cy = (F.col(c) for c in CELL)
    few = most <= FEW_EDGES

    def reach(e: Column) -> Column:
        """The rows of cells an edge is in and its last column, told as points' cells are; once a polygon, not for each of its cells."""
        low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        right = F.greatest(e["x1"], e["x2"])
        return F.struct(
            _row(low, cell_m, lv).alias("low"), _row(high, cell_m, lv).alias("high"), _column(right, cell_m, lv).alias("last")
        )

    def needed(_, i: Column) -> Column:
        """What the ray towards +x from a point of the cell can cross or touch."""
        e = F.get("__reach", i)
        return (e["low"] <= cy) & (e["high"] >= cy) & (e["last"] >= cx)

    def trim(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("sides", F.filter("sides", needed)).drop("__reach").filter(F.size("sides") > 0)
        return rows.withColumns(few_edges("sides")).drop("sides") if few else rows

    filed = filed.withColumn("__reach", F.transform("sides", reach))

    tasks = None
    if cells:
        pairs = _depth(points, polys, [F.lit(0)])[1]
        pairs = pairs[-1] * points.count() if len(pairs) else 0.0
        least = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, min(MOST_TASKS, int(np.ceil(pairs / PAIRS_PER_TASK))))
    rows = points.select(key, "x", "y")
    if cells:
        # Pairs of a key with one point are all met in one cell; a key of several points may have more.
        many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
        many = materialize(many.select(key, F.lit(True).alias("__many")), "many")
        rows = left_on(rows, many, [key]).select(key, "x", "y", F.col("__many").isNull().alias("__alone"))
    covers = few_edges_cover("x", "y") if few else edges_cover_listed("sides", "x", "y")
    inside = _grid_join(rows, filed, key, renamed[poly], cell_m, hot_rows, trim, tasks, covers)
    own = [*inside.cells, "__alone"] if cells else []
    out = inside.select(key, *[F.col(renamed[c]).alias(c) for c in attrs], *own)
    if cells:
        out.cells, out.in_cell = inside.cells, inside.one_cell
        out.one_cell = inside.one_cell and many.isEmpty()
    return out


def _pip_edges(
    points: DataFrame, polys: DataFrame, key: str, cell_m: float, hot_rows: int, poly: str, attrs: list[str]
) -> DataFrame:
    """``pip_join`` edge by edge, for polygons of any number of edges."""
    level = _box_level(cell_m)
    # The ray runs towards +x: a point needs every edge at its height that ends
    # right of it, and a point left of the polygon needs none.
    filed = (
        polys.select(
            poly, level.alias("__lv"), F.col("xmin").alias("__x0"), F.explode("sides").alias("e")
        )
        .select(poly, "__lv", "__x0", "e.*")
        .withColumns(
            {
                "__x1": F.greatest("x1", "x2"),
                "__y0": F.least("y1", "y2"),
                "__y1": F.greatest("y1", "y2"),
            }
        )
    )
    met = _grid_join(points.select(key, "x", "y"), filed, key, poly, cell_m, hot_rows)
    args = [F.col(c) for c in (*EDGE, "x", "y")]
    pairs = (
        met.withColumns({"__cross": edge_crosses(*args), "__on": on_edge(*args)})
        .filter(F.col("__cross") | F.col("__on"))
        .groupBy(*CELL, *SALT, key, poly)
        .agg(F.sum(F.col("__cross").cast("int")).alias("__n"), F.max("__on").alias("__on"))
        .filter((F.col("__n") % 2 == 1) | F.col("__on"))
        .select(key, poly)
    )
    return pairs.join(polys.select(*attrs), poly).select(key, *attrs)


def pip_best(pairs: DataFrame, key: str = "fired_key") -> DataFrame:
    """For each location and day: the polygon with the fastest growth, then the
    largest daily area, then input order; missing values last.

    Pairs that come with their cells are ranked there, where the join has met them,
    and not dealt again; what is left of a location is dealt only where it may be in
    several cells (polygons of several sizes, divided cells, a key of several points).
    """
    keep = [c for c in POLYGON_FIELDS if c != "date_day"]
    if not set(CELL) <= set(pairs.columns):
        return first_per(pairs, [key, "date_day"], growth_order(), keep)
    # A hash leads the keys: rows are put in order by the first eight bytes where these differ.
    met = pairs.withColumn("__spot", F.xxhash64(key, "date_day"))
    best = first_per(met, ["__spot", *pairs.cells, "__alone", key, "date_day"], growth_order(), keep)
    if not pairs.in_cell:
        return first_per(best, [key, "date_day"], growth_order(), keep)
    done = best.filter("__alone").select(key, "date_day", *keep)
    if pairs.one_cell:
        return done
    return done.unionByName(first_per(best.filter("not __alone"), [key, "date_day"], growth_order(), keep))


def first_burn(
    points: DataFrame, polys: DataFrame, key: str = "fired_key", pairs: DataFrame | None = None, **how
) -> DataFrame:
    """For each location the first day a polygon contains it, and that day's best polygon.

    Where polygons lie many deep, they are met in rounds, earlier and better ones
    first, each a few times as many as the one before: what a round finds is the
    first of all, and only points without any go on. So the pairs met grow with
    the points, not with how deep the polygons lie.
    """
    if pairs is not None:
        return _as_metrics(_first(pairs, key), key, "intersect")
    order = [*min_key(*polygon_order())]
    cuts = _rounds(points, polys, order)
    if not cuts:
        return _as_metrics(_first(pip_join(points, polys, key, **how), key), key, "intersect")
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest, found = points.select(key, "x", "y"), None
    for after, last in zip([None, *cuts], [*cuts, None], strict=True):
        part = polys
        if after is not None:
            part = part.filter(place > after)
        if last is not None:
            part = part.filter(place <= last)
        best = materialize(_first(pip_join(rest, part, key, **how), key), "burnt")
        found = best if found is None else found.unionByName(best)
        if last is None:
            break
        rest = materialize(_without(rest, best, key), "rest")
        if rest.isEmpty():
            break
    return _as_metrics(found, key, "intersect")


def _first(pairs: DataFrame, key: str) -> DataFrame:
    return first_per(pairs, [key], polygon_order(), list(POLYGON_FIELDS))


def _without(points: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Points whose key, missing ones included, was not found."""
    seen = found.select(F.col(key).alias("__found"))
    return points.join(seen, F.col(key).eqNullSafe(F.col("__found")), "left_anti")


def _depth(points: DataFrame, polys: DataFrame, order: list[Column]) -> tuple[DataFrame | None, np.ndarray, list]:
    """How many boxes of the sampled polygons up to each, in ``order``, a point lies in; with the fields and rows of the sample, of bounded size."""
    n, m = polys.count(), points.count()
    if not n or not m:
        return None, np.zeros(0), []
    share = min(1.0, SEEN_POLYGONS / n)
    names = [f"o{i}" for i in range(len(order))]
    fields = polys.select(*[c.alias(name) for c, name in zip(order, names, strict=True)], *BOX)
    rows = fields.sample(share, 7).limit(2 * SEEN_POLYGONS).orderBy(*names).collect()
    # Points are drawn by hash, so that a small sample comes from all files.
    drawn = points.select("x", "y").dropna().sample(min(1.0, 8 * SEEN_POINTS / m), 7)
    drawn = drawn.orderBy(F.xxhash64("x", "y")).limit(SEEN_POINTS).collect()
    if not rows or not drawn:
        return None, np.zeros(0), []
    x, y = np.array([(p["x"], p["y"]) for p in drawn], dtype=float).T
    deep = np.zeros(len(rows))
    for k, q in enumerate(rows):
        if q["xmin"] is not None:
            deep[k] = ((x >= q["xmin"]) & (x <= q["xmax"]) & (y >= q["ymin"]) & (y <= q["ymax"])).mean()
    return fields, np.cumsum(deep) / share, rows


def _rounds(points: DataFrame, polys: DataFrame, order: list[Column]) -> list[Column]:
    """Places in ``order`` after which a round ends; none where one round will do.

    Told from samples of bounded size: how many boxes of the polygons up to a place
    a point lies in. A wrong guess costs time, not results.
    """
    fields, deep, rows = _depth(points, polys, order)
    if not len(deep):
        return []
    names = fields.columns[: len(order)]
    cuts, goal = [], ROUND_BOXES
    while deep[-1] > 2 * goal:
        at = min(int(np.searchsorted(deep, goal)), len(rows) - 1)
        kinds = [fields.schema[name].dataType for name in names]
        cuts.append(F.struct(*[F.lit(rows[at][name]).cast(kind).alias(name) for name, kind in zip(names, kinds, strict=True)]))
        goal *= ROUND_GROWTH
    return cuts


def nearest_within(
    points: DataFrame,
    polys: DataFrame,
    max_m: float = NEAR_M,
    key: str = "fired_key",
    cell_m: float = CELL_M,
    hot_rows: int = HOT_CELL_ROWS,
    poly: str = "poly_ord",
) -> DataFrame:
    """Nearest polygon outline no farther than ``max_m``, with its distance.

    Equal to "nearest of all, then keep if within ``max_m``". The points must lie
    outside every polygon (``recover_near`` sees to that), so the nearest thing is
    an edge. Each edge is filed for its own box grown by ``max_m``. Ties: day,
    growth, area, input order.
    """
    attrs = [c for c in POLYGON_FIELDS if c in polys.columns]
    pad = float(max_m)
    filed = (
        polys.select(poly, F.explode("sides").alias("e"))
        .select(poly, "e.*")
        .withColumns(
            {
                "__x0": F.least("x1", "x2") - pad,
                "__x1": F.greatest("x1", "x2") + pad,
                "__y0": F.least("y1", "y2") - pad,
                "__y1": F.greatest("y1", "y2") + pad,
            }
        )
    )
    width, height = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    filed = filed.withColumn("__lv", _level(width, height, cell_m))
    near = _grid_join(points.select(key, "x", "y"), filed, key, poly, cell_m, hot_rows)
    distance = segment_distance(*[F.col(c) for c in (*EDGE, "x", "y")])
    near = near.withColumn("nearest_dist_m", distance).filter(F.col("nearest_dist_m") <= max_m)
    near = near.groupBy(*CELL, *SALT, key, poly).agg(F.min("nearest_dist_m").alias("nearest_dist_m"))
    near = near.select(key, poly, "nearest_dist_m").join(polys.select(*attrs), poly)
    best = first_per(
        near, [key], [asc("nearest_dist_m"), *polygon_order()], [*POLYGON_FIELDS, "nearest_dist_m"]
    )
    return _as_metrics(best, key, "nearest_1km", "nearest_dist_m")


def nearest_polygon(
    points: DataFrame,
    polys: DataFrame,
    key: str = "fired_key",
    start_m: float = NEAR_M,
    cell_m: float = CELL_M,
    **how,
) -> DataFrame:
    """Nearest polygon outline of every point, however far, with its distance.

    The points must lie outside every polygon. Rounds of ``nearest_within`` with a
    bound that doubles: what a round finds is the nearest of all, and only points
    without any go on to the next one, on cells as wide as the bound. The rounds
    end when no point is left or the bound spans all points and polygons. Without
    polygons the result is empty.
    """
    box = polys.agg(*[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX, strict=True)])
    ends = points.agg(F.min("x").alias("px"), F.min("y").alias("py"), F.max("x").alias("qx"), F.max("y").alias("qy"))
    b = box.join(ends).first()
    if b["xmin"] is None or b["px"] is None:
        return nearest_within(points, polys, start_m, key, cell_m, **how)
    wide = max(b["xmax"], b["qx"]) - min(b["xmin"], b["px"])
    high = max(b["ymax"], b["qy"]) - min(b["ymin"], b["py"])
    rest, bound, found = points.select(key, "x", "y"), float(start_m), None
    while True:
        near = materialize(nearest_within(rest, polys, bound, key, max(cell_m, bound), **how), "near")
        found = near if found is None else found.unionByName(near)
        if bound >= wide + high:
            break
        rest = materialize(unmatched(rest, near, key).select(key, "x", "y"), "rest")
        if rest.isEmpty():
            break
        bound *= 2
    return found.withColumn("match_type", F.lit("nearest"))


def recover_near(
    points: DataFrame,
    polys: DataFrame,
    max_m: float = NEAR_M,
    key: str = "fired_key",
    exact: DataFrame | None = None,
    **how,
) -> DataFrame:
    """``nearest_within`` for the locations no polygon contains."""
    if exact is None:
        exact = first_burn(points, polys, key, **how)
    rest = materialize(unmatched(points, exact, key).select(key, "x", "y"), "unmatched")
    return nearest_within(rest, polys, max_m, key, **how)


def match_locations(points: DataFrame, polys: DataFrame, max_m: float = NEAR_M) -> DataFrame:
    """Containing polygon where there is one, else the nearest within ``max_m``."""
    exact = materialize(first_burn(points, polys), "exact")
    near = recover_near(points, polys, max_m, exact=exact)
    # Disjoint by the anti join, so there is nothing to choose between.
    return exact.unionByName(near, allowMissingColumns=True)


def _as_metrics(best: DataFrame, key: str, match_type: str, *extra: str) -> DataFrame:
    return best.select(
        key,
        F.col("date_day").alias("burn_date"),
        F.col("id").alias("fire_id"),
        "did",
        "fsr_km2_dy",
        "dy_ar_km2",
        F.lit(match_type).alias("match_type"),
        *extra,
    )


def burnt_locations(obs: DataFrame) -> DataFrame:
    """Distinct locations of rows that may receive a fire, with coordinates."""
    eligible = obs.filter(F.col("eligible_fire_speed"))
    return distinct_keys(eligible, "fired_key", "x", "y")


def ignition_point(polys: DataFrame, key: str = "id") -> DataFrame:
    """Ignition coordinates on the first row of each event."""
    return first_per(
        polys, [key], [asc("event_day"), asc("poly_ord")], ["ig_utm_x", "ig_utm_y"]
    )


def first_day_centroid(polys: DataFrame, key: str = "id", day: str = "event_day") -> DataFrame:
    """Area-weighted centroid of all polygons on an event's first day.

    One pass: the moments of a day are sums, and the least (day, moments) struct
    of an event is its first day. Polygons of one day are taken as disjoint.
    """
    m = poly_moments("geom")
    daily = (
        polys.select(key, day, m.alias("m"))
        .groupBy(key, day)
        .agg(
            F.sum("m.a").alias("a"),
            F.sum("m.mx").alias("mx"),
            F.sum("m.my").alias("my"),
            F.count(F.lit(1)).alias("n_polygons"),
        )
    )
    first = first_per(daily, [key], [asc(day)], [day, "a", "mx", "my", "n_polygons"])
    return first.select(
        key,
        day,
        F.try_divide("mx", "a").alias("x"),
        F.try_divide("my", "a").alias("y"),
        "n_polygons",
    )
