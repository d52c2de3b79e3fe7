"""Planar geometry as Column expressions.

A polygon is ``ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>``: parts, then rings (outer
first, then holes), then vertices. Rings are closed. The edge list of a polygon
(``edges``) is the form the predicates work on; compute it once per polygon.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditional import as_col

# Sphere radius of the sinusoidal grid, and the two known systems.
EARTH_RADIUS_M = 6371007.181
SINUSOIDAL = "+proj=sinu +R=6371007.181"
WGS84 = "EPSG:4326"

GEOMETRY_TYPE = "array<array<array<struct<x:double,y:double>>>>"


def to_sinusoidal(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Degrees to metres on the sphere's sinusoidal projection."""
    lon_r, lat_r = F.radians(as_col(lon)), F.radians(as_col(lat))
    return F.lit(EARTH_RADIUS_M) * lon_r * F.cos(lat_r), F.lit(EARTH_RADIUS_M) * lat_r


def to_wgs84(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Metres back to degrees (longitude, latitude); longitude is NULL at a pole."""
    lat_r = as_col(y) / F.lit(EARTH_RADIUS_M)
    lon = F.degrees(F.try_divide(as_col(x), F.lit(EARTH_RADIUS_M) * F.cos(lat_r)))
    return lon, F.degrees(lat_r)


def parse_wkt(wkt: Column | str) -> Column:
    """POLYGON or MULTIPOLYGON text to the nested-array form; NULL for other text.

    Blanks and nested brackets are first reduced to single separators (``#``
    between parts, ``;`` between rings), so that every split is on one character.
    """
    text = F.trim(as_col(wkt))
    single = text.rlike(r"(?i)^POLYGON\b")
    multi = text.rlike(r"(?i)^MULTIPOLYGON\b")
    empty = text.rlike(r"(?i)\bEMPTY\s*$")
    inner = F.regexp_replace(text, r"^[A-Za-z\s]+", "")
    inner = F.regexp_replace(inner, r"\s*([(),])\s*", "$1")
    inner = F.regexp_replace(inner, r"\s+", " ")
    inner = F.regexp_replace(inner, r"^\(+|\)+$", "")
    inner = F.replace(inner, F.lit(")),(("), F.lit("#"))
    inner = F.replace(inner, F.lit("),("), F.lit(";"))

    def vertex(pair: Column) -> Column:
        xy = F.split(pair, " ")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    def ring(body: Column) -> Column:
        return F.transform(F.split(body, ","), vertex)

    def part(body: Column) -> Column:
        return F.transform(F.split(body, ";"), ring)

    parts = F.transform(F.split(inner, "#"), part)
    return F.when((single | multi) & ~empty, parts).when(
        single | multi, F.array().cast(GEOMETRY_TYPE)
    )


def _ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs; an unclosed ring is closed."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    pairs = F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )
    # Drops the step from the repeated closing vertex to itself.
    return F.filter(pairs, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def edges(geom: Column | str) -> Column:
    """All edges of all rings as ``ARRAY<STRUCT<x1,y1,x2,y2>>``."""
    return F.flatten(F.transform(F.flatten(as_col(geom)), _ring_edges))


def bbox(geom: Column | str) -> dict[str, Column]:
    """Bounding box columns; vertices of the outer rings decide it."""
    vertices = F.flatten(F.transform(as_col(geom), lambda p: p[0]))
    xs = F.transform(vertices, lambda v: v["x"])
    ys = F.transform(vertices, lambda v: v["y"])
    return {
        "xmin": F.array_min(xs),
        "ymin": F.array_min(ys),
        "xmax": F.array_max(xs),
        "ymax": F.array_max(ys),
    }


def edge_crosses(x1, y1, x2, y2, x, y) -> Column:
    """The ray from the point towards +x crosses the edge (half-open in y)."""
    span = F.nullif(y2 - y1, F.lit(0.0))
    at = x1 + (y - y1) / span * (x2 - x1)
    return ((y1 > y) != (y2 > y)) & (x < at)


def on_edge(x1, y1, x2, y2, x, y) -> Column:
    """The point lies on the closed segment."""
    flat = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
    return (
        flat
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(F.least(y1, y2), F.greatest(y1, y2))
    )


def edges_cover(edge_list: Column | str, x: Column | str, y: Column | str) -> Column:
    """Closed containment given the edge list: on an edge, or an odd crossing count."""
    edge_list, x, y = as_col(edge_list), as_col(x), as_col(y)
    crossing = F.filter(edge_list, lambda e: edge_crosses(e["x1"], e["y1"], e["x2"], e["y2"], x, y))
    touching = F.exists(edge_list, lambda e: on_edge(e["x1"], e["y1"], e["x2"], e["y2"], x, y))
    return (F.size(crossing) % 2 == 1) | touching


#: Edges tested one by one in compiled code, and those that a row may hold as plain columns.
UNROLLED = 8
FEW_EDGES = 4


def edges_cover_listed(edge_list: Column | str, x: Column | str, y: Column | str) -> Column:
    """``edges_cover``, in compiled code where the list is short."""
    edge_list, x, y = as_col(edge_list), as_col(x), as_col(y)
    count, touch = F.lit(0), F.lit(False)
    for i in range(UNROLLED):
        e = F.get(edge_list, F.lit(i))
        ends = e["x1"], e["y1"], e["x2"], e["y2"]
        count = count + F.coalesce(edge_crosses(*ends, x, y).cast("int"), F.lit(0))
        touch = touch | F.coalesce(on_edge(*ends, x, y), F.lit(False))
    short = (count % 2 == 1) | touch
    return F.when(F.size(edge_list) <= UNROLLED, short).otherwise(edges_cover(edge_list, x, y))


def few_edges(edge_list: Column | str) -> dict[str, Column]:
    """Up to FEW_EDGES edges as columns that are never missing: NaN where there is no edge, which no ray meets."""
    out, none = {}, F.lit(float("nan"))
    for i in range(FEW_EDGES):
        e = F.get(as_col(edge_list), F.lit(i))
        whole = e["x1"].isNotNull() & e["y1"].isNotNull() & e["x2"].isNotNull() & e["y2"].isNotNull()
        out |= {f"__e{i}_{end}": F.coalesce(F.when(whole, e[end]), none) for end in ("x1", "y1", "x2", "y2")}
    return out


def few_edges_cover(x: Column | str, y: Column | str) -> Column:
    """``edges_cover`` over the columns of ``few_edges``: short enough for a join to be compiled with it."""
    x, y = as_col(x), as_col(y)
    odd, touch = F.lit(False), F.lit(False)
    for i in range(FEW_EDGES):
        x1, y1, x2, y2 = (F.col(f"__e{i}_{end}") for end in ("x1", "y1", "x2", "y2"))
        # An edge at one height is never crossed, so nothing is divided by zero.
        odd = odd != F.when((y1 > y) != (y2 > y), x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)).otherwise(F.lit(False))
        touch = touch | on_edge(x1, y1, x2, y2, x, y)
    return odd | touch


def st_covers(geom: Column | str, x: Column | str, y: Column | str) -> Column:
    """Closed point-in-polygon: the boundary counts, also of a hole; holes do not."""
    return edges_cover(edges(geom), x, y)


def segment_distance(x1, y1, x2, y2, x, y) -> Column:
    """Distance from a point to a closed segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(((x - x1) * dx + (y - y1) * dy) / length2, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_poly_dist(geom: Column | str, x: Column | str, y: Column | str) -> Column:
    """Metres from a point to a polygon, 0 inside or on the boundary."""
    x, y = as_col(x), as_col(y)
    sides = edges(geom)
    nearest = F.array_min(
        F.transform(
            sides, lambda e: segment_distance(e["x1"], e["y1"], e["x2"], e["y2"], x, y)
        )
    )
    return F.when(edges_cover(sides, x, y), F.lit(0.0)).otherwise(nearest)


def _ring_moments(ring: Column) -> Column:
    """(area, area * x, area * y) of a ring, orientation removed.

    Vertices are taken relative to the ring's first vertex so that large
    coordinates do not cancel.
    """
    ox, oy = ring[0]["x"], ring[0]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross / 2).alias("a"),
            (acc["mx"] + (ax + bx) * cross / 6).alias("mx"),
            (acc["my"] + (ay + by) * cross / 6).alias("my"),
        )

    def finish(acc: Column) -> Column:
        sign = F.when(acc["a"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        area = acc["a"] * sign
        return F.struct(
            area.alias("a"),
            (acc["mx"] * sign + area * ox).alias("mx"),
            (acc["my"] * sign + area * oy).alias("my"),
        )

    return F.aggregate(_ring_edges(ring), zero, step, finish)


def poly_moments(geom: Column | str) -> Column:
    """(area, area * x, area * y) over all parts; holes subtract."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, m: Column) -> Column:
        return F.struct(*[(acc[k] + m[k]).alias(k) for k in ("a", "mx", "my")])

    signed = F.flatten(
        F.transform(
            as_col(geom),
            lambda part: F.transform(
                part,
                lambda ring, i: F.transform(
                    F.array(_ring_moments(ring)),
                    lambda m: F.struct(
                        *[
                            F.when(i == 0, m[k]).otherwise(-m[k]).alias(k)
                            for k in ("a", "mx", "my")
                        ]
                    ),
                )[0],
            ),
        )
    )
    return F.aggregate(signed, zero, add)


def poly_area(geom: Column | str) -> Column:
    """Planar area in square metres."""
    return poly_moments(geom)["a"]
