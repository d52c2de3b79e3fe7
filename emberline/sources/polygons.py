"""Polygon layers, points and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditional import as_col
from ..functions.geometry import SINUSOIDAL, WGS84, bbox, parse_wkt, to_sinusoidal, to_wgs84

KNOWN_SYSTEMS = (SINUSOIDAL, WGS84)


def read_polygons(
    df: DataFrame, wkt_col: str = "wkt", crs: str = SINUSOIDAL, keep_text: bool = False
) -> DataFrame:
    """Polygon text to ``geom`` plus its bounding box, all inside the JVM."""
    if crs != SINUSOIDAL:
        raise ValueError(f"polygons must be in {SINUSOIDAL}, got {crs!r}")
    out = df.withColumn("geom", parse_wkt(wkt_col))
    if not keep_text:
        out = out.drop(wkt_col)
    return out.withColumns(bbox("geom"))


def spread(df: DataFrame) -> DataFrame:
    """Raw polygon text over all cores, where its files have fewer splits than these: parsing is the cost, not the text."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def with_point(df: DataFrame, x: Column | str, y: Column | str, crs: str = SINUSOIDAL) -> DataFrame:
    """Add planar coordinates ``x``, ``y`` in metres; all columns stay."""
    if crs == WGS84:
        px, py = to_sinusoidal(x, y)
    elif crs == SINUSOIDAL:
        px, py = as_col(x).cast("double"), as_col(y).cast("double")
    else:
        raise ValueError(f"unknown reference system {crs!r}; known: {KNOWN_SYSTEMS}")
    return df.withColumns({"x": px, "y": py})


def with_lonlat(df: DataFrame, x: Column | str = "x", y: Column | str = "y") -> DataFrame:
    """Add degrees ``lon``, ``lat`` for planar coordinates."""
    lon, lat = to_wgs84(x, y)
    return df.withColumns({"lon": lon, "lat": lat})


def drop_geometry(df: DataFrame) -> DataFrame:
    """The attribute columns only."""
    return df.drop("geom", "xmin", "ymin", "xmax", "ymax")
