"""Polygons stored as JSON text ``[[lat, lng], ...]`` and the point-in-polygon test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "array<array<double>>"


def parse_polygon(text: Column, strict: bool = True) -> Column:
    """Null or blank text is the empty polygon. Bad JSON fails the job, or is null if not strict."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.array().cast(POLYGON)).otherwise(F.from_json(text, POLYGON, {"mode": mode}))


def format_polygon(polygon: Column) -> Column:
    return F.coalesce(F.to_json(polygon), F.lit("[]"))


def polygon_valid(name: Column, polygon: Column) -> Column:
    """A named area of at least three points, each a pair."""
    pairs = F.forall(polygon, lambda p: p.isNotNull() & (F.size(p) == 2))
    return F.coalesce((F.length(F.trim(name)) > 0) & (F.size(polygon) >= 3) & pairs, F.lit(False))


def edges(polygon: Column) -> Column:
    """Array of (lat_i, lng_i, lat_j, lng_j), j being the point before i, cyclically."""
    return F.transform(polygon, lambda p, i: F.struct(
        F.get(p, F.lit(0)).alias("lat_i"), F.get(p, F.lit(1)).alias("lng_i"),
        F.get(F.get(polygon, F.pmod(i - 1, F.size(polygon))), F.lit(0)).alias("lat_j"),
        F.get(F.get(polygon, F.pmod(i - 1, F.size(polygon))), F.lit(1)).alias("lng_j")))


def crosses(lat: Column, lng: Column, edge: Column) -> Column:
    """Whether the ray from a point towards greater latitudes crosses an edge; the boundary is half open."""
    spans = (edge["lng_i"] > lng) != (edge["lng_j"] > lng)
    at = F.try_divide((edge["lat_j"] - edge["lat_i"]) * (lng - edge["lng_i"]), edge["lng_j"] - edge["lng_i"]) + edge["lat_i"]
    return spans & (lat < at)


def inside(lat: Column, lng: Column, polygon_edges: Column) -> Column:
    """Ray casting: an odd number of edges is crossed."""
    return F.size(F.filter(polygon_edges, lambda e: crosses(lat, lng, e))) % 2 == 1


def bounds(polygon: Column) -> Column:
    """Smallest and largest latitude and longitude."""
    lats = F.transform(polygon, lambda p: F.get(p, F.lit(0)))
    lngs = F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.array_min(lats).alias("lat0"), F.array_max(lats).alias("lat1"),
                    F.array_min(lngs).alias("lng0"), F.array_max(lngs).alias("lng1"))
