"""Geometry as Columns.

A point is ``struct<x,y>`` in degrees and a line or ring an array of points.
All functions are built from Spark expressions, so they run in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def point(x, y) -> Column:
    """A point from two columns."""
    return F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y"))


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance in meters between two lon/lat points."""
    dy, dx = F.radians(y2 - y1) / 2, F.radians(x2 - x1) / 2
    a = F.pow(F.sin(dy), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(dx), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance in the unit of the coordinates."""
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def legs(line: Column) -> Column:
    """Consecutive point pairs of a line: array<struct<a, b>>."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())


def _leg_m(leg: Column) -> Column:
    return haversine(leg["a"]["x"], leg["a"]["y"], leg["b"]["x"], leg["b"]["y"])


def line_length(line: Column) -> Column:
    """Length of a lon/lat line in meters; 0 for fewer than two points."""
    return F.aggregate(F.transform(legs(line), _leg_m), F.lit(0.0), lambda s, d: s + d)


def length_at(line: Column, at: Column) -> Column:
    """Length up to a linear reference in [0, 1]; an error outside of it."""
    return line_length(line) * _reference(at)


def _reference(at: Column) -> Column:
    return F.when(at.between(0, 1), at).otherwise(F.raise_error(F.concat(F.lit("linear reference outside [0, 1]: "), at.cast("string"))))


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often ``make`` names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def measured(line: Column) -> Column:
    """Legs with their start and end measure in meters."""
    empty = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,lo:double,hi:double>>")
    leg_of = lambda leg, lo, hi: F.array(F.struct(leg["a"].alias("a"), leg["b"].alias("b"), lo.alias("lo"), hi.alias("hi")))
    return F.aggregate(
        legs(line),
        F.struct(F.lit(0.0).alias("m"), empty.alias("out")),
        lambda acc, leg: bound(acc["m"] + _leg_m(leg), lambda m: F.struct(m.alias("m"), F.concat(acc["out"], leg_of(leg, acc["m"], m)).alias("out"))),
        lambda acc: acc["out"],
    )


def measured_length(measures: Column) -> Column:
    """Length of measured legs in meters; 0 without any."""
    return F.when(F.size(measures) > 0, F.get(measures, F.size(measures) - 1)["hi"]).otherwise(0.0)


def _point(measures: Column, at: Column) -> Column:
    """Point of measured legs at a linear reference."""

    def on(leg: Column, target: Column) -> Column:
        share = F.when(leg["hi"] > leg["lo"], F.least(F.greatest((target - leg["lo"]) / (leg["hi"] - leg["lo"]), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return bound(share, lambda s: F.struct((leg["a"]["x"] + s * (leg["b"]["x"] - leg["a"]["x"])).alias("x"), (leg["a"]["y"] + s * (leg["b"]["y"] - leg["a"]["y"])).alias("y")))

    first = lambda target: F.element_at(F.filter(measures, lambda g: (g["hi"] >= target - 1e-9) & (g["lo"] <= target + 1e-9)), 1)
    return bound(measured_length(measures) * _reference(at), lambda target: bound(first(target), lambda leg: on(leg, target)))


def point_at(line: Column, at: Column) -> Column:
    """Point at a linear reference in [0, 1], interpolated on its leg."""
    return bound(measured(line), lambda m: _point(m, at))


def cut(measures: Column, start: Column, end: Column) -> Column:
    """The part of measured legs between two references.

    The interior vertices strictly between both ends are kept (1e-6 tolerance).
    """
    inside = lambda total: F.transform(F.filter(measures, lambda g: (g["hi"] / total > start + 1e-6) & (g["hi"] / total < end - 1e-6)), lambda g: g["b"])
    return F.concat(F.array(_point(measures, start)), bound(measured_length(measures), inside), F.array(_point(measures, end)))


def sub_line(line: Column, start: Column, end: Column, backward: Column | None = None) -> Column:
    """The part of a line between two references; reversed for backward travel (``cut``)."""
    part = bound(measured(line), lambda m: cut(m, start, end))
    return part if backward is None else F.when(backward, F.reverse(part)).otherwise(part)


def exit_bearing(line: Column) -> Column:
    """Bearing in degrees of the last leg with two different points; null if none."""

    def bearing(leg: Column) -> Column:
        y1, y2, dx = F.radians(leg["a"]["y"]), F.radians(leg["b"]["y"]), F.radians(leg["b"]["x"] - leg["a"]["x"])
        return F.degrees(F.atan2(F.sin(dx) * F.cos(y2), F.cos(y1) * F.sin(y2) - F.sin(y1) * F.cos(y2) * F.cos(dx)))

    leg = F.element_at(F.filter(legs(line), lambda g: (g["a"]["x"] != g["b"]["x"]) | (g["a"]["y"] != g["b"]["y"])), -1)
    return (bound(leg, bearing) + 360) % 360


def points_along(line: Column, stride_m: float) -> Column:
    """Points every ``stride_m`` meters, and the last one.

    A line shorter than the stride gives its first and last point.
    """

    def inside(g: Column) -> Column:
        """Points of one leg, from its start up to but not including its end."""
        first, last = F.ceil(g["lo"] / stride_m - 1e-9), F.ceil(g["hi"] / stride_m - 1e-9) - 1
        share = lambda i: (i * F.lit(stride_m) - g["lo"]) / F.nullif(g["hi"] - g["lo"], F.lit(0.0))
        made = lambda i: F.struct((g["a"]["x"] + share(i) * (g["b"]["x"] - g["a"]["x"])).alias("x"), (g["a"]["y"] + share(i) * (g["b"]["y"] - g["a"]["y"])).alias("y"))
        return F.when(last >= first, F.transform(F.sequence(first, last), made)).otherwise(F.array())

    ends = F.array(F.element_at(line, 1), F.element_at(line, -1))
    return F.when(line_length(line) < stride_m, ends).otherwise(F.concat(F.flatten(F.transform(measured(line), inside)), F.slice(line, -1, 1)))


def circle(x: Column, y: Column, radius_m: float, corners: int = 12) -> Column:
    """A closed regular polygon at a distance around a point."""
    step = 2 * math.pi / corners
    per_degree = EARTH_RADIUS_M * math.pi / 180
    return F.transform(
        F.sequence(F.lit(0), F.lit(corners)),
        lambda i: F.struct(
            (x + F.lit(radius_m / per_degree) * F.cos((i % corners) * F.lit(step)) / F.cos(F.radians(y))).alias("x"),
            (y + F.lit(radius_m / per_degree) * F.sin((i % corners) * F.lit(step))).alias("y"),
        ),
    )


def ring_area(ring: Column) -> Column:
    """Signed planar area of a closed ring (shoelace)."""
    return F.aggregate(F.transform(legs(ring), lambda g: g["a"]["x"] * g["b"]["y"] - g["b"]["x"] * g["a"]["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring (ray casting)."""
    crossed = F.filter(
        legs(ring),
        lambda g: ((g["a"]["y"] > y) != (g["b"]["y"] > y)) & (x < (g["b"]["x"] - g["a"]["x"]) * (y - g["a"]["y"]) / F.nullif(g["b"]["y"] - g["a"]["y"], F.lit(0.0)) + g["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def envelope(line: Column) -> Column:
    """Bounding box of points: struct<xmin, xmax, ymin, ymax>."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))


def centroid(line: Column) -> Column:
    """Center of the bounding box, as the index of edges uses it."""
    box = envelope(line)
    return F.struct(((box["xmin"] + box["xmax"]) / 2).alias("x"), ((box["ymin"] + box["ymax"]) / 2).alias("y"))


def box_within(inner: Column, outer: tuple[float, float, float, float]) -> Column:
    """Whether a record's bbox lies fully in (xmin, xmax, ymin, ymax)."""
    xmin, xmax, ymin, ymax = outer
    return (inner["xmin"] >= xmin) & (inner["xmax"] <= xmax) & (inner["ymin"] >= ymin) & (inner["ymax"] <= ymax)


def to_wkt(points: Column, kind: str = "LINESTRING") -> Column:
    """WKT of a point array: LINESTRING, POLYGON (one ring) or MULTIPOINT; POINT of a point."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    if kind == "POINT":
        return F.concat(F.lit("POINT("), pair(points), F.lit(")"))
    body = F.array_join(F.transform(points, pair), ",")
    return F.concat(F.lit("POLYGON((" if kind == "POLYGON" else f"{kind}("), body, F.lit("))" if kind == "POLYGON" else ")"))


def from_wkt(text: Column) -> Column:
    """Points of a LINESTRING or of the outer ring of a POLYGON, quoted or not."""
    body = F.regexp_extract(F.trim(text), r"(?i)^\"?\s*(?:LINESTRING|POLYGON|MULTIPOINT|POINT)\s*Z?\s*\(\(?([^()]*)\)", 1)
    made = F.transform(
        F.split(body, r"\s*,\s*"),
        lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y")),
    )
    return F.when(body != "", made)


def to_geojson(points: Column, kind: str = "LineString") -> Column:
    """GeoJSON text of a point array (LineString or Polygon with one ring)."""
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    body = F.array_join(F.transform(points, pair), ",")
    left, right = ("[[", "]]") if kind == "Polygon" else ("[", "]")
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":{left}'), body, F.lit(f"{right}}}"))


def to_feature(geometry: Column) -> Column:
    """A GeoJSON Feature with null properties around a geometry text."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":null}'))
