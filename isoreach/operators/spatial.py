"""Spatial joins: cells narrow the candidates to an equi-join, an exact test decides."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.functions.geometry import EARTH_RADIUS_M, envelope, haversine, in_ring, planar
from isoreach.scratch import Scratch

#: Cells each way that the envelope of a ring may cover.
SPAN = 16


def cell_of(value: Column, size: float) -> Column:
    """Number of the grid cell of a coordinate."""
    return F.floor(value / F.lit(size)).cast("int")


def around(column: Column) -> Column:
    """A cell and its two neighbours."""
    return F.array(column - 1, column, column + 1)


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (l, r, distance) of points at most ``radius`` apart (planar).

    Cells as wide as the radius: a point meets the points of nine cells.  Both
    sides are ``(id, x, y)`` with ids ``l`` and ``r``.  A small file can hold many
    points, so neither side is broadcast by its size on disk.
    """
    a = left.select(F.col("l"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    a = a.withColumn("cx", F.explode(around(cell_of(F.col("lx"), radius)))).withColumn("cy", F.explode(around(cell_of(F.col("ly"), radius))))
    b = right.select("r", F.col("x").alias("rx"), F.col("y").alias("ry"))
    b = b.withColumn("cx", cell_of(F.col("rx"), radius)).withColumn("cy", cell_of(F.col("ry"), radius))
    d = planar(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))
    return a.join(b.hint("merge"), ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select("l", "r", "distance")


def nearest_in_meters(left: DataFrame, right: DataFrame, meters: float) -> DataFrame:
    """(l, r, distance): the nearest right point within a great-circle distance.

    Rows of cells are as high as the bound; each row has as many cells around
    the globe as are surely as wide as the bound at the greatest latitude that
    a pair with a point in the row can have.  So the 3 x 3 cells around a point
    hold all points within the bound, also across the antimeridian.
    """
    half = min(max(meters, 1.0), math.pi * EARTH_RADIUS_M) / (2 * EARTH_RADIUS_M) * 1.001
    height = math.degrees(2 * half)
    greatest = F.least(F.lit(90.0), F.greatest(F.abs(F.col("cy") - 1), F.abs(F.col("cy") + 2)) * height)
    bound = F.least(F.lit(1.0), F.lit(math.sin(min(half, math.pi / 2))) / F.greatest(F.cos(F.radians(greatest)), F.lit(1e-12)))
    cells = F.greatest(F.lit(1), F.floor(F.lit(math.pi) / F.asin(bound)))
    column = lambda x: F.floor((F.col(x) + 180) * F.col("n") / 360)
    a = left.select("l", F.col("x").alias("lx"), F.col("y").alias("ly")).withColumn("cy", F.explode(around(cell_of(F.col("ly"), height)))).withColumn("n", cells)
    a = a.withColumn("cx", F.explode(F.array_distinct(F.transform(around(column("lx")), lambda c: F.pmod(c, F.col("n"))))))
    b = right.select("r", F.col("x").alias("rx"), F.col("y").alias("ry")).withColumn("cy", cell_of(F.col("ry"), height)).withColumn("n", cells)
    b = b.withColumn("cx", F.pmod(column("rx"), F.col("n"))).drop("n")
    exact = haversine(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))
    near = a.join(b, ["cx", "cy"]).withColumn("distance", exact).where(F.col("distance") <= meters)
    return near.groupBy("l").agg(F.min(F.struct("distance", "r")).alias("m")).select("l", "m.r", "m.distance")


def nearest(left: DataFrame, right: DataFrame, cell: float, meters: float | None = None) -> DataFrame:
    """(l, r, distance): the nearest right point of every left point.

    Left points look into squares of growing cells until the nearest found is
    no farther than a square surely covers, or the squares cover all points;
    each round is written, so none repeats the work of those before.  Ties go
    to the lower ``r``.  ``meters`` bounds the great-circle distance, and points
    beyond it drop out; the cells then follow from the bound.  Distances are
    planar otherwise.
    """
    if meters is not None:
        return nearest_in_meters(left, right, meters)
    scratch = Scratch(left.sparkSession, "nearest")
    rest = scratch.table(left.select("l", F.col("x").alias("lx"), F.col("y").alias("ly")), "0")
    b = scratch.table(right.select("r", F.col("x").alias("rx"), F.col("y").alias("ry")), "right")
    box = rest.select(F.col("lx").alias("x"), F.col("ly").alias("y")).union(b.select("rx", "ry")).agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]).first()
    span = 0.0 if box["x0"] is None else max(box["x1"] - box["x0"], box["y1"] - box["y0"])
    size, k, out = cell, 0, []
    while not rest.isEmpty():
        k += 1
        last = size >= span
        a = rest.withColumn("cx", F.explode(around(cell_of(F.col("lx"), size)))).withColumn("cy", F.explode(around(cell_of(F.col("ly"), size))))
        at = b.withColumn("cx", cell_of(F.col("rx"), size)).withColumn("cy", cell_of(F.col("ry"), size))
        flat = planar(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))
        near = a.join(at, ["cx", "cy"]).groupBy("l", "lx", "ly").agg(F.min(F.struct(flat.alias("distance"), F.col("r"))).alias("m"))
        done = near if last else near.where(F.col("m.distance") <= size)
        out.append(scratch.table(done.select("l", F.col("m.r").alias("r"), F.col("m.distance").alias("distance")), f"found{k}"))
        if last:
            break
        rest = scratch.table(rest.join(out[-1].select("l"), "l", "left_anti"), str(k))
        size *= 4
    if not out:
        return rest.join(b.limit(0), F.lit(False)).select("l", "r", F.lit(0.0).alias("distance"))
    return reduce(DataFrame.unionByName, out)


def points_in_rings(points: DataFrame, rings: DataFrame, ring_id: str, cell: float = 0.01) -> DataFrame:
    """Points with the id of every ring that holds them (one row per pair).

    Rings are dealt over the cells of their envelope, points to their own cell;
    the bounding box is tested before the ring.  A large ring takes cells that
    double until its envelope covers ``SPAN`` or fewer each way, and points are
    dealt to cells of every size in use (at most one per doubling).
    """
    box = envelope(F.col("ring"))
    wide = F.greatest(F.col("_box.xmax") - F.col("_box.xmin"), F.col("_box.ymax") - F.col("_box.ymin"))
    r = rings.select(ring_id, "ring", box.alias("_box"))
    r = r.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide / (cell * SPAN), F.lit(1.0))))).cast("int"))
    levels = [row[0] for row in r.select("_level").where("_level is not null").distinct().collect()]  # a few dozen at most
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    cell_at = lambda c: F.floor(c / size).cast("long")
    span = lambda lo, hi: F.sequence(cell_at(F.col(lo)), cell_at(F.col(hi)))
    r = r.withColumn("_cx", F.explode(span("_box.xmin", "_box.xmax"))).withColumn("_cy", F.explode(span("_box.ymin", "_box.ymax")))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    p = p.withColumn("_cx", cell_at(F.col("x"))).withColumn("_cy", cell_at(F.col("y")))
    boxed = F.col("x").between(F.col("_box.xmin"), F.col("_box.xmax")) & F.col("y").between(F.col("_box.ymin"), F.col("_box.ymax"))
    return p.join(r, ["_level", "_cx", "_cy"]).where(boxed & in_ring(F.col("x"), F.col("y"), F.col("ring"))).drop("_level", "_cx", "_cy", "_box", "ring")


def _segments(rows: DataFrame, key: str, line: str, names: str) -> DataFrame:
    """(key, segment ends named by ``names``) of consecutive points; a single point is a segment of no length."""
    a, b = names
    point = F.col(line)
    ends = F.when(F.size(point) > 1, F.transform(F.sequence(F.lit(1), F.size(point) - 1), lambda i: F.struct(F.element_at(point, i).alias("p"), F.element_at(point, i + 1).alias("q"))))
    ends = F.coalesce(ends, F.when(F.size(point) == 1, F.array(F.struct(F.element_at(point, 1).alias("p"), F.element_at(point, 1).alias("q")))))
    each = rows.select(key, F.explode(ends).alias("s"))
    return each.select(key, *[F.col(f"s.{e}.{c}").cast("double").alias(f"{n}{c}") for e, n in (("p", a), ("q", b)) for c in "xy"])


def _with_cells(segments: DataFrame, names: str, size: Column, pad: int) -> DataFrame:
    """Segments once per cell that they may touch, column by column, with ``pad`` cells around."""
    a, b = names
    _at = lambda value: F.floor(value / size).cast("int")
    ax, ay, bx, by = (F.col(f"{n}{c}") for n in (a, b) for c in "xy")
    left, right = F.least(ax, bx), F.greatest(ax, bx)
    out = segments.withColumn("_cx", F.explode(F.sequence(_at(left) - pad, _at(right) + pad)))
    clipped = lambda x: F.least(F.greatest(x, left), right)
    steep = F.coalesce(F.try_divide(by - ay, bx - ax), F.lit(0.0))
    at = lambda x: F.when(ax == bx, F.lit(None)).otherwise(F.least(F.greatest(ay + (clipped(x) - ax) * steep, F.least(ay, by)), F.greatest(ay, by)))
    first, last = at((F.col("_cx") - pad) * size), at((F.col("_cx") + 1 + pad) * size)
    low, high = F.coalesce(F.least(first, last), F.least(ay, by)), F.coalesce(F.greatest(first, last), F.greatest(ay, by))
    return out.withColumn("_cy", F.explode(F.sequence(_at(low) - pad, _at(high) + pad)))


def segments_meet() -> Column:
    """Whether segments a-b and c-d share a point: their boxes meet, and each lies on both sides of the other's line or on it."""
    p = {n: (F.col(f"{n}x"), F.col(f"{n}y")) for n in "abcd"}
    side = lambda o, q, r: F.signum((p[q][0] - p[o][0]) * (p[r][1] - p[o][1]) - (p[q][1] - p[o][1]) * (p[r][0] - p[o][0]))
    boxes = F.lit(True)
    for i in (0, 1):
        boxes = boxes & (F.greatest(p["a"][i], p["b"][i]) >= F.least(p["c"][i], p["d"][i])) & (F.greatest(p["c"][i], p["d"][i]) >= F.least(p["a"][i], p["b"][i]))
    return boxes & (side("a", "b", "c") * side("a", "b", "d") <= 0) & (side("c", "d", "a") * side("c", "d", "b") <= 0)


def lines_in_rings(lines: DataFrame, rings: DataFrame, key: str, ring_id: str, cell: float = 0.01) -> DataFrame:
    """(key, ring id) of lines that share a point with a ring's area or its border.

    ``lines(key, line)``, ``rings(ring_id, ring)``.  A line has its first point
    inside, or one of its segments meets one of the border: segments and borders
    are dealt over the cells along them for an equi-join, and the test is
    exact.  Segments outside the box of all rings are left out first, and long
    ones take cells that double until they cover about ``SPAN`` of them each
    way, so that the rows dealt do not grow with the length of a segment.  Lines
    without points meet nothing; a ring need not be closed.
    """
    starts = lines.select(key, F.get("line", F.lit(0))["x"].alias("x"), F.get("line", F.lit(0))["y"].alias("y")).where("x is not null and y is not null")
    closed = rings.where("size(ring) > 0").select(ring_id, F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))
    inside = points_in_rings(starts, closed, ring_id, cell).select(key, ring_id)
    border = _segments(closed, ring_id, "ring", "cd")
    box = border.agg(*[f(g(f"c{c}", f"d{c}")).alias(f"_{c}{i}") for c in "xy" for i, (f, g) in enumerate(((F.min, F.least), (F.max, F.greatest)))])
    along = _segments(lines, key, "line", "ab").where("ax is not null and ay is not null and bx is not null and by is not null")
    boxed = F.lit(True)
    for c in "xy":
        boxed = boxed & (F.greatest(f"a{c}", f"b{c}") >= F.col(f"_{c}0")) & (F.least(f"a{c}", f"b{c}") <= F.col(f"_{c}1"))
    along = along.crossJoin(F.broadcast(box)).where(boxed).drop("_x0", "_x1", "_y0", "_y1")  # one row
    wide = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")))
    along = along.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide / (cell * SPAN), F.lit(1.0))))).cast("int"))
    along = Scratch(lines.sparkSession, "rings").table(along, "along")  # read for its levels and for the join
    levels = [row[0] for row in along.select("_level").distinct().collect()]  # a few dozen at most
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    border = _with_cells(border.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))), "cd", size, 1)
    crossing = _with_cells(along, "ab", size, 0).join(border, ["_level", "_cx", "_cy"]).where(segments_meet()).select(key, ring_id)
    return inside.union(crossing).distinct()


def exactly_one(points: DataFrame, rings: DataFrame, key: str, ring_id: str) -> DataFrame:
    """Overlay: points inside exactly one ring, with its id; others drop out."""
    found = points_in_rings(points, rings, ring_id)
    return found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def first_match(points: DataFrame, rings: DataFrame, key: str, ring_id: str) -> DataFrame:
    """(key, ring id): one ring per point, the least id of those that hold it."""
    return points_in_rings(points, rings, ring_id).groupBy(key).agg(F.min(ring_id).alias(ring_id))
