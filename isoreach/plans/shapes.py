"""Queries on geometry, identifiers and dates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from isoreach.functions import dates, geometry as geo, ids, kernels
from isoreach.operators import bins, grid as grids
from isoreach.operators.isochrones import encoded
from isoreach.plans.domain import table
from isoreach.plans.network import HAVERSINE
from isoreach.shipping import ship


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def _lines(spark, sf_dir):
    """Parts as lines: from a grid point east by p_size thousandths, then north."""
    k = F.col("p_partkey")
    x, y, step = F.lit(-105.0) + 0.001 * (k % 50), F.lit(40.0) + 0.001 * F.floor(k / 50), 0.001 * F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.array(_point(x, y), _point(x + step, y), _point(x + step, y + 0.002)).alias("line"))


def line_lengths(spark, sf_dir):
    """Length of every line, and a quarter of it."""
    line = F.col("line")
    return _lines(spark, sf_dir).select("p_partkey", F.round(geo.line_length(line), 3).alias("meters"), F.round(geo.length_at(line, F.lit(0.25)), 3).alias("quarter"))


def points_at(spark, sf_dir):
    """The point at three tenths of every line."""
    at = geo.point_at(F.col("line"), F.lit(0.3))
    return _lines(spark, sf_dir).select("p_partkey", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


def sub_lines(spark, sf_dir):
    """From three to nine tenths: how many points, where it starts, and where it starts backwards."""
    part = geo.sub_line(F.col("line"), F.lit(0.3), F.lit(0.9), F.col("p_partkey") % 2 == 1)
    made = _lines(spark, sf_dir).withColumn("part", part)
    first = F.element_at("part", 1)
    return made.select("p_partkey", F.size("part").alias("points"), F.round(first["x"], 6).alias("x"), F.round(first["y"], 6).alias("y"))


def exit_bearings(spark, sf_dir):
    """Bearing of the last leg of every line, and of the line backwards."""
    return _lines(spark, sf_dir).select("p_partkey", F.round(geo.exit_bearing(F.col("line")), 4).alias("out"), F.round(geo.exit_bearing(F.reverse("line")), 4).alias("back"))


def points_along(spark, sf_dir):
    """Number of points every 100 meters along a line, its end included."""
    return _lines(spark, sf_dir).select("p_partkey", F.size(geo.points_along(F.col("line"), 100.0)).alias("points"))


def circles(spark, sf_dir):
    """Corners of a square 500 meters around every supplier."""
    k = F.col("s_suppkey")
    ring = geo.circle(F.lit(-105.0) + 0.01 * (k % 10), F.lit(40.0) + 0.01 * F.floor(k / 10), 500.0, corners=4)
    made = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(ring).alias("corner", "p"))
    return made.select("s_suppkey", "corner", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def boxes(spark, sf_dir):
    """Bounding box and center of every line, and the area of its closed ring."""
    box, center = geo.envelope(F.col("line")), geo.centroid(F.col("line"))
    ring = F.concat("line", F.slice("line", 1, 1))
    made = _lines(spark, sf_dir).select("p_partkey", box.alias("b"), center.alias("c"), F.abs(geo.ring_area(ring)).alias("area"))
    return made.select("p_partkey", *[F.round(f"b.{n}", 6).alias(n) for n in ("xmin", "xmax", "ymin", "ymax")], F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round("area", 9).alias("area"))


def _half(spark, sf_dir):
    """Parts as lines whose coordinates are halves, which print alike everywhere."""
    k = F.col("p_partkey")
    x, y = (k % 50) + 0.5, F.col("p_size") + 0.5
    return table(spark, sf_dir, "part").select("p_partkey", F.array(_point(x, y), _point(x + 1, y), _point(x + 1, y + 2)).alias("line"))


def geometry_texts(spark, sf_dir):
    """Lines as WKT and as a GeoJSON feature."""
    line = F.col("line")
    return _half(spark, sf_dir).select("p_partkey", geo.to_wkt(line).alias("wkt"), geo.to_feature(geo.to_geojson(line)).alias("feature"))


def geometry_codecs(spark, sf_dir):
    """Lines through WKT, GeoJSON, WKB and WKT again, read back as points."""
    rows = _half(spark, sf_dir).select("p_partkey", geo.to_wkt(F.col("line")).alias("g"))
    for form in ("geojson", "wkb", "wkt"):
        rows = encoded("g", rows, form)
    line = geo.from_wkt(F.col("g"))
    return rows.select("p_partkey", F.size(line).alias("points"), F.element_at(line, 1)["x"].alias("x"), F.element_at(line, -1)["y"].alias("y"))


def sampled_points(spark, sf_dir):
    """How many of the points sampled in every nation's L-shaped polygon lie inside of it."""
    ship(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("zone"), F.col("n_regionkey").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for zone, n in zip(batch["zone"], batch["n"], strict=True):
                ring = np.array([[0, 0], [4, 0], [4, 1], [1, 1], [1, 3], [0, 3]], float) + zone
                out += [(zone, float(x), float(y)) for x, y in kernels.sample_polygon(ring, 5 + int(n), int(zone))]
            yield pd.DataFrame(out, columns=["zone", "x", "y"])

    points = rows.mapInPandas(run, "zone long, x double, y double")
    corners = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3), (0, 0)]
    ring = F.array(*[_point(F.col("zone") + float(x), F.col("zone") + float(y)) for x, y in corners])
    return points.where(geo.in_ring(F.col("x"), F.col("y"), ring)).groupBy("zone").agg(F.count(F.lit(1)).alias("inside"))


def zone_ids(spark, sf_dir):
    """Zone ids of orders by status, priority's number and key."""
    made = ids.zone_id(F.lit("ag"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("zone"))


def row_ids(spark, sf_dir):
    """Row ids of lines by orientation, parsed back where they name an edge."""
    kind = F.when(F.col("l_returnflag") == "R", "origin").when(F.col("l_returnflag") == "A", "destination").otherwise("edge")
    made = ids.row_id(kind, F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey"))
    parsed = ids.parse_edge_row(F.col("row_id"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", made.alias("row_id"))
    return rows.select("l_orderkey", "row_id", F.coalesce(parsed["edge_list_id"], F.lit(-1)).alias("edge_list_id"), F.coalesce(parsed["edge_id"], F.lit(-1)).alias("edge_id"))


def way_paths(spark, sf_dir):
    """Number of nodes of each order's way between two of its nodes, if they are in this order."""
    ways = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("long"))).alias("nodes"))
    between = ids.path_between(F.col("nodes"), F.lit(2).cast("long"), F.lit(5).cast("long"))
    return ways.select("l_orderkey", F.size(between).alias("n")).where("n > 0")


def boxed_orders(spark, sf_dir):
    """Lines whose box lies in a box given as text."""
    box = geo.envelope(F.col("line"))
    return _lines(spark, sf_dir).where(geo.box_within(box, ids.parse_bbox("-104.99,-104.96,40.01,40.02"))).select("p_partkey")


def stepped_dates(spark, sf_dir):
    """Order dates a week back and their keys as fractional seconds past midnight, late ones null."""
    o = table(spark, sf_dir, "orders")
    start = F.to_date("o_orderdate").cast("timestamp_ntz")
    delta = F.when(F.col("o_orderstatus") == "P", F.lit(float("inf"))).otherwise(F.col("o_orderkey") / 4)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    return o.select("o_orderkey", F.date_format(dates.step_date(F.to_date("o_orderdate"), -7), "yyyy-MM-dd").alias("week_before"), text(dates.start_plus(start, F.col("o_orderkey") / 4)).alias("at"), text(dates.shifted(start, delta)).alias("delayed"))


def travel_minutes(spark, sf_dir):
    """Whole minutes of travel by line, with the delay at the destination where there is one."""
    delay = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") * 60)
    seconds = F.col("l_quantity") * 37
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", bins.legacy_minutes(seconds, delay).alias("minutes"))
    return rows.groupBy("l_returnflag", "minutes").agg(F.count(F.lit(1)).alias("n"))


def _extents(spark, sf_dir):
    """One rectangle per region, as WKT."""
    k = F.col("r_regionkey").cast("double")
    corner = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    x1, y1, x2, y2 = k, F.lit(0.25), k * 2 + 1.25, F.lit(2.5)
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(",", corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2), corner(x1, y1)), F.lit("))"))
    return table(spark, sf_dir, "region").select("r_regionkey", wkt.alias("extent"))


def grid_cells(spark, sf_dir):
    """Unit cells that touch every region's rectangle, with their centers."""
    cells = grids.grid(_extents(spark, sf_dir), 1.0)
    return cells.select("r_regionkey", "grid_id", "origin_x", "origin_y")


def area_population(spark, sf_dir):
    """Customers of regions, by the share of the region's rectangle in each cell of any."""
    extents = _extents(spark, sf_dir)
    cells = grids.grid(extents, 1.0).select("grid_id", "geometry").distinct()
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    people = table(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy(F.col("n_regionkey").alias("zone_id")).agg(F.count(F.lit(1)).alias("population"))
    zones = extents.select(F.col("r_regionkey").alias("zone_id"), F.col("extent").alias("geometry")).join(people, "zone_id")
    return grids.population(cells, zones).select("grid_id", F.round("population", 6).alias("population"))


LINES_SQL = """l0 AS (SELECT p_partkey, -105.0 + 0.001 * (p_partkey % 50) AS x, 40.0 + 0.001 * (p_partkey // 50) AS y, 0.001 * p_size AS s FROM part),
l1 AS (SELECT *, x + s AS x2, y + 0.002 AS y2 FROM l0),
l AS (SELECT *, {a} AS a, {b} AS b FROM l1)""".format(a=HAVERSINE.format(x1="x", y1="y", x2="x2", y2="y"), b=HAVERSINE.format(x1="x2", y1="y", x2="x2", y2="y2"))
AT_SQL = "CASE WHEN {f} * (a + b) <= a THEN x + {f} * (a + b) / nullif(a, 0) * s ELSE x2 END AS px{i}, CASE WHEN {f} * (a + b) <= a THEN y ELSE y + ({f} * (a + b) - a) / b * 0.002 END AS py{i}"
EXTENT_SQL = "e AS (SELECT r_regionkey, CAST(r_regionkey AS DOUBLE) AS x1, 0.25 AS y1, r_regionkey * 2 + 1.25 AS x2, 2.5 AS y2 FROM region)"
CELLS_SQL = f"{EXTENT_SQL}, c AS (SELECT r_regionkey, i, j FROM e, range(0, 12) a(i), range(0, 4) b(j) WHERE least(x2, i + 1) > greatest(x1, i) AND least(y2, j + 1) > greatest(y1, j))"

QUERIES = {
    "line_lengths": (line_lengths, f"WITH {LINES_SQL} SELECT p_partkey, round(a + b, 3) AS meters, round((a + b) * 0.25, 3) AS quarter FROM l"),
    "points_at": (points_at, f"WITH {LINES_SQL}, p AS (SELECT p_partkey, {AT_SQL.format(f=0.3, i=1)} FROM l) SELECT p_partkey, round(px1, 6) AS x, round(py1, 6) AS y FROM p"),
    "sub_lines": (sub_lines, f"WITH {LINES_SQL}, p AS (SELECT p_partkey, a / (a + b) > 0.3 + 1e-6 AND a / (a + b) < 0.9 - 1e-6 AS inner_point, {AT_SQL.format(f=0.3, i=1)}, {AT_SQL.format(f=0.9, i=2)} FROM l) SELECT p_partkey, CAST(2 + CAST(inner_point AS INTEGER) AS INTEGER) AS points, round(CASE WHEN p_partkey % 2 = 1 THEN px2 ELSE px1 END, 6) AS x, round(CASE WHEN p_partkey % 2 = 1 THEN py2 ELSE py1 END, 6) AS y FROM p"),
    "exit_bearings": (exit_bearings, f"WITH {LINES_SQL}, d AS (SELECT p_partkey, degrees(atan2(sin(radians(x - x2)) * cos(radians(y)), cos(radians(y)) * sin(radians(y)) - sin(radians(y)) * cos(radians(y)) * cos(radians(x - x2)))) AS w FROM l) SELECT p_partkey, CAST(0 AS DOUBLE) AS out, round((w + 360) - 360 * floor((w + 360) / 360), 4) AS back FROM d"),
    "points_along": (points_along, f"WITH {LINES_SQL} SELECT p_partkey, CAST(CASE WHEN a + b < 100 THEN 2 ELSE floor((a + b) / 100) + 2 END AS INTEGER) AS points FROM l"),
    "circles": (circles, "WITH s AS (SELECT s_suppkey, -105.0 + 0.01 * (s_suppkey % 10) AS x, 40.0 + 0.01 * (s_suppkey // 10) AS y, 500.0 / (6371008.8 * pi() / 180) AS r FROM supplier), c AS (SELECT * FROM (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1), (4, 1, 0)) v(corner, dx, dy)) SELECT s_suppkey, corner, round(x + r * dx / cos(radians(y)), 6) AS x, round(y + r * dy, 6) AS y FROM s CROSS JOIN c"),
    "boxes": (boxes, f"WITH {LINES_SQL}, d AS (SELECT p_partkey, CAST(x AS DOUBLE) AS x, CAST(x2 AS DOUBLE) AS x2, CAST(y AS DOUBLE) AS y, CAST(y2 AS DOUBLE) AS y2, CAST(s AS DOUBLE) AS s FROM l) SELECT p_partkey, round(x, 6) AS xmin, round(x2, 6) AS xmax, round(y, 6) AS ymin, round(y2, 6) AS ymax, round((x + x2) / 2, 6) AS x, round((y + y2) / 2, 6) AS y, round(s * 0.001, 9) AS area FROM d"),
    "geometry_texts": (geometry_texts, """WITH p AS (SELECT p_partkey, CAST(p_partkey % 50 + 0.5 AS DOUBLE) AS x, CAST(p_size + 0.5 AS DOUBLE) AS y FROM part)
SELECT p_partkey, 'LINESTRING(' || x || ' ' || y || ',' || (x + 1) || ' ' || y || ',' || (x + 1) || ' ' || (y + 2) || ')' AS wkt,
 '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || x || ',' || y || '],[' || (x + 1) || ',' || y || '],[' || (x + 1) || ',' || (y + 2) || ']]},"properties":null}' AS feature FROM p"""),
    "geometry_codecs": (geometry_codecs, "SELECT p_partkey, 3 AS points, CAST(p_partkey % 50 + 0.5 AS DOUBLE) AS x, CAST(p_size + 2.5 AS DOUBLE) AS y FROM part"),
    "sampled_points": (sampled_points, "SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST(5 + n_regionkey AS BIGINT) AS inside FROM nation"),
    "zone_ids": (zone_ids, "SELECT o_orderkey, 'ag-' || o_orderstatus || '-' || left(o_orderpriority, 1) || '-' || o_orderkey AS zone FROM orders"),
    "row_ids": (row_ids, "SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN CAST(l_orderkey AS VARCHAR) WHEN 'A' THEN CAST(l_suppkey AS VARCHAR) ELSE l_linenumber || '-' || l_partkey END AS row_id, CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE -1 END AS edge_list_id, CASE WHEN l_returnflag = 'N' THEN l_partkey ELSE -1 END AS edge_id FROM lineitem"),
    "way_paths": (way_paths, "SELECT l_orderkey, CAST(count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 2 AND 5) AS INTEGER) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 2) > 0 AND count(*) FILTER (l_linenumber = 5) > 0"),
    "boxed_orders": (boxed_orders, f"WITH {LINES_SQL} SELECT p_partkey FROM l WHERE x >= -104.99 AND x2 <= -104.96 AND y >= 40.01 AND y2 <= 40.02"),
    "stepped_dates": (stepped_dates, "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before, strftime(date_trunc('day', o_orderdate) + to_milliseconds(o_orderkey * 250), '%Y-%m-%d %H:%M:%S.%g') AS at, CASE WHEN o_orderstatus <> 'P' THEN strftime(date_trunc('day', o_orderdate) + to_milliseconds(o_orderkey * 250), '%Y-%m-%d %H:%M:%S.%g') END AS delayed FROM orders"),
    "travel_minutes": (travel_minutes, "SELECT l_returnflag, CAST(floor((l_quantity * 37 + CASE WHEN l_returnflag <> 'N' THEN l_linenumber * 60 ELSE 0 END) / 60) AS BIGINT) AS minutes, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "grid_cells": (grid_cells, f"WITH {CELLS_SQL} SELECT r_regionkey, i || ':' || j AS grid_id, i + CAST(0.5 AS DOUBLE) AS origin_x, j + CAST(0.5 AS DOUBLE) AS origin_y FROM c"),
    "area_population": (area_population, f"""WITH {CELLS_SQL}, p AS (SELECT n_regionkey AS z, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
o AS (SELECT c.i, c.j, p.n * greatest(0, least(x2, i + 1) - greatest(x1, i)) * greatest(0, least(y2, j + 1) - greatest(y1, j)) / ((x2 - x1) * (y2 - y1)) AS v FROM (SELECT DISTINCT i, j FROM c) c, e JOIN p ON p.z = e.r_regionkey)
SELECT i || ':' || j AS grid_id, round(CAST(sum(v) AS DOUBLE), 6) AS population FROM o GROUP BY 1 HAVING sum(v) > 0"""),
}
