"""Queries on output rows, means by class, and where trips end."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach.functions import geometry as geo
from isoreach.graph.search import Constraints, reach
from isoreach.operators import bins, metrics, output
from isoreach.plans.domain import TAGGED_SQL, TREE_SQL, table, tagged_edges, torus, vertices


def _tree(spark, sf_dir, cost=30.0):
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))
    return bins.destinations(reach(origins, torus(spark, sf_dir), Constraints(cost=cost))).where(F.col("cost") < cost)


def scaffolded_results(spark, sf_dir):
    """Customers with the run's parameters and one more nested value."""
    rows = output.scaffold(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), {"format": "aggregate", "limits": (10.0, 20.0)})
    rows = output.set_value(rows, "info.account.total", F.col("c_acctbal"))
    rows = output.set_value(rows, "info.format", F.lit("disaggregate"), overwrite=True)
    return rows.select("c_custkey", F.col("info.format").alias("format"), F.element_at("info.limits", 2).alias("last"), F.col("info.account.total").alias("total"))


def scaffolded_bins(spark, sf_dir):
    """The bins of every nation's row, in order."""
    rows = output.scaffold_bins(table(spark, sf_dir, "nation").select("n_nationkey"), bins.Binning("cost", (10, 20, 40), marginal=True, prepend_zero=True))
    return output.bin_list(rows, ["n_nationkey"])


def single_values(spark, sf_dir):
    """One value by its JSON path, and the only element of a list."""
    e = table(spark, sf_dir, "events")
    listed = F.concat(F.lit('{"all":[{"v":"'), F.col("event_type"), F.lit('"}]}'))
    return e.select("event_id", output.single_value(F.col("props"), "$.k").cast("long").alias("k"), output.single_value(listed, "$.all[*].v").alias("kind"))


def typed_speeds(spark, sf_dir):
    """Mean speeds by size of street, class and whether one-way, and over all."""
    edges = tagged_edges(spark, sf_dir).withColumn("subtype", F.when(F.col("highway") == "motorway", "road"))
    out = metrics.class_speeds(edges, ["subtype", "class", "oneway"])
    return out.select("subtype", "class", "oneway", F.round("kph", 4).alias("kph"), "total")


def global_speed(spark, sf_dir):
    """Mean speed over all edges."""
    return metrics.global_speed(tagged_edges(spark, sf_dir)).select(F.round("kph", 4).alias("kph"))


def edge_statistics(spark, sf_dir):
    """Edges, length and mean speed by class and over all."""
    out = metrics.summary(tagged_edges(spark, sf_dir))
    return out.select("class", "edges", F.round("length_m", 2).alias("length_m"), F.round("kph", 4).alias("kph"), "total")


def destination_points(spark, sf_dir):
    """Points every 100 meters along the last edge to every destination."""
    at = vertices(spark, sf_dir)
    end = lambda name, i: at.select(F.col("vertex_id").alias(name), F.struct("x", "y").alias(i))
    lines = torus(spark, sf_dir).join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("edge_list_id", "edge_id", F.array("a", "b").alias("line"))
    tree = _tree(spark, sf_dir, 12.0)
    ends = output.destination_points(tree, lines).groupBy("origin").agg(F.count(F.lit(1)).alias("ends"), F.round(F.sum("x"), 6).alias("x"))
    every = output.destination_points(tree, lines, "all").groupBy("origin").agg(F.count(F.lit(1)).alias("points"))
    along = output.destination_points(tree, lines, "stride", 1e7).groupBy("origin").agg(F.count(F.lit(1)).alias("along"))
    return ends.join(every, "origin").join(along, "origin")


def arrival_delays(spark, sf_dir):
    """Cost of arriving with a delay at every second nation."""
    delays = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex_id"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("double")).alias("delay"))
    out = output.with_arrival_delay(_tree(spark, sf_dir), delays)
    return out.select("origin", "vertex_id", F.col("arrival_cost").cast("long").alias("cost"))


def archives_in_extent(spark, sf_dir):
    """Nations with a supplier inside of a square."""
    k = F.col("s_suppkey")
    stops = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("archive"), (k % 20 + 0.5).alias("x"), (F.floor(k / 20) + 0.5).alias("y"))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = spark.range(1).select(F.col("id").alias("ring_id"), F.array(point(4.0, 0.0), point(9.0, 0.0), point(9.0, 3.0), point(4.0, 3.0), point(4.0, 0.0)).alias("ring"))
    return output.archives_in_extent(stops, ring)


def states(spark, sf_dir):
    """The states of the nation, with the nations of the table that lie in the first ones' rectangles."""
    region = output.study_region(spark)
    low = F.col("geoid").cast("double") * 2
    corner = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(",", corner(low, F.lit(0.0)), corner(low + 2, F.lit(0.0)), corner(low + 2, F.lit(1.0)), corner(low, F.lit(1.0)), corner(low, F.lit(0.0))), F.lit("))"))
    at = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 0.5).alias("x"), F.lit(0.5).alias("y"))
    return output.zones_of_points(at, region.select("geoid", wkt.alias("geometry")), "n_nationkey")


def scaled_regions(spark, sf_dir):
    """Squares around the equator, scaled so that each side grows by half."""
    k = F.col("r_regionkey").cast("double")
    corner = lambda dx, dy: F.concat_ws(" ", (k + dx).cast("string"), F.lit(str(dy)))
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(",", corner(-0.25, -0.25), corner(0.25, -0.25), corner(0.25, 0.25), corner(-0.25, 0.25), corner(-0.25, -0.25)), F.lit("))"))
    rows = table(spark, sf_dir, "region").select("r_regionkey", wkt.alias("geometry"))
    half = 0.5 * 39313.6  # meters from the center to a corner, near the equator
    box = geo.envelope(geo.from_wkt(F.col("geometry")))
    return output.scaled_exteriors(rows, "r_regionkey", half).select("r_regionkey", F.round(box["xmax"] - box["xmin"], 2).alias("width"), F.round((box["xmax"] + box["xmin"]) / 2, 4).alias("x"))


KPH = "round(sum(length_m * mph) / nullif(sum(CASE WHEN mph IS NOT NULL THEN length_m END), 0) * 1.609344, 4) AS kph"
POINTS_SQL = f"{TREE_SQL}, near AS (SELECT origin, vertex FROM dest WHERE cost < 12)"
QUERIES = {
    "scaffolded_results": (scaffolded_results, "SELECT c_custkey, 'disaggregate' AS format, CAST(20 AS DOUBLE) AS last, c_acctbal AS total FROM customer"),
    "scaffolded_bins": (scaffolded_bins, "SELECT n_nationkey, bin_key, lo, hi FROM nation, (VALUES ('10', CAST(0 AS DOUBLE), CAST(10 AS DOUBLE)), ('20', 10, 20), ('40', 20, 40)) b(bin_key, lo, hi)"),
    "single_values": (single_values, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events"),
    "typed_speeds": (typed_speeds, f"WITH {TAGGED_SQL} SELECT CASE WHEN highway = 'motorway' THEN 'road' END AS subtype, class, oneway, {KPH}, false AS total FROM tagged GROUP BY 1, 2, 3 UNION ALL SELECT NULL, NULL, NULL, {KPH}, true FROM tagged"),
    "global_speed": (global_speed, f"WITH {TAGGED_SQL} SELECT {KPH} FROM tagged"),
    "edge_statistics": (edge_statistics, f"WITH {TAGGED_SQL} SELECT class, count(*) AS edges, round(sum(length_m), 2) AS length_m, {KPH}, grouping(class) = 1 AS total FROM tagged GROUP BY ROLLUP (class)"),
    "destination_points": (destination_points, f"{POINTS_SQL} SELECT CAST(origin AS BIGINT) AS origin, count(*) AS ends, round(CAST(sum(-105.0 + 0.01 * (vertex % 5)) AS DOUBLE), 6) AS x, 2 * count(*) AS points, 2 * count(*) AS along FROM near GROUP BY 1"),
    "arrival_delays": (arrival_delays, f"{TREE_SQL} SELECT CAST(origin AS BIGINT) AS origin, CAST(vertex AS BIGINT) AS vertex_id, cost + CASE WHEN n_regionkey > 1 THEN n_regionkey ELSE 0 END AS cost FROM dest JOIN nation ON n_nationkey = vertex WHERE cost < 30"),
    "archives_in_extent": (archives_in_extent, "SELECT DISTINCT s_nationkey AS archive FROM supplier WHERE s_suppkey % 20 BETWEEN 4 AND 8 AND s_suppkey // 20 BETWEEN 0 AND 2"),
    "states": (states, "WITH g AS (SELECT g FROM range(1, 57) t(g) WHERE g NOT IN (3, 7, 14, 43, 52)) SELECT n_nationkey, lpad(CAST(g AS VARCHAR), 2, '0') AS geoid FROM nation JOIN g ON n_nationkey // 2 = g"),
    "scaled_regions": (scaled_regions, "SELECT r_regionkey, CAST(0.75 AS DOUBLE) AS width, CAST(r_regionkey AS DOUBLE) AS x FROM region"),
}
