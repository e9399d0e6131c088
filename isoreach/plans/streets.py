"""Queries on street networks: searches that grow with the tables, imports, contraction, islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach.functions import geometry as geo
from isoreach.functions import tags
from isoreach.graph import contraction, edits, islands
from isoreach.graph.search import Constraints, Limit, OnDemand, Timetable, reach, with_costs
from isoreach.operators import bins, isochrones as iso, opportunities as opp, overture
from isoreach.operators.spatial import lines_in_rings
from isoreach.plans.domain import TORUS_SQL, TREE_SQL, table, torus, vertices
from isoreach.sources import osm

WIDTH = 40  # streets of the grid of parts


def _origins(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))


def _costs(tree):
    return bins.destinations(tree).select("origin", "vertex_id", F.col("cost").cast("long").alias("cost"))


def streets(spark, sf_dir):
    """Parts as corners of a grid of streets; walks to the next corner east and south cost by size."""
    k = F.col("p_partkey")
    at = table(spark, sf_dir, "part").select(k.alias("src"), (1 + F.col("p_size") % 5).cast("double").alias("cost"), (100.0 + F.col("p_size")).alias("distance"))
    last = at.agg(F.max("src").alias("last"))
    both = at.crossJoin(F.broadcast(last)).withColumn("step", F.explode(F.array(F.lit(1), F.lit(WIDTH))))  # one row
    inside = F.when(F.col("step") == 1, F.col("src") % WIDTH < WIDTH - 1).otherwise(True) & (F.col("src") + F.col("step") <= F.col("last"))
    ahead = both.where(inside).select("src", (F.col("src") + F.col("step")).alias("dst"), "step", "cost", "distance")
    back = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "step", "cost", "distance")
    edges = ahead.unionByName(back)
    return edges.select("src", "dst", F.lit(0).alias("edge_list_id"), (F.col("src") * 100 + F.col("dst") - F.col("src") + WIDTH).alias("edge_id"), F.lit("walk").alias("mode"), "cost", "distance")


def street_access(spark, sf_dir):
    """Corners within twelve minutes' walk of every supplier's corner: how many, and the dearest."""
    origins = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("origin"))
    tree = _costs(reach(origins, streets(spark, sf_dir), Constraints(cost=12.0))).where("cost <= 12")
    return tree.groupBy("origin").agg(F.count(F.lit(1)).alias("corners"), F.sum("cost").alias("minutes"))


def delayed_tree(spark, sf_dir):
    """Costs after a departure delay by origin."""
    origins = _origins(spark, sf_dir)
    delays = origins.select("origin", (F.col("origin") % 4).cast("double").alias("delay"))
    return _costs(reach(origins, torus(spark, sf_dir), Constraints(cost=30.0), delays=delays)).where("cost < 30")


def mode_limited_tree(spark, sf_dir):
    """Costs of trips that walk at most 12 minutes in all."""
    return _costs(reach(_origins(spark, sf_dir), torus(spark, sf_dir), Constraints(cost=25.0, mode_cost={"walk": 12.0}))).where("cost < 25")


def leg_limited_tree(spark, sf_dir):
    """Costs of trips whose first leg, if by bike, costs under 9, and whose walks cost 5 before they end."""
    limits = Constraints(cost=20.0, max_legs=3, limits=(Limit(9.0, "cost", "max_exclusive", "bike", "first"), Limit(5.0, "cost", "min_inclusive", "walk")))
    return _costs(reach(_origins(spark, sf_dir), torus(spark, sf_dir), limits)).where("cost < 20")


def trip_limited_tree(spark, sf_dir):
    """Costs of trips of less than 1,600 meters."""
    limits = Constraints(cost=40.0, limits=(Limit(1600.0, "distance", "max_exclusive"),))
    return _costs(reach(_origins(spark, sf_dir), torus(spark, sf_dir), limits)).where("cost < 40")


def fixed_speed_tree(spark, sf_dir):
    """Costs by fixed speeds of the modes."""
    edges = with_costs(torus(spark, sf_dir), {"walk": 80.0, "bike": 160.0})
    tree = bins.destinations(reach(_origins(spark, sf_dir), edges, Constraints(cost=15.0))).where("cost < 15")
    return tree.select("origin", "vertex_id", F.round("cost", 3).alias("cost"))


def largest_trees(spark, sf_dir):
    """Costs of the six cheapest labels of every tree."""
    tree = reach(_origins(spark, sf_dir), torus(spark, sf_dir), Constraints(cost=40.0), most=6)
    return tree.groupBy("origin").agg(F.sum("cost").cast("long").alias("minutes"), F.count(F.lit(1)).alias("labels"))


def transit_tree(spark, sf_dir):
    """Earliest arrivals with walks and rides that leave every few minutes of the clock."""
    edges = torus(spark, sf_dir).withColumn("mode", F.when(F.col("mode") == "walk", "walk").otherwise("transit"))
    k = F.col("edge_id")
    ride = edges.where("mode = 'transit'").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("departure", F.col("i") * (5 + k % 7) + k % 3)
    times = ride.select("edge_list_id", "edge_id", F.col("departure").cast("double").alias("departure"), (F.col("departure") + 1 + k % 4).cast("double").alias("arrival"), (k % 5).alias("route"))
    return _costs(reach(_origins(spark, sf_dir), edges, Constraints(cost=30.0), timetable=Timetable(times, 60.0))).where("cost < 30")


def express_tree(spark, sf_dir):
    """Earliest arrivals where later rides overtake, and two routes run by the dates of other days."""
    edges = torus(spark, sf_dir).withColumn("mode", F.when(F.col("mode") == "walk", "walk").otherwise("transit"))
    k, i = F.col("edge_id"), F.col("i")
    ride = edges.where("mode = 'transit'").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("departure", i * (5 + k % 7) + k % 3)
    times = ride.select("edge_list_id", "edge_id", F.col("departure").cast("double").alias("departure"), (F.col("departure") + 1 + (i * 7 + k) % 23).cast("double").alias("arrival"), ((i + k) % 5).alias("route"))
    regions = table(spark, sf_dir, "region").where("r_regionkey in (0, 2)")  # routes 0 and 2 have no service on day 1
    mapping = regions.select(F.col("r_regionkey").cast("long").alias("route"), F.lit(1).cast("long").alias("target_day"), F.col("r_regionkey").cast("long").alias("picked_day"))
    return _costs(reach(_origins(spark, sf_dir), edges, Constraints(cost=30.0), timetable=Timetable(times, 75.0, mapping, 60.0))).where("cost < 30")


def on_demand_tree(spark, sf_dir):
    """Costs with rides on demand, from regions that still serve others, and where they may end."""
    edges = torus(spark, sf_dir).withColumn("mode", F.when(F.col("mode") == "walk", "walk").otherwise("flex"))
    zones = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex_id"), F.col("n_regionkey").alias("zone_id"))
    r = table(spark, sf_dir, "region")
    relations = r.select(F.col("r_regionkey").alias("src_zone"), F.explode(F.array("r_regionkey", (F.col("r_regionkey") + 1) % 5)).alias("dst_zone"), F.lit(0.0).alias("opens"), (F.col("r_regionkey") * 4 + 8).cast("double").alias("closes"))
    limits = Constraints(cost=20.0)
    tree = bins.destinations(reach(_origins(spark, sf_dir), edges, limits, on_demand=OnDemand("flex", zones, relations, 6.0)))
    ends = tree.where("cost < 20 and (zone is null or may_alight)")  # a ride may lead back to the origin
    return ends.groupBy("origin", "vertex_id").agg(F.min("cost").cast("long").alias("cost"))


def isochrone_counts(spark, sf_dir):
    """Places in the isochrone of every origin and bin."""
    binning = bins.Binning("cost", (10, 20, 30))
    tree = bins.destinations(reach(_origins(spark, sf_dir), torus(spark, sf_dir), Constraints(cost=30.0)))
    rings = iso.isochrones(tree, vertices(spark, sf_dir), binning)
    return rings.select("origin", "bin_key", "n_destinations")


def isochrone_shapes(spark, sf_dir):
    """Hulls of the places of every origin and bin: twice the area and the corners of convex ones, and the places that dug ones cover."""
    binning = bins.Binning("cost", (10, 20, 30))
    k = F.col("n_nationkey")
    at = table(spark, sf_dir, "nation").select(k.cast("long").alias("vertex_id"), (k % 5).cast("double").alias("x"), F.floor(k / 5).cast("double").alias("y"))
    tree = bins.destinations(reach(_origins(spark, sf_dir), torus(spark, sf_dir), Constraints(cost=30.0)))
    ring = geo.from_wkt(F.col("isochrone"))
    area = lambda name: F.coalesce(F.round(geo.ring_area(F.col(name)) * 2), F.lit(0)).cast("long")
    hulls = iso.isochrones(tree, at, binning).select("origin", "bin_key", ring.alias("hull"))
    dug = iso.isochrones(tree, at, binning, "dug", concavity=1.2).select("origin", "bin_key", ring.alias("dug"))
    places = bins.explode_bins(tree, binning).select("origin", "bin_key", "vertex_id").distinct().join(at, "vertex_id")
    both = hulls.join(dug, ["origin", "bin_key"])
    edge = F.exists(geo.legs(F.col("dug")), lambda g: (F.greatest(g["a"]["x"], g["b"]["x"]) >= F.col("x")) & (F.least(g["a"]["x"], g["b"]["x"]) <= F.col("x")) & (F.greatest(g["a"]["y"], g["b"]["y"]) >= F.col("y")) & (F.least(g["a"]["y"], g["b"]["y"]) <= F.col("y")) & ((g["b"]["x"] - g["a"]["x"]) * (F.col("y") - g["a"]["y"]) == (g["b"]["y"] - g["a"]["y"]) * (F.col("x") - g["a"]["x"])))
    covered = F.coalesce(geo.in_ring(F.col("x"), F.col("y"), F.col("dug")) | edge, F.lit(False))
    met = places.join(both, ["origin", "bin_key"]).groupBy("origin", "bin_key", "hull", "dug").agg(F.count_if(covered).alias("covered"))
    corners = F.coalesce(F.size("hull") - 1, F.lit(0)).cast("long").alias("corners")
    return met.select("origin", "bin_key", area("hull").alias("double_area"), corners, "covered", (area("dug") <= area("hull")).alias("within"))


def extent_lines(spark, sf_dir):
    """Orders as lines through suppliers and quantities, with every region's triangle that they touch."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").cast("double").alias("x"), F.min("l_quantity").cast("double").alias("y"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    k = F.col("r_regionkey") * 20.0
    corner = lambda dx, y: F.struct((k + dx).alias("x"), F.lit(float(y)).alias("y"))
    rings = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.array(corner(1, 5), corner(14, 9), corner(8, 30), corner(1, 5)).alias("ring"))
    return lines_in_rings(lines.groupBy("l_orderkey").agg(line.alias("line")), rings, "l_orderkey", "region", 4.0)


def edited_trade(spark, sf_dir):
    """Trade between nations after edits: pairs cut, replaced, updated and added, and nations retired or removed."""
    n, s, r = (table(spark, sf_dir, name) for name in ("nation", "supplier", "region"))
    nodes = n.select(F.col("n_nationkey").cast("long").alias("osmid"))
    ways = s.select(F.col("s_nationkey").cast("long").alias("src"), (24 - F.col("s_nationkey")).cast("long").alias("dst"), F.col("s_suppkey").cast("long").alias("way_id"), F.col("s_acctbal").cast("double").alias("cost"))
    key = F.col("r_regionkey").cast("long")
    edge = lambda src, dst, way, cost: r.select(src.alias("src"), dst.alias("dst"), way.cast("long").alias("way_id"), F.lit(cost).alias("cost"))
    batch = edits.Edits(
        retired=r.select((key + 2).alias("osmid")).where("osmid = 2"),
        removed=r.select((key + 3).alias("osmid")).where("osmid = 3"),
        cut=r.select((key + 5).alias("src"), (19 - key).alias("dst")),
        replaced=edge(key + 10, 14 - key, F.lit(-1), 1.0),
        updated=ways.where("src = 0 and cost < 0").withColumn("cost", -F.col("cost")),
        nodes=r.select((key + 100).alias("osmid")),
        edges=edge(key + 100, key + 15, F.lit(-2), 2.0),
        strict=False,
    )
    kept, edges = edits.apply(nodes, ways, batch)
    ends = edits.neighbours(edges).groupBy("node").agg(F.count_if(F.col("heading") == "out").alias("outs"), F.count_if(F.col("heading") == "in").alias("ins"))
    sums = edges.groupBy(F.col("src").alias("node")).agg(F.round(F.sum("cost"), 2).alias("cost"))
    out = kept.withColumnRenamed("osmid", "node").join(ends, "node", "left").join(sums, "node", "left")
    return out.fillna(0, ["outs", "ins"])


def _segments(spark, sf_dir):
    """Orders as segments east along the equator, with their lines as connectors."""
    at = ((F.col("l_linenumber") - 1) / 8.0).alias("at")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("mph"), F.max("l_returnflag").alias("flag"))
    c = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("s").cast("string").alias("connector_id"), at))).alias("connectors"),
        F.max("flag").alias("flag"),
        F.min("mph").alias("mph"),
    )
    denied = F.when(F.col("flag") == "N", F.array(F.struct(F.lit("denied").alias("access_type"), F.struct(F.lit(None).cast("string").alias("during"), F.lit("backward").alias("heading"), *[F.lit(None).cast("array<string>").alias(n) for n in ("using", "recognized", "mode")]).alias("when"))))
    limits = F.array(F.struct(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")).alias("between"), F.col("mph").alias("mph")))
    point = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"))
    return c.select(F.col("l_orderkey").cast("string").alias("id"), F.array(point(0.0), point(0.01)).alias("line"), "connectors", denied.alias("access_restrictions"), limits.alias("speed_limits"), F.lit("road").alias("class"))


def segment_splits(spark, sf_dir):
    """Directed splits of segments between connectors, with length and speed."""
    s = overture.splits(_segments(spark, sf_dir))
    return s.select(F.col("id").cast("long").alias("id"), "heading", F.col("src_connector").cast("long").alias("src"), F.col("dst_connector").cast("long").alias("dst"), F.round("distance", 3).alias("distance"), F.round("kph", 4).alias("kph"))


def open_headings(spark, sf_dir):
    """Open headings of segments."""
    return _segments(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.array_join(overture.headings(F.col("access_restrictions")), ",").alias("headings"))


def segment_network(spark, sf_dir):
    """Edges of segments with their ends numbered, counted by bearing and heading."""
    connectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("connector_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    _, edges = overture.network(_segments(spark, sf_dir), connectors)
    return edges.groupBy("heading", F.round("bearing", 3).alias("bearing")).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))


def _ways(spark, sf_dir):
    """Orders as ways over suppliers as nodes, with tags by status and priority."""
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("osmid")).agg(F.transform(order, lambda p: p["l_suppkey"]).alias("nodes"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("osmid"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "primary").when(F.col("o_orderpriority") == "5-LOW", "raceway").when(F.col("o_orderpriority") != "3-MEDIUM", "residential").alias("highway"),
        F.when(F.col("o_orderstatus") == "P", "private").alias("access"),
        F.lit(None).cast("string").alias("area"),
        F.when(F.col("o_orderstatus") == "F", "yes").alias("oneway"),
        F.lit(None).cast("string").alias("junction"),
        F.lit("30 mph").alias("maxspeed"),
    )
    return w.join(o, "osmid")


def public_ways(spark, sf_dir):
    """Ways that are public streets, and whether a tag query keeps them."""
    return _ways(spark, sf_dir).where(osm.public_streets()).select("osmid", osm.tag_query('["highway"~"^prim"]["oneway"!="yes"]').alias("kept"))


def way_edges(spark, sf_dir):
    """Directed edges of public ways: the way of each, and how long it is."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("osmid"), (F.col("s_suppkey") * 0.001).alias("x"), F.lit(0.0).alias("y"))
    edges = osm.directed_edges(nodes, _ways(spark, sf_dir).where(osm.public_streets()))
    return edges.where("src <> dst").select("src", "dst", "way_id", F.round("distance", 3).alias("distance"), F.round("kph", 4).alias("kph"))


def truncated_edges(spark, sf_dir):
    """Streets with a corner inside of a square, and whether both are."""
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(k.alias("osmid"), (k % WIDTH).cast("double").alias("x"), F.floor(k / WIDTH).cast("double").alias("y"))
    extent = [(4.5, 4.5), (20.5, 4.5), (20.5, 16.5), (4.5, 16.5), (4.5, 4.5)]
    edges = streets(spark, sf_dir).select("src", "dst")
    inner = osm.truncate(nodes, edges, extent, by_edge=False).withColumn("both", F.lit(True))
    return osm.truncate(nodes, edges, extent).join(inner, ["src", "dst"], "left").fillna(False, ["both"])


def _chains(spark, sf_dir):
    """Every order's lines as a chain of one-way edges."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("distance"))
    node = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    ahead = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber")).withColumn("there", F.lit(True))
    used = lines.join(ahead, ["l_orderkey", "l_linenumber"], "left_semi")
    return used.select(node.alias("src"), (node + 1).alias("dst"), "distance", F.col("l_orderkey").alias("way_id"), F.lit("residential").alias("highway"))


def simplified_chains(spark, sf_dir):
    """Chains between endpoints as single edges."""
    made = contraction.simplify(_chains(spark, sf_dir))
    return made.select("src", "dst", F.round("distance", 4).alias("distance"), F.size("nodes").alias("nodes"), F.element_at("way_ids", 1).alias("way_id"), "highway")


def simplified_tags(spark, sf_dir):
    """Tags along the same chains: sidewalks by return flag, speeds by quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("most"))
    tagged = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src"),
        F.when(F.col("flag") == "R", "both").when(F.col("flag") == "A", "no").alias("sidewalk"),
        F.when(F.col("most") >= 25, "30 mph").otherwise("20 mph").alias("maxspeed"),
    )
    made = contraction.simplify(_chains(spark, sf_dir).join(tagged, "src"), tags=("sidewalk", "maxspeed"))
    return made.select("src", "dst", "sidewalk", "maxspeed", tags.reduce_numbers(F.regexp_replace("maxspeed", " mph", ""), "min").cast("int").alias("least_mph"))


def consolidated_corners(spark, sf_dir):
    """Corners of a street with gaps, merged where an edge joins close ones."""
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(k.alias("vertex_id"), (k * 1.0 + 0.9 * (k % 2 == 0).cast("double")).alias("x"), F.lit(0.0).alias("y"))
    edges = table(spark, sf_dir, "part").where(k > 0).select((k - 1).alias("src"), k.alias("dst"))
    merged, left = contraction.consolidate(nodes, edges, 0.1)
    return merged.select("vertex_id", F.round("x", 6).alias("x"), F.size("consolidated_ids").alias("merged")).join(left.select(F.col("src").alias("vertex_id"), "dst"), "vertex_id", "left").select("vertex_id", "x", "merged", F.coalesce("dst", F.lit(-1)).alias("next"))


def _rides(spark, sf_dir):
    """Edges between suppliers that follow each other in an order, by large returned lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49")
    a = lines.select("l_orderkey", F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("i"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst"), (F.col("l_linenumber") - 1).alias("i"))
    return a.join(b, ["l_orderkey", "i"]).where("src <> dst").select("src", "dst").distinct()


def strong_labels(spark, sf_dir):
    """Strongly connected suppliers along such edges."""
    return islands.strong_components(_rides(spark, sf_dir)).select(F.col("node").alias("vertex_id"), "component")


def leafless_rides(spark, sf_dir):
    """Edges left after dead ends are removed again and again."""
    return islands.prune_leaves(_rides(spark, sf_dir))


def _blocks(spark, sf_dir):
    """Every order's lines as a block of streets of its own, spread by quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    node = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lines.select(node.alias("vertex_id"), (F.col("q") * 0.0001).alias("x"), F.lit(0.0).alias("y"), "l_orderkey", "l_linenumber")


def small_islands(spark, sf_dir):
    """Edges of weakly connected blocks under 300 meters across."""
    v = _blocks(spark, sf_dir)
    return islands.weak_islands(_chains(spark, sf_dir).select("src", "dst"), v.select("vertex_id", "x", "y"), 300.0)


def uncovered_buildings(spark, sf_dir):
    """Places by supplier, and the buildings (parts) with an activity that no place inside covers."""
    k = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(k.alias("place_id"), (k % 20 + 0.5).cast("double").alias("x"), (F.floor(k / 20) + 0.5).cast("double").alias("y"), F.array(F.col("s_acctbal") > 0, F.col("s_acctbal") > 5000).alias("mask"))
    p = F.col("p_partkey")
    x, y = (p % 20).cast("double"), F.floor(p / 20).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(0.25, 0.25), corner(0.75, 0.25), corner(0.75, 0.75), corner(0.25, 0.75), corner(0.25, 0.25))
    buildings = table(spark, sf_dir, "part").select(p.alias("building_id"), x.alias("x"), y.alias("y"), F.array(F.col("p_size") > 10, F.col("p_size") > 40).alias("mask"), ring.alias("ring"))
    out = opp.places_and_buildings(places, buildings, ["jobs", "food"])
    return out.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


STREETS_SQL = f"""c AS (SELECT p_partkey AS k, 1 + p_size % 5 AS m FROM part), g AS (SELECT k AS a, k + 1 AS b, m FROM c WHERE k % {WIDTH} < {WIDTH} - 1 AND k + 1 <= (SELECT max(k) FROM c) UNION ALL SELECT k, k + {WIDTH}, m FROM c WHERE k + {WIDTH} <= (SELECT max(k) FROM c)),
st AS (SELECT a AS src, b AS dst, m FROM g UNION ALL SELECT b, a, m FROM g)"""
MODES_SQL = f"WITH RECURSIVE {TORUS_SQL}"
SEGMENT_SQL = """ls AS (SELECT l_orderkey AS id, l_linenumber AS i, min(l_suppkey) AS s, min(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
sg AS (SELECT id, max(f) AS f, min(q) AS mph FROM ls GROUP BY 1),
od AS (SELECT id, (i - 1) / 8.0 AS at, s, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM ls),
sp AS (SELECT a.id, a.s AS src, b.s AS dst, b.at - a.at AS w FROM od a JOIN od b ON a.id = b.id AND b.r = a.r + 1),
hd AS (SELECT sp.*, mph, f, h.heading FROM sp JOIN sg USING (id) CROSS JOIN (VALUES ('forward'), ('backward')) h(heading) WHERE heading = 'forward' OR f <> 'N')"""
WAYS_SQL = """ws AS (SELECT o_orderkey AS osmid, CASE WHEN o_orderpriority = '1-URGENT' THEN 'primary' ELSE 'residential' END AS highway, o_orderstatus = 'F' AS one FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '3-MEDIUM') AND o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
RIDES_SQL = "ri AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_quantity >= 49 AND a.l_suppkey <> b.l_suppkey)"
CHAIN_SQL = "ln AS (SELECT l_orderkey AS o, l_linenumber AS i, sum(l_quantity) AS d, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), ch AS (SELECT a.o, a.i, a.d FROM ln a JOIN ln b ON a.o = b.o AND b.i = a.i + 1), rn AS (SELECT *, i - row_number() OVER (PARTITION BY o ORDER BY i) AS run FROM ch)"

QUERIES = {
    "street_access": (street_access, f"""WITH RECURSIVE {STREETS_SQL}, p AS (SELECT s_suppkey AS origin, s_suppkey AS v, CAST(0 AS BIGINT) AS cost FROM supplier UNION SELECT p.origin, st.dst, p.cost + st.m FROM p JOIN st ON st.src = p.v WHERE p.cost + st.m <= 12),
t AS (SELECT origin, v, min(cost) AS cost FROM p WHERE v <> origin GROUP BY 1, 2) SELECT origin, count(*) AS corners, CAST(sum(cost) AS BIGINT) AS minutes FROM t GROUP BY 1"""),
    "delayed_tree": (delayed_tree, f"""{MODES_SQL}, p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(n_nationkey % 4 AS BIGINT) AS cost FROM nation UNION SELECT p.o, e.dst, p.cost + e.mins FROM p JOIN torus e ON e.src = p.v WHERE p.cost + e.mins < 30)
SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, min(cost) AS cost FROM p WHERE v <> o GROUP BY 1, 2"""),
    "mode_limited_tree": (mode_limited_tree, f"""{MODES_SQL}, p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS w FROM nation UNION SELECT p.o, e.dst, p.cost + e.mins, p.w + CASE WHEN e.mode = 'walk' THEN e.mins ELSE 0 END FROM p JOIN torus e ON e.src = p.v
 WHERE p.cost + e.mins < 25 AND p.w + CASE WHEN e.mode = 'walk' THEN e.mins ELSE 0 END <= 12) SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, min(cost) AS cost FROM p WHERE v <> o GROUP BY 1, 2"""),
    "leg_limited_tree": (leg_limited_tree, f"""{MODES_SQL}, p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS leg, 0 AS n, '' AS m FROM nation
 UNION SELECT p.o, e.dst, p.cost + e.mins, CASE WHEN e.mode = p.m THEN p.leg ELSE 0 END + e.mins, CASE WHEN e.mode = p.m THEN p.n ELSE p.n + 1 END, e.mode FROM p JOIN torus e ON e.src = p.v
 WHERE p.cost + e.mins < 20 AND CASE WHEN e.mode = p.m THEN p.n ELSE p.n + 1 END <= 3 AND NOT (p.m = 'walk' AND e.mode <> 'walk' AND p.leg < 5)
 AND NOT (e.mode = 'bike' AND CASE WHEN e.mode = p.m THEN p.n ELSE p.n + 1 END = 1 AND CASE WHEN e.mode = p.m THEN p.leg ELSE 0 END + e.mins >= 9))
SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, min(cost) AS cost FROM p WHERE v <> o GROUP BY 1, 2"""),
    "trip_limited_tree": (trip_limited_tree, f"""{MODES_SQL}, p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(0 AS BIGINT) AS cost FROM nation UNION SELECT p.o, e.dst, p.cost + e.mins FROM p JOIN torus e ON e.src = p.v WHERE 80 * (p.cost + e.mins) < 1600)
SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, min(cost) AS cost FROM p WHERE v <> o GROUP BY 1, 2"""),
    "fixed_speed_tree": (fixed_speed_tree, f"""{MODES_SQL}, p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(0 AS DOUBLE) AS cost FROM nation UNION SELECT p.o, e.dst, p.cost + e.mins * CASE WHEN e.mode = 'walk' THEN 1 ELSE CAST(0.5 AS DOUBLE) END FROM p JOIN torus e ON e.src = p.v
 WHERE p.cost + e.mins * CASE WHEN e.mode = 'walk' THEN 1 ELSE CAST(0.5 AS DOUBLE) END < 15) SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, round(min(cost), 3) AS cost FROM p WHERE v <> o GROUP BY 1, 2"""),
    "largest_trees": (largest_trees, f"{TREE_SQL}, k AS (SELECT origin, cost, row_number() OVER (PARTITION BY origin ORDER BY cost) AS r FROM tree) SELECT CAST(origin AS BIGINT) AS origin, CAST(sum(cost) AS BIGINT) AS minutes, count(*) AS labels FROM k WHERE r <= 6 GROUP BY 1"),
    "transit_tree": (transit_tree, f"""{MODES_SQL}, tt AS (SELECT edge_id, d * (5 + edge_id % 7) + edge_id % 3 AS dep, d * (5 + edge_id % 7) + edge_id % 3 + 1 + edge_id % 4 AS arr FROM torus, range(0, 101) r(d) WHERE mode = 'bike'),
ck AS (SELECT t.edge_id, n, min(dep) AS dep FROM tt t, range(60, 91) c(n) WHERE dep >= n AND dep <= 90 GROUP BY 1, 2), rd AS (SELECT ck.edge_id, n, arr - n AS mins FROM ck JOIN tt ON tt.edge_id = ck.edge_id AND tt.dep = ck.dep),
st AS (SELECT src, dst, n, rd.mins FROM torus JOIN rd USING (edge_id) UNION ALL SELECT src, dst, n, torus.mins FROM torus, range(60, 91) c(n) WHERE mode = 'walk'),
p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(0 AS BIGINT) AS cost FROM nation UNION SELECT p.o, st.dst, p.cost + st.mins FROM p JOIN st ON st.src = p.v AND st.n = 60 + p.cost WHERE p.cost + st.mins < 30)
SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, min(cost) AS cost FROM p WHERE v <> o GROUP BY 1, 2"""),
    "express_tree": (express_tree, f"""{MODES_SQL}, tt AS (SELECT edge_id, d * (5 + edge_id % 7) + edge_id % 3 AS dep, d * (5 + edge_id % 7) + edge_id % 3 + 1 + (d * 7 + edge_id) % 23 AS arr, (d + edge_id) % 5 AS route FROM torus, range(0, 101) r(d) WHERE mode = 'bike'),
mv AS (SELECT edge_id, dep - 60 * (pk - 1) AS dep, arr - 60 * (pk - 1) AS arr FROM (SELECT *, CASE route WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS pk FROM tt)),
rd AS (SELECT edge_id, n, min(arr) - n AS mins FROM mv, range(75, 106) c(n) WHERE dep >= n GROUP BY 1, 2),
st AS (SELECT src, dst, n, rd.mins FROM torus JOIN rd USING (edge_id) UNION ALL SELECT src, dst, n, torus.mins FROM torus, range(75, 106) c(n) WHERE mode = 'walk'),
p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(0 AS BIGINT) AS cost FROM nation UNION SELECT p.o, st.dst, p.cost + st.mins FROM p JOIN st ON st.src = p.v AND st.n = 75 + p.cost WHERE p.cost + st.mins < 30)
SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, min(cost) AS cost FROM p WHERE v <> o GROUP BY 1, 2"""),
    "on_demand_tree": (on_demand_tree, f"""{MODES_SQL}, z AS (SELECT n_nationkey AS v, n_regionkey AS z FROM nation),
p AS (SELECT n_nationkey AS o, n_nationkey AS v, CAST(0 AS BIGINT) AS cost, -1 AS zone FROM nation
 UNION SELECT p.o, e.dst, p.cost + e.mins, CASE WHEN e.mode = 'walk' THEN -1 WHEN p.zone >= 0 THEN p.zone ELSE z.z END FROM p JOIN torus e ON e.src = p.v JOIN z ON z.v = e.dst
 WHERE p.cost + e.mins < 20 AND (e.mode = 'walk' OR p.zone >= 0 OR 6 + p.cost < z.z * 4 + 8)),
b AS (SELECT o, v, zone, min(cost) AS cost FROM p GROUP BY 1, 2, 3)
SELECT CAST(o AS BIGINT) AS origin, CAST(v AS BIGINT) AS vertex_id, min(cost) AS cost FROM b JOIN z USING (v) WHERE cost > 0 AND (zone = -1 OR z.z = zone OR z.z = (zone + 1) % 5) GROUP BY 1, 2"""),
    "isochrone_shapes": (isochrone_shapes, f"""{TREE_SQL}, b AS (SELECT * FROM (VALUES ('10', 10), ('20', 20), ('30', 30)) v(bin_key, hi)),
p AS (SELECT DISTINCT origin AS o, bin_key AS k, vertex % 5 AS x, vertex // 5 AS y FROM dest JOIN b ON cost < hi),
c AS (SELECT a.o, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON a.o = b.o AND a.k = b.k AND (a.x, a.y) <> (b.x, b.y)),
bad AS (SELECT DISTINCT c.* FROM c JOIN p ON p.o = c.o AND p.k = c.k WHERE (bx - ax) * (p.y - ay) - (b_y - ay) * (p.x - ax) < 0
  OR ((bx - ax) * (p.y - ay) - (b_y - ay) * (p.x - ax) = 0 AND NOT (p.x BETWEEN least(ax, bx) AND greatest(ax, bx) AND p.y BETWEEN least(ay, b_y) AND greatest(ay, b_y)))),
h AS (SELECT o, k, count(*) AS n, sum(ax * b_y - bx * ay) AS area FROM (SELECT * FROM c EXCEPT SELECT * FROM bad) GROUP BY 1, 2),
g AS (SELECT o, k, count(*) AS places FROM p GROUP BY 1, 2)
SELECT CAST(g.o AS BIGINT) AS origin, g.k AS bin_key, CAST(CASE WHEN n > 2 THEN area ELSE 0 END AS BIGINT) AS double_area, CAST(CASE WHEN n > 2 THEN n ELSE 0 END AS BIGINT) AS corners, CASE WHEN n > 2 THEN places ELSE 0 END AS covered, true AS "within" FROM g LEFT JOIN h ON g.o = h.o AND g.k = h.k"""),
    "extent_lines": (extent_lines, """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, CAST(min(l_suppkey) AS DOUBLE) AS x, CAST(min(l_quantity) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2),
s AS (SELECT o, x AS ax, y AS ay, coalesce(lead(x) OVER w, x) AS bx, coalesce(lead(y) OVER w, y) AS b_y FROM l WINDOW w AS (PARTITION BY o ORDER BY i)),
t AS (SELECT CAST(r_regionkey AS BIGINT) AS z, r_regionkey * 20.0::DOUBLE AS k FROM region),
e AS (SELECT z, k + 1 AS cx, 5.0::DOUBLE AS cy, k + 14 AS dx, 9.0::DOUBLE AS dy FROM t UNION ALL SELECT z, k + 14, 9, k + 8, 30 FROM t UNION ALL SELECT z, k + 8, 30, k + 1, 5 FROM t),
hit AS (SELECT o, z FROM s JOIN e ON greatest(ax, bx) >= least(cx, dx) AND greatest(cx, dx) >= least(ax, bx) AND greatest(ay, b_y) >= least(cy, dy) AND greatest(cy, dy) >= least(ay, b_y)
  WHERE ((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax)) <= 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx)) <= 0),
ins AS (SELECT o, z FROM l, e GROUP BY o, i, z HAVING min((dx - cx) * (y - cy) - (dy - cy) * (x - cx)) >= 0)
SELECT o AS l_orderkey, z AS region FROM hit UNION SELECT o, z FROM ins"""),
    "edited_trade": (edited_trade, """WITH w AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(24 - s_nationkey AS BIGINT) AS dst, CAST(s_acctbal AS DOUBLE) AS cost FROM supplier WHERE s_nationkey NOT IN (2, 3) AND 24 - s_nationkey NOT IN (2, 3) AND s_nationkey NOT BETWEEN 5 AND 14),
e AS (SELECT src, dst, CASE WHEN src = 0 THEN abs(cost) ELSE cost END AS cost FROM w UNION ALL SELECT r_regionkey + 10, 14 - r_regionkey, 1 FROM region UNION ALL SELECT r_regionkey + 100, r_regionkey + 15, 2 FROM region),
n AS (SELECT CASE n_nationkey WHEN 2 THEN -2 ELSE n_nationkey END AS node FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT r_regionkey + 100 FROM region)
SELECT CAST(node AS BIGINT) AS node, (SELECT count(DISTINCT dst) FROM e WHERE src = node) AS outs, (SELECT count(DISTINCT src) FROM e WHERE dst = node) AS ins, (SELECT round(sum(cost), 2) FROM e WHERE src = node) AS cost FROM n"""),
    "isochrone_counts": (isochrone_counts, f"{TREE_SQL}, b AS (SELECT * FROM (VALUES ('10', 10), ('20', 20), ('30', 30)) v(bin_key, hi)) SELECT CAST(origin AS BIGINT) AS origin, bin_key, count(DISTINCT vertex) AS n_destinations FROM dest JOIN b ON cost < hi GROUP BY 1, 2"),
    "segment_splits": (segment_splits, f"WITH {SEGMENT_SQL} SELECT id, heading, CASE heading WHEN 'forward' THEN src ELSE dst END AS src, CASE heading WHEN 'forward' THEN dst ELSE src END AS dst, round(2 * 6371008.8 * asin(sqrt(power(sin(radians(0.01) / 2), 2))) * w, 3) AS distance, round(mph * 1.609344, 4) AS kph FROM hd"),
    "open_headings": (open_headings, f"WITH {SEGMENT_SQL} SELECT id, CASE WHEN f = 'N' THEN 'forward' ELSE 'forward,backward' END AS headings FROM sg"),
    "segment_network": (segment_network, f"WITH {SEGMENT_SQL} SELECT heading, CAST(CASE heading WHEN 'forward' THEN 90 ELSE 270 END AS DOUBLE) AS bearing, count(*) AS edges, count(DISTINCT CASE heading WHEN 'forward' THEN src ELSE dst END) AS sources FROM hd GROUP BY 1, 2"),
    "public_ways": (public_ways, f"WITH {WAYS_SQL} SELECT osmid, highway = 'primary' AND NOT one AS kept FROM ws"),
    "way_edges": (way_edges, f"""WITH {WAYS_SQL}, nd AS (SELECT l_orderkey AS osmid, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS i FROM lineitem),
g AS (SELECT a.osmid, a.s AS x, b.s AS y, one FROM nd a JOIN nd b ON a.osmid = b.osmid AND b.i = a.i + 1 JOIN ws ON ws.osmid = a.osmid), e AS (SELECT x AS src, y AS dst, osmid FROM g UNION ALL SELECT y, x, osmid FROM g WHERE NOT one)
SELECT src, dst, min(osmid) AS way_id, round(2 * 6371008.8 * asin(sqrt(power(sin(radians(dst * 0.001 - src * 0.001) / 2), 2))), 3) AS distance, round(CAST(30 * 1.609344 AS DOUBLE), 4) AS kph FROM e WHERE src <> dst GROUP BY 1, 2"""),
    "truncated_edges": (truncated_edges, f"WITH {STREETS_SQL}, i AS (SELECT src, dst, src % {WIDTH} BETWEEN 5 AND 20 AND src // {WIDTH} BETWEEN 5 AND 16 AS a, dst % {WIDTH} BETWEEN 5 AND 20 AND dst // {WIDTH} BETWEEN 5 AND 16 AS b FROM st) SELECT src, dst, a AND b AS both FROM i WHERE a OR b"),
    "simplified_chains": (simplified_chains, f"WITH {CHAIN_SQL} SELECT o * 10 + min(i) AS src, o * 10 + max(i) + 1 AS dst, round(sum(d), 4) AS distance, CAST(count(*) + 1 AS INTEGER) AS nodes, o AS way_id, 'residential' AS highway FROM rn GROUP BY o, run"),
    "simplified_tags": (simplified_tags, """WITH ln AS (SELECT l_orderkey AS o, l_linenumber AS i, CASE min(l_returnflag) WHEN 'R' THEN 'both' WHEN 'A' THEN 'no' END AS s, CASE WHEN max(l_quantity) >= 25 THEN '30 mph' ELSE '20 mph' END AS m FROM lineitem GROUP BY 1, 2),
ch AS (SELECT a.* FROM ln a JOIN ln b ON a.o = b.o AND b.i = a.i + 1), rn AS (SELECT *, i - row_number() OVER (PARTITION BY o ORDER BY i) AS run FROM ch),
sw AS (SELECT o, run, i, s, lag(s) OVER (PARTITION BY o, run ORDER BY i) AS p FROM rn WHERE s IS NOT NULL), sj AS (SELECT o, run, string_agg(s, '#' ORDER BY i) AS sidewalk FROM sw WHERE s IS DISTINCT FROM p GROUP BY 1, 2),
mw AS (SELECT o, run, i, m, lag(m) OVER (PARTITION BY o, run ORDER BY i) AS p FROM rn), mj AS (SELECT o, run, string_agg(m, '#' ORDER BY i) AS maxspeed FROM mw WHERE m IS DISTINCT FROM p GROUP BY 1, 2)
SELECT o * 10 + min(i) AS src, o * 10 + max(i) + 1 AS dst, any_value(sidewalk) AS sidewalk, any_value(maxspeed) AS maxspeed, CAST(CASE WHEN any_value(maxspeed) LIKE '%20%' THEN 20 ELSE 30 END AS INTEGER) AS least_mph FROM rn JOIN mj USING (o, run) LEFT JOIN sj USING (o, run) GROUP BY o, run"""),
    "consolidated_corners": (consolidated_corners, """WITH k AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS last FROM part), m AS (SELECT k, last, CASE WHEN k % 2 = 1 THEN k - 1 ELSE k END AS g FROM k)
SELECT g AS vertex_id, round(avg(CASE WHEN k % 2 = 0 THEN k + 0.9 ELSE k END), 6) AS x, CAST(count(*) AS INTEGER) AS merged, CASE WHEN max(k) < max(last) THEN g + 2 ELSE -1 END AS next FROM m GROUP BY g"""),
    "strong_labels": (strong_labels, f"WITH RECURSIVE {RIDES_SQL}, nd AS (SELECT src AS v FROM ri UNION SELECT dst FROM ri), r AS (SELECT v AS a, v AS b FROM nd UNION SELECT r.a, ri.dst FROM r JOIN ri ON ri.src = r.b) SELECT x.a AS vertex_id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1"),
    "leafless_rides": (leafless_rides, f"""WITH RECURSIVE {RIDES_SQL}, r AS (SELECT src AS a, dst AS b FROM ri UNION SELECT r.a, ri.dst FROM r JOIN ri ON ri.src = r.b), cy AS (SELECT a FROM r WHERE a = b),
f AS (SELECT DISTINCT r.b AS v FROM r JOIN cy ON cy.a = r.a UNION SELECT a FROM cy), t AS (SELECT DISTINCT r.a AS v FROM r JOIN cy ON cy.a = r.b UNION SELECT a FROM cy)
SELECT src, dst FROM ri WHERE src IN (SELECT v FROM f) AND dst IN (SELECT v FROM t)"""),
    "small_islands": (small_islands, f"""WITH {CHAIN_SQL}, nd AS (SELECT o, run, i FROM rn UNION SELECT o, run, i + 1 FROM rn), w AS (SELECT nd.o, nd.run, (max(q) - min(q)) * 0.0001 AS x FROM nd JOIN ln ON ln.o = nd.o AND ln.i = nd.i GROUP BY 1, 2)
SELECT rn.o * 10 + rn.i AS src, rn.o * 10 + rn.i + 1 AS dst FROM rn JOIN w ON w.o = rn.o AND w.run = rn.run WHERE 2 * 6371008.8 * asin(sqrt(power(sin(radians(w.x) / 2), 2))) < 300"""),
    "uncovered_buildings": (uncovered_buildings, """WITH s AS (SELECT s_suppkey % 20 AS i, s_suppkey // 20 AS j, s_acctbal > 0 AS a, s_acctbal > 5000 AS b FROM supplier), p AS (SELECT p_partkey % 20 AS i, p_partkey // 20 AS j, p_size > 10 AS a, p_size > 40 AS b FROM part),
k AS (SELECT p.i, p.j FROM p LEFT JOIN s ON s.i = p.i AND s.j = p.j WHERE (p.a AND NOT coalesce(s.a, false)) OR (p.b AND NOT coalesce(s.b, false))),
u AS (SELECT i + CAST(0.5 AS DOUBLE) AS x, j + CAST(0.5 AS DOUBLE) AS y FROM s UNION ALL SELECT CAST(i AS DOUBLE), CAST(j AS DOUBLE) FROM k) SELECT x, y, count(*) AS n FROM u GROUP BY 1, 2"""),
}
