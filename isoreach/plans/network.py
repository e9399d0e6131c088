"""Network queries: tags, speeds, stress and comfort, spatial joins, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach.functions import geometry as geo
from isoreach.functions import ids, tags
from isoreach.operators import metrics, overture, schedules as sched, spatial
from isoreach.plans.domain import SCHEDULES_SQL, TAGGED_SQL, schedules, table, tagged_edges, vertices


def edge_stress(spark, sf_dir):
    """Level of traffic stress of every edge."""
    return metrics.stress(tagged_edges(spark, sf_dir)).select("edge_id", "lts")


def edge_comfort(spark, sf_dir):
    """Walking comfort index of every edge and its parts."""
    return metrics.comfort(tagged_edges(spark, sf_dir)).select("edge_id", "wci", "wci_speed", "wci_cycle", "wci_signal")


def neighbour_speed(spark, sf_dir):
    """Distance-weighted speed of the neighbours that have one."""
    e = tagged_edges(spark, sf_dir)
    return metrics.neighbour_speed(e, metrics.neighbours(e)).select("edge_id", F.round("near_mph", 4).alias("near_mph"))


def class_speeds(spark, sf_dir):
    """Length-weighted mean speed by class, with the global one as class null."""
    return metrics.class_speeds(tagged_edges(spark, sf_dir)).select("class", F.round("kph", 4).alias("kph"))


def filled_speeds(spark, sf_dir):
    """Speeds filled from the own value, the class mean, the global mean."""
    return metrics.fill_speeds(tagged_edges(spark, sf_dir)).select("edge_id", F.round("speed", 4).alias("speed"))


def edge_summary(spark, sf_dir):
    """Edges, length and classes with a total row."""
    return metrics.summary(tagged_edges(spark, sf_dir)).select("class", "edges", F.round("length_m", 2).alias("length_m"))


def top_highways(spark, sf_dir):
    """Most important road class per part brand."""
    e = tagged_edges(spark, sf_dir).groupBy("class").agg(F.collect_set("highway").alias("h"))
    return e.select("class", tags.top_highway(F.col("h")).alias("highway"))


def parsed_speeds(spark, sf_dir):
    """Speed tags of several spellings in km/h."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 6 == 0, F.concat(s, F.lit(" mph"))).when(k % 6 == 1, s).when(k % 6 == 2, F.concat(s, F.lit(";80"))).when(k % 6 == 3, "walk").when(k % 6 == 4, "unposted").otherwise(F.concat(s, F.lit(" fpm")))
    return table(spark, sf_dir, "part").select(k.alias("edge_id"), F.round(tags.speed_kph(raw), 4).alias("kph"))


def reduced_tags(spark, sf_dir):
    """Least and greatest number, distinct values and mean of delimited tags."""
    raw = F.concat_ws("#", F.col("p_size").cast("string"), (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 5).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", tags.reduce_numbers(raw, "min").alias("low"), tags.reduce_numbers(raw, "max").alias("high"), tags.unique_tags(raw).alias("distinct_values"), F.round(tags.mean_number(raw), 4).alias("mean_value"))


def oneway_flags(spark, sf_dir):
    """One-way and reversed flags of several spellings."""
    raw = F.get(F.array(*[F.lit(v) for v in ("yes", "no", "-1", "T", "reverse", "1")]), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tags.is_oneway(raw).alias("oneway"), tags.is_reversed(raw).alias("reversed"))


def mode_access(spark, sf_dir):
    """Travel-mode access after an order's restrictions, in sequence."""
    lines = table(spark, sf_dir, "lineitem")
    when = F.when(F.col("l_linestatus") == "O", F.struct(F.array(F.when(F.col("l_linenumber") % 2 == 0, "car").otherwise("foot")).alias("mode"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("array<string>").alias("using"), F.lit(None).cast("array<string>").alias("recognized")))
    kind = F.when(F.col("l_returnflag") == "R", "denied").when(F.col("l_returnflag") == "A", "allowed").otherwise("designated")
    rows = lines.select("l_orderkey", F.struct("l_linenumber", kind.alias("access_type"), when.alias("when")).alias("r")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("restrictions"))
    return rows.select("l_orderkey", overture.mode_access_state(F.col("restrictions"), ["car"]).alias("state"), overture.supports_mode(F.col("restrictions"), ["car"]).alias("allowed"))


def valid_headings(spark, sf_dir):
    """Whether an order's restrictions leave the forward heading open."""
    lines = table(spark, sf_dir, "lineitem")
    heading = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_linenumber") % 2 == 0, "forward").otherwise("backward"))
    when = F.struct(F.lit(None).cast("array<string>").alias("mode"), heading.alias("heading"), F.lit(None).cast("array<string>").alias("using"), F.lit(None).cast("array<string>").alias("recognized"))
    kind = F.when(F.col("l_returnflag") == "R", "denied").otherwise("allowed")
    rows = lines.select("l_orderkey", F.struct("l_linenumber", kind.alias("access_type"), when.alias("when")).alias("r")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("restrictions"))
    return rows.select("l_orderkey", overture.heading_valid(F.col("restrictions"), "forward").alias("forward"), overture.heading_valid(F.col("restrictions"), "backward").alias("backward"))


def split_speeds(spark, sf_dir):
    """Overlap-weighted speed of the stretch [0.2, 0.7) from linear limits."""
    lines = table(spark, sf_dir, "lineitem")
    lo = (F.col("l_linenumber") - 1) / 7.0
    limit = F.struct("l_linenumber", F.struct(lo.alias("lo"), (lo + 0.25).alias("hi")).alias("between"), F.col("l_quantity").alias("mph"))
    rows = lines.select("l_orderkey", limit.alias("s")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("limits"))
    return rows.select("l_orderkey", F.round(overture.split_speed(F.col("limits"), F.lit(0.2), F.lit(0.7)) + 1e-8, 6).alias("mph"))


def nearest_vertex(spark, sf_dir):
    """Nearest nation vertex of every supplier's place."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l"), (F.lit(-105.0) + 0.0037 * (F.col("s_suppkey") % 13)).alias("x"), (F.lit(39.9) + 0.0041 * (F.col("s_suppkey") % 11)).alias("y"))
    v = vertices(spark, sf_dir).select(F.col("vertex_id").alias("r"), "x", "y")
    return spatial.nearest(s, v, 0.01).select(F.col("l").alias("s_suppkey"), F.col("r").alias("vertex_id"), F.round("distance", 9).alias("distance"))


def nearest_in_range(spark, sf_dir):
    """The same within 300 meters; farther suppliers drop out."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l"), (F.lit(-105.0) + 0.0037 * (F.col("s_suppkey") % 13)).alias("x"), (F.lit(39.9) + 0.0041 * (F.col("s_suppkey") % 11)).alias("y"))
    v = vertices(spark, sf_dir).select(F.col("vertex_id").alias("r"), "x", "y")
    return spatial.nearest(s, v, 0.01, meters=300.0).select(F.col("l").alias("s_suppkey"), F.col("r").alias("vertex_id"), F.round("distance", 3).alias("distance"))


def _zones(spark, sf_dir):
    k = F.col("r_regionkey")
    x1, y1 = F.lit(-105.001) + 0.009 * k, F.lit(39.899)
    x2, y2 = x1 + 0.0142, F.lit(39.93)
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))])
    return table(spark, sf_dir, "region").select(k.alias("zone_id"), ring.alias("ring"))


def overlay_exactly_one(spark, sf_dir):
    """Vertices inside exactly one zone."""
    v = vertices(spark, sf_dir)
    return spatial.exactly_one(v, _zones(spark, sf_dir), "vertex_id", "zone_id").select("vertex_id", F.col("zone_id").cast("long").alias("zone_id"))


def overlay_first(spark, sf_dir):
    """The first zone of every vertex inside any."""
    return spatial.first_match(vertices(spark, sf_dir), _zones(spark, sf_dir), "vertex_id", "zone_id").select("vertex_id", F.col("zone_id").cast("long").alias("zone_id"))


def distances(spark, sf_dir):
    """Great-circle meters from every vertex to the next number."""
    v = vertices(spark, sf_dir)
    v = v.join(v.select((F.col("vertex_id") - 1).alias("vertex_id"), F.col("x").alias("x2"), F.col("y").alias("y2")), "vertex_id")
    return v.select("vertex_id", F.round(geo.haversine(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")), 3).alias("meters"))


def next_departures(spark, sf_dir):
    """First arrival among departures at or after each purchase, on the user's edge."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("edge_id"), F.date_trunc("second", "ts").alias("now"))
    out = sched.wait_and_ride(sched.next_departure(e, schedules(spark, sf_dir)))
    return out.select("query_id", "route", F.date_format("departure", "yyyy-MM-dd HH:mm:ss").alias("departure"), "wait_s", "ride_s")


def _stops(spark, sf_dir):
    order = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")).alias("stop_sequence")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), order, F.col("l_suppkey").alias("stop_id"))


def stop_pairs(spark, sf_dir):
    """Consecutive stops of every order's lines."""
    lines = _stops(spark, sf_dir)
    return sched.stop_pairs(lines).select("trip_id", (F.floor(F.col("leg") / 1_000_000_000)).cast("int").alias("leg"), "src_stop_id", "dst_stop_id")


def archive_summary(spark, sf_dir):
    """Trips, legs and distinct legs."""
    return sched.archive_summary(_stops(spark, sf_dir))


def picked_dates(spark, sf_dir):
    """Days with pending orders nearest to three target dates, by priority."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    active = pending.select(F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("date")).distinct()
    targets = active.select("service_id").distinct().withColumn("target_date", F.explode(F.array(*[F.lit(d).cast("date") for d in ("1996-03-01", "1997-07-04", "1999-01-15")])))
    out = sched.pick_dates(targets, active, 400)
    return out.select("service_id", F.col("target_date").cast("string").alias("target_date"), F.col("picked_date").cast("string").alias("picked_date"))


def route_ids(spark, sf_dir):
    """Fully qualified route ids and provider file names."""
    o = table(spark, sf_dir, "orders")
    agency = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("a,"), F.col("o_orderstatus")))
    return o.select("o_orderkey", ids.route_id(F.lit(2), agency, F.col("o_orderpriority"), F.col("o_orderstatus")).alias("route"), ids.provider_filename(F.lit("CO"), F.when(F.col("o_orderkey") % 2 == 0, "Fort Collins"), F.col("o_orderpriority"), F.lit("bus (local)")).alias("file"))


def cell_parents(spark, sf_dir):
    """Parents at resolution 5 of cell indexes at resolution 8."""
    value = F.lit(0x88268CD801FFFFF).cast("long").bitwiseOR(F.shiftleft((F.col("p_partkey") % 64).cast("long"), 21))
    return table(spark, sf_dir, "part").select("p_partkey", ids.cell_parent(F.lower(F.hex(value)), 5).alias("parent"), ids.cell_resolution(F.lower(F.hex(value))).alias("resolution"))


def json_values(spark, sf_dir):
    """A nested value by its dotted path."""
    return table(spark, sf_dir, "events").select("event_id", ids.json_value(F.col("props"), "k").cast("long").alias("k"))


def costar(spark, sf_dir):
    """Activities of commercial properties."""
    kind = F.get(F.array(*[F.lit(v) for v in ("Health Care", "Retail", "Specialty", "Hospitality")]), (F.col("p_partkey") % 4).cast("int"))
    subtype = F.get(F.array(*[F.lit(v) for v in ("Bar", "Hotel", "Fast Food")]), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tags.costar_activity(kind, subtype).alias("activity"))


NEAR_SPEED = "ns AS (SELECT l AS edge_id, sum(mph * d) / nullif(sum(d), 0) AS near_mph FROM near JOIN tagged ON edge_id = r WHERE mph IS NOT NULL GROUP BY 1)"
PLACES_SQL = "s AS (SELECT s_suppkey, -105.0 + 0.0037 * (s_suppkey % 13) AS x, 39.9 + 0.0041 * (s_suppkey % 11) AS y FROM supplier), v AS (SELECT CAST(n_nationkey AS BIGINT) AS vertex_id, -105.0 + 0.01 * (n_nationkey % 5) AS vx, 39.9 + 0.01 * (n_nationkey // 5) AS vy FROM nation)"
HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians({x2} - {x1}) / 2), 2))))"
ZONE_SQL = "z AS (SELECT CAST(r_regionkey AS BIGINT) AS zone_id, -105.001 + 0.009 * r_regionkey AS x1, -105.001 + 0.009 * r_regionkey + 0.0142 AS x2 FROM region), hit AS (SELECT vertex_id, zone_id FROM v JOIN z ON vx > x1 AND vx < x2 AND vy > 39.899 AND vy < 39.93)"
FACILITY_SQL = "CASE WHEN cycleway IS NULL THEN NULL WHEN cycleway = 'track' THEN 'buffered' WHEN cycleway IN ('lane', 'designated') THEN 'lane' WHEN cycleway IN ('crossing', 'shared', 'shared_lane') THEN 'facility' ELSE 'none' END"

QUERIES = {
    "edge_stress": (edge_stress, f"""WITH {TAGGED_SQL}, {NEAR_SPEED}, b AS (SELECT edge_id, highway, oneway = 'yes' AS one, coalesce({FACILITY_SQL}, 'none') AS f, round(round(coalesce(mph, near_mph, 25), 6)) AS v FROM tagged LEFT JOIN ns USING (edge_id))
SELECT edge_id, CAST(CASE WHEN highway IN ('motorway', 'trunk', 'motorway_link', 'trunk_link') THEN 4 WHEN highway IN ('cycleway', 'path', 'footway', 'pedestrian', 'living_street') THEN 1 WHEN f = 'buffered' THEN 1
 WHEN f = 'lane' AND NOT one THEN CASE WHEN v <= 30 THEN 1 WHEN v <= 35 THEN 2 WHEN v <= 40 THEN 3 ELSE 4 END
 WHEN f = 'lane' THEN CASE WHEN v <= 30 THEN 1 WHEN v <= 40 THEN 2 ELSE 3 END
 WHEN f = 'facility' AND NOT one THEN CASE WHEN v <= 25 THEN 2 WHEN v <= 40 THEN 3 ELSE 4 END
 WHEN f = 'facility' THEN CASE WHEN v <= 35 THEN 2 WHEN v <= 45 THEN 3 ELSE 4 END
 WHEN NOT one THEN CASE WHEN v <= 25 THEN 2 WHEN v <= 35 THEN 3 ELSE 4 END
 ELSE CASE WHEN v <= 30 THEN 2 WHEN v <= 40 THEN 3 ELSE 4 END END AS INTEGER) AS lts FROM b"""),
    "edge_comfort": (edge_comfort, f"""WITH {TAGGED_SQL}, {NEAR_SPEED},
tg AS (SELECT *, {FACILITY_SQL} AS f, coalesce(sidewalk NOT IN ('no', 'none'), false) OR coalesce(footway = 'sidewalk', false) AS side, coalesce(footway NOT IN ('no', 'none'), false) AS foot FROM tagged),
sc AS (SELECT edge_id, CASE f WHEN 'buffered' THEN 2 WHEN 'lane' THEN 2 WHEN 'facility' THEN 0 WHEN 'none' THEN -2 END AS fc FROM tg),
nc AS (SELECT l AS edge_id, CASE WHEN count(fc) = 0 OR sum(d) = 0 THEN -2 ELSE CAST(trunc(round(sum(coalesce(fc, 0) * d) / sum(d), 9)) AS INTEGER) END AS near_cycle, bool_or(side) AS near_side FROM near JOIN sc ON sc.edge_id = r JOIN tg ON tg.edge_id = r GROUP BY 1),
p AS (SELECT edge_id, side, foot, nc.edge_id IS NOT NULL AS has, side OR foot OR coalesce(highway IN ('residential', 'unclassified', 'living_street', 'service', 'pedestrian', 'trailhead', 'track', 'footway', 'bridleway', 'steps', 'corridor', 'path', 'elevator'), false) OR coalesce(near_side, false) AS ok,
 round(round(coalesce(mph, near_mph, 0), 6)) AS v, coalesce(fc, near_cycle, -2) AS cy, CASE node_highway WHEN 'traffic_signals' THEN 2 WHEN 'stop' THEN 1 ELSE 0 END AS sg
 FROM tg LEFT JOIN ns USING (edge_id) LEFT JOIN nc USING (edge_id) LEFT JOIN sc USING (edge_id)),
q AS (SELECT *, CASE WHEN v <= 25 THEN 2 WHEN v <= 30 THEN 1 WHEN v <= 40 THEN 0 WHEN v <= 45 THEN -1 ELSE -2 END AS sp FROM p)
SELECT edge_id, CAST(CASE WHEN NOT ok THEN -6 WHEN foot OR (NOT has AND side) THEN 9 ELSE least(9, greatest(-6, (CASE WHEN side OR foot THEN 2 ELSE -2 END) + sp + cy + sg)) END AS INTEGER) AS wci, CAST(sp AS INTEGER) AS wci_speed, CAST(cy AS INTEGER) AS wci_cycle, CAST(sg AS INTEGER) AS wci_signal FROM q"""),
    "neighbour_speed": (neighbour_speed, f"WITH {TAGGED_SQL}, {NEAR_SPEED} SELECT edge_id, round(near_mph, 4) AS near_mph FROM ns"),
    "class_speeds": (class_speeds, f"WITH {TAGGED_SQL} SELECT class, round(sum(length_m * mph) / nullif(sum(CASE WHEN mph IS NOT NULL THEN length_m END), 0) * 1.609344, 4) AS kph FROM tagged GROUP BY ROLLUP (class)"),
    "filled_speeds": (filled_speeds, f"WITH {TAGGED_SQL}, c AS (SELECT class, sum(length_m * mph) / sum(CASE WHEN mph IS NOT NULL THEN length_m END) AS a FROM tagged GROUP BY 1), g AS (SELECT sum(length_m * mph) / sum(CASE WHEN mph IS NOT NULL THEN length_m END) AS a FROM tagged) SELECT edge_id, round(coalesce(mph, c.a, g.a) * 1.609344, 4) AS speed FROM tagged JOIN c USING (class) CROSS JOIN g"),
    "edge_summary": (edge_summary, f"WITH {TAGGED_SQL} SELECT class, count(*) AS edges, round(sum(length_m), 2) AS length_m FROM tagged GROUP BY ROLLUP (class)"),
    "top_highways": (top_highways, f"WITH {TAGGED_SQL}, r AS (SELECT class, highway, CASE WHEN highway IN ('motorway', 'motorway_link') THEN 1 WHEN highway IN ('trunk', 'trunk_link') THEN 2 WHEN highway = 'primary' THEN 3 WHEN highway = 'secondary' THEN 4 WHEN highway = 'residential' THEN 7 ELSE 8 END AS k FROM tagged) SELECT class, arg_min(highway, (k, highway)) AS highway FROM r GROUP BY 1"),
    "parsed_speeds": (parsed_speeds, "SELECT p_partkey AS edge_id, round(CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 1.609344 WHEN 1 THEN p_size WHEN 2 THEN least(p_size, 80) WHEN 3 THEN 5 END AS DOUBLE), 4) AS kph FROM part"),
    "reduced_tags": (reduced_tags, "SELECT p_partkey, CAST(least(p_size, p_size % 5) AS VARCHAR) AS low, CAST(greatest(p_size, p_size % 5) AS VARCHAR) AS high, CASE WHEN p_size = p_size % 5 THEN CAST(p_size AS VARCHAR) ELSE p_size || ';' || (p_size % 5) END AS distinct_values, round((p_size + 2 * (p_size % 5)) / 3.0, 4) AS mean_value FROM part"),
    "oneway_flags": (oneway_flags, "SELECT p_partkey, p_partkey % 6 <> 1 AS oneway, p_partkey % 6 IN (2, 3, 4) AS reversed FROM part"),
    "mode_access": (mode_access, """WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS i, CASE l_returnflag WHEN 'R' THEN 'denied' ELSE 'allowed' END AS t,
 CASE WHEN l_linestatus = 'O' THEN l_linenumber % 2 = 0 END AS m, l_linestatus = 'O' AS w FROM lineitem),
s AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS i, 'default' AS state FROM l UNION ALL
 SELECT s.l_orderkey, l.i, CASE WHEN t = 'denied' AND NOT w AND state = 'default' THEN 'blanket' WHEN t = 'denied' AND m THEN 'denied' WHEN t = 'allowed' AND m AND state <> 'denied' THEN 'exception' ELSE state END
 FROM s JOIN l ON l.l_orderkey = s.l_orderkey AND l.i = s.i + 1)
SELECT l_orderkey, arg_max(state, i) AS state, arg_max(state, i) IN ('default', 'exception') AS allowed FROM s GROUP BY 1"""),
    "valid_headings": (valid_headings, """WITH l AS (SELECT l_orderkey, l_returnflag = 'R' AS den, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'forward' ELSE 'backward' END END AS h FROM lineitem),
a AS (SELECT l_orderkey, d.dir, coalesce(bool_or(den AND h = dir), false) AS hd, coalesce(bool_or(NOT den AND h = dir), false) AS ha, coalesce(bool_or(den AND h IS NULL), false) AS gd, coalesce(bool_or(NOT den AND h IS NULL), false) AS ga FROM l CROSS JOIN (VALUES ('forward'), ('backward')) d(dir) GROUP BY 1, 2),
b AS (SELECT l_orderkey, dir, CASE WHEN hd THEN ha ELSE ha OR ga OR NOT gd END AS ok FROM a)
SELECT l_orderkey, bool_or(ok) FILTER (dir = 'forward') AS forward, bool_or(ok) FILTER (dir = 'backward') AS backward FROM b GROUP BY 1"""),
    "split_speeds": (split_speeds, """WITH l AS (SELECT l_orderkey, l_quantity AS mph, greatest(0, least((l_linenumber - 1) / 7.0 + 0.25, 0.7) - greatest((l_linenumber - 1) / 7.0, 0.2)) AS o FROM lineitem)
SELECT l_orderkey, round(CASE WHEN sum(o) >= 1e-6 THEN sum(o * mph) / sum(o) END + CAST(1e-8 AS DOUBLE), 6) AS mph FROM l GROUP BY 1"""),
    "nearest_vertex": (nearest_vertex, f"WITH {PLACES_SQL}, d AS (SELECT s_suppkey, vertex_id, sqrt(power(vx - x, 2) + power(vy - y, 2)) AS d FROM s CROSS JOIN v) SELECT s_suppkey, arg_min(vertex_id, (d, vertex_id)) AS vertex_id, round(min(d), 9) AS distance FROM d GROUP BY 1"),
    "nearest_in_range": (nearest_in_range, f"WITH {PLACES_SQL}, d AS (SELECT s_suppkey, vertex_id, {HAVERSINE.format(x1='x', y1='y', x2='vx', y2='vy')} AS d FROM s CROSS JOIN v) SELECT s_suppkey, arg_min(vertex_id, (d, vertex_id)) AS vertex_id, round(min(d), 3) AS distance FROM d GROUP BY 1 HAVING min(d) <= 300"),
    "overlay_exactly_one": (overlay_exactly_one, f"WITH {PLACES_SQL}, {ZONE_SQL} SELECT vertex_id, min(zone_id) AS zone_id FROM hit GROUP BY 1 HAVING count(*) = 1"),
    "overlay_first": (overlay_first, f"WITH {PLACES_SQL}, {ZONE_SQL} SELECT vertex_id, min(zone_id) AS zone_id FROM hit GROUP BY 1"),
    "distances": (distances, f"WITH {PLACES_SQL}, n AS (SELECT vertex_id, vx, vy, lead(vx) OVER (ORDER BY vertex_id) AS x2, lead(vy) OVER (ORDER BY vertex_id) AS y2 FROM v) SELECT vertex_id, round({HAVERSINE.format(x1='vx', y1='vy', x2='x2', y2='y2')}, 3) AS meters FROM n WHERE x2 IS NOT NULL"),
    "next_departures": (next_departures, f"""WITH {SCHEDULES_SQL}, q AS (SELECT event_id AS query_id, user_id AS edge_id, date_trunc('second', ts) AS now FROM events WHERE event_type = 'purchase'),
r AS (SELECT query_id, now, route, departure, arrival, row_number() OVER (PARTITION BY query_id ORDER BY arrival, departure, route) AS k FROM q LEFT JOIN sched s ON s.edge_id = q.edge_id AND departure >= now)
SELECT query_id, route, strftime(departure, '%Y-%m-%d %H:%M:%S') AS departure, CAST(epoch(departure) - epoch(now) AS BIGINT) AS wait_s, CAST(epoch(arrival) - epoch(departure) AS BIGINT) AS ride_s FROM r WHERE k = 1"""),
    "stop_pairs": (stop_pairs, "SELECT * FROM (SELECT l_orderkey AS trip_id, l_linenumber AS leg, l_suppkey AS src_stop_id, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst_stop_id FROM lineitem) WHERE dst_stop_id IS NOT NULL"),
    "archive_summary": (archive_summary, "WITH p AS (SELECT l_orderkey AS t, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM lineitem), g AS (SELECT t, count(*) AS n, count(DISTINCT (a, b)) AS u FROM p WHERE b IS NOT NULL GROUP BY 1) SELECT count(*) AS trips, CAST(sum(n) AS BIGINT) AS legs, CAST(sum(u) AS BIGINT) AS unique_legs FROM g"),
    "picked_dates": (picked_dates, """WITH a AS (SELECT DISTINCT o_orderpriority AS service_id, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'P'), t AS (SELECT * FROM (VALUES (DATE '1996-03-01'), (DATE '1997-07-04'), (DATE '1999-01-15')) v(t)),
c AS (SELECT service_id, t, d, abs(date_diff('day', t, d)) AS away, CASE WHEN d = t THEN 0 WHEN dayofweek(d) = dayofweek(t) THEN 1 ELSE 2 END AS step FROM a CROSS JOIN t)
SELECT service_id, CAST(t AS VARCHAR) AS target_date, CAST(arg_min(d, (step, away, d)) AS VARCHAR) AS picked_date FROM c WHERE away <= 400 GROUP BY 1, 2"""),
    "route_ids": (route_ids, "SELECT o_orderkey, '2->' || CASE WHEN o_orderkey % 3 <> 0 THEN 'a_' || o_orderstatus ELSE '()' END || '->' || o_orderpriority || '->' || o_orderstatus AS route, 'CO-' || CASE WHEN o_orderkey % 2 = 0 THEN 'Fort_Collins-' ELSE '' END || replace(o_orderpriority, ' ', '_') || '-bus_local' AS file FROM orders"),
    "cell_parents": (cell_parents, "SELECT p_partkey, lower(to_hex((((CAST(613167731102973951 AS BIGINT) | ((CAST(p_partkey AS BIGINT) % 64) << 21)) & ~(CAST(15 AS BIGINT) << 52)) | (CAST(5 AS BIGINT) << 52)) | ((CAST(1 AS BIGINT) << 30) - 1))) AS parent, 8 AS resolution FROM part"),
    "json_values": (json_values, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "costar": (costar, "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'healthcare' WHEN p_partkey % 4 = 1 THEN 'retail' WHEN p_partkey % 4 = 2 THEN 'services' WHEN p_partkey % 3 IN (0, 2) THEN 'food' END AS activity FROM part"),
}
