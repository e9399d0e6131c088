"""Queries that write tables with the sinks and read them back with the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach import sinks
from isoreach.operators import bins, modal, opportunities as opp
from isoreach.plans.domain import opportunities, table, torus, vertices
from isoreach.scratch import Scratch
from isoreach.operators import schedules as sched
from isoreach.sources import flex, gtfs, osm, pbf, tables


def _folder(spark) -> str:
    return Scratch(spark, "files").root


def network_files(spark, sf_dir):
    """Edges of a written network, by list."""
    path = _folder(spark)
    sinks.network(vertices(spark, sf_dir), torus(spark, sf_dir).withColumn("edge_list_id", F.when(F.col("mode") == "walk", 0).otherwise(1)), path)
    edges = spark.read.parquet(f"{path}/edges").join(spark.read.parquet(f"{path}/vertices").select(F.col("vertex_id").alias("src")), "src")
    return edges.groupBy("edge_list_id", "mode").agg(F.count(F.lit(1)).alias("edges"), F.sum("cost").cast("long").alias("minutes"))


def _modal_network(spark, sf_dir):
    """Orders as bent segments over suppliers as connectors; classes by priority, speeds by half, three modes."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("double").alias("q"), F.max("l_returnflag").alias("flag"))
    stop = F.struct(F.col("s").cast("string").alias("connector_id"), ((F.col("l_linenumber") - 1) / 8.0).alias("at"))
    c = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(stop).alias("connectors"), F.max("flag").alias("flag"), F.min("q").alias("q"))
    nothing = lambda *names: [F.lit(None).cast("array<string>").alias(n) for n in names]
    when = F.struct(F.lit(None).cast("string").alias("during"), F.lit("backward").alias("heading"), F.array(F.lit("car")).alias("mode"), *nothing("using", "recognized"))
    half = lambda lo, mph: F.struct(F.struct(F.lit(lo).alias("lo"), F.lit(lo + 0.5).alias("hi")).alias("between"), mph.alias("mph"))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    segments = c.join(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.array(point(0.0, 0.0), point(0.01, 0.0), point(0.01, 0.01)).alias("line"),
        "connectors",
        F.when(F.col("flag") == "N", F.array(F.struct(F.lit("denied").alias("access_type"), when.alias("when")))).alias("access_restrictions"),
        F.when((rank != 3) & (F.col("o_orderstatus") != "P"), F.array(half(0.0, F.col("q")), half(0.5, F.col("q") + 10))).alias("speed_limits"),
        F.lit("road").alias("subtype"),
        F.element_at(F.array(*[F.lit(v) for v in ("primary", "secondary", "residential", "service", "footway")]), rank).alias("class"),
        F.when(rank == 5, "crosswalk").alias("subclass"),
        F.when(rank >= 4, F.array(F.struct(F.struct(F.lit(0.0).alias("lo"), F.lit(0.5).alias("hi")).alias("between"), F.lit("alley").alias("value")))).alias("subclass_rules"),
    )
    connectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("connector_id"), (F.col("s_suppkey") * 0.001).alias("x"), F.lit(0.0).alias("y"))
    modes = [
        modal.Mode("drive", F.col("class") != "footway", {"mode": ["car"]}),
        modal.Mode("walk", F.col("class") != "primary", {"mode": ["foot"]}),
        modal.Mode("bike", ~F.col("class").isin("primary", "footway"), {"mode": ["bicycle"]}),
    ]
    path = _folder(spark)
    network = modal.build(segments, connectors, modes)
    sinks.modal_network(network, path, {"release": "orders"})
    network.drop()  # what is written is read from here on
    return path


def modal_files(spark, sf_dir):
    """Written tables of every mode, joined by edge: by class and bearing the edges, their numbers, ends, miles and speeds."""
    path = _modal_network(spark, sf_dir)
    parts = {
        "edges": "edge_id long, src_vertex_id long, dst_vertex_id long, distance double",
        "speeds": "edge_id long, mph double",
        "classes": "edge_id long, class string",
        "bearings": "edge_id long, bearing double",
        "segments": "edge_id long, segment_id long, linear_reference double",
    }
    out = None
    for mode in ("drive", "walk", "bike"):
        rows = tables.modal_tables(spark, path, mode, parts)
        sums = [F.sum(F.col(a)).alias(b) for a, b in (("edge_id", "numbers"), ("src_vertex_id", "sources"), ("dst_vertex_id", "targets"), ("segment_id", "segments"))]
        made = rows.groupBy(F.lit(mode).alias("mode"), "class", F.round("bearing", 3).alias("bearing")).agg(F.count(F.lit(1)).alias("edges"), *sums, F.round(F.sum("distance"), 2).alias("meters"), F.round(F.avg("mph"), 4).alias("mph"))
        out = made if out is None else out.unionByName(made)
    return out


def modal_speeds(spark, sf_dir):
    """Written mean speeds of every mode by class, and the edges and miles that the written summary tells."""
    path = _modal_network(spark, sf_dir)
    means = spark.read.option("header", True).schema("class string, mph double").csv(*[[f"{path}/{m}/speed_mapping" for m in ("drive", "walk", "bike")]]).withColumn("mode", F.regexp_extract(F.col("_metadata.file_path"), r"/(\w+)/speed_mapping/", 1))
    told = spark.read.text(f"{path}/summary", lineSep="[stats.edge_list.").select(F.regexp_extract("value", r'^"(\w+)"', 1).alias("mode"), F.regexp_extract("value", r'road_class_stats\."([\w-]+)"', 1).alias("class"), F.regexp_extract("value", r"(?:edges|count) = (\d+)", 1).cast("long").alias("edges"), F.regexp_extract("value", r"miles = ([0-9.E-]+)", 1).cast("double").alias("miles"))
    told = told.where("mode <> ''").withColumn("class", F.when(F.col("class") == "", "_global_").otherwise(F.col("class")))
    return told.join(means, ["mode", "class"], "left").select("mode", "class", "edges", F.round("miles", 3).alias("miles"), F.round("mph", 4).alias("mph"))


def bundle_files(spark, sf_dir):
    """A transit archive from orders' lines over suppliers as stops: written edges with their departures."""
    path = _folder(spark)
    k = F.col("s_suppkey")
    # rows of places that are as far apart in all of the world's longitudes, so that no two share a place
    places = table(spark, sf_dir, "supplier").select(k.alias("vertex_id"), (F.pmod(k, F.lit(17000)) * 0.02 - 170).alias("x"), (F.floor(k / 17000) * 0.02).alias("y"))
    stops = places.select(F.col("vertex_id").cast("string").alias("stop_id"), F.lit(None).cast("string").alias("parent_station"), F.format_string("%.4f", F.col("x") + 0.001).alias("stop_lon"), F.format_string("%.4f", "y").alias("stop_lat"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    clock = F.format_string("%02d:%02d:00", F.lit(6) + F.col("l_linenumber"), (F.col("l_orderkey") % 60).cast("int"))
    times = lines.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_linenumber").cast("string").alias("stop_sequence"), F.col("s").cast("string").alias("stop_id"), clock.alias("arrival_time"), F.lit(None).cast("string").alias("departure_time"))
    o = table(spark, sf_dir, "orders")
    trips = o.select(F.col("o_orderkey").cast("string").alias("trip_id"), F.col("o_orderpriority").alias("route_id"), F.col("o_orderstatus").alias("service_id"), F.lit(None).cast("string").alias("agency_id"))
    active = o.select(F.col("o_orderstatus").alias("service_id"), F.to_date("o_orderdate").alias("date")).distinct()
    targets = o.select(F.col("o_orderstatus").alias("service_id")).distinct().withColumn("target_date", F.lit("1990-01-01").cast("date"))
    sinks.bundle(*gtfs.bundle(times, trips, stops, places, active, targets, 1), path)
    edges, schedules = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/schedules")
    out = schedules.join(edges.select("edge_id", "src", "dst"), "edge_id")
    return out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("departures"), F.sum((F.unix_seconds(F.col("arrival").cast("timestamp")) - F.unix_seconds(F.col("departure").cast("timestamp"))) / 60).cast("long").alias("minutes"))


def schedule_file(spark, sf_dir):
    """Departures written as text and read with the schema of schedules."""
    path = _folder(spark)
    text = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("edge_id"), F.col("event_type").alias("fully_qualified_id"), text.alias("src_departure_time"), text.alias("dst_arrival_time"))
    sinks.metrics(rows, path)
    back = gtfs.schedule_rows(spark, path)
    return back.groupBy("edge_id", "route").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("departure"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def metric_file(spark, sf_dir):
    """Edge metrics written with a header and merged with others by edge."""
    left, right = _folder(spark), _folder(spark)
    p = table(spark, sf_dir, "part")
    sinks.metrics(p.select(F.col("p_partkey").alias("edge_id"), F.col("p_size").alias("lts")), left)
    sinks.metrics(p.select(F.col("p_partkey").alias("edge_id"), F.col("p_retailprice").alias("wci")), right)
    return sinks.merged_metrics(tables.modal_edges(spark, left, "edge_id long, lts int"), tables.modal_edges(spark, right, "edge_id long, wci double"))


def opportunity_file(spark, sf_dir):
    """An opportunity vector written, sorted by vertex, and read back by activity."""
    path = _folder(spark)
    wide = opp.opportunity_vector(opportunities(spark, sf_dir), ["BUILDING", "MACHINERY"])
    sinks.opportunity_vectors(wide, path)
    back = tables.opportunity_file(spark, path, ["MACHINERY", "BUILDING"])
    return back.select("vertex_id", F.col("MACHINERY").cast("long").alias("machinery"), F.col("BUILDING").cast("long").alias("building"))


def zone_files(spark, sf_dir):
    """On-demand zones written, and the nations where a ride from each nation may end."""
    path = _folder(spark)
    r = table(spark, sf_dir, "region")
    relations = r.select(F.col("r_regionkey").cast("string").alias("src_zone"), ((F.col("r_regionkey") + 1) % 5).cast("string").alias("dst_zone"), F.lit(28800).alias("start_s"), F.lit(64800).alias("end_s"))
    sinks.zones(relations, r.select(F.col("r_regionkey").cast("string").alias("zone_id"), F.lit("POLYGON EMPTY").alias("geometry")), path)
    at = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex_id"), F.col("n_regionkey").cast("string").alias("zone_id"))
    relation, ids = spark.read.parquet(f"{path}/relations"), spark.read.parquet(f"{path}/zone_ids")
    leaving = flex.may_depart(at.join(ids, "zone_id", "left_semi"), relation, F.lit(30000))
    return flex.may_alight(leaving.select(F.col("vertex_id").alias("origin"), "zone_id"), at, relation)


def overlay_files(spark, sf_dir):
    """Rows in one folder per zone, counted by folder."""
    path = _folder(spark)
    sinks.overlay(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("zone")), "zone", path)
    return spark.read.option("header", True).csv(path).groupBy("overlay_id").agg(F.count(F.lit(1)).alias("rows"))


def result_files(spark, sf_dir):
    """Chosen columns of nested results as a text table."""
    path = _folder(spark)
    nested = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.struct(F.col("c_acctbal").alias("total")).alias("bin")).alias("info"))
    sinks.results(nested, path, {"key": "c_custkey", "total": "info.bin.total"})
    return spark.read.option("header", True).schema("key long, total double").csv(path)


def json_results(spark, sf_dir):
    """Whole rows as JSON lines, read back."""
    path = _folder(spark)
    sinks.results(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path, {}, "json")
    return spark.read.schema("s_suppkey long, s_name string").json(path)


def category_file(spark, sf_dir):
    """Categories of a file with one a line, numbered in its order."""
    path = f"{_folder(spark)}/names"
    names = table(spark, sf_dir, "nation").groupBy().agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value"))
    names.coalesce(1).write.text(path)
    return tables.categories(spark, path)


def latest_release(spark, sf_dir):
    """Regions written as two releases; the newest is read."""
    path = _folder(spark)
    r = table(spark, sf_dir, "region")
    for name, rows in (("2024-01-17.0", r.withColumn("r_name", F.lower("r_name"))), ("2024-11-13.0", r)):
        rows.write.parquet(f"{path}/release/{name}")
    return spark.read.parquet(tables.latest_release([f"{path}/release/2024-11-13.0", f"{path}/release/2024-01-17.0"])).select("r_regionkey", "r_name")


def delay_file(spark, sf_dir):
    """Delay zones of a file, and the delay of every nation inside of one."""
    path = _folder(spark)
    k = F.col("r_regionkey").cast("double")
    corner = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    x1, x2, y1, y2 = k * 5 - 0.5, k * 5 + 4.5, F.lit(-1.0), F.lit(1.0)
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(",", corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2), corner(x1, y1)), F.lit("))"))
    sinks.metrics(table(spark, sf_dir, "region").select(wkt.alias("geometry"), (k * 2).alias("time")), path)
    from isoreach.operators.spatial import points_in_rings

    zones = tables.time_delays(spark, path)
    at = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex_id"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return points_in_rings(at, zones.select("zone_id", "ring"), "zone_id").join(zones.select("zone_id", "time"), "zone_id").select("vertex_id", "time")


def manifest_file(spark, sf_dir):
    """Providers of one country in a written manifest."""
    path = _folder(spark)
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("provider"), none.alias("name"), none.alias("municipality"), none.alias("state_code"), F.when(F.col("n_regionkey") == 1, "US").otherwise("FR").alias("country_code"), F.lit("gtfs").alias("data_type"), none.alias("url"))
    sinks.metrics(rows, path)
    return gtfs.manifest(spark, path, country="US", data_type="gtfs").select("provider")


def route_shapes(spark, sf_dir):
    """Lines of orders as shapes in sequence."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    rows = lines.select(F.col("l_orderkey").alias("shape_id"), F.col("l_linenumber").alias("shape_pt_sequence"), F.col("s").cast("string").alias("shape_pt_lon"), F.lit("0").alias("shape_pt_lat"))
    return gtfs.shapes(rows)


def _archives(spark, sf_dir):
    """Zipped archives by order priority: orders are trips over suppliers, those of one status share a shape."""
    path = _folder(spark)
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    archive = F.substring("o_orderpriority", 1, 1).alias("archive")
    times = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(archive, F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("s").alias("stop_id"), F.format_string("%02d:00:00", "l_linenumber").alias("arrival_time"), F.lit(None).cast("string").alias("departure_time"))
    trips = o.select(archive, F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"), F.lit("s, \"daily\"").alias("service_id"), F.col("o_orderstatus").alias("shape_id"))
    shapes = o.where("o_orderstatus <> 'P'").select(archive, F.col("o_orderstatus").alias("shape_id"), F.lit(0).alias("shape_pt_sequence"), F.lit(0.5).alias("shape_pt_lon"), F.lit(1.5).alias("shape_pt_lat")).distinct()
    plain = o.select(archive).distinct()
    stops = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(archive, F.col("s").alias("stop_id"), F.lit(None).cast("string").alias("parent_station"), F.lit("1.0").alias("stop_lon"), F.lit("2.0").alias("stop_lat")).distinct()
    routes = o.select(archive, F.col("o_custkey").alias("route_id"), F.lit("a").alias("agency_id")).distinct()
    sinks.archives({"agency": plain.withColumn("agency_id", F.lit("a")), "stops": stops, "routes": routes, "trips": trips, "stop_times": times, "shapes": shapes}, path)
    return path


def zipped_archives(spark, sf_dir):
    """Members of written zipped archives, by archive: trips, routes, stops and hours of arrival."""
    path = _archives(spark, sf_dir)
    times, trips = gtfs.read_archives(spark, path, "stop_times"), gtfs.read_archives(spark, path, "trips")
    hours = (gtfs.seconds("arrival_time") / 3600).cast("long")
    per = times.groupBy("archive").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("stop_id").alias("stops"), F.sum(hours).alias("hours"), F.count("departure_time").alias("departures"))
    return per.join(trips.groupBy("archive").agg(F.count(F.lit(1)).alias("trips"), F.count_distinct("route_id").alias("routes"), F.max("service_id").alias("service")), "archive")


def archive_summaries(spark, sf_dir):
    """Trips, legs and known shapes of zipped archives."""
    path = _archives(spark, sf_dir)
    read = lambda member: gtfs.read_archives(spark, path, member)
    return sched.archive_summaries(read("stop_times"), read("trips"), read("shapes")).drop("coverage")


def street_archive(spark, sf_dir):
    """Suppliers as nodes and orders' lines as ways in binary archives: ways all of whose nodes are there."""
    path = _folder(spark)
    s, o = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "orders")
    nodes = s.where("s_acctbal > 0").select(F.col("s_suppkey").cast("long").alias("osmid"), (F.col("s_acctbal").cast("double") / 1000).alias("x"), (F.col("s_nationkey") * -0.5).alias("y"), F.col("s_name").alias("ref"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    on_way = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "s"))), lambda p: p["s"].cast("long"))
    ways = lines.groupBy("l_orderkey").agg(on_way.alias("nodes")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ways = ways.select(F.col("o_orderkey").cast("long").alias("osmid"), "nodes", F.col("o_orderpriority").alias("highway"), F.when(F.col("o_orderstatus") == "F", "yes").alias("oneway"))
    pbf.write(nodes, path, "nodes")
    pbf.write(ways, path, "ways")
    all_nodes, kept = osm.read_archive(spark, path)
    at = kept.select(F.col("osmid").alias("way"), "highway", "oneway", F.size("nodes").cast("long").alias("n"), F.posexplode("nodes").alias("i", "osmid")).join(all_nodes.select("osmid", "x", "y", "ref"), "osmid")
    return at.groupBy("way", "highway", "oneway", "n").agg(F.sum(F.round(F.col("x") * 1e5).cast("long") * (F.col("i") + 1)).alias("x"), F.sum(F.round(F.col("y") * 2).cast("long") * (F.col("i") + 1)).alias("y"), F.max("ref").alias("ref"))


def feature_rows(spark, sf_dir):
    """Destinations of lines by bin of their quantity, marginal bins from zero."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("cost"))
    found = bins.explode_bins(rows, bins.Binning("cost", (10, 25, 50), marginal=True, prepend_zero=True))
    return found.groupBy("bin_key").agg(F.count(F.lit(1)).alias("n"))


TORUS = "people AS (SELECT n_nationkey k, count(c_custkey) n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), torus AS (SELECT CASE WHEN s IN (1, 24) THEN 'walk' ELSE 'bike' END AS mode, 2 + ((n * 7 + s * 3 + k) % 11) AS mins FROM people, (VALUES (1), (5), (20), (24)) v(s))"
MODAL_SQL = """ls AS (SELECT l_orderkey AS o, l_linenumber AS i, min(l_suppkey) AS s, CAST(min(l_quantity) AS DOUBLE) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
sg AS (SELECT o, max(f) AS f, min(q) AS q FROM ls GROUP BY 1), od AS (SELECT o, CAST((i - 1) / 8.0 AS DOUBLE) AS at, s, row_number() OVER (PARTITION BY o ORDER BY i) AS r FROM ls),
vx AS (SELECT s_suppkey AS s, row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS v FROM supplier),
sp AS (SELECT a.o, a.at AS a, b.at AS b, va.v AS va, vb.v AS vb FROM od a JOIN od b ON a.o = b.o AND b.r = a.r + 1 JOIN vx va ON va.s = a.s JOIN vx vb ON vb.s = b.s),
dr AS (SELECT sp.*, h, f, left(o_orderpriority, 1) AS p, CASE WHEN left(o_orderpriority, 1) <> '3' AND o_orderstatus <> 'P' THEN (q * greatest(least(b, 0.5) - a, 0) + (q + 10) * greatest(b - greatest(a, 0.5), 0)) / (b - a) END AS mph,
 'road-' || CASE left(o_orderpriority, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'residential' WHEN '4' THEN CASE WHEN a < 0.5 THEN 'service-alley' ELSE 'service' END ELSE 'footway-crosswalk' END AS class,
 CASE h WHEN 'forward' THEN CASE WHEN b <= 0.5 THEN 90.0 ELSE 0.0 END ELSE CASE WHEN a >= 0.5 THEN 180.0 ELSE 270.0 END END AS bearing, (b - a) * 4 * 6371008.8 * asin(sqrt(power(sin(radians(0.01) / 2), 2))) AS d
 FROM sp JOIN sg USING (o) JOIN orders ON o_orderkey = o CROSS JOIN (VALUES ('forward'), ('backward')) h(h)),
ed AS (SELECT m AS mode, dr.*, row_number() OVER (PARTITION BY m ORDER BY h DESC, CAST(o AS VARCHAR), a) - 1 AS n FROM dr CROSS JOIN (VALUES ('drive'), ('walk'), ('bike')) m(m) WHERE CASE m WHEN 'drive' THEN p <> '5' AND (h = 'forward' OR f <> 'N') WHEN 'walk' THEN p <> '1' ELSE p NOT IN ('1', '5') END),
mn AS (SELECT mode, class, sum(d * mph) / sum(CASE WHEN mph IS NOT NULL THEN d END) AS mean FROM ed GROUP BY ROLLUP (mode, class))"""
QUERIES = {
    "modal_files": (modal_files, f"""WITH {MODAL_SQL} SELECT ed.mode, ed.class, CAST(bearing AS DOUBLE) AS bearing, count(*) AS edges, CAST(sum(n) AS BIGINT) AS numbers, CAST(sum(CASE h WHEN 'forward' THEN va ELSE vb END) AS BIGINT) AS sources, CAST(sum(CASE h WHEN 'forward' THEN vb ELSE va END) AS BIGINT) AS targets,
CAST(sum(o) AS BIGINT) AS segments, round(sum(d), 2) AS meters, round(avg(coalesce(mph, c.mean, g.mean)), 4) AS mph FROM ed LEFT JOIN mn c ON c.mode = ed.mode AND c.class = ed.class JOIN mn g ON g.mode = ed.mode AND g.class IS NULL GROUP BY 1, 2, 3"""),
    "modal_speeds": (modal_speeds, f"""WITH {MODAL_SQL}, t AS (SELECT mode, class, count(*) AS edges, sum(d) / 1609.344 AS miles FROM ed GROUP BY ROLLUP (mode, class)) SELECT t.mode, coalesce(t.class, '_global_') AS class, edges, round(miles, 3) AS miles, round(mean, 4) AS mph FROM t JOIN mn ON mn.mode = t.mode AND mn.class IS NOT DISTINCT FROM t.class"""),
    "network_files": (network_files, f"WITH {TORUS} SELECT CASE mode WHEN 'walk' THEN 0 ELSE 1 END AS edge_list_id, mode, count(*) AS edges, CAST(sum(mins) AS BIGINT) AS minutes FROM torus GROUP BY 1, 2"),
    "bundle_files": (bundle_files, """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
p AS (SELECT s AS src, lead(s) OVER (PARTITION BY o ORDER BY i) AS dst, lead(i) OVER (PARTITION BY o ORDER BY i) - i AS h FROM l) SELECT src, dst, count(*) AS departures, CAST(sum(h) * 60 AS BIGINT) AS minutes FROM p WHERE dst IS NOT NULL GROUP BY 1, 2"""),
    "schedule_file": (schedule_file, "SELECT user_id AS edge_id, event_type AS route, count(*) AS n, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1, 2"),
    "metric_file": (metric_file, "SELECT p_partkey AS edge_id, p_size AS lts, p_retailprice AS wci FROM part"),
    "opportunity_file": (opportunity_file, "SELECT CAST(c_nationkey AS BIGINT) AS vertex_id, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer GROUP BY 1"),
    "zone_files": (zone_files, "SELECT CAST(a.n_nationkey AS BIGINT) AS origin, CAST(b.n_nationkey AS BIGINT) AS vertex_id FROM nation a JOIN nation b ON b.n_regionkey = (a.n_regionkey + 1) % 5"),
    "overlay_files": (overlay_files, "SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]', '_', 'g') AS overlay_id, count(*) AS rows FROM orders GROUP BY 1"),
    "result_files": (result_files, "SELECT c_custkey AS key, c_acctbal AS total FROM customer"),
    "json_results": (json_results, "SELECT s_suppkey, s_name FROM supplier"),
    "category_file": (category_file, "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS label, n_name AS category FROM nation"),
    "latest_release": (latest_release, "SELECT r_regionkey, r_name FROM region"),
    "delay_file": (delay_file, "SELECT CAST(n_nationkey AS BIGINT) AS vertex_id, CAST(n_nationkey // 5 * 2 AS DOUBLE) AS time FROM nation"),
    "manifest_file": (manifest_file, "SELECT n_name AS provider FROM nation WHERE n_regionkey = 1"),
    "route_shapes": (route_shapes, "WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2) SELECT o AS shape_id, 'LINESTRING(' || string_agg(s || ' 0', ',' ORDER BY i) || ')' AS geometry FROM l GROUP BY 1"),
    "zipped_archives": (zipped_archives, """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), t AS (SELECT left(o_orderpriority, 1) AS archive, l.* FROM l JOIN orders ON o_orderkey = o),
a AS (SELECT archive, count(*) AS times, count(DISTINCT s) AS stops, CAST(sum(i) AS BIGINT) AS hours, 0 AS departures FROM t GROUP BY 1)
SELECT a.*, trips, routes, 's, "daily"' AS service FROM a JOIN (SELECT left(o_orderpriority, 1) AS archive, count(*) AS trips, count(DISTINCT o_custkey) AS routes FROM orders GROUP BY 1) USING (archive)"""),
    "archive_summaries": (archive_summaries, """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), p AS (SELECT o, s, lead(s) OVER (PARTITION BY o ORDER BY i) AS d FROM l),
g AS (SELECT o, count(*) AS legs, count(DISTINCT (s, d)) AS unique_legs FROM p WHERE d IS NOT NULL GROUP BY 1)
SELECT left(o_orderpriority, 1) AS archive, count(*) AS trips, CAST(coalesce(sum(legs), 0) AS BIGINT) AS legs, CAST(coalesce(sum(unique_legs), 0) AS BIGINT) AS unique_legs, count(*) FILTER (legs IS NOT NULL AND o_orderstatus <> 'P') AS shaped, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END) AS shapes FROM orders LEFT JOIN g ON o = o_orderkey GROUP BY 1"""),
    "street_archive": (street_archive, """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT o, s, row_number() OVER (PARTITION BY o ORDER BY i) AS k FROM l),
m AS (SELECT o, k, s_suppkey, s_acctbal, s_nationkey, s_name FROM r LEFT JOIN supplier ON s_suppkey = s AND s_acctbal > 0)
SELECT CAST(o AS BIGINT) AS way, o_orderpriority AS highway, CASE o_orderstatus WHEN 'F' THEN 'yes' END AS oneway, count(*) AS n, CAST(sum(k * CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS x, CAST(sum(-k * s_nationkey) AS BIGINT) AS y, max(s_name) AS ref
FROM m JOIN orders ON o_orderkey = o GROUP BY ALL HAVING count(s_suppkey) = count(*)"""),
    "feature_rows": (feature_rows, "WITH b AS (SELECT * FROM (VALUES ('10', 0, 10), ('25', 10, 25), ('50', 25, 50)) v(bin_key, lo, hi)) SELECT bin_key, count(*) AS n FROM lineitem JOIN b ON l_quantity >= lo AND l_quantity < hi GROUP BY 1"),
}
