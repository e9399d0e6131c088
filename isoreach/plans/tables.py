"""Table queries: opportunities, calendars, filters, set operations, taxonomy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoreach.functions import dates, ids
from isoreach.graph.islands import renumbered
from isoreach.operators import opportunities as opp
from isoreach.operators import overture, schedules as sched, taxonomy
from isoreach.plans.domain import ACTIVITIES, opportunities, schedules, table

WAC = {"CNS01": ["jobs", "retail"], "CNS02": ["jobs"]}


def opportunity_vector(spark, sf_dir):
    """One row per vertex, one column per activity."""
    wide = opp.opportunity_vector(opportunities(spark, sf_dir), ACTIVITIES)
    return wide.select("vertex_id", *[F.col(a).cast("long").alias(a.lower()) for a in ACTIVITIES])


def areal_shares(spark, sf_dir):
    """Region totals shared evenly among the region's nations."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("zone_id"), F.col("n_nationkey").cast("long").alias("vertex_id"))
    zones = opportunities(spark, sf_dir).join(nation, "vertex_id").groupBy("zone_id", "activity").agg(F.sum("count").alias("count"))
    return opp.proportioned(zones, nation).select("vertex_id", "activity", F.round("count", 6).alias("count"))


def lodes_jobs(spark, sf_dir):
    """Jobs per zone and activity from segment columns."""
    wac = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("geoid")).agg(F.count(F.lit(1)).alias("CNS01"), F.count_distinct("o_custkey").alias("CNS02"))
    return opp.lodes(wac, WAC).select("geoid", "activity", F.col("count").cast("long").alias("count"))


def long_categories(spark, sf_dir):
    """Market segments mapped to activities; one category may feed several."""
    mapping = opp.parse_mapping("AUTOMOBILE->retail-services,BUILDING->jobs,FURNITURE->retail,HOUSEHOLD->retail,MACHINERY->jobs")
    out = opp.mapped_long(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", None, mapping)
    return out.select("c_nationkey", "activity", F.col("count").cast("long").alias("count"))


def inverted_mapping(spark, sf_dir):
    """Activities with the categories that feed them."""
    rows = table(spark, sf_dir, "nation").select("n_name", F.concat_ws(";", F.lit("all"), (F.col("n_regionkey") % 2).cast("string")).alias("acts"))
    return opp.invert_mapping(rows, "n_name", "acts").select("activity", F.array_join("categories", ",").alias("categories"))


def wide_to_long(spark, sf_dir):
    """Account balances of suppliers and customers unpivoted per nation."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.max("s_suppkey").alias("last"))
    return opp.wide_to_long(s, "s_nationkey", ["suppliers", "last"]).select("s_nationkey", "activity", F.col("count").cast("long").alias("count"))


def combined_models(spark, sf_dir):
    """Two opportunity models side by side, absent cells 0."""
    a = opportunities(spark, sf_dir).where("activity = 'BUILDING'")
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("vertex_id")).agg(F.count(F.lit(1)).cast("double").alias("count")).withColumn("activity", F.lit("suppliers"))
    wide = opp.opportunity_vector(opp.combine([a, b.select("vertex_id", "activity", "count")]), ["BUILDING", "suppliers"])
    return wide.select("vertex_id", F.col("BUILDING").cast("long").alias("building"), F.col("suppliers").cast("long").alias("suppliers"))


def delays(spark, sf_dir):
    """Sum, mean and median delay by event type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


def loaded_schedules(spark, sf_dir):
    """Departures of one week that do not arrive before they depart."""
    out = sched.valid_departures(schedules(spark, sf_dir), F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-14 23:59:59").cast("timestamp"))
    return out.groupBy("edge_id", "route").agg(F.count(F.lit(1)).alias("departures"), F.date_format(F.min("departure"), "yyyy-MM-dd HH:mm:ss").alias("first_departure"))


def daytime_trips(spark, sf_dir):
    """Departures and arrivals within office hours."""
    s = schedules(spark, sf_dir)
    seconds = lambda c: F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    inside = sched.within_time_of_day(seconds(F.col("departure")), seconds(F.col("arrival")), 8 * 3600, 18 * 3600)
    return s.where(inside).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def service_dates(spark, sf_dir):
    """Calendar days on weekdays, with days added for finished urgent orders and deleted for pending low ones, by month."""
    c = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("service_id"),
        F.lit("1996-01-01").cast("date").alias("start_date"),
        F.lit("1996-06-30").cast("date").alias("end_date"),
        *[(F.col("r_regionkey") + i < 7).alias(d) for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"), 1)],
    )
    o = table(spark, sf_dir, "orders").where("year(o_orderdate) = 1996 and month(o_orderdate) <= 6")
    kind = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), "Added").when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "Deleted")
    x = o.select(F.lit("ASIA").alias("service_id"), F.to_date("o_orderdate").alias("date"), kind.alias("exception_type")).where("exception_type is not null").distinct()
    return sched.active_dates(c, x).groupBy("service_id", F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("days"))


def kept_trips(spark, sf_dir):
    """Stop times of the trips that touch no bad stop."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("stop_id"))
    bad = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("stop_id"))
    return sched.without_bad_stops(lines, bad).select("trip_id", "stop_sequence", "stop_id")


def flex_pairs(spark, sf_dir):
    """Two-stop trips picked up and dropped off by phone."""
    lines = table(spark, sf_dir, "lineitem")
    first = F.col("l_linenumber") == 1
    phone = F.col("l_returnflag") != "R"
    s = lines.select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("stop_id"), F.when(first & phone, 2).otherwise(1).alias("pickup_type"), F.when(~first & phone, 2).otherwise(1).alias("drop_off_type"))
    return sched.flex_pairs(s)


def pruned_ways(spark, sf_dir):
    """Ways without missing nodes, and the nodes that they keep."""
    from isoreach.sources.osm import prune

    nodes = table(spark, sf_dir, "supplier").where("s_acctbal > 500").select(F.col("s_suppkey").alias("osmid"))
    ways = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("osmid")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("nodes"))
    kept_nodes, kept_ways = prune(nodes, ways)
    return kept_ways.select(F.lit("way").alias("kind"), "osmid").unionByName(kept_nodes.select(F.lit("node").alias("kind"), "osmid"))


def bounded_places(spark, sf_dir):
    """Records whose box lies in the query's box, with a class of the set."""
    from isoreach.functions.geometry import box_within

    k = F.col("p_partkey")
    x = F.lit(-105.0) + 0.001 * (k % 100)
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("class"), F.struct(x.alias("xmin"), (x + 0.002).alias("xmax"), F.lit(40.0).alias("ymin"), F.lit(40.01).alias("ymax")).alias("bbox"))
    test = overture.row_filter(bbox=box_within(F.col("bbox"), (-104.9805, -104.9205, 39.9, 40.1)), has_class=F.col("class").isNotNull(), class_in=F.col("class").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"))
    return p.where(test).select("p_partkey", "class")


def class_filters(spark, sf_dir):
    """Class and subclass filters with unset values."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("c"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("s"))
    one = overture.class_filter(F.col("c"), ["Brand#11", "Brand#22", "Brand#33"], include=False, allow_unset=True)
    return p.select("p_partkey", one.alias("kept"))


def renumbered_edges(spark, sf_dir):
    """Lines numbered anew from 0 after some are removed."""
    e = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("edge_list_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"), F.col("l_returnflag").alias("flag"))
    e = e.groupBy("edge_list_id", "edge_id").agg(F.min("flag").alias("flag"))
    return renumbered(e.drop("flag"), e.where("flag = 'R'")).select("edge_id", "old_edge_id")


def set_operations(spark, sf_dir):
    """Nations of indebted suppliers and of the richest customers: in both, in either and in the first alone."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").cast("long").alias("k"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").cast("long").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(s.intersect(c), "intersect").unionByName(tag(s.union(c).distinct(), "union")).unionByName(tag(s.exceptAll(s.intersect(c)).distinct().join(c, "k", "left_anti"), "except"))


def top_regions(spark, sf_dir):
    """The three largest and the three smallest nations by customers; ties by key."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "c_nationkey").limit(3).withColumn("kind", F.lit("largest"))
    return top.unionByName(n.orderBy("n", "c_nationkey").limit(3).withColumn("kind", F.lit("smallest"))).select("kind", F.col("c_nationkey").cast("long").alias("c_nationkey"), "n")


def taxonomy_closure(spark, sf_dir):
    """Every category with all its descendants, itself included."""
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("child"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n:"), "n_name").alias("child"), F.col("r_name").alias("parent"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", F.col("n_name"), "c_mktsegment").alias("child"), F.concat(F.lit("n:"), "n_name").alias("parent")).distinct()
    return taxonomy.closure(r.unionByName(n).unionByName(c)).select("category", "descendant")


def activity_masks(spark, sf_dir):
    """Activities that any of an order's line modes feed."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("categories"))
    groups = spark.createDataFrame([("jobs", "A"), ("jobs", "R"), ("food", "N"), ("food", "R")], "activity string, category string")
    return taxonomy.activity_mask(rows, "l_orderkey", groups, ["food", "jobs"]).select("l_orderkey", F.col("food"), F.col("jobs"))


def leg_counts(spark, sf_dir):
    """Legs and legs per mode of a customer's orders in sequence."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_orderstatus").over(w))
    legs = o.where("before is null or before <> o_orderstatus")
    return legs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("legs"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("legs_f"), F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("legs_o"))


def stop_times(spark, sf_dir):
    """Stop timestamps from service dates and seconds past midnight."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 100000).alias("s"))
    return o.select("o_orderkey", F.date_format(ids.stop_timestamp(F.col("d"), F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def date_maps(spark, sf_dir):
    """Maps of target to picked dates per service."""
    active = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("date")).where(F.dayofmonth("date") == 5).distinct()
    targets = active.select("service_id").distinct().withColumn("target_date", F.explode(F.array(*[F.lit(d).cast("date") for d in ("1996-03-01", "1997-07-04")])))
    out = sched.date_mapping(sched.pick_dates(targets, active, 60))
    text = F.array_join(F.transform(F.map_entries("dates"), lambda e: F.concat_ws(">", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return out.select("service_id", text.alias("dates"))


def mapped_departures(spark, sf_dir):
    """Departures moved onto picked dates and back."""
    s = schedules(spark, sf_dir).where("route = 'purchase'")
    picks = F.create_map(F.lit("2024-01-05").cast("date"), F.lit("2024-02-02").cast("date"), F.lit("2024-01-06").cast("date"), F.lit("2023-12-30").cast("date"))
    there = dates.onto_date(F.col("departure"), picks)
    out = s.select("edge_id", "departure", there.alias("there"), dates.back_to_date(there, F.col("departure"), there).alias("back"), F.size(dates.tolerance_window(F.to_date("departure"), F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"), 3)).alias("days"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("edge_id", text("departure"), text("there"), text("back"), "days")


def route_windows(spark, sf_dir):
    """Flex zone windows that are open at a time of day."""
    e = table(spark, sf_dir, "events")
    now = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    start, end = F.when(F.col("user_id") % 3 != 0, 28800), F.when(F.col("user_id") % 2 != 0, 64800)
    return e.where(ids.window_contains(now, start, end)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "opportunity_vector": (opportunity_vector, "SELECT CAST(c_nationkey AS BIGINT) AS vertex_id, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{a}') AS {a.lower()}" for a in ACTIVITIES) + " FROM customer GROUP BY 1"),
    "areal_shares": (areal_shares, "WITH z AS (SELECT n_regionkey AS r, c_mktsegment AS activity, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), m AS (SELECT n_regionkey AS r, count(*) AS k FROM nation GROUP BY 1) SELECT CAST(n_nationkey AS BIGINT) AS vertex_id, activity, round(n / CAST(k AS DOUBLE), 6) AS count FROM nation JOIN m ON m.r = n_regionkey JOIN z ON z.r = n_regionkey"),
    "lodes_jobs": (lodes_jobs, "WITH w AS (SELECT o_orderpriority AS geoid, count(*) AS a, count(DISTINCT o_custkey) AS b FROM orders GROUP BY 1) SELECT geoid, 'jobs' AS activity, a + b AS count FROM w UNION ALL SELECT geoid, 'retail', a FROM w"),
    "long_categories": (long_categories, "WITH m AS (SELECT * FROM (VALUES ('AUTOMOBILE', 'retail'), ('AUTOMOBILE', 'services'), ('BUILDING', 'jobs'), ('FURNITURE', 'retail'), ('HOUSEHOLD', 'retail'), ('MACHINERY', 'jobs')) v(c, activity)) SELECT c_nationkey, activity, count(*) AS count FROM customer JOIN m ON c = c_mktsegment GROUP BY 1, 2"),
    "inverted_mapping": (inverted_mapping, "SELECT activity, string_agg(n_name, ',' ORDER BY n_name) AS categories FROM (SELECT n_name, 'all' AS activity FROM nation UNION ALL SELECT n_name, CAST(n_regionkey % 2 AS VARCHAR) FROM nation) GROUP BY 1"),
    "wide_to_long": (wide_to_long, "SELECT s_nationkey, 'suppliers' AS activity, count(*) AS count FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey, 'last', max(s_suppkey) FROM supplier GROUP BY 1"),
    "combined_models": (combined_models, "WITH a AS (SELECT c_nationkey AS v, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), b AS (SELECT s_nationkey AS v, count(*) AS n FROM supplier GROUP BY 1) SELECT CAST(coalesce(a.v, b.v) AS BIGINT) AS vertex_id, coalesce(a.n, 0) AS building, coalesce(b.n, 0) AS suppliers FROM a FULL JOIN b ON a.v = b.v"),
    "delays": (delays, "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1"),
    "loaded_schedules": (loaded_schedules, "WITH s AS (SELECT user_id AS edge_id, event_type AS route, date_trunc('second', ts) AS d FROM events) SELECT edge_id, route, count(*) AS departures, strftime(min(d), '%Y-%m-%d %H:%M:%S') AS first_departure FROM s WHERE d BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:59:59' GROUP BY 1, 2"),
    "daytime_trips": (daytime_trips, "WITH s AS (SELECT event_type AS route, date_trunc('second', ts) AS d, date_trunc('second', ts) + to_seconds(CAST(floor(abs(value)) AS BIGINT)) AS a FROM events), t AS (SELECT route, hour(d) * 3600 + minute(d) * 60 + second(d) AS x, hour(a) * 3600 + minute(a) * 60 + second(a) AS y FROM s) SELECT route, count(*) AS n FROM t WHERE x BETWEEN 28800 AND 64800 AND y BETWEEN 28800 AND 64800 GROUP BY 1"),
    "service_dates": (service_dates, """WITH c AS (SELECT r_name AS s, CAST(d AS DATE) AS d FROM region, range(DATE '1996-01-01', DATE '1996-07-01', INTERVAL 1 DAY) t(d) WHERE r_regionkey + isodow(d) < 7),
x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_orderpriority = '1-URGENT' AS a FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <= 6 AND ((o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P'))),
u AS (SELECT s, d FROM c UNION SELECT 'ASIA', d FROM x WHERE a) SELECT s AS service_id, CAST(month(d) AS INTEGER) AS month, count(*) AS days FROM u WHERE NOT (s = 'ASIA' AND d IN (SELECT d FROM x WHERE NOT a)) GROUP BY 1, 2"""),
    "kept_trips": (kept_trips, "SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence, l_suppkey AS stop_id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0)"),
    "flex_pairs": (flex_pairs, "WITH g AS (SELECT l_orderkey AS trip_id, count(*) AS n, arg_min(l_suppkey, l_linenumber) AS a, arg_max(l_suppkey, l_linenumber) AS b, bool_and(l_returnflag <> 'R') AS p, min(l_linenumber) AS f, max(l_linenumber) AS l FROM lineitem GROUP BY 1) SELECT trip_id, a AS origin_zone, b AS destination_zone FROM g WHERE n = 2 AND p AND f = 1 AND l > 1"),
    "pruned_ways": (pruned_ways, "WITH k AS (SELECT s_suppkey AS s FROM supplier WHERE s_acctbal > 500), w AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), g AS (SELECT o FROM w LEFT JOIN k USING (s) GROUP BY 1 HAVING count(*) = count(k.s)) SELECT 'way' AS kind, o AS osmid FROM g UNION ALL SELECT DISTINCT 'node', s FROM w WHERE o IN (SELECT o FROM g)"),
    "bounded_places": (bounded_places, "WITH p AS (SELECT p_partkey, p_brand AS class, -105.0 + 0.001 * (p_partkey % 100) AS x FROM part) SELECT p_partkey, class FROM p WHERE x >= -104.9805 AND x + 0.002 <= -104.9205 AND class IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')"),
    "class_filters": (class_filters, "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_brand NOT IN ('Brand#11', 'Brand#22', 'Brand#33') ELSE true END AS kept FROM part"),
    "renumbered_edges": (renumbered_edges, "WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS i, min(l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT row_number() OVER (ORDER BY i) - 1 AS edge_id, i AS old_edge_id FROM e WHERE f <> 'R'"),
    "set_operations": (set_operations, "WITH s AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS k FROM supplier WHERE s_acctbal < 0), c AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS k FROM customer WHERE c_acctbal > 9900) SELECT 'intersect' AS op, k FROM (SELECT k FROM s INTERSECT SELECT k FROM c) UNION ALL SELECT 'union', k FROM (SELECT k FROM s UNION SELECT k FROM c) UNION ALL SELECT 'except', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c)"),
    "top_regions": (top_regions, "WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY 1) (SELECT 'largest' AS kind, * FROM n ORDER BY n DESC, c_nationkey LIMIT 3) UNION ALL (SELECT 'smallest', * FROM n ORDER BY n, c_nationkey LIMIT 3)"),
    "taxonomy_closure": (taxonomy_closure, "WITH RECURSIVE e AS (SELECT r_name AS child, NULL AS parent FROM region UNION ALL SELECT 'n:' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT n_name || '/' || c_mktsegment, 'n:' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), t AS (SELECT child AS category, child AS descendant FROM e UNION SELECT t.category, e.child FROM t JOIN e ON e.parent = t.descendant) SELECT * FROM t"),
    "activity_masks": (activity_masks, "SELECT l_orderkey, bool_or(l_returnflag IN ('N', 'R')) AS food, bool_or(l_returnflag IN ('A', 'R')) AS jobs FROM lineitem GROUP BY 1"),
    "leg_counts": (leg_counts, "WITH o AS (SELECT o_custkey, o_orderstatus AS s, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) SELECT o_custkey, count(*) AS legs, count(*) FILTER (s = 'F') AS legs_f, count(*) FILTER (s = 'O') AS legs_o FROM o WHERE b IS NULL OR b <> s GROUP BY 1"),
    "stop_times": (stop_times, "SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(o_orderkey % 100000), '%Y-%m-%d %H:%M:%S') AS at FROM orders"),
    "date_maps": (date_maps, """WITH a AS (SELECT DISTINCT o_orderpriority AS s, CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) = 5), t AS (SELECT * FROM (VALUES (DATE '1996-03-01'), (DATE '1997-07-04')) v(t)),
c AS (SELECT s, t, d, abs(date_diff('day', t, d)) AS w, CASE WHEN d = t THEN 0 WHEN dayofweek(d) = dayofweek(t) THEN 1 ELSE 2 END AS k FROM a CROSS JOIN t), p AS (SELECT s, t, arg_min(d, (k, w, d)) AS d FROM c WHERE w <= 60 GROUP BY 1, 2)
SELECT s AS service_id, string_agg(CAST(t AS VARCHAR) || '>' || CAST(d AS VARCHAR), ',' ORDER BY t) AS dates FROM p GROUP BY 1"""),
    "mapped_departures": (mapped_departures, """WITH s AS (SELECT user_id AS edge_id, date_trunc('second', ts) AS d FROM events WHERE event_type = 'purchase'),
t AS (SELECT *, d + to_days(CAST(CASE CAST(d AS DATE) WHEN DATE '2024-01-05' THEN 28 WHEN DATE '2024-01-06' THEN -7 ELSE 0 END AS INTEGER)) AS there FROM s)
SELECT edge_id, strftime(d, '%Y-%m-%d %H:%M:%S') AS departure, strftime(there, '%Y-%m-%d %H:%M:%S') AS there, strftime(d, '%Y-%m-%d %H:%M:%S') AS back,
 CAST(greatest(0, 1 + date_diff('day', greatest(DATE '2024-01-10', CAST(d AS DATE) - 3), least(DATE '2024-01-20', CAST(d AS DATE) + 3))) AS INTEGER) AS days FROM t"""),
    "route_windows": (route_windows, "WITH e AS (SELECT event_type, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS n, CASE WHEN user_id % 3 <> 0 THEN 28800 ELSE 0 END AS a, CASE WHEN user_id % 2 <> 0 THEN 64800 ELSE 86399 END AS b FROM events) SELECT event_type, count(*) AS n FROM e WHERE n >= a AND n < b GROUP BY 1"),
}
