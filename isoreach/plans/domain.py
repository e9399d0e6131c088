"""The test tables as domain tables, in DataFrames and as SQL of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFTS = (1, 5, 20, 24)
ACTIVITIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
HIGHWAYS = ("residential", "primary", "motorway", "footway", "secondary", "living_street", "trunk_link")
CYCLEWAYS = ("track", "lane", "shared", "no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations on a five-by-five grid of lon/lat points."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("vertex_id"), (F.lit(-105.0) + 0.01 * (k % 5)).alias("x"), (F.lit(39.9) + 0.01 * F.floor(k / 5)).alias("y"))


def torus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred edges between nations with whole minutes from customer counts."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey").join(people, "n_nationkey", "left").fillna(0, ["n"])
    e = nation.withColumn("s", F.explode(F.array(*[F.lit(s) for s in SHIFTS])))
    minutes = 2 + (F.col("n") * 7 + F.col("s") * 3 + F.col("n_nationkey")) % 11
    return e.select(
        F.col("n_nationkey").cast("long").alias("src"),
        ((F.col("n_nationkey") + F.col("s")) % 25).cast("long").alias("dst"),
        F.lit(0).alias("edge_list_id"),
        (F.col("n_nationkey") * 100 + F.col("s")).cast("long").alias("edge_id"),
        F.when(F.col("s").isin(1, 24), "walk").otherwise("bike").alias("mode"),
        minutes.cast("double").alias("cost"),
        (minutes * 80).cast("double").alias("distance"),
    )


TORUS_SQL = """people AS (SELECT n_nationkey k, count(c_custkey) n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
torus AS (SELECT k AS src, (k + s) % 25 AS dst, k * 100 + s AS edge_id, CASE WHEN s IN (1, 24) THEN 'walk' ELSE 'bike' END AS mode,
  2 + ((n * 7 + s * 3 + k) % 11) AS mins FROM people, (VALUES (1), (5), (20), (24)) v(s))"""

TREE_SQL = (
    "WITH RECURSIVE "
    + TORUS_SQL
    + """,
paths AS (SELECT n_nationkey AS origin, n_nationkey AS vertex, CAST(0 AS BIGINT) AS cost FROM nation
  UNION SELECT p.origin, e.dst, p.cost + e.mins FROM paths p JOIN torus e ON e.src = p.vertex WHERE p.cost + e.mins < 40),
tree AS (SELECT origin, vertex, min(cost) AS cost FROM paths GROUP BY 1, 2),
dest AS (SELECT * FROM tree WHERE vertex <> origin),
opps AS (SELECT c_nationkey AS vertex, c_mktsegment AS activity, count(*) AS n FROM customer GROUP BY 1, 2)"""
)


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation and segment: (vertex_id, activity, count)."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("vertex_id"), F.col("c_mktsegment").alias("activity")).agg(F.count(F.lit(1)).cast("double").alias("count"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations that trade: (src, dst, n)."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = lines.select("l_orderkey", "l_suppkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    j = j.join(customer.select("c_custkey", "c_nationkey"), "c_custkey").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


TRADE_SQL = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers (even ids) to suppliers (odd ids): large returns of urgent orders."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()


RETURNS_SQL = "returned AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45 AND o_orderpriority = '1-URGENT')"


def tagged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tagged edges on a grid with centers 0.0001 degrees apart in x."""
    k = F.col("p_partkey")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("edge_id"),
        (F.lit(-105.0) + 0.0001 * (k % 50)).alias("x"),
        (F.lit(40.0) + 0.001 * F.floor(k / 50)).alias("y"),
        pick(HIGHWAYS, k % 7).alias("highway"),
        F.when(k % 3 == 0, pick(CYCLEWAYS, k % 4)).alias("cycleway"),
        F.when(k % 5 == 0, "both").alias("sidewalk"),
        F.when(k % 11 == 0, "sidewalk").alias("footway"),
        F.when(k % 4 == 0, "yes").otherwise("no").alias("oneway"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("mph"),
        F.when(k % 13 == 0, "traffic_signals").when(k % 17 == 0, "stop").alias("node_highway"),
        F.col("p_brand").alias("class"),
        F.col("p_retailprice").alias("length_m"),
    )


TAGGED_SQL = """tagged AS (SELECT p_partkey AS edge_id, -105.0 + 0.0001 * (p_partkey % 50) AS x, 40.0 + 0.001 * (p_partkey // 50) AS y,
  (['residential','primary','motorway','footway','secondary','living_street','trunk_link'])[1 + p_partkey % 7] AS highway,
  CASE WHEN p_partkey % 3 = 0 THEN (['track','lane','shared','no'])[1 + p_partkey % 4] END AS cycleway,
  CASE WHEN p_partkey % 5 = 0 THEN 'both' END AS sidewalk, CASE WHEN p_partkey % 11 = 0 THEN 'sidewalk' END AS footway,
  CASE WHEN p_partkey % 4 = 0 THEN 'yes' ELSE 'no' END AS oneway, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS mph,
  CASE WHEN p_partkey % 13 = 0 THEN 'traffic_signals' WHEN p_partkey % 17 = 0 THEN 'stop' END AS node_highway, p_brand AS class, p_retailprice AS length_m FROM part),
near AS (SELECT a.edge_id AS l, b.edge_id AS r, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM tagged a JOIN tagged b
  ON a.edge_id <> b.edge_id AND abs(a.y - b.y) < 0.0002 AND abs(a.x - b.x) < 0.0002 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.0001378)"""


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as departures: route = type, edge = user, arrival = departure plus the value in seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("edge_id"), F.col("event_type").alias("route"), F.date_trunc("second", "ts").alias("departure"), (F.date_trunc("second", "ts") + F.make_interval(secs=F.floor(F.abs("value")))).alias("arrival"))


SCHEDULES_SQL = "sched AS (SELECT user_id AS edge_id, event_type AS route, date_trunc('second', ts) AS departure, date_trunc('second', ts) + to_seconds(CAST(floor(abs(value)) AS BIGINT)) AS arrival FROM events)"
