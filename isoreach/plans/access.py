"""Access queries: search, bins, opportunities."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach.graph.components import components
from isoreach.graph.islands import filter_components
from isoreach.graph.search import Constraints, reach
from isoreach.operators import bins, opportunities as opp
from isoreach.plans.domain import ACTIVITIES, RETURNS_SQL, TORUS_SQL, TRADE_SQL, TREE_SQL, opportunities, returns, table, torus, trade

BINNING = bins.Binning("cost", (10, 20, 30, 40))
MARGINAL = bins.Binning("cost", (10, 20, 30, 40), marginal=True, prepend_zero=True)


def _tree(spark, sf_dir):
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))
    return reach(origins, torus(spark, sf_dir), Constraints(cost=40.0))


def tree_costs(spark, sf_dir):
    """Cost of every destination below the largest bin."""
    return bins.destinations(_tree(spark, sf_dir)).where("cost < 40").select("origin", "vertex_id", F.col("cost").cast("long").alias("cost"))


def access_aggregate(spark, sf_dir):
    """Opportunities by origin, cumulative bin and activity, zero-filled."""
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))
    found = opp.aggregate(bins.destinations(_tree(spark, sf_dir)), opportunities(spark, sf_dir), BINNING)
    return opp.zero_filled(found, origins, BINNING, ACTIVITIES).select("origin", "bin_key", "activity", F.col("opportunities").cast("long").alias("opportunities"))


def access_marginal(spark, sf_dir):
    """The same in marginal bins, only where something is reached."""
    found = opp.aggregate(bins.destinations(_tree(spark, sf_dir)), opportunities(spark, sf_dir), MARGINAL)
    return found.select("origin", "bin_key", "activity", F.col("opportunities").cast("long").alias("opportunities"))


def access_wide(spark, sf_dir):
    """One row per origin with a column for each activity in the largest bin."""
    long = access_aggregate(spark, sf_dir).where("bin_key = '40'")
    wide = long.groupBy("origin").pivot("activity", list(ACTIVITIES)).agg(F.first("opportunities"))
    return wide.select("origin", *[F.col(a).alias(f"opps_{a.lower()}_40") for a in ACTIVITIES])


def access_disaggregate(spark, sf_dir):
    """Opportunities of every reached destination, by bin, as a text of the map."""
    found = opp.disaggregate(bins.destinations(_tree(spark, sf_dir)), opportunities(spark, sf_dir), BINNING)
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("long").cast("string"))), ",")
    return found.select("origin", "bin_key", "vertex_id", text.alias("counts"))


def bin_destinations(spark, sf_dir):
    """Number of destinations by origin and cumulative bin."""
    reached = bins.explode_bins(bins.destinations(_tree(spark, sf_dir)), BINNING)
    return reached.groupBy("origin", "bin_key").agg(F.count_distinct("vertex_id").alias("n_destinations"))


def filtered_destinations(spark, sf_dir):
    """Destinations with a boolean feature set and another unset."""
    tree = bins.destinations(_tree(spark, sf_dir)).where("cost < 40").withColumn("even", F.col("vertex_id") % 2 == 0).withColumn("far", F.col("cost") > 20)
    return bins.destination_filter(tree, [("even", False), ("far", True)]).select("origin", "vertex_id")


def walk_only(spark, sf_dir):
    """Costs with one allowed mode."""
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))
    tree = reach(origins, torus(spark, sf_dir), Constraints(cost=40.0, modes=frozenset(["walk"])))
    return bins.destinations(tree).where("cost < 40").select("origin", "vertex_id", F.col("cost").cast("long").alias("cost"))


def two_legs(spark, sf_dir):
    """Costs by mode sequence with at most two legs: a walk, then a ride."""
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))
    limits = Constraints(cost=25.0, max_legs=2, sequences=(("walk", "bike"),))
    return bins.destinations(reach(origins, torus(spark, sf_dir), limits, by_mode=True)).where("cost < 25").select("origin", "vertex_id", "mode_seq", F.col("cost").cast("long").alias("cost"))


def activity_totals(spark, sf_dir):
    """Total of every activity; a zero total would be an error."""
    return opp.totals(opportunities(spark, sf_dir)).select("activity", F.col("total").cast("long").alias("total"))


def weak_components(spark, sf_dir):
    """Weakly connected components of customers and suppliers by large returns of urgent orders."""
    return components(returns(spark, sf_dir)).select(F.col("node").alias("vertex_id"), "component")


def largest_component(spark, sf_dir):
    """Nodes of the largest of those components."""
    labels = weak_components(spark, sf_dir).withColumnRenamed("vertex_id", "node")
    return filter_components(labels, "largest").select(F.col("node").alias("vertex_id"), "component")


def trade_degrees(spark, sf_dir):
    """Degrees and neighbours of the trade network."""
    from isoreach.graph.contraction import degrees

    return degrees(trade(spark, sf_dir)).select(F.col("node").alias("vertex_id"), "in_degree", "out_degree", "neighbours")


BIN_SQL = "bins AS (SELECT * FROM (VALUES ('10', 0, 10), ('20', 0, 20), ('30', 0, 30), ('40', 0, 40)) b(bin_key, lo, hi))"
MARGINAL_SQL = "bins AS (SELECT * FROM (VALUES ('10', 0, 10), ('20', 10, 20), ('30', 20, 30), ('40', 30, 40)) b(bin_key, lo, hi))"
SUM_SQL = "agg AS (SELECT origin, bin_key, activity, CAST(sum(n) AS BIGINT) AS opportunities FROM dest JOIN bins ON cost >= lo AND cost < hi JOIN opps USING (vertex) GROUP BY 1, 2, 3)"
FILLED_SQL = f"""{TREE_SQL}, {BIN_SQL}, {SUM_SQL},
filled AS (SELECT CAST(n_nationkey AS BIGINT) AS origin, bin_key, activity, coalesce(opportunities, 0) AS opportunities FROM nation CROSS JOIN bins
  CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) a(activity)
  LEFT JOIN (SELECT origin AS n_nationkey, bin_key, activity, opportunities FROM agg) USING (n_nationkey, bin_key, activity))"""
WCC_SQL = f"""WITH RECURSIVE {RETURNS_SQL},
u AS (SELECT src AS a, dst AS b FROM returned UNION SELECT dst, src FROM returned), r AS (SELECT a, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a),
comp AS (SELECT CAST(a AS BIGINT) AS vertex_id, CAST(min(c) AS BIGINT) AS component FROM r GROUP BY 1)"""

QUERIES = {
    "access_aggregate": (access_aggregate, f"{FILLED_SQL} SELECT origin, bin_key, activity, opportunities FROM filled"),
    "access_marginal": (access_marginal, f"{TREE_SQL}, {MARGINAL_SQL}, {SUM_SQL} SELECT CAST(origin AS BIGINT) AS origin, bin_key, activity, opportunities FROM agg"),
    "access_wide": (access_wide, f"{FILLED_SQL} SELECT origin, " + ", ".join(f"max(CASE WHEN activity = '{a}' THEN opportunities END) AS opps_{a.lower()}_40" for a in ACTIVITIES) + " FROM filled WHERE bin_key = '40' GROUP BY origin"),
    "access_disaggregate": (access_disaggregate, f"{TREE_SQL}, {BIN_SQL} SELECT CAST(origin AS BIGINT) AS origin, bin_key, CAST(vertex AS BIGINT) AS vertex_id, string_agg(activity || '=' || n, ',' ORDER BY activity) AS counts FROM dest JOIN bins ON cost >= lo AND cost < hi JOIN opps USING (vertex) GROUP BY 1, 2, 3"),
    "tree_costs": (tree_costs, f"{TREE_SQL} SELECT CAST(origin AS BIGINT) AS origin, CAST(vertex AS BIGINT) AS vertex_id, cost FROM dest"),
    "bin_destinations": (bin_destinations, f"{TREE_SQL}, {BIN_SQL} SELECT CAST(origin AS BIGINT) AS origin, bin_key, count(DISTINCT vertex) AS n_destinations FROM dest JOIN bins ON cost >= lo AND cost < hi GROUP BY 1, 2"),
    "filtered_destinations": (filtered_destinations, f"{TREE_SQL} SELECT CAST(origin AS BIGINT) AS origin, CAST(vertex AS BIGINT) AS vertex_id FROM dest WHERE vertex % 2 = 0 AND cost <= 20"),
    "walk_only": (walk_only, f"""WITH RECURSIVE {TORUS_SQL}, p AS (SELECT n_nationkey AS origin, n_nationkey AS vertex, CAST(0 AS BIGINT) AS cost FROM nation
  UNION SELECT p.origin, e.dst, p.cost + e.mins FROM p JOIN torus e ON e.src = p.vertex AND e.mode = 'walk' WHERE p.cost + e.mins < 40)
  SELECT CAST(origin AS BIGINT) AS origin, CAST(vertex AS BIGINT) AS vertex_id, min(cost) AS cost FROM p WHERE vertex <> origin GROUP BY 1, 2"""),
    "two_legs": (two_legs, f"""WITH RECURSIVE {TORUS_SQL}, p AS (SELECT n_nationkey AS origin, n_nationkey AS vertex, '' AS seq, CAST(0 AS BIGINT) AS cost FROM nation
  UNION SELECT p.origin, e.dst, CASE WHEN seq = '' THEN e.mode WHEN seq = e.mode OR seq LIKE '%-' || e.mode THEN seq ELSE seq || '-' || e.mode END, p.cost + e.mins FROM p JOIN torus e ON e.src = p.vertex
  WHERE p.cost + e.mins < 25 AND (e.mode = 'bike' OR seq IN ('', 'walk')))
  SELECT CAST(origin AS BIGINT) AS origin, CAST(vertex AS BIGINT) AS vertex_id, seq AS mode_seq, min(cost) AS cost FROM p WHERE seq <> '' GROUP BY 1, 2, 3"""),
    "activity_totals": (activity_totals, "SELECT c_mktsegment AS activity, count(*) AS total FROM customer GROUP BY 1"),
    "weak_components": (weak_components, f"{WCC_SQL} SELECT * FROM comp"),
    "largest_component": (largest_component, f"{WCC_SQL} SELECT * FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)"),
    "trade_degrees": (trade_degrees, f"WITH {TRADE_SQL}, x AS (SELECT src AS v, dst AS o, 0 AS i, 1 AS u FROM trade UNION ALL SELECT dst, src, 1, 0 FROM trade) SELECT CAST(v AS BIGINT) AS vertex_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(u) AS BIGINT) AS out_degree, count(DISTINCT o) AS neighbours FROM x GROUP BY 1"),
}
