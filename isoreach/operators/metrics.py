"""Edge metrics: neighbours, speeds, traffic stress and walking comfort.

Joins on edges are merged: few columns of many edges make a small file, and no
driver holds them for a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions import tags
from isoreach.operators.spatial import within_distance

#: Neighbours: edges whose centers lie within this many degrees.
NEIGHBOUR_DEGREES = 0.0001378


def neighbours(edges: DataFrame, radius: float = NEIGHBOUR_DEGREES) -> DataFrame:
    """(edge_id, other, distance) of edges with close centers, without the edge itself."""
    pairs = within_distance(edges.select(F.col("edge_id").alias("l"), "x", "y"), edges.select(F.col("edge_id").alias("r"), "x", "y"), radius)
    return pairs.where("l <> r").select(F.col("l").alias("edge_id"), F.col("r").alias("other"), "distance")


def neighbour_speed(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(edge_id, near_mph): distance-weighted speed of the neighbours that have one."""
    known = edges.where("mph is not null").select(F.col("edge_id").alias("other"), "mph")
    joined = near.join(known.hint("merge"), "other").groupBy("edge_id").agg(F.sum(F.col("mph") * F.col("distance")).alias("s"), F.sum("distance").alias("d"))
    return joined.where("d > 0").select("edge_id", (F.col("s") / F.col("d")).alias("near_mph"))


def stress(edges: DataFrame) -> DataFrame:
    """``edges`` with ``lts``, the level of traffic stress 1..4."""
    near = neighbour_speed(edges, neighbours(edges))
    level = tags.stress_level(F.col("highway"), F.col("cycleway"), F.col("oneway"), F.col("mph"), F.col("near_mph"))
    return edges.join(near.hint("merge"), "edge_id", "left").withColumn("lts", level).drop("near_mph")


def comfort(edges: DataFrame) -> DataFrame:
    """``edges`` with the walking comfort index and its parts.

    A cycling score from neighbours is their distance-weighted mean over all
    neighbours, cut to a whole number, and -2 if none has a tag.
    """
    near = neighbours(edges)
    own = edges.select(F.col("edge_id").alias("other"), tags.facility_comfort(tags.facility(F.col("cycleway"))).alias("score"), tags.is_sidewalk(F.col("sidewalk"), F.col("footway")).alias("side"))
    around = near.join(own.hint("merge"), "other").groupBy("edge_id").agg(
        F.count("score").alias("scored"),
        F.sum(F.coalesce("score", F.lit(0)) * F.col("distance")).alias("s"),
        F.sum("distance").alias("d"),
        F.bool_or("side").alias("near_side"),
    )
    mean = F.round(F.col("s") / F.col("d"), 9)
    near_cycle = F.when((F.col("scored") > 0) & (F.col("d") > 0), F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean))).otherwise(tags.NO_FACILITY_FOUND)
    out = edges.join(neighbour_speed(edges, near).hint("merge"), "edge_id", "left").join(around.withColumn("has", F.lit(True)).hint("merge"), "edge_id", "left")
    side, foot = tags.is_sidewalk(F.col("sidewalk"), F.col("footway")), tags.is_footway(F.col("footway"))
    eligible = tags.is_walkable(F.col("highway"), F.col("sidewalk"), F.col("footway")) | F.coalesce("near_side", F.lit(False))
    speed = tags.speed_comfort(F.coalesce("mph", "near_mph"))
    cycle = F.coalesce(tags.facility_comfort(tags.facility(F.col("cycleway"))), F.when(F.col("has"), near_cycle), F.lit(tags.NO_FACILITY_FOUND)).cast("int")
    signal = tags.signal_comfort(F.col("node_highway")).cast("int")
    out = out.withColumn("wci_speed", speed).withColumn("wci_cycle", cycle).withColumn("wci_signal", signal)
    total = tags.walking_comfort(eligible, foot, side, F.coalesce("has", F.lit(False)), F.col("wci_speed"), F.col("wci_cycle"), F.col("wci_signal"))
    return out.withColumn("wci", total).drop("near_mph", "scored", "s", "d", "near_side", "has")


def mean_speed() -> Column:
    """Length-weighted mean speed in km/h; missing speeds have no weight, without any it is null."""
    weight = F.when(F.col("mph").isNotNull(), F.col("length_m"))
    return F.sum(F.col("length_m") * F.col("mph")) / F.nullif(F.sum(weight), F.lit(0.0)) * tags.MPH_KPH


def class_speeds(edges: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """(keys, kph, total): mean speed by class, and one row with ``total`` set over all edges.

    ``keys`` can be several (subtype, class, subclass).  A class without any
    speed has a null mean; ``total`` tells the global row from a null class.
    """
    by_class = edges.groupBy(*keys).agg(mean_speed().alias("kph")).withColumn("total", F.lit(False))
    overall = edges.agg(mean_speed().alias("kph")).select(*[F.lit(None).cast(edges.schema[k].dataType).alias(k) for k in keys], "kph", F.lit(True).alias("total"))
    return by_class.unionByName(overall)


def global_speed(edges: DataFrame) -> DataFrame:
    """(kph): the mean speed over all edges; an error where no edge has a speed."""
    made = edges.agg(mean_speed().alias("kph"))
    return made.select(F.when(F.col("kph").isNotNull(), F.col("kph")).otherwise(F.raise_error(F.lit("no edge has a speed")).cast("double")).alias("kph"))


def fill_speeds(edges: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """``edges`` with ``speed`` in km/h: own, else the class mean, else the global mean."""
    means = edges.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(mean_speed().alias("_c"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = edges.join(means, same, "left").drop(*[f"_{k}" for k in keys])
    overall = edges.agg(mean_speed().alias("_g"))  # one row
    return out.crossJoin(F.broadcast(overall)).withColumn("speed", F.coalesce(F.col("mph") * tags.MPH_KPH, "_c", "_g")).drop("_c", "_g")


def summary(edges: DataFrame) -> DataFrame:
    """Edges, length and mean speed by class; the totals have ``total`` set."""
    made = [F.count(F.lit(1)).alias("edges"), F.sum("length_m").alias("length_m"), mean_speed().alias("kph")]
    return edges.rollup("class").agg(*made, (F.grouping("class") == 1).alias("total"))
