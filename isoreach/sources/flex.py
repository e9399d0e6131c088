"""On-demand zones: relations between zones and where trips may end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions.ids import window_contains, zone_id
from isoreach.operators.schedules import flex_pairs
from isoreach.operators.spatial import first_match


def relations(stop_times: DataFrame, trips: DataFrame, active: DataFrame, date: str) -> DataFrame:
    """(src_zone, dst_zone, start_s, end_s) of trips that run on a date.

    Trips have two stop times, picked up by phone at the first and dropped off
    by phone at the second; weekdays and exceptions of the calendar both count.
    """
    running = active.where(F.col("date") == F.lit(date).cast("date")).select("service_id")
    run = trips.join(running, "service_id", "left_semi")
    windows = stop_times.groupBy("trip_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    pairs = flex_pairs(stop_times).join(run, "trip_id").join(windows, "trip_id", "left")
    made = lambda place: zone_id(F.col("agency_id"), F.col("route_id"), F.col("trip_id"), F.col(place))
    return pairs.select(made("origin_zone").alias("src_zone"), made("destination_zone").alias("dst_zone"), "start_s", "end_s")


def zones_of(vertices: DataFrame, zones: DataFrame) -> DataFrame:
    """(vertex_id, zone_id): the least zone that holds each vertex."""
    return first_match(vertices, zones, "vertex_id", "zone_id")


def may_depart(vertex_zones: DataFrame, relation: DataFrame, now_s: Column) -> DataFrame:
    """Vertices whose zone starts a relation with an open window."""
    open_now = relation.where(window_contains(now_s, F.col("start_s"), F.col("end_s"))).select(F.col("src_zone").alias("zone_id")).distinct()
    return vertex_zones.join(open_now, "zone_id", "left_semi")


def may_alight(source: DataFrame, vertex_zones: DataFrame, relation: DataFrame) -> DataFrame:
    """(origin, vertex_id): places where a trip from each origin's zone may end.

    ``source(origin, zone_id)``; the time is not tested again.
    """
    pairs = relation.select(F.col("src_zone").alias("zone_id"), "dst_zone").distinct()
    reach = source.join(pairs, "zone_id").select("origin", F.col("dst_zone").alias("zone_id")).distinct()
    return reach.join(vertex_zones, "zone_id").select("origin", "vertex_id").distinct()
