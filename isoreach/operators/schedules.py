"""Scheduled transit: departures, calendars, date picking and archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_departures(schedules: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows that do not arrive before they depart, in a departure range (inclusive)."""
    out = schedules.where(F.col("departure") <= F.col("arrival"))
    if start is not None:
        out = out.where(F.col("departure").between(start, end))
    return out


def next_departure(queries: DataFrame, schedules: DataFrame, bucket_seconds: int = 21600) -> DataFrame:
    """Per query (query_id, edge_id, now) the departure at or after ``now`` that arrives first.

    An as-of join: schedules fall into time buckets; a query looks into its own
    bucket, and its edge's best departure of all later buckets comes from a
    running minimum over bucket minima.  Ties: earliest departure, then route.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    ride = F.struct("arrival", "departure", "route")
    s = schedules.withColumn("b", bucket(F.col("departure")))
    later = Window.partitionBy("edge_id").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = s.groupBy("edge_id", "b").agg(F.min(ride).alias("ride")).withColumn("ride", F.min("ride").over(later))
    previous = best.withColumn("after", F.lag("b").over(Window.partitionBy("edge_id").orderBy("b")))
    q = queries.withColumn("b", bucket(F.col("now")))
    own = q.join(s.select("edge_id", "b", "arrival", "departure", "route"), ["edge_id", "b"]).where("departure >= now").groupBy("query_id").agg(F.min(ride).alias("own"))
    # the first bucket after the query's own holds the best of all later ones
    rest = q.alias("q").join(previous.alias("p"), (F.col("q.edge_id") == F.col("p.edge_id")) & (F.col("p.b") > F.col("q.b")) & (F.coalesce(F.col("p.after"), F.lit(-(1 << 60))) <= F.col("q.b")))
    rest = rest.select("q.query_id", F.col("p.ride").alias("rest"))
    out = q.join(own, "query_id", "left").join(rest, "query_id", "left")
    chosen = F.when(F.col("rest").isNull() | (F.col("own.arrival") < F.col("rest.arrival")) | ((F.col("own.arrival") == F.col("rest.arrival")) & (F.col("own.departure") <= F.col("rest.departure"))), F.col("own")).otherwise(F.col("rest"))
    return out.withColumn("ride", chosen).select("query_id", "edge_id", "now", F.col("ride.route").alias("route"), F.col("ride.departure").alias("departure"), F.col("ride.arrival").alias("arrival"))


def wait_and_ride(rows: DataFrame) -> DataFrame:
    """Seconds of waiting and riding; null without a departure."""
    seconds = lambda a, b: F.unix_timestamp(b) - F.unix_timestamp(a)
    return rows.withColumn("wait_s", seconds("now", "departure")).withColumn("ride_s", seconds("departure", "arrival"))


def stop_pairs(stop_times: DataFrame, trip: str = "trip_id", order: str = "stop_sequence", carry: tuple[str, ...] = ("stop_id",)) -> DataFrame:
    """Consecutive stops of every trip: columns ``src_*`` and ``dst_*``.

    Trips are dealt by a number of partitions: partitions that may be merged
    end as few as there are cores, and one task sorts more as the input grows.
    """
    w = Window.partitionBy(trip).orderBy(order)
    dealt = stop_times.repartition(int(stop_times.sparkSession.conf.get("spark.sql.shuffle.partitions")), trip)
    out = dealt.select(trip, F.col(order).alias("leg"), *[F.col(c).alias(f"src_{c}") for c in carry], *[F.lead(c).over(w).alias(f"dst_{c}") for c in carry], F.lead(order).over(w).alias("_next"))
    return out.where("_next is not null").drop("_next")


def archive_summary(stop_times: DataFrame, trip: str = "trip_id", order: str = "stop_sequence", stop: str = "stop_id") -> DataFrame:
    """Trips, legs and distinct legs per trip, over trips with two stops or more."""
    legs = stop_pairs(stop_times, trip, order, (stop,))
    per = legs.groupBy(trip).agg(F.count(F.lit(1)).alias("legs"), F.count_distinct(f"src_{stop}", f"dst_{stop}").alias("unique_legs"))
    return per.agg(F.count(F.lit(1)).alias("trips"), F.sum("legs").alias("legs"), F.sum("unique_legs").alias("unique_legs"))


def archive_summaries(stop_times: DataFrame, trips: DataFrame, shapes: DataFrame, archive: str = "archive") -> DataFrame:
    """Per archive its trips, shapes, legs, distinct legs per trip, and the trips with a known shape.

    Trips with fewer than two stops have no legs and count for no shape;
    ``coverage`` is the share of all trips that have a known shape (0 without trips).
    """
    legs = stop_pairs(stop_times.withColumn("_t", F.struct(archive, "trip_id")).withColumn("stop_sequence", F.col("stop_sequence").cast("int")), "_t", "stop_sequence", ("stop_id",))
    per = legs.groupBy("_t").agg(F.count(F.lit(1)).alias("legs"), F.count_distinct("src_stop_id", "dst_stop_id").alias("unique_legs")).select(F.col(f"_t.{archive}").alias(archive), F.col("_t.trip_id").alias("trip_id"), "legs", "unique_legs")
    known = shapes.select(archive, "shape_id").distinct().withColumn("_known", F.lit(1))
    # merged, as the size of zipped text tells nothing of its rows; by shape before shapes are met, as many trips share one
    each = trips.select(archive, "trip_id", "shape_id").dropDuplicates([archive, "trip_id"]).join(per.hint("merge"), [archive, "trip_id"], "left")
    sums = [F.count(F.lit(1)).alias("trips"), F.sum("legs").alias("legs"), F.sum("unique_legs").alias("unique_legs"), F.count("legs").alias("shaped")]
    each = each.groupBy(archive, "shape_id").agg(*sums).join(known.hint("merge"), [archive, "shape_id"], "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = each.groupBy(archive).agg(count("trips").alias("trips"), count("legs").alias("legs"), count("unique_legs").alias("unique_legs"), count(F.when(F.col("_known").isNotNull(), F.col("shaped"))).alias("shaped"))
    out = out.join(known.groupBy(archive).agg(F.count(F.lit(1)).alias("shapes")), archive, "full").fillna(0, ["trips", "legs", "unique_legs", "shaped", "shapes"])
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("shaped"), F.col("trips")), F.lit(0.0)))


def checked_routes(schedules: DataFrame, routes: DataFrame) -> DataFrame:
    """Schedule rows whose route is known; an unknown one is an error: ``routes(route)``."""
    met = schedules.join(routes.select("route").distinct().withColumn("_known", F.lit(1)), "route", "left")
    test = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown route "), F.coalesce("route", F.lit("null")))).cast("int")).otherwise(1)
    return met.where(test == 1).select(schedules.columns)


def checked_edges(schedules: DataFrame, edge_ids: int) -> DataFrame:
    """Schedule rows of edges 0 to ``edge_ids - 1``, each of which must have some; a gap or another id is an error."""
    found = schedules.agg(F.count_distinct("edge_id").alias("n"), F.min("edge_id").alias("lo"), F.max("edge_id").alias("hi")).first()
    if (found["n"], found["lo"] or 0, found["hi"] if found["n"] else -1) != (edge_ids, 0, edge_ids - 1):
        raise ValueError(f"edge ids are not dense: {found['n']} ids from {found['lo']} to {found['hi']} for {edge_ids} edges")
    return schedules


def active_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, date): calendar days on their weekdays, plus added, minus deleted dates."""
    days = F.explode(F.sequence("start_date", "end_date"))
    flags = F.array("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
    regular = calendar.withColumn("date", days).where(F.get(flags, F.dayofweek("date") - 1)).select("service_id", "date")
    added = exceptions.where("exception_type = 'Added'").select("service_id", "date")
    deleted = exceptions.where("exception_type = 'Deleted'").select("service_id", "date")
    return regular.unionByName(added).distinct().join(deleted, ["service_id", "date"], "left_anti")


def pick_dates(targets: DataFrame, active: DataFrame, tolerance: int = 3650) -> DataFrame:
    """(service_id, target_date, picked_date): exact, else nearest of the same weekday, else nearest.

    ``targets(service_id, target_date)``; only dates within ``tolerance`` days
    count; nearer first, the earlier of equals.  A service without any such
    date is skipped.
    """
    both = targets.join(active, "service_id").withColumn("away", F.abs(F.date_diff("date", "target_date"))).where(F.col("away") <= tolerance)
    same = F.dayofweek("date") == F.dayofweek("target_date")
    order = F.struct(F.when(F.col("away") == 0, 0).when(same, 1).otherwise(2).alias("step"), F.col("away"), F.col("date"))
    return both.groupBy("service_id", "target_date").agg(F.min(order).alias("m")).select("service_id", "target_date", F.col("m.date").alias("picked_date"))


def date_mapping(picked: DataFrame, route: str = "service_id") -> DataFrame:
    """Per route the map of target to picked dates."""
    return picked.groupBy(route).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("target_date", "picked_date")))).alias("dates"))


def within_time_of_day(departure: Column, arrival: Column, start: int, end: int) -> Column:
    """Both seconds of the day in ``[start, end]``; missing times pass, later days fail."""
    ok = lambda c: F.when(c.isNull(), True).otherwise((c >= start) & (c <= end) & (c < 86400))
    return ok(departure) & ok(arrival)


def without_bad_stops(stop_times: DataFrame, bad: DataFrame) -> DataFrame:
    """Stop times of the trips that touch no bad stop."""
    trips = stop_times.join(bad, "stop_id", "left_semi").select("trip_id").distinct()
    return stop_times.join(trips, "trip_id", "left_anti")


def flex_pairs(stop_times: DataFrame, by_phone: int = 2, none: int = 1) -> DataFrame:
    """Trips of exactly two stop times: pick-up by phone first, drop-off by phone last."""
    per = stop_times.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("stop_sequence", "stop_id", "pickup_type", "drop_off_type")).alias("src"), F.max(F.struct("stop_sequence", "stop_id", "pickup_type", "drop_off_type")).alias("dst"))
    ok = (F.col("n") == 2) & (F.col("src.pickup_type") == by_phone) & (F.col("src.drop_off_type") == none) & (F.col("dst.pickup_type") == none) & (F.col("dst.drop_off_type") == by_phone)
    return per.where(ok).select("trip_id", F.col("src.stop_id").alias("origin_zone"), F.col("dst.stop_id").alias("destination_zone"))
