"""Transit archives as tables, and the edges and schedules they make."""

from __future__ import annotations

import codecs
import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.functions.geometry import haversine
from isoreach.functions.ids import route_id, stop_timestamp
from isoreach.operators.schedules import date_mapping, pick_dates, stop_pairs, without_bad_stops
from isoreach.operators.spatial import nearest
from isoreach.shipping import ship
from isoreach.sources import zipped
from isoreach.sources.pbf import opened

MANIFEST_SCHEMA = "provider string, name string, municipality string, state_code string, country_code string, data_type string, url string"
SCHEDULE_SCHEMA = "edge_id long, fully_qualified_id string, src_departure_time timestamp_ntz, dst_arrival_time timestamp_ntz"

# The members of an archive, their columns that are read, and the members none may lack.
MEMBERS = {
    "agency": ("agency_id", "agency_name"),
    "stops": ("stop_id", "parent_station", "stop_lon", "stop_lat"),
    "routes": ("route_id", "agency_id"),
    "trips": ("trip_id", "route_id", "service_id", "shape_id"),
    "stop_times": ("trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "shapes": ("shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"),
}
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")


def read_archives(spark: SparkSession, path: str, member: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(archive, columns as text) of one member of every zipped archive at a path, folder or glob.

    A member that tells its pieces (``sinks.archives``) is dealt over tasks by
    them; any other is inflated by one task, as a stream of batches, so that no
    archive or member is ever held whole.  The archive is named by its file
    without ``.zip``.  Columns that an archive lacks and empty values are null;
    an optional member it lacks has no rows.
    """
    ship(spark)
    wanted = tuple(columns or MEMBERS[member])
    needed = member in REQUIRED
    schema = pa.schema([("path", pa.string()), ("inner", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("width", pa.int32()), ("at", pa.list_(pa.int32()))])

    def parts(file: str) -> list[tuple]:
        fs, place = opened(file)
        with fs.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
            inner = next((n for n in archive.namelist() if n.rsplit("/", 1)[-1] == f"{member}.txt"), None)
            if inner is None:
                if needed:
                    raise ValueError(f"{place.rsplit('/', 1)[-1].removesuffix('.zip')} has no {member}.txt")
                return []
            with archive.open(inner) as stream:
                header = [h.strip() for h in next(csv.reader(io.TextIOWrapper(stream, "utf-8-sig", newline="")), [])]
            at = [header.index(c) if c in header else -1 for c in wanted]
            told = zipped.pieces_of(raw, archive.getinfo(inner))
            return [(file, inner, *piece, len(header), at) for piece in told[1:]] if told else [(file, inner, -1, 0, 0, len(header), at)]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            rows = [row for file in found.column(0).to_pylist() for row in parts(file)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def columns_of(file: str, inner: str, offset: int, size: int, crc: int, width: int, at: list[int]) -> Iterator[list[pa.Array]]:
        fs, place = opened(file)
        with fs.open_input_file(place) as raw:
            if offset < 0:
                with zipfile.ZipFile(raw) as archive:
                    yield from zipped.parsed(lambda: archive.open(inner), width, at, True)
            else:
                text = zipped.inflated(raw.read_at(size, offset), crc)
                yield from zipped.parsed(lambda: io.BytesIO(text), 0 if text.startswith(codecs.BOM_UTF8) else width, at, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for row in found.to_pylist():
                name = row["path"].rsplit("/", 1)[-1].removesuffix(".zip")
                for made in columns_of(*row.values()):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(made[0])), *made], names=["archive", *wanted])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    dealt = files.mapInArrow(plan, "path string, inner string, offset long, size long, crc long, width int, at array<int>").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, ", ".join(f"`{c}` string" for c in ("archive", *wanted)))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One member of an extracted archive, all columns as text."""
    return spark.read.option("header", True).csv(f"{folder}/{name}.txt")


def manifest(spark: SparkSession, path: str, country: str | None = None, data_type: str | None = None) -> DataFrame:
    """Providers, optionally of one country and data type."""
    out = spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)
    if country is not None:
        out = out.where(F.col("country_code") == country)
    return out if data_type is None else out.where(F.col("data_type") == data_type)


def schedule_rows(spark: SparkSession, path: str) -> DataFrame:
    """A written schedule table as (edge_id, route, departure, arrival)."""
    s = spark.read.schema(SCHEDULE_SCHEMA).option("header", True).csv(path)
    return s.select("edge_id", F.col("fully_qualified_id").alias("route"), F.col("src_departure_time").alias("departure"), F.col("dst_arrival_time").alias("arrival"))


def seconds(text) -> F.Column:
    """Seconds of ``h:mm:ss``, which may pass 24 hours."""
    part = lambda i: F.get(F.split(F.col(text), ":"), F.lit(i)).try_cast("int")
    return part(0) * 3600 + part(1) * 60 + part(2)


def stop_places(stops: DataFrame) -> DataFrame:
    """(stop_id, x, y): own coordinates, else those of the parent station, one level up."""
    s = stops.select("stop_id", F.col("parent_station").alias("p"), F.col("stop_lon").cast("double").alias("x"), F.col("stop_lat").cast("double").alias("y"))
    parent = s.select(F.col("stop_id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"))
    return s.join(parent, "p", "left").select("stop_id", F.coalesce("x", "px").alias("x"), F.coalesce("y", "py").alias("y"))


def matched_stops(stops: DataFrame, vertices: DataFrame, tolerance_m: float, cell: float = 0.01) -> DataFrame:
    """(stop_id, vertex_id) of stops with a vertex within the tolerance."""
    places = stop_places(stops).where("x is not null and y is not null").select(F.col("stop_id").alias("l"), "x", "y")
    return nearest(places, vertices.select(F.col("vertex_id").alias("r"), "x", "y"), cell, meters=tolerance_m).select(F.col("l").alias("stop_id"), F.col("r").alias("vertex_id"))


def bundle(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, vertices: DataFrame, active: DataFrame, targets: DataFrame, edge_list_id: int = 0, tolerance_m: float = 500.0, missing: str = "drop", date_tolerance: int = 3650):
    """(edges, schedules, date mapping) of an archive for target dates.

    A stop that matches no vertex is an error or (``missing='drop'``) removes
    the trips that touch it.  One-sided times count for both; a stop without
    any is an error.  A trip without a date within the tolerance is skipped.
    """
    places = matched_stops(stops, vertices, tolerance_m)
    bad = stops.join(places, "stop_id", "left_anti").select("stop_id")
    times = stop_times.select("trip_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), "stop_id", seconds("arrival_time").alias("a"), seconds("departure_time").alias("d"))
    if missing == "fail":
        unknown = times.join(bad, "stop_id", "left_semi").limit(1).count()
        if unknown:
            raise ValueError("a stop matches no vertex within the tolerance")
    times = without_bad_stops(times, bad)
    none = F.col("a").isNull() & F.col("d").isNull()
    times = times.withColumn("arr", F.when(none, F.raise_error(F.concat(F.lit("no time at stop "), "stop_id")).cast("int")).otherwise(F.coalesce("a", "d"))).withColumn("dep", F.coalesce("d", "a"))
    pairs = stop_pairs(times.join(places, "stop_id"), carry=("vertex_id", "arr", "dep"))
    edges = pairs.select(F.col("src_vertex_id").alias("src"), F.col("dst_vertex_id").alias("dst")).distinct()
    edges = edges.withColumn("edge_list_id", F.lit(edge_list_id)).withColumn("edge_id", F.xxhash64("src", "dst"))
    at = vertices.select("vertex_id", "x", "y")
    edges = edges.join(at.toDF("src", "x1", "y1"), "src").join(at.toDF("dst", "x2", "y2"), "dst").withColumn("distance", haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).drop("x1", "y1", "x2", "y2")
    services = trips.select("service_id").distinct().join(targets, how="cross") if "service_id" not in targets.columns else targets
    picked = pick_dates(services, active, date_tolerance)
    routed = pairs.join(trips.select("trip_id", "route_id", "service_id", "agency_id"), "trip_id").join(picked, "service_id")
    routed = routed.withColumn("route", route_id(F.lit(edge_list_id), F.col("agency_id"), F.col("route_id"), F.col("service_id")))
    schedules = routed.join(edges.select(F.col("src").alias("src_vertex_id"), F.col("dst").alias("dst_vertex_id"), "edge_id"), ["src_vertex_id", "dst_vertex_id"])
    schedules = schedules.select("edge_id", "route", stop_timestamp(F.col("picked_date"), F.col("src_dep")).alias("departure"), stop_timestamp(F.col("picked_date"), F.col("dst_arr")).alias("arrival"))
    mapping = date_mapping(routed.select("route", "target_date", "picked_date").distinct(), "route")
    return edges, schedules, mapping


def shapes(rows: DataFrame) -> DataFrame:
    """(shape_id, geometry): points of a shape in sequence as a WKT line."""
    pts = F.transform(F.sort_array(F.collect_list(F.struct(F.col("shape_pt_sequence").cast("int").alias("i"), F.col("shape_pt_lon").alias("x"), F.col("shape_pt_lat").alias("y")))), lambda p: F.concat_ws(" ", p["x"], p["y"]))
    return rows.groupBy("shape_id").agg(F.concat(F.lit("LINESTRING("), F.array_join(pts, ","), F.lit(")")).alias("geometry"))
