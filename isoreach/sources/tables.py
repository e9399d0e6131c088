"""Readers of segment archives, opportunity files, categories and delays."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from isoreach.functions.geometry import box_within, from_wkt
from isoreach.shipping import ship
from isoreach.sources.pbf import opened
from isoreach.sources.zipped import BATCH_ROWS, BLOCK_BYTES

SEGMENT_SCHEMA = (
    "id string, geometry binary, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, subtype string, class string, subclass string, "
    "connectors array<struct<connector_id:string,at:double>>, "
    "access_restrictions array<struct<access_type:string,when:struct<during:string,heading:string,using:array<string>,recognized:array<string>,mode:array<string>>>>, "
    "speed_limits array<struct<max_speed:struct<value:int,unit:string>,is_max_speed_variable:boolean,between:array<double>>>, "
    "subclass_rules array<struct<value:string,between:array<double>>>"
)
PLACE_SCHEMA = "id string, geometry binary, categories struct<primary:string,alternate:array<string>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, confidence double"


def latest_release(paths: Sequence[str]) -> str:
    """The newest of release folders named by date and number; ties by name."""
    found = [(m[1], p) for p in paths if (m := re.search(r"(\d{4}-\d{2}-\d{2})", p))]
    if not found:
        raise ValueError("no release found")
    return max(found)[1]


def segments(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Segment records; the bounding box reaches the scan as filters."""
    out = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    return out if bbox is None else out.where(box_within(F.col("bbox"), bbox))


def places(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Place records, optionally in a bounding box."""
    out = spark.read.schema(PLACE_SCHEMA).parquet(path)
    return out if bbox is None else out.where(box_within(F.col("bbox"), bbox))


def opportunity_file(spark: SparkSession, path: str, activities: Sequence[str], key: str = "vertex_id") -> DataFrame:
    """Wide opportunities with a header; a missing column or a bad number is an error."""
    out = spark.read.option("header", True).csv(path)
    absent = [a for a in activities if a not in out.columns]
    if absent:
        raise ValueError(f"columns missing in {path}: {absent}")
    return out.select(F.col(key).cast("long").alias(key), *[F.col(a).cast("double").alias(a) for a in activities])


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(label, category) of a file with one category a line; the label is the line number."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("label", "category"))


def time_delays(spark: SparkSession, path: str) -> DataFrame:
    """(zone_id, ring, time) of a file (geometry, time): a row per polygon; other geometries are an error."""
    rows = spark.read.option("header", True).schema("geometry string, time double").csv(path)
    kind = F.upper(F.regexp_extract("geometry", r"^\s*(\w+)", 1))
    bodies = F.split(F.regexp_replace("geometry", r"^\s*\w+\s*\(\s*\(\s*\(|\)\s*\)\s*\)\s*$", ""), r"\)\s*\)\s*,\s*\(\s*\(")
    parts = F.transform(bodies, lambda body: F.concat(F.lit("POLYGON(("), body, F.lit("))")))
    polygons = F.when(kind == "POLYGON", F.array("geometry")).when(kind == "MULTIPOLYGON", parts).otherwise(F.raise_error(F.lit("a delay zone is a polygon")))
    return rows.select(F.xxhash64("geometry").alias("zone_id"), F.explode(polygons).alias("polygon"), "time").select("zone_id", from_wkt(F.col("polygon")).alias("ring"), "time")


def modal_edges(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Edges of a file; rows that do not parse drop out."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(schema).csv(path)


def modal_tables(spark: SparkSession, path: str, mode: str, parts: Mapping[str, str]) -> DataFrame:
    """Tables of a mode of ``sinks.modal_network`` side by side, by edge: ``parts`` has the schema of each, ``edge_id`` first.

    The tables of a network are written in the same parts and order.  Only the
    names of their files are joined, by part; a task then reads the files of a
    part together, batch by batch, so that no row is shuffled.  Parts or rows
    that do not match are an error.
    """
    ship(spark)
    names = list(parts)
    schemas = [T.StructType.fromDDL(parts[n]) for n in names]
    types = [{f.name: f.type for f in to_arrow_schema(s)} for s in schemas]
    made = T.StructType([*schemas[0].fields, *[f for s in schemas[1:] for f in s.fields[1:]]])

    def files(name: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{mode}/{name}")
        return found.select(F.regexp_extract("path", r"part-(\d+)", 1).alias("part"), F.col("path").alias(name))

    def batches_of(file: str, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(file)
        with io.BufferedReader(fs.open_input_stream(at)) as stream:  # inflated by its name
            if not stream.peek(1):
                return
            convert = pcsv.ConvertOptions(column_types=columns, include_columns=list(columns), null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False)
            yield from pcsv.open_csv(stream, pcsv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES), pcsv.ParseOptions(escape_char="\\", double_quote=False, newlines_in_values=True), convert)

    def together(row: dict[str, str]) -> Iterator[pa.RecordBatch]:
        if None in row.values():
            raise ValueError(f"tables of {mode} are written in different parts: {row['part']}")
        streams = [batches_of(row[n], t) for n, t in zip(names, types)]
        held = [None] * len(streams)
        while True:
            for i, stream in enumerate(streams):
                while held[i] is not None and not held[i].num_rows or held[i] is None:
                    held[i] = next(stream, False)
                    if held[i] is False:
                        break
            if any(h is False for h in held):
                if not all(h is False for h in held):
                    raise ValueError(f"tables of {mode} differ in their rows: part {row['part']}")
                return
            n = min(h.num_rows for h in held)
            now = [h.slice(0, n) for h in held]
            held = [h.slice(n) for h in held]
            if not all(b.column(0).equals(now[0].column(0)) for b in now[1:]):
                raise ValueError(f"tables of {mode} differ in their edges: part {row['part']}")
            yield pa.RecordBatch.from_arrays([*now[0].columns, *[c for b in now[1:] for c in b.columns[1:]]], names=made.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for rows in together(row):
                    for i in range(0, rows.num_rows, BATCH_ROWS):
                        yield rows.slice(i, BATCH_ROWS)

    met = reduce(lambda a, b: a.join(b, "part", "full"), [files(n) for n in names])
    return met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, made)
