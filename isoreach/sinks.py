"""Writers of networks, bundles, metrics, opportunity vectors and results."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoreach.functions.geometry import to_wkt
from isoreach.operators.modal import ModalNetwork, summary
from isoreach.scratch import Scratch
from isoreach.shipping import ship
from isoreach.sources import zipped
from isoreach.sources.pbf import opened


def network(vertices: DataFrame, edges: DataFrame, path: str, overwrite: bool = False) -> None:
    """Vertices and edges as Parquet, edges by list; an existing network stays unless overwritten."""
    mode = "overwrite" if overwrite else "ignore"
    vertices.write.mode(mode).parquet(f"{path}/vertices")
    edges.write.mode(mode).partitionBy("edge_list_id").parquet(f"{path}/edges")


def modal_network(network: ModalNetwork, path: str, source: Mapping[str, str] | None = None, ids: bool = True, overwrite: bool = False) -> None:
    """A network of several modes as zipped text: vertices beside one folder per mode, and a summary.

    A mode's folder has edges, geometries (WKT), speeds (miles an hour),
    classes, bearings and speed_mapping (mean by class, ``_global_`` for all);
    ``ids`` adds the segment and start of every edge and the connector of every
    vertex.  Rows carry their number, so that no table has to be sorted again:
    each is one narrow pass over the network's own.  ``summary`` is TOML: what
    ``source`` tells, then counts, miles and mean speeds.  Tables that exist
    stay unless overwritten.
    """
    mode = "overwrite" if overwrite else "ignore"

    def save(df: DataFrame, name: str) -> None:
        df.write.mode(mode).option("header", True).option("compression", "gzip").csv(f"{path}/{name}")

    save(network.vertices.select("vertex_id", "x", "y"), "vertices")
    if ids:
        save(network.vertices.select("vertex_id", "connector_id"), "vertex_connectors")
    parts = {
        "edges": ["edge_id", F.col("src").alias("src_vertex_id"), F.col("dst").alias("dst_vertex_id"), "distance"],
        "geometries": ["edge_id", to_wkt(F.col("geometry")).alias("geometry")],
        "speeds": ["edge_id", "mph"],
        "classes": ["edge_id", "class"],
        "bearings": ["edge_id", "bearing"],
    } | ({"segments": ["edge_id", "segment_id", F.col("start").alias("linear_reference")]} if ids else {})
    scratch = Scratch(network.edges.sparkSession, "stats")
    stats = scratch.table(summary(network), "stats")  # read twice
    scratch.sweep()
    for name in sorted(r["mode"] for r in stats.where("class is null").select("mode").collect()):  # one row a mode
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
            raise ValueError(f"not a folder name: {name!r}")
        own = network.edges.where(F.col("mode") == name)
        for part, columns in parts.items():
            save(own.select(*columns), f"{name}/{part}")
        save(network.speeds.where(F.col("mode") == name).select(F.coalesce("class", F.lit("_global_")).alias("class"), "mph"), f"{name}/speed_mapping")
    summary_lines(stats, network.vertices, source or {}).coalesce(1).sortWithinPartitions("at").select("value").write.mode(mode).text(f"{path}/summary")


def summary_lines(stats: DataFrame, vertices: DataFrame, source: Mapping[str, str]) -> DataFrame:
    """(at, value): lines of a TOML summary, one table per mode and class."""
    quoted = lambda v: F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)  # noqa: E731  a JSON string is a TOML string
    line = lambda key, value: F.concat(F.lit(f"{key} = "), value)
    names = F.concat(F.lit("[stats.edge_list."), quoted(F.col("mode")), F.when(F.col("class").isNull(), F.lit("]")).otherwise(F.concat(F.lit(".road_class_stats."), quoted(F.col("class")), F.lit("]"))))
    count = F.when(F.col("class").isNull(), line("edges", F.col("edges").cast("string"))).otherwise(line("count", F.col("edges").cast("string")))
    miles = F.when(F.col("class").isNull(), line("miles", F.col("miles").cast("string"))).otherwise(line("distance_miles", F.col("miles").cast("string")))
    table = F.filter(F.array(names, count, miles, line("avg_speed_mph", F.col("mph").cast("string"))), lambda v: v.isNotNull())
    body = stats.select(F.concat(F.lit("1"), F.col("mode"), F.lit("\u0001"), F.coalesce("class", F.lit(""))).alias("at"), F.array_join(table, "\n").alias("value"))
    told = [line(json.dumps(k), quoted(F.lit(v))) for k, v in source.items()]
    head = vertices.agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.lit("0").alias("at"), F.array_join(F.array(F.lit("[source]"), *told, F.lit("[stats]"), line("vertices", F.col("n"))), "\n").alias("value"))
    return head.unionByName(body)


def bundle(edges: DataFrame, schedules: DataFrame, mapping: DataFrame, path: str, overwrite: bool = True) -> None:
    """Edges, schedules and date mapping of one or more transit archives."""
    mode = "overwrite" if overwrite else "ignore"
    edges.write.mode(mode).partitionBy("edge_list_id").parquet(f"{path}/edges")
    schedules.write.mode(mode).parquet(f"{path}/schedules")
    mapping.write.mode(mode).parquet(f"{path}/date_mapping")


def archives(members: Mapping[str, DataFrame], path: str, archive: str = "archive") -> int:
    """Zipped transit archives, one per value of a column, with every member; the number written.

    Lines are sorted over all tasks; each task deflates its own in pieces, and
    a task per archive only copies them together, so that none sorts, holds or
    deflates an archive.  It writes under a hidden name until the archive is
    whole, so that a repeated task leaves the same archives.
    """
    names = list(members)
    headers = [[c for c in members[n].columns if c != archive] for n in names]
    spark = members[names[0]].sparkSession
    ship(spark)
    scratch = Scratch(spark, "archives")
    rows = lambda i: members[names[i]].select(F.col(archive).cast("string").alias("a"), F.lit(i).alias("m"), text_line(members[names[i]], headers[i]).alias("v"))
    ranged = reduce(DataFrame.unionByName, [rows(i) for i in range(len(names))]).repartitionByRange("a", "m", "v").sortWithinPartitions("a", "m", "v")
    schema = pa.schema([("a", pa.string()), ("m", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("text", pa.int64()), ("crc", pa.int64())])
    folder = f"{scratch.root}/deflated"

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        file, part, made, of, piece = f"{at}/{uuid.uuid4().hex}", TaskContext.get().partitionId(), [], None, zipped.Deflater()
        with fs.open_output_stream(file) as out:

            def end() -> None:
                if piece.text:
                    begin, data = out.tell(), piece.end()
                    out.write(data)
                    made.append((*of, part, len(made), file, begin, len(data), piece.text, piece.crc))

            for batch in batches:
                a, m, v = (batch.column(i) for i in range(3))
                v = v.cast(pa.large_binary())  # its values are one text
                (_, starts, values), first = v.buffers(), v.offset
                starts, values = np.frombuffer(starts, np.int64)[first : first + len(v) + 1], memoryview(values or b"")
                last = 0
                for stop in sorted({*pc.run_end_encode(a).run_ends.to_pylist(), *pc.run_end_encode(m).run_ends.to_pylist()}):
                    own = a[last].as_py(), m[last].as_py()
                    if own != of or piece.text >= zipped.PIECE_BYTES:
                        end()
                        of, piece = own, zipped.Deflater()
                    piece.add(values[starts[last] : starts[stop]])
                    last = stop
            end()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(schema)], schema=schema)

    deflated = scratch.table(ranged.mapInArrow(deflate, "a string, m int, part int, n int, file string, at long, size long, text long, crc long"), "pieces")
    found = deflated.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("m", "part", "n", "file", "at", "size", "text", "crc"))).alias("pieces"))  # in the order of their ranges
    dealt = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # by no key: by that of the groups no rows would be dealt anew, and few tasks would write all

    def copied(piece: zipped.Piece) -> Iterator[bytes]:
        fs, at = opened(piece.file)
        with fs.open_input_file(at) as raw:
            for i in range(0, piece.size, zipped.BLOCK_BYTES):
                yield raw.read_at(min(zipped.BLOCK_BYTES, piece.size - i), piece.at + i)

    def write(name: str, pieces: list[dict], fs: pafs.FileSystem, at: str) -> None:
        hidden = f"{at}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(hidden) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
            for m, member in enumerate(names):
                line = io.StringIO()
                csv.writer(line, lineterminator="\n").writerow(headers[m])
                head = zipped.Deflater()
                head.add(line.getvalue().encode())
                data = head.end()
                first = zipped.Piece("", 0, len(data), head.text, head.crc)
                own = [zipped.Piece(p["file"], p["at"], p["size"], p["text"], p["crc"]) for p in pieces if p["m"] == m]
                zipped.add_member(out, f"{member}.txt", [first, *own], lambda p: copied(p) if p.file else [data])
        fs.move(hidden, f"{at}/{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}.zip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(path)
        fs.create_dir(at, recursive=True)
        done = 0
        for row in (r for batch in batches for r in batch.to_pylist()):
            write(row["a"], row["pieces"], fs, at)
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    total = dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    scratch.drop("pieces", "deflated")
    return total


def text_line(df: DataFrame, columns: Sequence[str]) -> Column:
    """Columns as a line of comma-separated values, quoted where they must be; null as an empty value."""

    def value(field: T.StructField) -> Column:
        text = F.coalesce(F.col(field.name).cast("string"), F.lit(""))
        if isinstance(field.dataType, T.NumericType):
            return text
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in ',"\n\r']), quoted).otherwise(text)

    line = F.concat_ws(",", *[value(df.schema[c]) for c in columns])
    return F.concat(F.when(line == "", '""').otherwise(line) if len(columns) == 1 else line, F.lit("\n"))


def zones(relations: DataFrame, geometries: DataFrame, path: str) -> None:
    """Zone ids, relations and geometries of an on-demand service."""
    ids = relations.select(F.col("src_zone").alias("zone_id")).union(relations.select("dst_zone")).distinct()
    ids.write.mode("overwrite").parquet(f"{path}/zone_ids")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
    geometries.write.mode("overwrite").parquet(f"{path}/geometries")


def metrics(df: DataFrame, path: str) -> None:
    """Edge metrics, keyed by edge, with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def merged_metrics(left: DataFrame, right: DataFrame, key: str = "edge_id") -> DataFrame:
    """Two metric tables side by side; keys that do not match are an error."""
    out = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full")
    bad = F.col("_l").isNull() | F.col("_r").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unmatched edge "), F.col(key).cast("string"))).cast("int")).otherwise(1)
    return out.withColumn("_ok", checked).where("_ok = 1").drop("_l", "_r", "_ok")


def overlay(df: DataFrame, zone: str, path: str) -> None:
    """Result rows in one folder per zone, with names fit for files."""
    safe = F.regexp_replace(F.col(zone).cast("string"), r"[^A-Za-z0-9_.-]", "_")
    df.withColumn("overlay_id", safe).write.mode("overwrite").partitionBy("overlay_id").option("header", True).csv(path)


def results(df: DataFrame, path: str, columns: Mapping[str, str], form: str = "csv") -> None:
    """Chosen columns by dotted path as CSV, or whole rows as JSON lines."""
    if form == "json":
        df.write.mode("overwrite").json(path)
        return
    for dotted in columns.values():
        if not re.fullmatch(r"[A-Za-z_0-9]+(\.[A-Za-z_0-9]+)*", dotted):
            raise ValueError(f"not a dotted path: {dotted!r}")
    names = sorted(columns)
    df.select(*[F.col(columns[n]).alias(n) for n in names]).write.mode("overwrite").option("header", True).csv(path)


def opportunity_vectors(df: DataFrame, path: str) -> None:
    """One row per vertex, sorted inside its files."""
    df.repartitionByRange("vertex_id").sortWithinPartitions("vertex_id").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
