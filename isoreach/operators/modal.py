"""Networks of several modes over shared vertices, from segment records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoreach.functions import geometry as geo
from isoreach.functions.tags import MPH_KPH
from isoreach.graph.numbering import numbered
from isoreach.operators import overture
from isoreach.scratch import Scratch

METERS_PER_MILE = 1609.344


@dataclass(frozen=True)
class Mode:
    """One edge list: its name, the segments it keeps (a column or its SQL), and what its travellers bring to restrictions."""

    name: str
    keep: Column | str
    query: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class ModalNetwork:
    """Shared vertices, the edges of all modes, and mean speeds by mode and class."""

    vertices: DataFrame
    edges: DataFrame
    speeds: DataFrame
    scratch: Scratch

    def drop(self) -> None:
        """Delete the tables of the edges and speeds, once nothing reads them any more."""
        self.scratch.drop(*self.scratch.tags)


def full_type(subtype: Column, klass: Column, subclass: Column, rules: Column, start: Column, end: Column) -> Column:
    """Subtype, class and subclass of a stretch, joined by a dash.

    A segment without a subclass takes the one of its first linear rule
    ``(between, value)`` that shares more than a point with the stretch.
    """
    meets = lambda r: overture.overlap(F.coalesce(r["between"]["lo"], F.lit(0.0)), F.coalesce(r["between"]["hi"], F.lit(1.0)), start, end) > 0
    return F.concat_ws("-", subtype, klass, F.coalesce(subclass, F.get(F.filter(rules, meets), F.lit(0))["value"]))


def travel(modes: Sequence[Mode]) -> Column:
    """Every mode and heading in which a segment is open: array of 2 i for the i-th mode forward, 2 i + 1 for it backward."""
    made = []
    for i, mode in enumerate(modes):
        keep = F.expr(mode.keep) if isinstance(mode.keep, str) else mode.keep
        for k, heading in enumerate(("forward", "backward")):
            is_open = F.coalesce(keep, F.lit(False)) & overture.heading_valid(F.col("access_restrictions"), heading, mode.query)
            made.append(F.when(is_open, F.lit(2 * i + k)))
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def mean_speeds(edges: DataFrame) -> DataFrame:
    """(mode, class, mph): length-weighted mean of the known speeds; class null for the whole mode.

    Neither a class nor a mode without any speed has a row.
    """
    weight = F.when(F.col("mph").isNotNull(), F.col("distance"))
    sums = edges.groupBy("mode", "class").agg(F.sum(weight * F.col("mph")).alias("_s"), F.sum(weight).alias("_w"))
    mean = F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0.0))
    return sums.rollup("mode", "class").agg(mean.alias("mph")).where("mode is not null and mph is not null")


def build(segments: DataFrame, connectors: DataFrame, modes: Sequence[Mode], islands: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> ModalNetwork:
    """The network of all modes.

    ``segments`` are those of ``overture.splits`` with ``subtype``, ``subclass``
    and ``subclass_rules``.  Edges are numbered from 0 in each mode, forward
    ones first, then by segment and start; vertices from 0 by connector.  A
    missing speed is the mean of its class in the mode, else that of the mode,
    else null.  ``islands(edges, vertices)`` names edges that go: means are
    taken before, and vertices of no edge left go with them; without it every
    connector is a vertex.  A stretch between two connectors is one row for all
    modes and headings, with the place of its edge in each; it gets its ends,
    is dealt and written as such, and edges are made from it when they are read.
    A connector that is not in the table is an error.
    """
    names = [m.name for m in modes]
    if len(set(names)) < len(names):
        raise ValueError(f"modes that repeat: {sorted(n for n in set(names) if names.count(n) > 1)}")
    klass = full_type(F.col("subtype"), F.col("class"), F.col("subclass"), F.col("subclass_rules"), F.col("start"), F.col("end"))
    parts = overture.stretches(segments, travel(modes), ["subtype", "subclass", "subclass_rules"])
    parts = parts.select(
        "travel",
        F.col("id").alias("segment_id"),
        "start",
        F.col("src_connector").alias("src"),
        F.col("dst_connector").alias("dst"),
        "distance",
        (F.col("kph") / MPH_KPH).alias("mph"),
        klass.alias("class"),
        "geometry",
    )
    scratch = Scratch(segments.sparkSession, "modal")
    parts = scratch.table(parts, "parts")
    by_mode = F.get(F.array(*[F.lit(n) for n in names]), F.floor(F.col("code") / 2).cast("int")).alias("mode")
    speeds = scratch.table(mean_speeds(parts.select(F.explode("travel").alias("code"), "class", "distance", "mph").select(by_mode, "class", "distance", "mph")), "speeds")
    at = connectors.select(F.col("connector_id").alias("vertex_id"), "x", "y")
    if islands is not None:
        order = [F.desc("heading"), "segment_id", "start"]
        edges = numbered(headed(parts, names), "_old", order, ["edge_list_id"])
        gone = islands(edges.withColumnRenamed("_old", "edge_id"), at).select("edge_list_id", F.col("edge_id").alias("_old"))
        edges = edges.join(gone, ["edge_list_id", "_old"], "left_anti")
        at = at.join(edges.select(F.col("src").alias("vertex_id")).union(edges.select("dst")).distinct(), "vertex_id", "left_semi")
    vertices = numbered(at.withColumnRenamed("vertex_id", "connector_id"), "vertex_id", ["connector_id"])
    if islands is not None:
        for end in ("src", "dst"):
            edges = met(edges, vertices, end)
        return ModalNetwork(vertices, filled(numbered(edges, "edge_id", ["_old"], ["edge_list_id"]).drop("_old"), speeds), speeds, scratch)
    last = "parts"
    for end in ("src", "dst"):  # written after each, so that the shuffle of one is gone before that of the next
        parts = scratch.table(met(parts, vertices, end), end)
        scratch.drop(last)
        scratch.sweep()
        last = end
    ranges = scratch.table(placed(parts, 2 * len(names)), "ranges")
    scratch.drop(last)
    scratch.sweep()
    sizes = ranges.select("_part", F.explode("travel").alias("code")).groupBy("_part", "code").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.floor(F.col("code") / 2)).orderBy("code", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(sizes.select("_part", "code", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    return ModalNetwork(vertices, filled(headed(ranges, names, offsets), speeds), speeds, scratch)


def met(rows: DataFrame, vertices: DataFrame, end: str) -> DataFrame:
    """``rows`` with the vertex of the connector ``end`` in its place; one that is not in the table is an error."""
    ids = vertices.select(F.col("connector_id").alias(end), F.col("vertex_id").alias("_id"))
    unknown = F.raise_error(F.concat(F.lit("unknown connector "), F.col(end))).cast("long")
    return rows.join(ids, end, "left").withColumn(end, F.when(F.col("_id").isNotNull(), F.col("_id")).otherwise(unknown)).drop("_id")


def placed(parts: DataFrame, codes: int) -> DataFrame:
    """Stretches dealt by ranges of segment and start and sorted in them, with their range and, as ``_place_c`` for every code of ``travel``, the place of their edge among those of its range."""
    ranged = parts.repartitionByRange("segment_id", "start").sortWithinPartitions("segment_id", "start")
    places = [f"_place_{c}" for c in range(codes)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * codes
        for batch in batches:
            lists = batch.column("travel")
            rows, found = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
            made = []
            for code in range(codes):
                own = rows[found == code]
                numbers, none = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
                numbers[own], none[own] = seen[code] + np.arange(len(own)), False
                seen[code] += len(own)
                made.append(pa.array(numbers, mask=none))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.repeat(pa.scalar(part, pa.int32()), batch.num_rows)], names=[*batch.schema.names, *places, "_part"])

    schema = T.StructType([*parts.schema.fields, *[T.StructField(p, T.LongType()) for p in places], T.StructField("_part", T.IntegerType())])
    return ranged.mapInArrow(place, schema).withColumns({"bearing": geo.exit_bearing(F.col("geometry")), "_back": geo.exit_bearing(F.reverse("geometry"))})


def headed(parts: DataFrame, names: Sequence[str], offsets: DataFrame | None = None) -> DataFrame:
    """Edges of all modes and headings from their stretches; numbered by place and ``offsets`` of ranges, if given."""
    made = []
    for code in range(2 * len(names)):
        back = code % 2 == 1
        line = F.reverse("geometry") if back else F.col("geometry")
        if offsets is None:
            rows, bearing, number = parts.where(F.array_contains("travel", code)), geo.exit_bearing(line), []
        else:
            before = F.broadcast(offsets.where(F.col("code") == code).drop("code"))  # one row a range
            rows, bearing = parts.where(F.col(f"_place_{code}").isNotNull()).join(before, "_part"), F.col("_back" if back else "bearing")
            number = [(F.col(f"_place_{code}") + F.col("_before")).alias("edge_id")]
        made.append(
            rows.select(
                F.lit(code // 2).alias("edge_list_id"),
                F.lit(names[code // 2]).alias("mode"),
                "segment_id",
                F.lit("backward" if back else "forward").alias("heading"),
                "start",
                F.col("dst" if back else "src").alias("src"),
                F.col("src" if back else "dst").alias("dst"),
                "distance",
                "mph",
                "class",
                bearing.alias("bearing"),
                line.alias("geometry"),
                *number,
            )
        )
    return reduce(DataFrame.unionByName, made)


def filled(edges: DataFrame, speeds: DataFrame) -> DataFrame:
    """``edges`` with missing speeds from their class in the mode, else from the mode."""
    by_class = speeds.where("class is not null").select("mode", "class", F.col("mph").alias("_class_mph"))
    by_mode = speeds.where("class is null").select("mode", F.col("mph").alias("_mode_mph"))
    out = edges.join(by_class, ["mode", "class"], "left").join(F.broadcast(by_mode), "mode", "left")  # one row a mode
    return out.withColumn("mph", F.coalesce("mph", "_class_mph", "_mode_mph")).drop("_class_mph", "_mode_mph")


def summary(network: ModalNetwork) -> DataFrame:
    """(mode, class, edges, miles, mph) by mode and class, class null for a whole mode.

    Counts and miles are of the edges left, speeds the means before islands went.
    """
    sums = network.edges.groupBy("mode", "class").agg(F.count(F.lit(1)).alias("_n"), F.sum("distance").alias("_m"))
    counts = sums.rollup("mode", "class").agg(F.sum("_n").alias("edges"), (F.sum("_m") / METERS_PER_MILE).alias("miles")).where("mode is not null")
    mean = network.speeds.select(F.col("mode").alias("_mode"), F.col("class").alias("_class"), "mph")
    return counts.join(mean, (F.col("mode") == F.col("_mode")) & F.col("class").eqNullSafe(F.col("_class")), "left").drop("_mode", "_class")
