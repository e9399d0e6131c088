"""Output rows: run parameters, nested values, bins, and where a trip ends."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isoreach.functions import geometry as geo, kernels
from isoreach.functions.ids import dotted_path
from isoreach.operators.bins import Binning
from isoreach.operators.spatial import points_in_rings
from isoreach.shipping import ship

#: Numbers of the 50 states and the capital district are those from 1 to 56 but these.
NO_STATES = (3, 7, 14, 43, 52)


def set_value(df: DataFrame, path: str, value: Column, overwrite: bool = False) -> DataFrame:
    """``df`` with a value at a dotted path of nested structs; parents are made where absent.

    A value that is there already is an error unless ``overwrite`` is set, and
    so is a path through something that is no struct.
    """
    dotted_path(path)
    names = path.split(".")

    def built(kind, column: Column | None, rest: list[str]) -> Column:
        name, *more = rest
        if kind is not None and not isinstance(kind, StructType):
            raise ValueError(f"{path} leads through a value")
        known = kind is not None and name in kind.fieldNames()
        if known and not more and not overwrite:
            raise ValueError(f"{path} has a value")
        inner = built(kind[name].dataType if known else None, column.getField(name) if known else None, more) if more else value
        return F.struct(inner.alias(name)) if column is None else column.withField(name, inner)

    if len(names) == 1 and path in df.columns and not overwrite:
        raise ValueError(f"{path} has a value")
    top, *more = names
    if not more:
        return df.withColumn(top, value)
    there = top in df.columns
    return df.withColumn(top, built(df.schema[top].dataType if there else None, F.col(top) if there else None, more))


def single_value(column: Column, path: str) -> Column:
    """The one value at a JSON path (with ``[*]`` for all of a list); none or several are an error."""
    found = F.get_json_object(column, path)
    if "[*]" in path:
        # a single match comes without brackets
        many = F.from_json(F.when(found.startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]"))), "array<string>")
        n = F.when(found.isNull(), 0).otherwise(F.size(many))
        found = F.get(many, F.lit(0))
    else:
        n = F.when(found.isNull(), 0).otherwise(1)
    return F.when(n == 1, found).otherwise(F.raise_error(F.concat(F.lit(f"{path}: "), n.cast("string"), F.lit(" values"))))


def scaffold(df: DataFrame, params: Mapping[str, str | float | Sequence[float]]) -> DataFrame:
    """``df`` with the run's parameters under ``info``, which must not be there yet."""
    for name, given in params.items():
        value = F.array(*[F.lit(x) for x in given]) if isinstance(given, (list, tuple)) else F.lit(given)
        df = set_value(df, f"info.{name}", value)
    return df


def scaffold_bins(df: DataFrame, binning: Binning) -> DataFrame:
    """``df`` with ``bin``: a map of every bin's key to its bounds, to be filled by later steps."""
    cells = [x for key, lo, hi in binning.intervals() for x in (F.lit(key), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))]
    return df.withColumn("bin", F.create_map(*cells))


def bin_list(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bin_key, lo, hi): the bins of scaffolded rows, in order of their upper bounds."""
    entries = F.array_sort(F.transform(F.map_entries("bin"), lambda e: F.struct(e["value"]["hi"].alias("hi"), e["value"]["lo"].alias("lo"), e["key"].alias("bin_key"))))
    return df.select(*keys, F.explode(entries).alias("b")).select(*keys, "b.bin_key", "b.lo", "b.hi")


def destination_points(tree: DataFrame, lines: DataFrame, how: str = "end", stride_m: float = 100.0) -> DataFrame:
    """(origin, vertex_id, x, y): where the incoming edge of every label ends, its points, or points along it.

    ``lines(edge_list_id, edge_id, line)``; ``how`` is end, all or stride.
    """
    line = F.col("line")
    points = {"end": F.slice(line, -1, 1), "all": line, "stride": geo.points_along(line, stride_m)}
    if how not in points:
        raise ValueError(f"unknown points {how!r}")
    met = tree.where(F.col("edge_id").isNotNull()).join(lines, ["edge_list_id", "edge_id"])
    return met.select("origin", "vertex_id", F.explode(points[how]).alias("p")).select("origin", "vertex_id", "p.x", "p.y")


def with_arrival_delay(tree: DataFrame, delays: DataFrame) -> DataFrame:
    """``tree`` with the delay of each destination and the cost of arriving there; it is not carried on.

    ``delays(vertex_id, delay)``; a place without one has none.
    """
    met = tree.join(delays.select("vertex_id", F.col("delay").alias("arrival_delay")), "vertex_id", "left").fillna(0.0, ["arrival_delay"])
    return met.withColumn("arrival_cost", F.col("cost") + F.col("arrival_delay"))


def scaled_exteriors(rows: DataFrame, key: str, meters: float) -> DataFrame:
    """(key, geometry) of polygons in WKT: the hull of each, scaled about its center.

    The hull grows by (r + meters) / r, r being the greatest great-circle
    distance of a corner from the hull's center; a shrinkage beyond it is an
    error.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["geometry"] = [kernels.encode("POLYGON", [kernels.scaled_hull(*kernels.decode(g), meters)]) for g in batch["geometry"]]
            yield batch

    return rows.select(key, "geometry").mapInPandas(run, f"`{key}` {kind}, geometry string")


def archives_in_extent(stops: DataFrame, extent: DataFrame, archive: str = "archive") -> DataFrame:
    """(archive) of those with any stop inside a ring: ``stops(archive, x, y)``, ``extent(ring_id, ring)``."""
    return points_in_rings(stops.select(archive, "x", "y"), extent, "ring_id").select(archive).distinct()


def study_region(spark: SparkSession, geoids: Sequence[str] | None = None) -> DataFrame:
    """(geoid) of a study region: the states of the nation, or those given (digits only)."""
    if geoids is None:
        geoids = [f"{n:02d}" for n in range(1, 57) if n not in NO_STATES]
    bad = [g for g in geoids if not g.isdigit()]
    if bad or not geoids:
        raise ValueError(f"not geoids: {bad}")
    return spark.createDataFrame([(g,) for g in dict.fromkeys(geoids)], "geoid string")


def zones_of_points(points: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """(key, geoid) of points in state polygons: ``zones(geoid, geometry)`` in WKT, the least geoid of several."""
    rings = zones.select("geoid", geo.from_wkt(F.col("geometry")).alias("ring"))
    return points_in_rings(points.select(key, "x", "y"), rings, "geoid").groupBy(key).agg(F.min("geoid").alias("geoid"))
