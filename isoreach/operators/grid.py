"""Query grids over a study area and their population."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.functions import kernels
from isoreach.operators.spatial import cell_of
from isoreach.shipping import ship

SCHEMA = "grid_id string, origin_x double, origin_y double, geometry string"


def validate(query: Mapping) -> str:
    """Kind of a query's place: extent or point; any other mix of keys is an error."""
    extent, x, y = ("extent" in query), ("origin_x" in query), ("origin_y" in query)
    if extent and not x and not y:
        return "extent"
    if x and y and not extent:
        return "point"
    raise ValueError("a query has an extent or both origin_x and origin_y")


def square_cell(ring: np.ndarray, i: int, j: int, size: float) -> tuple[str, float, float, str] | None:
    """The square cell (i, j) if it touches a counter-clockwise ring: (id, center, center, WKT)."""
    corners = np.array([[i, j], [i + 1, j], [i + 1, j + 1], [i, j + 1]]) * size
    if abs(kernels.area(kernels.clip_convex(ring, corners))) > 0:
        return f"{i}:{j}", float((i + 0.5) * size), float((j + 0.5) * size), kernels.encode("POLYGON", [[*corners.tolist(), corners[0].tolist()]])
    return None


def grid(queries: DataFrame, size: float, cell: Callable = square_cell) -> DataFrame:
    """One row per cell of every query's extent (WKT polygon or multipolygon).

    Other columns of the query are copied to its cells.  Rows and columns of
    an extent's box are exploded and dealt over tasks; Python only clips one
    cell.  ``cell`` is pluggable; squares stand in where no hexagonal index is
    installed.
    """
    ship(queries.sparkSession)
    rest = [f for f in queries.schema.fields if f.name != "extent"]
    names = [f.name for f in rest]
    copied = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query in batch.to_dict("records"):
                kind, coordinates = kernels.decode(query["extent"])
                if kind not in ("POLYGON", "MULTIPOLYGON"):
                    raise ValueError(f"an extent is a polygon, not a {kind}")
                for polygon in [coordinates] if kind == "POLYGON" else coordinates:
                    ring = kernels.counter_clockwise(np.array(polygon[0], float))
                    lo, hi = np.floor(ring.min(axis=0) / size).astype(int), np.floor(ring.max(axis=0) / size).astype(int)
                    rows.append((ring.ravel().tolist(), int(lo[0]), int(hi[0]), int(lo[1]), int(hi[1]), *[query[n] for n in names]))
            yield pd.DataFrame(rows, columns=["_ring", "_i0", "_i1", "_j0", "_j1", *names])

    boxed = queries.mapInPandas(boxes, ", ".join(["_ring array<double>, _i0 int, _i1 int, _j0 int, _j1 int", *copied]))
    cells = boxed.withColumn("_i", F.explode(F.sequence("_i0", "_i1"))).withColumn("_j", F.explode(F.sequence("_j0", "_j1"))).repartition("_i", "_j")

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*made, *[query[n] for n in names]) for query in batch.to_dict("records") if (made := cell(np.array(query["_ring"]).reshape(-1, 2), query["_i"], query["_j"], size))]
            yield pd.DataFrame(found, columns=[p.split()[0] for p in SCHEMA.split(", ")] + names)

    return cells.select("_ring", "_i", "_j", *[F.col(f"`{n}`") for n in names]).mapInPandas(clip, ", ".join([SCHEMA, *copied]))


def overlap_areas(cells: DataFrame, zones: DataFrame, bucket: float = 0.05) -> DataFrame:
    """(grid_id, zone_id, overlap, zone_area) of convex cells and any simple zones.

    ``cells(grid_id, geometry)`` and ``zones(zone_id, geometry)`` in WKT;
    envelopes are dealt over buckets for an equi-join and clips are exact.
    """
    ship(cells.sparkSession)

    def boxed(df: DataFrame, key: str, name: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rings = [np.array(kernels.decode(g)[1][0], float) for g in batch["geometry"]]
                box = np.array([[*r.min(axis=0), *r.max(axis=0)] for r in rings]).reshape(-1, 4)
                yield pd.DataFrame({key: batch[key], name: batch["geometry"], "x1": box[:, 0], "y1": box[:, 1], "x2": box[:, 2], "y2": box[:, 3]})

        out = df.select(F.col(key).cast("string").alias(key), "geometry").mapInPandas(run, f"{key} string, {name} string, x1 double, y1 double, x2 double, y2 double")
        span = lambda a, b: F.explode(F.sequence(cell_of(F.col(a), bucket), cell_of(F.col(b), bucket)))
        return out.withColumn("bx", span("x1", "x2")).withColumn("by", span("y1", "y2")).select(key, name, "bx", "by")

    pairs = boxed(cells, "grid_id", "cell").join(boxed(zones, "zone_id", "zone"), ["bx", "by"]).select("grid_id", "zone_id", "cell", "zone").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for g, z, cell, zone in batch.itertuples(index=False):
                window, ring = kernels.counter_clockwise(kernels.decode(cell)[1][0]), kernels.counter_clockwise(kernels.decode(zone)[1][0])
                made.append((g, z, abs(kernels.area(kernels.clip_convex(ring, window))), abs(kernels.area(ring))))
            yield pd.DataFrame(made, columns=["grid_id", "zone_id", "overlap", "zone_area"])

    return pairs.mapInPandas(run, "grid_id string, zone_id string, overlap double, zone_area double").where("overlap > 0")


def population(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """(grid_id, population): zone population by the share of its area in the cell."""
    shares = overlap_areas(cells, zones.select("zone_id", "geometry"))
    people = zones.select(F.col("zone_id").cast("string").alias("zone_id"), "population")
    return shares.join(people, "zone_id").groupBy("grid_id").agg(F.sum(F.col("population") * F.col("overlap") / F.col("zone_area")).alias("population"))


def from_points(spark: SparkSession, points: list[tuple[float, float]]) -> DataFrame:
    """Grid rows of single origins."""
    return spark.createDataFrame([(f"{x}:{y}", x, y, kernels.encode("POINT", [x, y])) for x, y in points], SCHEMA)
