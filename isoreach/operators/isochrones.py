"""Isochrones: hulls of the places reached in each bin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.functions import kernels
from isoreach.operators.bins import Binning, explode_bins
from isoreach.shipping import ship

SCHEMA = "origin long, bin_key string, isochrone string, n_destinations long"


def isochrones(tree: DataFrame, vertices: DataFrame, binning: Binning, method: str = "convex", form: str = "wkt", base: float | None = None, factor: float = 1.0, concavity: float = 2.0) -> DataFrame:
    """(origin, bin_key, isochrone, n_destinations) per origin and bin.

    ``method``: convex, neighbours (a concave hull whose k follows the number
    of points) or dug (a concave hull by ``concavity``).  Fewer than three points give an empty polygon.  Places are
    made distinct before they meet, so a group holds at most the vertices of
    one origin's tree.
    """
    ship(tree.sparkSession)
    methods = {
        "convex": kernels.convex_hull,
        "neighbours": lambda points: kernels.neighbour_hull(points, kernels.hull_k(len(points), base, factor)),
        "dug": lambda points: kernels.dug_hull(points, concavity),
    }
    ring_of = methods[method]

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        points = group[["x", "y"]].drop_duplicates().to_numpy()
        ring = ring_of(points)
        corners = ring.tolist()
        coordinates = [[*corners, corners[0]]] if len(ring) > 2 else []
        return pd.DataFrame([(group["origin"].iloc[0], group["bin_key"].iloc[0], kernels.encode("POLYGON", coordinates, form), len(points))], columns=["origin", "bin_key", "isochrone", "n_destinations"])

    reached = explode_bins(tree, binning).select("origin", "bin_key", "vertex_id").distinct()
    return reached.join(vertices, "vertex_id").groupBy("origin", "bin_key").applyInPandas(hull, SCHEMA)


def encoded(column: str, df: DataFrame, form: str) -> DataFrame:
    """``df`` with a geometry text column in another format; any known format is read."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[column] = [None if g is None else kernels.encode(*kernels.decode(g), form) for g in batch[column]]
            yield batch

    return df.mapInPandas(run, df.schema)


def with_distances(tree: DataFrame) -> DataFrame:
    """Destinations only, without the origin's own row."""
    return tree.where(F.col("edge_id").isNotNull())
