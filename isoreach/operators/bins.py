"""Bins over a reachability feature and the membership of destinations in them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Binning:
    """Bin edges over ``feature``.

    ``marginal``: bins between consecutive edges; otherwise every bin starts at
    0 and bins are cumulative.
    """

    feature: str
    edges: Sequence[float]
    marginal: bool = False
    prepend_zero: bool = False

    def intervals(self) -> list[tuple[str, float, float]]:
        """(key, lower, upper) of every bin; the key is the rounded upper edge."""
        edges = sorted(set(map(float, self.edges)))
        if (self.prepend_zero or not self.marginal) and edges[:1] != [0.0]:
            edges = [0.0, *edges]
        if len(edges) < 2:
            raise ValueError("a binning needs two different edges")
        lows = edges[:-1] if self.marginal else [0.0] * (len(edges) - 1)
        return [(str(round(hi)), lo, hi) for lo, hi in zip(lows, edges[1:], strict=True)]

    def table(self, spark: SparkSession) -> DataFrame:
        """The bins as a DataFrame (bin_key, low, high)."""
        return spark.createDataFrame(self.intervals(), "bin_key string, low double, high double")


def in_bin(value: Column, low: Column, high: Column) -> Column:
    """Membership: lower end inclusive, upper end exclusive."""
    return (value >= low) & (value < high)


def explode_bins(rows: DataFrame, binning: Binning) -> DataFrame:
    """One row per destination and bin that holds it, in a column ``bin_key``.

    The bins are literals, so no join is needed; a destination falls in many
    cumulative bins.
    """
    value = F.col(binning.feature)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), in_bin(value, F.lit(lo), F.lit(hi)).alias("ok")) for k, lo, hi in binning.intervals()])
    return rows.withColumn("bin_key", F.explode(F.transform(F.filter(cells, lambda b: b["ok"]), lambda b: b["k"])))


def legacy_minutes(trip_seconds: Column, arrival_delay: Column) -> Column:
    """Whole minutes of travel with the arrival delay, if any."""
    return F.floor((trip_seconds + F.coalesce(arrival_delay, F.lit(0))) / 60)


def destination_filter(rows: DataFrame, predicates: Sequence[tuple[str, bool]]) -> DataFrame:
    """Rows where every boolean feature differs from its ``negate`` flag."""
    for feature, negate in predicates:
        rows = rows.where(F.col(feature) != F.lit(negate))
    return rows


def destinations(tree: DataFrame) -> DataFrame:
    """Tree rows with an incoming edge: the origin itself is no destination."""
    return tree.where(F.col("edge_id").isNotNull())
