"""The public face: networks, grids, reach, opportunities, isochrones, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from isoreach.graph.search import Constraints, reach
from isoreach.operators import bins, grid, isochrones, metrics, opportunities


@dataclass
class Engine:
    """Accessibility analysis over DataFrames.

    ``vertices(vertex_id, x, y)`` and ``edges(src, dst, edge_list_id, edge_id,
    mode, cost, distance)``; opportunities are long (vertex_id, activity,
    count).
    """

    spark: SparkSession
    vertices: DataFrame | None = None
    edges: DataFrame | None = None
    models: list[DataFrame] = field(default_factory=list)

    def network(self, vertices: DataFrame, edges: DataFrame) -> Engine:
        """Use a network."""
        self.vertices, self.edges = vertices, edges
        return self

    def opportunities(self, *models: DataFrame) -> Engine:
        """Use opportunity tables; several add up where they share an activity."""
        self.models = list(models)
        return self

    def grid(self, queries: DataFrame, size: float) -> DataFrame:
        """Cells of the queries' extents."""
        return grid.grid(queries, size)

    def reach(self, origins: DataFrame, limits: Constraints, **how) -> DataFrame:
        """Search trees of origin vertices."""
        return reach(origins, self.edges, limits, **how)

    def access(self, origins: DataFrame, limits: Constraints, binning: bins.Binning, activities: Sequence[str]) -> DataFrame:
        """Opportunities by origin, bin and activity, zero-filled."""
        tree = bins.destinations(self.reach(origins, limits))
        found = opportunities.aggregate(tree, opportunities.combine(self.models), binning)
        return opportunities.zero_filled(found, origins, binning, activities)

    def isochrones(self, origins: DataFrame, limits: Constraints, binning: bins.Binning, **how) -> DataFrame:
        """Hulls of the vertices reached in each bin."""
        return isochrones.isochrones(bins.destinations(self.reach(origins, limits)), self.vertices, binning, **how)

    def stress(self, edges: DataFrame) -> DataFrame:
        """Level of traffic stress of tagged edges."""
        return metrics.stress(edges)

    def comfort(self, edges: DataFrame) -> DataFrame:
        """Walking comfort index of tagged edges."""
        return metrics.comfort(edges)
