"""Run configurations as plain objects: edge lists, their modes and limits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from isoreach.graph.search import Constraints
from isoreach.operators.bins import Binning

# Units in the canonical ones (seconds, meters, kilowatt-hours).
UNITS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "meters": 1.0, "kilometers": 1000.0, "feet": 0.3048, "miles": 1609.344, "kilowatt_hours": 1.0}


def canonical(value: float, unit: str) -> float:
    """A value in its canonical unit."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return value * UNITS[unit]


@dataclass(frozen=True)
class EdgeList:
    """One edge list of a run: where it is, its mode, and what limits it."""

    path: str
    mode: str
    limits: Constraints = field(default_factory=Constraints)


@dataclass(frozen=True)
class Run:
    """A run over several edge lists that share the vertices."""

    vertices: str
    edge_lists: tuple[EdgeList, ...]
    binning: Binning
    activities: tuple[str, ...] = ()

    def with_lists(self, lists: Sequence[EdgeList]) -> Run:
        """The run with more edge lists, as an import of transit or zones adds them."""
        known = {e.path for e in self.edge_lists}
        clash = [e.path for e in lists if e.path in known]
        if clash:
            raise ValueError(f"edge lists that the run already has: {clash}")
        return replace(self, edge_lists=(*self.edge_lists, *lists))

    def numbered(self) -> list[tuple[int, EdgeList]]:
        """Edge lists with their ids."""
        return list(enumerate(self.edge_lists))
