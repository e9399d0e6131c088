"""Weakly connected components by hooking, pointer doubling and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.scratch import Scratch
from isoreach.skew import join_spread


#: Pointers that are broadcast at most; more are joined, with hot ends dealt over tasks.
BROADCAST = 100_000


def _followed(rows: DataFrame, column: str, to: DataFrame, pointers: int, total: int, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``column`` replaced by the root that ``to(node, root)`` has for it; ``moved`` if it has one.

    ``pointers`` are the rows of ``to``, ``total`` those of ``rows`` and
    ``counts`` its rows by ``column``.
    """
    ends = to.select(F.col("node").alias(column), F.col("root").alias("_root"))
    found = rows.join(F.broadcast(ends), column, "left") if pointers <= BROADCAST else join_spread(rows, ends, [column], counts, "left", total)
    return found.select(*[F.coalesce("_root", column).alias(column) if c == column else c for c in rows.columns if c != "moved"], F.col("_root").isNotNull().alias("moved"))


def _roots(scratch: Scratch, links: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """(node, root) for every node with a smaller neighbour: where always stepping to the least one leads."""
    steps = scratch.table(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), f"{tag}-0")
    n, k = steps.count(), 0
    while True:
        k += 1
        twice = _followed(steps, "root", steps, n, n).drop("moved")
        # pointers of two steps that move along pointers of two steps span four
        longer = scratch.table(_followed(twice, "root", twice, n, n, twice.groupBy("root").agg(F.count(F.lit(1)).alias("n"))), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        steps = longer.select("node", "root")
        if longer.where("moved").isEmpty():
            return steps, n


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge list; component: its least node.

    In every round each node hooks on to its least neighbour, if that is
    smaller; doubling the pointers finds the roots, and links between roots are
    the next round's.  A node that did not hook had no smaller neighbour, but
    then has one after the round, so two rounds at least halve the nodes that
    have links at all: for n nodes there are at most 2 log2(n) rounds of at
    most log2(n) doublings, whatever their order, and the tables shrink.

    Rounds are written to the shared folder, so that no lineage grows and a
    lost executor costs one re-read; hot nodes are dealt over tasks.  Null ends
    and self-loops add nothing but their node.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = scratch.table(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"), "pairs")
    links = scratch.table(pairs.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "links0")
    hooked: list[tuple[DataFrame, int]] = []
    while total := links.count():
        k = len(hooked)
        roots, n = _roots(scratch, links, f"roots{k}")
        hooked.append((roots, n))
        moved = _followed(links, "lo", roots, n, total)  # a node of least rank has no root and stays
        moved = _followed(moved, "hi", roots, n, total, links.groupBy("hi").agg(F.count(F.lit(1)).alias("n")))
        links = scratch.table(moved.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), f"links{k + 1}")
        scratch.drop(f"links{k}")
    last, later = None, 0
    for k, (roots, n) in reversed(list(enumerate(hooked))):
        last, later = (roots, n) if last is None else (scratch.table(_followed(roots, "root", last, later, n).drop("moved").unionByName(last), f"last{k}"), later + n)
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if last is not None:
        nodes = nodes.join(last, "node", "left")
    found = nodes.select("node", F.coalesce("root", "node").alias("component") if last is not None else F.col("node").alias("component"))
    return scratch.result(found, "components")
