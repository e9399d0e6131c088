"""Batches of edits of a street graph, applied to all its nodes and edges at once.

``nodes(osmid, ...)`` and ``edges(src, dst, way_id, ...)``: parallel edges of a
pair are told apart by ``way_id``.  Neighbours in either direction come from
the one table of edges, so both always agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _checked(found: Column, text: Column) -> Column:
    return F.when(found, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))


def _named(kind: str, *columns: str) -> Column:
    return F.concat_ws(" ", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


@dataclass(frozen=True)
class Edits:
    """One batch; its parts apply in the order of their names here.

    ``retired(osmid)``: nodes lose their edges and stay under their negated
    ids.  ``removed(osmid)``: nodes go, with their edges.  ``cut(src, dst)``:
    all edges of a pair go.  ``replaced``: rows like edges; all edges of their
    pairs give way to them.  ``updated``: rows like edges; the edge of the same
    pair and way gives way.  ``nodes``: new nodes without edges.  ``edges``:
    new edges beside those there.  ``strict``: a node, pair or edge that an
    edit names and the graph lacks is an error, else such an edit does nothing
    (rows of ``replaced`` are always put in).  A new node with a known id and
    an edge at an unknown node are errors in any case.
    """

    retired: DataFrame | None = None
    removed: DataFrame | None = None
    cut: DataFrame | None = None
    replaced: DataFrame | None = None
    updated: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    strict: bool = True


def _present(rows: DataFrame, table: DataFrame, key: list[str], kind: str, strict: bool) -> DataFrame:
    """Distinct keys of an edit that the table has; others are an error or drop out."""
    met = rows.select(key).distinct().join(table.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    return met.where(_checked(there, _named(f"no {kind}", *key)) if strict else there).select(key)


def apply(nodes: DataFrame, edges: DataFrame, edits: Edits) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a batch."""
    pair, one = ["src", "dst"], ["src", "dst", "way_id"]
    strict = edits.strict
    gone = None
    if edits.retired is not None:
        old = _present(edits.retired, nodes, ["osmid"], "node", strict)
        renamed = nodes.join(old, "osmid", "left_semi").withColumn("osmid", -F.col("osmid")).select(nodes.columns)
        nodes, gone = nodes.join(old, "osmid", "left_anti").select(nodes.columns).unionByName(renamed), old
    if edits.removed is not None:
        old = _present(edits.removed, nodes, ["osmid"], "node", strict)
        nodes = nodes.join(old, "osmid", "left_anti").select(nodes.columns)
        gone = old if gone is None else gone.union(old)
    columns = edges.columns
    if gone is not None:
        for end in pair:
            edges = edges.join(gone.select(F.col("osmid").alias(end)), end, "left_anti").select(columns)
    if edits.cut is not None:
        edges = edges.join(_present(edits.cut, edges, pair, "edge", strict), pair, "left_anti").select(columns)
    new = []
    if edits.replaced is not None:
        edges = edges.join(edits.replaced.select(pair).distinct(), pair, "left_anti").select(columns)
        new.append(edits.replaced.select(columns))
    if edits.updated is not None:
        known = _present(edits.updated, edges, one, "edge", strict)
        edges = edges.join(known, one, "left_anti").select(columns)
        new.append(edits.updated.join(known, one, "left_semi").select(columns))
    if edits.nodes is not None:
        both = nodes.select("osmid").withColumn("_old", F.lit(1)).unionByName(edits.nodes.select("osmid").withColumn("_old", F.lit(0)))
        counts = both.groupBy("osmid").agg(F.count(F.lit(1)).alias("n"), F.min("_old").alias("o")).where("o = 0")
        fresh = counts.where(_checked(F.col("n") == 1, _named("a node is there already:", "osmid"))).select("osmid")
        nodes = nodes.unionByName(edits.nodes.join(fresh, "osmid").select(nodes.columns))
    if edits.edges is not None:
        new.append(edits.edges.select(columns))
    for rows in new:
        for end in pair:
            at = nodes.select(F.col("osmid").alias(end)).distinct().withColumn("_there", F.lit(True))
            rows = rows.join(at, end, "left").where(_checked(F.coalesce(F.col("_there"), F.lit(False)), _named("an edge at no node:", end))).select(columns)
        edges = edges.unionByName(rows)
    return nodes, edges


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour, heading) of all pairs, both ways: ``out`` along an edge, ``in`` against it."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("out").alias("heading"))
    return out.union(edges.select("dst", "src", F.lit("in"))).distinct()


def triplets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with the rows of its nodes, and its place among the edges of its pair by way."""
    row = lambda end: nodes.select(F.col("osmid").alias(end), F.struct(*nodes.columns).alias(f"{end}_node"))
    numbered = edges.withColumn("index", F.row_number().over(Window.partitionBy("src", "dst").orderBy("way_id")) - 1)
    return numbered.join(row("src"), "src").join(row("dst"), "dst")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without edges."""
    used = edges.select(F.col("src").alias("osmid")).union(edges.select("dst"))
    return nodes.join(used, "osmid", "left_anti")
