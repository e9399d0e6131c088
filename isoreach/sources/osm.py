"""Street networks from node and way tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.functions import geometry as geo
from isoreach.functions import tags
from isoreach.graph.components import components
from isoreach.graph.contraction import consolidate, simplify
from isoreach.graph.islands import filter_components
from isoreach.operators.output import scaled_exteriors
from isoreach.scratch import Scratch
from isoreach.sources import pbf
from isoreach.sources.pbf import NODE_SCHEMA, WAY_SCHEMA

# The public-street filter of the import.
NOT_PUBLIC_HIGHWAYS = ("abandoned", "construction", "planned", "platform", "proposed", "raceway", "razed")
NOT_PUBLIC_ACCESS = ("private", "no")


def read(spark: SparkSession, nodes: str, ways: str) -> tuple[DataFrame, DataFrame]:
    """Node and way tables with the fixed schemas."""
    return spark.read.schema(NODE_SCHEMA).parquet(nodes), spark.read.schema(WAY_SCHEMA).parquet(ways)


def read_archive(spark: SparkSession, path: str, ways: Column | None = None, extent: str | None = None, buffer_m: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of a binary archive: ways that pass, with all of their nodes there.

    ``extent`` (polygon in WKT) keeps nodes inside of it, grown by the buffer,
    and then only those that kept ways use.  A repeated id keeps one of its rows.
    Both are decoded once, into tables that the joins then read.
    """
    scratch = Scratch(spark, "archive")
    nodes = scratch.table(pbf.read(spark, path, "nodes").dropDuplicates(["osmid"]), "nodes")
    found = pbf.read(spark, path, "ways").dropDuplicates(["osmid"])
    found = scratch.table(found.where(ways) if ways is not None else found, "ways")
    if extent is None:
        return nodes, prune(nodes, found)[1]
    wide = scaled_exteriors(spark.createDataFrame([(0, extent)], "id int, geometry string"), "id", buffer_m)
    ring = wide.select(geo.from_wkt(F.col("geometry")).alias("ring")).first()["ring"]
    corners = F.array(*[F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in ring])
    return prune(nodes.where(geo.in_ring(F.col("x"), F.col("y"), corners)), found)


def public_streets() -> Column:
    """Ways with a road class that the public may use."""
    access = F.coalesce(F.col("access").isin(*NOT_PUBLIC_ACCESS), F.lit(False))
    area = F.coalesce(F.col("area") == "yes", F.lit(False))
    return F.col("highway").isNotNull() & ~F.col("highway").isin(*NOT_PUBLIC_HIGHWAYS) & ~access & ~area


def tag_query(text: str) -> Column:
    """Tag tests in brackets, all of which must hold.

    ``["k"]`` the tag exists, ``["k"="v"]`` and ``["k"!="v"]`` equality,
    ``["k"~"v"]`` and ``["k"!~"v"]`` a pattern.
    """
    import re

    out, rest = F.lit(True), re.sub(r'\["(\w+)"(?:\s*(=|!=|~|!~)\s*"([^"]*)")?\]', "", text).strip()
    if rest:
        raise ValueError(f"not a tag query: {rest!r}")
    for key, op, value in re.findall(r'\["(\w+)"(?:\s*(=|!=|~|!~)\s*"([^"]*)")?\]', text):
        column = F.col(key)
        test = {"": column.isNotNull(), "=": column == value, "!=": column.isNull() | (column != value), "~": column.rlike(value), "!~": column.isNull() | ~column.rlike(value)}[op]
        out = out & F.coalesce(test, F.lit(False))
    return out


def prune(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways all of whose nodes are there, and the nodes that kept ways use."""
    each = ways.select(F.col("osmid").alias("way"), F.explode("nodes").alias("osmid"))
    broken = each.join(nodes.select("osmid"), "osmid", "left_anti").select(F.col("way").alias("osmid")).distinct()
    kept = ways.join(broken, "osmid", "left_anti")
    used = kept.select(F.explode("nodes").alias("osmid")).distinct()
    return nodes.join(used, "osmid", "left_semi"), kept


def directed_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of ways, both ways unless one-way.

    A reversed one-way runs against its nodes.  Of several edges between two
    nodes the first segment of the lowest way stays.
    """
    one, back = tags.is_oneway(F.col("oneway"), F.col("junction")), tags.is_reversed(F.col("oneway"))
    pairs = F.zip_with(F.slice("nodes", F.lit(1), F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    legs = ways.where(F.size("nodes") > 1).select(F.col("osmid").alias("way_id"), "highway", "maxspeed", one.alias("one"), back.alias("back"), F.posexplode(pairs).alias("segment", "p"))
    forward = legs.where("not (one and back)").select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"), "way_id", "segment", "highway", "maxspeed")
    reverse = legs.where("not one or back").select(F.col("p.b").alias("src"), F.col("p.a").alias("dst"), "way_id", "segment", "highway", "maxspeed")
    best = forward.unionByName(reverse).groupBy("src", "dst").agg(F.min(F.struct("way_id", "segment", "highway", "maxspeed")).alias("m")).select("src", "dst", "m.*")
    at = nodes.select("osmid", "x", "y")
    placed = best.join(at.select(F.col("osmid").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), "src").join(at.select(F.col("osmid").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
    return placed.withColumn("distance", geo.haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).withColumn("kph", tags.speed_kph(F.col("maxspeed"))).drop("x1", "y1", "x2", "y2", "maxspeed")


@dataclass(frozen=True)
class Import:
    """Steps of a street import, in order."""

    component: str = "largest"
    simplify: bool = True
    extent: list[tuple[float, float]] | None = None
    truncate_by_edge: bool = True
    consolidate: bool = True
    threshold: float = 0.000135  # degrees, about 15 m
    ways: Column | None = None

    def run(self, nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(vertices, edges): filter, components, simplify, truncate, components, consolidate."""
        nodes, ways = prune(nodes, ways.where(self.ways) if self.ways is not None else ways)
        edges = self._connected(directed_edges(nodes, ways))
        if self.simplify:
            edges = simplify(edges.select("src", "dst", "distance", "way_id", "highway")).select("src", "dst", "distance", F.element_at("way_ids", 1).alias("way_id"), "highway")
        if self.extent:
            edges = truncate(nodes, edges, self.extent, self.truncate_by_edge)
        if self.simplify or self.extent:
            edges = self._connected(edges)
        used = edges.select(F.col("src").alias("osmid")).union(edges.select("dst")).distinct()
        vertices = nodes.join(used, "osmid", "left_semi").select(F.col("osmid").alias("vertex_id"), "x", "y")
        return consolidate(vertices, edges, self.threshold) if self.consolidate else (vertices, edges)

    def _connected(self, edges: DataFrame) -> DataFrame:
        kept = filter_components(components(edges), self.component).select("node")
        return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").select(edges.columns)


def truncate(nodes: DataFrame, edges: DataFrame, extent: list[tuple[float, float]], by_edge: bool = True) -> DataFrame:
    """Edges without those outside: with both ends outside, or (by node) with any."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in extent])
    inside = nodes.where(geo.in_ring(F.col("x"), F.col("y"), ring)).select("osmid")
    src = edges.join(inside.withColumnRenamed("osmid", "src"), "src", "left_semi").select(edges.columns)
    if not by_edge:
        return src.join(inside.withColumnRenamed("osmid", "dst"), "dst", "left_semi").select(edges.columns)
    dst = edges.join(inside.withColumnRenamed("osmid", "dst"), "dst", "left_semi").select(edges.columns)
    return src.unionByName(dst).dropDuplicates(["src", "dst"])
