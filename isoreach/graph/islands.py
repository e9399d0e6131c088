"""Component filters and islands of a directed network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.functions.geometry import haversine
from isoreach.graph.components import components
from isoreach.scratch import Scratch


def filter_components(labels: DataFrame, keep: str = "largest", k: int = 1) -> DataFrame:
    """Nodes of the kept components: all, largest, top_k or least_k; ties to the lower id."""
    if keep == "all":
        return labels
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    order = [F.asc("size") if keep == "least_k" else F.desc("size"), F.asc("component")]
    top = sizes.orderBy(*order).limit(1 if keep == "largest" else k)
    return labels.join(top.select("component"), "component", "left_semi")


def small_components(labels: DataFrame, vertices: DataFrame, threshold_m: float) -> DataFrame:
    """Components whose bounding box has a diagonal below the threshold."""
    box = labels.join(vertices.select(F.col("vertex_id").alias("node"), "x", "y"), "node").groupBy("component").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return box.where(haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) < threshold_m).select("component")


def weak_islands(edges: DataFrame, vertices: DataFrame, threshold_m: float) -> DataFrame:
    """Edges of weakly connected components that are small."""
    edges = Scratch(edges.sparkSession, "weak").table(edges, "edges")  # read for the components and the result
    labels = components(edges, "src", "dst")
    small = labels.join(small_components(labels, vertices, threshold_m), "component", "left_semi")
    return edges.join(small.select(F.col("node").alias("src")), "src", "left_semi").select(edges.columns)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components; component: the least node.

    Before each round of colouring, nodes that no cycle reaches, or that reach
    none, are trimmed as components of their own.  A node's colour is the first
    node that reaches it, in an order by hash drawn anew each round; the nodes
    of one colour that reach back to that node form a component and leave.
    Each round settles one node at least, and rounds go on until none is left.
    """
    scratch = Scratch(edges.sparkSession, "strong")
    left = scratch.table(edges.select("src", "dst").where("src <> dst").distinct(), "edges0")
    rest = scratch.table(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes0")
    k, forward, idle = 0, True, 0
    while rest.limit(1).count():
        k += 1
        if idle < 2:  # trim from either end until neither finds a node
            root = _open_ends(scratch, f"t{k}", rest, left if forward else left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("root", F.col("node"))
            forward = not forward
        else:
            color = _spread(scratch, f"c{k}", rest.select("node", F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("id")).alias("color")), left)
            color = color.select("node", F.col("color.id").alias("color"))
            same = left.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd")
            root = _reach_back(scratch, f"b{k}", color, same.select("src", "dst")).withColumnRenamed("component", "root")
        found = scratch.table(root.select("node", "root"), f"found/{k}")
        if not found.limit(1).count():
            idle += 1
            continue
        idle = 0
        rest = scratch.table(rest.join(found.select("node"), "node", "left_anti"), f"nodes{k}")
        left = left.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi")
        left = scratch.table(left.select("src", "dst"), f"edges{k}")
    if not k:
        return rest.withColumn("component", F.col("node"))
    done = edges.sparkSession.read.schema(found.schema).parquet(f"{scratch.root}/found/*")
    return done.join(done.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def _open_ends(scratch: Scratch, tag: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge, and the chains of single incoming edges behind them.

    Pointers along a chain double with each written round, so a chain takes as
    many rounds as the logarithm of its length.  Where a round resolves no
    pointer, those that remain run in cycles.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up"))
    at = nodes.join(into, "node", "left").select("node", F.when(F.col("n") == 1, F.col("up")).alias("up"), F.when(F.col("n").isNull(), True).when(F.col("n") > 1, False).alias("open"))
    at, k = scratch.table(at, f"{tag}-0"), 0
    waiting = at.where("open is null").count()
    while waiting:
        k += 1
        ahead = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("open").alias("there"))
        moved = at.where("open is null").select("node", "up").join(ahead, "up").select("node", F.col("next").alias("up"), F.col("there").alias("open"))
        at = scratch.table(at.where("open is not null").unionByName(moved), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        now = at.where("open is null").count()
        if now == waiting:
            break
        waiting = now
    return at.where("open").select("node")


def _spread(scratch: Scratch, tag: str, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Least label that reaches each node along the edges."""
    labels, k = scratch.table(labels, f"{tag}-0"), 0
    while True:
        k += 1
        near = edges.join(labels.select(F.col("node").alias("src"), "color"), "src").select(F.col("dst").alias("node"), "color")
        new = labels.select("node", "color", F.col("color").alias("was")).unionByName(near.withColumn("was", F.lit(None).cast(labels.schema["color"].dataType))).groupBy("node").agg(F.min("color").alias("color"), F.max("was").alias("was"))
        new = scratch.table(new, f"{tag}-{k}")
        moved = new.where("color <> was").limit(1).count()
        labels = new.select("node", "color")
        if not moved:
            return labels


def _reach_back(scratch: Scratch, tag: str, color: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach the root of their colour."""
    found = scratch.table(color.where("node = color").select("node", F.col("color").alias("component")), f"{tag}-0")
    k, size = 0, found.count()
    while True:
        k += 1
        more = edges.join(found.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component")
        found = scratch.table(found.union(more).distinct(), f"{tag}-{k}")
        now = found.count()
        if now == size:
            return found
        size = now


def strong_islands(edges: DataFrame, vertices: DataFrame, threshold_m: float) -> DataFrame:
    """Edges outside of strongly connected components that are large enough."""
    labels = strong_components(edges)
    small = labels.join(small_components(labels, vertices, threshold_m), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(small, "src", "left_semi").select(edges.columns)


def prune_leaves(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Edges left after removing, again and again, those from or to a dead end."""
    scratch = Scratch(edges.sparkSession, "leaves")
    left = scratch.table(edges, "0")
    size = left.count()
    for k in range(1, rounds + 1):
        next_left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = scratch.table(next_left.select(edges.columns), str(k))
        now = left.count()
        if now == size:
            return left
        size = now
    raise RuntimeError(f"edges still leave after {rounds} rounds")


def renumbered(edges: DataFrame, removed: DataFrame, buckets: int = 256) -> DataFrame:
    """Edges without the removed ones, numbered from 0 in the order of their ids.

    Numbers are running counts over ranges of ids plus the number inside the
    range, so no task sorts all edges.
    """
    kept = edges.join(removed.select("edge_list_id", "edge_id"), ["edge_list_id", "edge_id"], "left_anti")
    span = kept.agg(F.min("edge_id").alias("lo"), F.max("edge_id").alias("hi")).first()
    if span["lo"] is None:
        return kept.withColumn("old_edge_id", F.col("edge_id"))
    width = max(1, -(-(span["hi"] - span["lo"] + 1) // buckets))
    part = F.floor((F.col("edge_id") - span["lo"]) / width)
    kept = kept.withColumn("_part", part)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("edge_list_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = kept.groupBy("edge_list_id", "_part").count().select("edge_list_id", "_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("edge_list_id", "_part").orderBy("edge_id")) - 1
    out = kept.withColumn("_row", inside).join(offsets, ["edge_list_id", "_part"]).withColumn("old_edge_id", F.col("edge_id"))
    return out.withColumn("edge_id", F.col("_before") + F.col("_row")).drop("_part", "_before", "_row")
