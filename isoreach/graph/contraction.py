"""Simplification of chains and consolidation of intersections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions.tags import top_highway
from isoreach.graph.components import components
from isoreach.operators.spatial import within_distance
from isoreach.scratch import Scratch


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, neighbours, loop): degrees count parallel edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("dst").alias("other")).union(edges.select("dst", F.lit(1), F.lit(0), F.col("src")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count_distinct("other").alias("neighbours"), F.max((F.col("node") == F.col("other")).cast("int")).alias("loop"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Nodes that end a simplified edge: a self-loop, no way in or out, or a junction.

    A node is no endpoint only with two neighbours and a total degree of two
    or four.
    """
    d = F.col("in_degree") + F.col("out_degree")
    passes = (F.col("loop") == 0) & (F.col("in_degree") > 0) & (F.col("out_degree") > 0) & (F.col("neighbours") == 2) & d.isin(2, 4)
    return degrees(edges).where(~passes).select("node")


def with_ring_starts(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``ends`` and the least node of every component without any (a ring)."""
    labels = components(edges.select("src", "dst"), "src", "dst")
    ended = labels.join(ends, "node", "left_semi").select("component").distinct()
    rings = labels.join(ended, "component", "left_anti").select(F.col("component").alias("node")).distinct()
    return ends.union(rings)


#: Between the values of a merged tag.
DELIMITER = "#"


def merged_tag(values: Column) -> Column:
    """The values of a tag along merged edges or nodes, in order: nulls left out, equal neighbours once; null if none is left."""
    known = F.filter(values, lambda v: v.isNotNull())
    # the array is bound to a name, so that it is computed once
    parted = F.get(F.transform(F.array(known), lambda a: F.filter(a, lambda v, i: (i == 0) | (v != F.get(a, i - 1)))), F.lit(0))
    return F.when(F.exists(values, lambda v: v.isNotNull()), F.array_join(parted, DELIMITER))


def simplify(edges: DataFrame, rounds: int = 64, tags: Sequence[str] = ()) -> DataFrame:
    """Chains between endpoints as one edge: (src, dst, distance, nodes, way_ids, highway), and ``tags``.

    ``edges(src, dst, distance, way_id, highway)`` and a string column for each
    of ``tags``, merged along the chain (``merged_tag``).  Chains double in length
    each round: a chain that ends at an inner node is joined with the chain
    that leaves it without turning back.  A ring without any endpoint becomes
    one edge (each way) from its least node to itself.
    """
    scratch = Scratch(edges.sparkSession, "simplify")
    edges = scratch.table(edges.select("src", "dst", "distance", "way_id", "highway", *[F.col(f"`{t}`") for t in tags]), "edges")  # read for endpoints, rings and chains
    ends = scratch.table(with_ring_starts(edges, scratch.table(endpoints(edges), "endpoints")), "ends")
    inner = ends.select(F.col("node").alias("dst"), F.lit(True).alias("_end"))
    chains = edges.select("src", "dst", "distance", F.array("src", "dst").alias("nodes"), F.array("way_id").alias("way_ids"), F.array("highway").alias("classes"), *[F.array(F.col(f"`{t}`")).alias(f"tag_{t}") for t in tags])
    chains = scratch.table(chains.join(inner, "dst", "left").withColumn("done", F.coalesce("_end", F.lit(False))).drop("_end"), "0")
    for k in range(1, rounds + 1):
        tail = chains.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("distance").alias("_l"), F.col("nodes").alias("_n"), F.col("way_ids").alias("_w"), F.col("classes").alias("_c"), F.col("done").alias("_done"), *[F.col(f"`tag_{t}`").alias(f"_tag_{t}") for t in tags])
        open_chains = chains.where("not done")
        turn = (F.col("dst") == F.col("_s")) & (F.get("nodes", F.size("nodes") - 2) != F.get("_n", F.lit(1))) & ~F.arrays_overlap(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("_n", F.lit(2), F.greatest(F.size("_n") - 2, F.lit(0))))
        joined = open_chains.join(tail, turn).select("src", F.col("_d").alias("dst"), (F.col("distance") + F.col("_l")).alias("distance"), F.concat("nodes", F.slice("_n", F.lit(2), F.size("_n") - 1)).alias("nodes"), F.concat("way_ids", "_w").alias("way_ids"), F.concat("classes", "_c").alias("classes"), *[F.concat(F.col(f"`tag_{t}`"), F.col(f"`_tag_{t}`")).alias(f"tag_{t}") for t in tags], F.col("_done").alias("done"))
        stuck = open_chains.join(tail, turn, "left_anti")
        chains = scratch.table(chains.where("done").unionByName(joined).unionByName(stuck.withColumn("done", F.lit(True)).select(chains.columns)), str(k))
        scratch.drop(str(k - 1))
        if chains.where("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"chains still grow after {rounds} rounds")
    whole = chains.join(ends.select(F.col("node").alias("src")), "src", "left_semi")
    return whole.select("src", "dst", "distance", "nodes", F.array_distinct("way_ids").alias("way_ids"), top_highway(F.col("classes")).alias("highway"), *[merged_tag(F.col(f"`tag_{t}`")).alias(t) for t in tags])


def consolidate(nodes: DataFrame, edges: DataFrame, threshold: float, tags: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Merged nodes and rewired edges; no merge at all is an error.

    ``nodes(vertex_id, x, y)`` with buffers that overlap (centers within twice
    the threshold, in the unit of the coordinates) and that an edge connects
    become one node: its centroid, the ids it stands for, and the ``tags`` of
    its nodes, merged in the order of ids.  Edges inside a merged node drop out.
    """
    pairs = within_distance(nodes.select(F.col("vertex_id").alias("l"), "x", "y"), nodes.select(F.col("vertex_id").alias("r"), "x", "y"), 2 * threshold).where("l < r")
    linked = edges.select(F.least("src", "dst").alias("l"), F.greatest("src", "dst").alias("r")).distinct()
    close = pairs.join(linked, ["l", "r"], "left_semi")
    if not close.limit(1).count():
        raise ValueError("no nodes to consolidate within the threshold")
    labels = components(close, "l", "r")
    named = nodes.join(labels.withColumnRenamed("node", "vertex_id"), "vertex_id", "left").withColumn("merged", F.coalesce("component", "vertex_id"))
    merged = named.groupBy("merged").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sort_array(F.collect_set("vertex_id")).alias("consolidated_ids"), *[merged_tag(F.transform(F.sort_array(F.collect_list(F.struct("vertex_id", F.col(f"`{t}`").alias("tag")))), lambda x: x["tag"])).alias(t) for t in tags]).withColumnRenamed("merged", "vertex_id")
    ends = named.select("vertex_id", "merged")
    out = edges.join(ends.select(F.col("vertex_id").alias("src"), F.col("merged").alias("_s")), "src").join(ends.select(F.col("vertex_id").alias("dst"), F.col("merged").alias("_d")), "dst")
    rewired = out.where("_s <> _d").withColumn("src", F.col("_s")).withColumn("dst", F.col("_d")).select(edges.columns)
    return merged, rewired
