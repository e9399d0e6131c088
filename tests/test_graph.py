"""Components, islands, contraction and importers on hand-made networks."""

import random

import pytest
from pyspark.sql import functions as F

from isoreach.graph import components, contraction, islands
from isoreach.sources import osm


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 0, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, edge_list_id int, edge_id long")


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_components(spark):
    labels = components.components(frame(spark, [(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)]))
    got = {r["node"]: r["component"] for r in labels.collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 3, 20: 20, 21: 20, 7: 7}
    assert {r["node"] for r in islands.filter_components(labels, "largest").collect()} == {3, 4, 5, 9}
    assert {r["node"] for r in islands.filter_components(labels, "least_k", 2).collect()} == {7, 20, 21}


def test_strong_components(spark):
    labels = islands.strong_components(frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)]))
    assert {r["node"]: r["component"] for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_strong_components_of_long_chains(spark):
    ring = [(1000, 1001), (1001, 1002), (1002, 1000)]
    chain = [(i, i + 1) for i in range(250)]
    labels = islands.strong_components(frame(spark, [*chain, (250, 1000), *ring, (1001, 2000), *[(i, i + 1) for i in range(2000, 2250)]]))
    want = {i: i for i in (*range(251), *range(2000, 2251))} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert {r["node"]: r["component"] for r in labels.collect()} == want


def test_strong_components_equal_reachability(spark):
    import random

    rng = random.Random(5)
    arcs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(55)})
    reach = {n: {n} for arc in arcs for n in arc}
    for _ in reach:
        for a, b in arcs:
            reach[a] |= reach[b]
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    assert {r["node"]: r["component"] for r in islands.strong_components(frame(spark, arcs)).collect()} == want


def test_islands_and_leaves(spark):
    edges = frame(spark, [(1, 2), (2, 1), (10, 11), (11, 10), (2, 3)])
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 0.2, 0.0), (10, 1.0, 1.0), (11, 1.00001, 1.0)], "vertex_id long, x double, y double")
    assert pairs(islands.weak_islands(edges, places, 100.0)) == [(10, 11), (11, 10)]
    assert pairs(islands.strong_islands(edges, places, 100.0)) == [(10, 11), (11, 10)]
    lollipop = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)])
    assert pairs(islands.prune_leaves(lollipop)) == [(1, 2), (2, 3), (3, 1)]


def test_simplify(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, 3), (3, 2), (2, 1), (4, 5), (4, 6)]
    edges = spark.createDataFrame([(a, b, 10.0, i, "service" if a == 2 else "primary") for i, (a, b) in enumerate(rows)], "src long, dst long, distance double, way_id long, highway string")
    got = {(r["src"], r["dst"]): (r["distance"], r["nodes"], r["highway"]) for r in contraction.simplify(edges).collect()}
    assert got == {(1, 4): (30.0, [1, 2, 3, 4], "primary"), (4, 1): (30.0, [4, 3, 2, 1], "primary"), (4, 5): (10.0, [4, 5], "primary"), (4, 6): (10.0, [4, 6], "primary")}


def test_consolidate(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.00002, 0.0), (3, 1.0, 1.0), (4, 0.00001, 0.0)], "vertex_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    merged, rewired = contraction.consolidate(nodes, edges, 0.0001)
    assert {r["vertex_id"]: r["consolidated_ids"] for r in merged.collect()} == {1: [1, 2], 3: [3], 4: [4]}
    assert pairs(rewired) == [(1, 3), (3, 1)]
    with pytest.raises(ValueError):
        contraction.consolidate(nodes, edges, 1e-9)


def test_street_import(spark):
    nodes = spark.createDataFrame([(i, i * 0.001, 0.0) for i in range(1, 7)], "osmid long, x double, y double")
    tags = {f.split()[0]: None for f in osm.WAY_SCHEMA.split(", ")}
    ways = [{**tags, "osmid": 1, "nodes": [1, 2, 3], "highway": "primary"}, {**tags, "osmid": 2, "nodes": [3, 4], "highway": "service", "oneway": "-1"}, {**tags, "osmid": 3, "nodes": [4, 99], "highway": "service"}, {**tags, "osmid": 4, "nodes": [5, 6], "highway": "path", "access": "private"}]
    ways = spark.createDataFrame([tuple(w[k] for k in tags) for w in ways], osm.WAY_SCHEMA)
    kept_nodes, kept = osm.prune(nodes, ways)
    assert {r["osmid"] for r in kept.collect()} == {1, 2, 4} and {r["osmid"] for r in kept_nodes.collect()} == {1, 2, 3, 4, 5, 6}
    assert pairs(osm.directed_edges(nodes, kept)) == [(1, 2), (2, 1), (2, 3), (3, 2), (4, 3), (5, 6), (6, 5)]
    vertices, edges = osm.Import(consolidate=False, ways=osm.public_streets()).run(nodes, ways)
    assert pairs(edges) == [(1, 3), (3, 1), (4, 3)] and {r["vertex_id"] for r in vertices.collect()} == {1, 3, 4}
    assert {r["osmid"] for r in ways.where(osm.tag_query('["highway"~"^(primary|path)$"]["access"!="private"]')).collect()} == {1}
    with pytest.raises(ValueError):
        osm.tag_query("highway=primary")


def test_truncate(spark):
    nodes = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 2.5, 0.5)], "osmid long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    assert pairs(osm.truncate(nodes, edges, square)) == [(1, 2)] and pairs(osm.truncate(nodes, edges, square, by_edge=False)) == []


def test_renumber_keeps_order(spark):
    edges = frame(spark, [(i, i + 1) for i in range(50)])
    out = islands.renumbered(edges, edges.where(F.col("edge_id") % 3 == 0), buckets=4)
    got = sorted((r["edge_id"], r["old_edge_id"]) for r in out.collect())
    assert got == list(enumerate(i for i in range(50) if i % 3))


@pytest.mark.parametrize("few", [100_000, 0])
def test_components_of_long_chains(spark, monkeypatch, few):
    """Ids that fall away from the least node, in order or not, with pointers broadcast or joined."""
    from isoreach.graph import components as module

    monkeypatch.setattr(module, "BROADCAST", few)
    rng = random.Random(3)
    ids = list(range(10_000, 11_500))
    rng.shuffle(ids)
    edges = [(0, 4000), *[(k, k - 1) for k in range(4000, 1, -1)], *zip(ids, ids[1:], strict=False), (20_000, 20_000), (None, 20_001), (30_000, 30_001), (30_001, 30_000)]
    got = dict(map(tuple, module.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {k: 0 for k in range(4001)} | {k: 10_000 for k in ids} | {20_000: 20_000, 30_000: 30_000, 30_001: 30_000}


def test_components_leave_one_table(spark):
    import os

    from isoreach.scratch import _made, release

    from isoreach.graph.components import components

    found = components(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "src long, dst long"))
    assert os.listdir(_made[-1]) == ["components"] and found.count() == 5
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0
    release(spark)
    assert not _made


def test_tags_of_merged_streets(spark):
    """Values in order, without nulls, equal neighbours once; null without any."""
    edges = spark.createDataFrame([(1, 2, 10.0, 7, "residential", "no", None), (2, 3, 5.0, 7, "residential", None, None), (3, 4, 5.0, 8, "service", "no", None), (4, 5, 1.0, 8, "service", "both", None), (5, 6, 1.0, 9, "service", "no", None)], "src long, dst long, distance double, way_id long, highway string, sidewalk string, cycleway string")
    made = contraction.simplify(edges, tags=("sidewalk", "cycleway")).collect()
    assert [(r["src"], r["dst"], r["sidewalk"], r["cycleway"]) for r in made] == [(1, 6, "no#both#no", None)]
    nodes = spark.createDataFrame([(1, 0.0, 0.0, "stop"), (2, 0.1, 0.0, None), (3, 0.2, 0.0, "stop"), (4, 9.0, 0.0, "signal")], "vertex_id long, x double, y double, highway string")
    merged, _ = contraction.consolidate(nodes, spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long"), 0.1, tags=("highway",))
    assert {r["vertex_id"]: r["highway"] for r in merged.collect()} == {1: "stop", 4: "signal"}


def test_edits(spark):
    """A thousand edits against the same ones made one by one."""
    from isoreach.graph import edits

    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 401)], "osmid long, name string")
    rows = [(1 + i * 7 % 400, 1 + i * 11 % 400, i, 1.0) for i in range(1500)]
    schema = "src long, dst long, way_id long, cost double"
    edges = spark.createDataFrame(rows, schema)
    retired, removed = list(range(1, 101)), list(range(101, 151))
    cut = [(s, d) for s, d, w, _ in rows if w % 5 == 0 and min(s, d) > 150]
    replaced = [(s, d, w + 5000, 2.0) for s, d, w, _ in rows if w % 5 == 1 and min(s, d) > 150]
    updated = [(s, d, w, 3.0) for s, d, w, _ in rows if w % 5 == 2 and min(s, d) > 150 and (s, d) not in {(a, b) for a, b, *_ in replaced} | set(cut)]
    fresh = [(1000 + i, "new") for i in range(200)]
    added = [(1000 + i, 200 + i, 9000 + i, 4.0) for i in range(200)] * 2
    assert sum(map(len, (retired, removed, cut, replaced, updated, fresh, added))) > 1000
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "osmid long")
    batch = edits.Edits(one(retired), one(removed), spark.createDataFrame(cut, "src long, dst long"), spark.createDataFrame(replaced, schema), spark.createDataFrame(updated, schema), spark.createDataFrame(fresh, "osmid long, name string"), spark.createDataFrame(added, schema))
    got_nodes, got_edges = edits.apply(nodes, edges, batch)
    left = {i: f"n{i}" for i in range(1, 401)}
    for i in retired:
        left[-i] = left.pop(i)
    for i in removed:
        del left[i]
    left |= dict(fresh)
    kept = [r for r in rows if min(r[0], r[1]) > 150 and r[:2] not in set(cut)]
    for s, d in {r[:2] for r in replaced}:
        kept = [r for r in kept if r[:2] != (s, d)]
    kept += replaced
    new = {r[:3]: r for r in updated}
    kept = [new.get(r[:3], r) for r in kept] + added
    assert {r["osmid"]: r["name"] for r in got_nodes.collect()} == left
    assert sorted(tuple(r) for r in got_edges.select("src", "dst", "way_id", "cost").collect()) == sorted(kept)
    heads = {(r["node"], r["neighbour"], r["heading"]) for r in edits.neighbours(got_edges).collect()}
    assert heads == {(s, d, "out") for s, d, *_ in kept} | {(d, s, "in") for s, d, *_ in kept}
    assert {r["osmid"] for r in edits.isolated(got_nodes, got_edges).collect()} == set(left) - {i for r in kept for i in r[:2]}
    three = edits.triplets(got_nodes, got_edges)
    assert three.count() == len(kept) and three.where("src_node.osmid <> src or dst_node.osmid <> dst").count() == 0


def test_edits_that_name_what_is_not_there(spark):
    import pytest

    from isoreach.graph import edits

    nodes, edges = spark.createDataFrame([(1,), (2,)], "osmid long"), spark.createDataFrame([(1, 2, 7)], "src long, dst long, way_id long")
    one, row = lambda i: spark.createDataFrame([(i,)], "osmid long"), lambda *r: spark.createDataFrame([r], "src long, dst long, way_id long")
    done = lambda strict=True, **parts: [t.collect() for t in edits.apply(nodes, edges, edits.Edits(strict=strict, **parts))]
    for parts, text in (({"retired": one(9)}, "no node 9"), ({"removed": one(9)}, "no node 9"), ({"cut": row(2, 1, 0)}, "no edge 2 1"), ({"updated": row(1, 2, 8)}, "no edge 1 2 8")):
        with pytest.raises(Exception, match=text):
            done(**parts)
        assert [len(t) for t in done(False, **parts)] == [2, 1]
    with pytest.raises(Exception, match="there already: 2"):
        done(False, nodes=one(2))
    with pytest.raises(Exception, match="an edge at no node: 5"):
        done(False, edges=row(1, 5, 0))
    assert [len(t) for t in done()] == [2, 1] and [len(t) for t in done(removed=one(1), retired=one(2))] == [1, 0]
