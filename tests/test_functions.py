"""Column functions and geometry kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoreach.functions import geometry as geo
from isoreach.functions import ids, kernels, tags
from isoreach.operators import grid, overture, taxonomy
from isoreach.operators.isochrones import encoded

LINE = "LINESTRING(0 0, 0.01 0, 0.01 0.01)"


def value(spark, column, **cells):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()] or [F.lit(1).alias("one")])
    return df.select(column.alias("v")).first()["v"]


def test_lines(spark):
    line = geo.from_wkt(F.lit(LINE))
    length = value(spark, geo.line_length(line))
    assert abs(length - 2 * math.radians(0.01) * geo.EARTH_RADIUS_M) < 1
    middle = value(spark, geo.point_at(line, F.lit(0.5)))
    assert abs(middle["x"] - 0.01) < 1e-6 and abs(middle["y"]) < 1e-6
    part = value(spark, geo.sub_line(line, F.lit(0.25), F.lit(0.75)))
    assert [round(p["x"], 5) for p in part] == [0.005, 0.01, 0.01]
    assert value(spark, geo.sub_line(line, F.lit(0.25), F.lit(0.75), F.lit(True)))[0]["y"] > 0.004
    assert abs(value(spark, geo.exit_bearing(line)) - 0.0) < 1e-6
    assert len(value(spark, geo.points_along(line, 500.0))) == 6 and len(value(spark, geo.points_along(line, 5000.0))) == 2
    with pytest.raises(Exception, match="linear reference"):
        value(spark, geo.length_at(line, F.lit(1.5)))
    assert value(spark, geo.to_wkt(line)).startswith("LINESTRING(0.0 0.0,0.01 0.0")
    assert len(value(spark, geo.circle(F.lit(0.0), F.lit(0.0), 100.0))) == 13


def test_rings(spark):
    ring = geo.from_wkt(F.lit("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"))
    assert value(spark, geo.ring_area(ring)) == 4.0
    assert value(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), ring)) and not value(spark, geo.in_ring(F.lit(3.0), F.lit(1.0), ring))
    assert value(spark, geo.to_feature(geo.to_geojson(ring, "Polygon"))).endswith(',"properties":null}')


@pytest.mark.parametrize(("text", "kph"), [("45", 45.0), ("45 mph", 45 * 1.609344), ("30 kph", 30.0), ("walk", 5.0), ("unposted", None), ("45;80", 45.0), ("0", None), ("7 fpm", None), ("x", None), ("25mph", 25 * 1.609344)])
def test_speeds(spark, text, kph):
    got = value(spark, tags.speed_kph(F.lit(text)))
    assert got == kph if kph is None else abs(got - kph) < 1e-9


def test_ids(spark):
    assert value(spark, ids.zone_id(*map(F.lit, "abcd"))) == "a-b-c-d"
    with pytest.raises(Exception, match="not a zone id"):
        value(spark, ids.zone_id(F.lit("a-x"), F.lit("b"), F.lit("c"), F.lit("d")))
    assert tuple(value(spark, ids.parse_edge_row(F.lit("3-17")))) == (3, 17) and value(spark, ids.parse_edge_row(F.lit("17"))) is None
    assert value(spark, ids.cell_parent(F.lit("88268cd801fffff"), 8)) == "88268cd801fffff"
    with pytest.raises(Exception, match="finer"):
        value(spark, ids.cell_parent(F.lit("85268cdbfffffff"), 8))
    assert ids.parse_bbox("-105,-104,39,40") == (-105.0, -104.0, 39.0, 40.0)
    for bad in ("1,2,3", "5,4,0,1", "0,1,80,91"):
        with pytest.raises(ValueError):
            ids.parse_bbox(bad)
    assert ids.dotted_path("a.b") == "$.a.b"
    with pytest.raises(ValueError):
        ids.dotted_path("a..b")
    assert value(spark, ids.path_between(F.array(*map(F.lit, (5, 6, 7, 8))), F.lit(6), F.lit(8))) == [6, 7, 8]


def test_hulls():
    rng = np.random.default_rng(1)
    pts = rng.random((60, 2))
    convex, concave = kernels.convex_hull(pts), kernels.neighbour_hull(pts, 8)
    assert abs(kernels.area(concave)) <= kernels.area(convex) + 1e-12
    assert len(kernels.neighbour_hull(pts[:2], 3)) == 0 and len(kernels.neighbour_hull(pts[:3], 3)) == 3
    with pytest.raises(ValueError):
        kernels.neighbour_hull(pts, 2)
    assert kernels.hull_k(100) == 10 and kernels.hull_k(4) == 3


def test_clip_and_sampling():
    a, b = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float), np.array([[1, 1], [3, 1], [3, 3], [1, 3]], float)
    assert abs(kernels.area(kernels.clip_convex(a, b))) == 1.0
    ell = np.array([[0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2]], float)
    assert abs(sum(abs(kernels.area(t)) for t in kernels.ears(ell)) - 3.0) < 1e-12
    pts = kernels.sample_polygon(ell, 200, 5)
    assert not ((pts[:, 0] > 1) & (pts[:, 1] > 1)).any() and (pts == kernels.sample_polygon(ell, 200, 5)).all()


def test_codecs(spark):
    for kind, xy in (("POINT", [1.0, 2.0]), ("LINESTRING", [[0.0, 0.0], [1.5, 2.0]]), ("POLYGON", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]])):
        for form in ("wkt", "wkb", "geojson"):
            assert kernels.decode(kernels.encode(kind, xy, form)) == (kind, xy)
    df = spark.createDataFrame([("POINT(1.0 2.0)",), (None,)], "g string")
    assert encoded("g", df, "wkb").first()["g"] == "0101000000000000000000F03F0000000000000040"


def test_grid_and_population(spark):
    q = spark.createDataFrame([("POLYGON((0 0, 2 0, 2 1, 0 1, 0 0))", "walk")], "extent string, mode string")
    cells = grid.grid(q, 1.0).cache()
    assert sorted(r["grid_id"] for r in cells.collect()) == ["0:0", "1:0"] and cells.columns[-1] == "mode"
    zones = spark.createDataFrame([("z", "POLYGON((0.5 0, 2.5 0, 2.5 1, 0.5 1, 0.5 0))", 100.0)], "zone_id string, geometry string, population double")
    assert {r[0]: round(r[1], 9) for r in grid.population(cells, zones).collect()} == {"0:0": 25.0, "1:0": 50.0}
    assert grid.validate({"extent": "x"}) == "extent" and grid.validate({"origin_x": 1, "origin_y": 2}) == "point"
    for bad in ({}, {"origin_x": 1}, {"extent": "x", "origin_x": 1}, {"extent": "x", "origin_x": 1, "origin_y": 2}):
        with pytest.raises(ValueError):
            grid.validate(bad)


WHEN = "struct<mode:array<string>,heading:string,using:array<string>,recognized:array<string>>"


def restrictions(spark, rows):
    df = spark.createDataFrame([(rows,)], f"r array<struct<access_type:string,when:{WHEN}>>")
    return df


@pytest.mark.parametrize(
    ("rows", "open_to_cars"),
    [
        ([], True),
        ([("denied", None)], False),
        ([("denied", None), ("allowed", (["car"], None, None, None))], True),
        ([("allowed", (["car"], None, None, None)), ("denied", None)], True),
        ([("denied", (["car"], None, None, None)), ("allowed", (["car"], None, None, None))], False),
        ([("denied", (["foot"], None, None, None))], True),
        ([("denied", (["car"], "backward", None, None))], True),
        ([("denied", None), ("designated", (["car"], None, ["as_customer"], None))], False),
    ],
)
def test_mode_access(spark, rows, open_to_cars):
    df = restrictions(spark, rows)
    assert df.select(overture.supports_mode(F.col("r"), ["car"])).first()[0] is open_to_cars


@pytest.mark.parametrize(
    ("rows", "query", "want"),
    [
        ([], None, ["forward", "backward"]),
        ([("denied", (None, "backward", None, None))], None, ["forward"]),
        ([("denied", None)], None, []),
        ([("denied", None), ("allowed", (None, "forward", None, None))], None, ["forward"]),
        ([("denied", (None, "forward", None, None)), ("allowed", None)], None, ["backward"]),
        ([("denied", (["car"], None, None, None))], None, ["forward", "backward"]),
        ([("denied", (["car"], None, None, None))], {"mode": ["car", "bus"]}, []),
        ([("denied", (None, None, ["a", "b"], None))], {"using": ["a"]}, []),
        ([("denied", (None, None, ["a"], None))], {"using": ["a", "b"]}, ["forward", "backward"]),
    ],
)
def test_headings(spark, rows, query, want):
    assert restrictions(spark, rows).select(overture.headings(F.col("r"), query)).first()[0] == want


def test_segments_to_edges(spark):
    schema = f"id string, wkt string, connectors array<struct<connector_id:string,at:double>>, access_restrictions array<struct<access_type:string,when:{WHEN}>>, speed_limits array<struct<between:struct<lo:double,hi:double>,mph:double>>, class string"
    df = spark.createDataFrame([("s", LINE, [("a", 0.0), ("b", 0.5), ("c", 1.0)], [("denied", (None, "backward", None, None))], [((0.0, 0.5), 30.0), (None, 20.0)], "primary")], schema)
    df = df.withColumn("line", geo.from_wkt(F.col("wkt")))
    connectors = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.01, 0.0), ("c", 0.01, 0.01), ("d", 1.0, 1.0)], "connector_id string, x double, y double")
    vertices, edges = overture.network(df, connectors)
    assert sorted(r["connector_id"] for r in vertices.collect()) == ["a", "b", "c"]
    rows = {(r["src_connector"], r["dst_connector"]): (r["heading"], round(r["kph"] / 1.609344, 6)) for r in edges.collect()}
    assert rows == {("a", "b"): ("forward", 25.0), ("b", "c"): ("forward", 20.0)}
    with pytest.raises(Exception, match="unknown connector"):
        overture.network(df, connectors.where("connector_id <> 'b'"))[0].collect()


def test_taxonomy(spark):
    paths = spark.createDataFrame([("food", ["food"]), ("cafe", ["food", "cafe"]), ("tea", ["food", "cafe", "tea"])], "category string, path array<string>")
    pairs = taxonomy.closure(taxonomy.from_paths(paths))
    assert sorted(map(tuple, pairs.collect())) == [("cafe", "cafe"), ("cafe", "tea"), ("food", "cafe"), ("food", "food"), ("food", "tea"), ("tea", "tea")]
    groups = spark.createDataFrame([("drinks", "cafe")], "activity string, category string")
    assert {r["category"]: r["drinks"] for r in taxonomy.reverse_map(pairs, groups, ["drinks"]).collect()} == {"cafe": True, "tea": True}
    with pytest.raises(Exception, match="unknown category"):
        taxonomy.reverse_map(pairs, spark.createDataFrame([("x", "nope")], "activity string, category string"), ["x"]).collect()


def _covers(ring, p):
    a, b = ring, np.roll(ring, -1, axis=0)
    side = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
    on = (side == 0) & (np.maximum(a, b) >= p).all(axis=1) & (np.minimum(a, b) <= p).all(axis=1)
    return bool(on.any()) or kernels._inside(p, ring)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("concavity", [0.5, 1.0, 2.0, 8.0])
def test_dug_hull_is_a_simple_ring_around_all_points(seed, concavity):
    """Against a plain look at every point and every pair of edges; odd seeds lie on whole numbers, with repeats and lines."""
    rng = np.random.default_rng(seed)
    pts = rng.integers(0, 9, (60, 2)).astype(float) if seed % 2 else rng.normal(size=(60, 2))
    ring = kernels.dug_hull(pts, concavity)
    assert len(np.unique(ring, axis=0)) == len(ring) and all(_covers(ring, p) for p in pts)
    n = len(ring)
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            a, b, c, d = ring[i], ring[i + 1], ring[j], ring[(j + 1) % n]
            boxes = (np.maximum(a, b) >= np.minimum(c, d)).all() and (np.maximum(c, d) >= np.minimum(a, b)).all()
            assert not (boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0)
    convex = kernels.convex_hull(pts)
    assert 0 < kernels.area(ring) <= kernels.area(convex) + 1e-12
    assert {tuple(p) for p in convex} <= {tuple(p) for p in ring}


def test_dug_hull_digs_a_bay():
    bay = [(x, y) for x in range(9) for y in range(9) if not (3 <= x <= 5 and y >= 3)]
    ring = kernels.dug_hull(np.array(bay, float), 1.2)
    assert not _covers(ring, np.array([4.0, 7.0])) and kernels.area(ring) < 64 - 12
    assert kernels.area(kernels.dug_hull(np.array(bay, float), float("inf"))) == 64
    assert len(kernels.dug_hull(np.array([(0, 0), (1, 1), (2, 2)], float))) == 0 and len(kernels.dug_hull(np.zeros((5, 2)))) == 0 and len(kernels.dug_hull(np.zeros((0, 2)))) == 0
    assert len(kernels.dug_hull(np.array([(0, 0), (1, 0), (0, 1)], float))) == 3
    with pytest.raises(ValueError):
        kernels.dug_hull(np.array(bay, float), 0.0)


@pytest.mark.parametrize("whole", [True, False])
def test_lines_in_rings(spark, whole):
    """Against a look at every segment and every edge; whole numbers give touches and shared edges."""
    from isoreach.operators.spatial import lines_in_rings

    rng = np.random.default_rng(5)
    at = lambda n: [(float(x), float(y)) for x, y in (rng.integers(-6, 7, (n, 2)) if whole else rng.uniform(-6, 6, (n, 2)))]
    lines = {i: at(1 + i % 4) for i in range(150)} | {900: [], 901: [(-50.0, 0.3), (50.0, 0.4)], 902: [(0.0, -40.0), (0.0, 40.0)]}
    rings = {j: (lambda r: r + r[:1] if j % 2 else r)([tuple(p) for p in kernels.convex_hull(np.array(at(6))).tolist()]) for j in range(8)}
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    def meet(a, b, c, d):
        boxes = all(max(a[k], b[k]) >= min(c[k], d[k]) and max(c[k], d[k]) >= min(a[k], b[k]) for k in (0, 1))
        return boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0

    wanted = set()
    for i, line in lines.items():
        for j, ring in rings.items():
            edges = list(zip(ring, ring[1:] + ring[:1]))
            if any(_covers(np.array(ring), np.array(p)) for p in line) or any(meet(a, b, c, d) for a, b in zip(line, line[1:]) for c, d in edges):
                wanted.add((i, j))
    point = "array<struct<x: double, y: double>>"
    made = spark.createDataFrame(list(lines.items()) + [(950, None)], f"id long, line {point}")
    shapes = spark.createDataFrame(list(rings.items()) + [(99, []), (98, None)], f"ring_id long, ring {point}")
    for cell in (0.7, 50.0):
        assert {tuple(r) for r in lines_in_rings(made, shapes, "id", "ring_id", cell).collect()} == wanted
    assert {(901, j) for j in rings} & wanted


def test_segments_in_an_extent(spark):
    from isoreach.operators.overture import in_extent

    point = "array<struct<x: double, y: double>>"
    segments = spark.createDataFrame([(1, [(-1.0, 0.5), (2.0, 0.5)], [("a", 0.0), ("b", 1.0)]), (2, [(3.0, 3.0), (4.0, 4.0)], [("c", 0.0)]), (3, None, [("d", 0.0)]), (4, [(0.2, 0.2), (0.3, 0.3)], None)], f"id long, line {point}, connectors array<struct<connector_id: string, at: double>>")
    connectors = spark.createDataFrame([(c,) for c in "abcd"], "connector_id string")
    extent = spark.createDataFrame([(0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])], f"ring_id int, ring {point}")
    kept, used = in_extent(segments, connectors, extent)
    assert sorted(r["id"] for r in kept.collect()) == [1, 4] and sorted(r[0] for r in used.collect()) == ["a", "b"]


def test_edges_are_not_broadcast_by_their_size_on_disk(spark, tmp_path):
    from isoreach.operators import metrics

    path = str(tmp_path / "edges")
    tags = [F.lit(v).alias(c) for c, v in (("highway", "residential"), ("cycleway", "lane"), ("sidewalk", "both"), ("footway", "no"), ("oneway", "no"), ("node_highway", "stop"))]
    spark.range(50).select(F.col("id").alias("edge_id"), (F.col("id") * 0.0001).alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("mph"), *tags).write.parquet(path)
    edges = spark.read.parquet(path)
    near = metrics.neighbours(edges)
    for made in (near, metrics.neighbour_speed(edges, near), metrics.stress(edges), metrics.comfort(edges)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == (98 if made is near else 50)


def test_long_segments_take_few_cells(spark):
    from isoreach.operators.spatial import lines_in_rings

    wkt = lambda rows, key, name: spark.createDataFrame(rows, f"{key} long, wkt string").select(key, geo.from_wkt(F.col("wkt")).alias(name))
    lines = wkt([(1, "LINESTRING(-40000000 0.5,40000000 0.5)"), (2, "LINESTRING(5 5,50000000 5)"), (3, "LINESTRING(-3 -3,0.2 0.2)"), (4, "LINESTRING(0.5 -30000000,0.5 30000000)")], "id", "line")
    rings = wkt([(7, "POLYGON((0 0,1 0,1 1,0 1,0 0))"), (8, "POLYGON((900 4,901 4,901 6,900 6,900 4))")], "ring_id", "ring")
    assert sorted(tuple(r) for r in lines_in_rings(lines, rings, "id", "ring_id", 0.01).collect()) == [(1, 7), (2, 8), (3, 7), (4, 7)]
