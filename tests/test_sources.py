"""Archives, files, sinks and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isoreach import sinks
from isoreach.operators import opportunities as opp
from isoreach.operators import schedules as sched
from isoreach.sources import flex, gtfs, osm, pbf, tables
from isoreach.streaming import feeds


def test_bundle(spark, tmp_path):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.01, 0.0), (3, 0.02, 0.0)], "vertex_id long, x double, y double")
    stops = spark.createDataFrame([("a", None, "0.0", "0.0001"), ("b", None, "0.01", "0.0"), ("c", "p", None, None), ("p", None, "0.02", "0.0"), ("far", None, "5.0", "5.0")], "stop_id string, parent_station string, stop_lon string, stop_lat string")
    times = spark.createDataFrame([("t1", "1", "a", "23:59:00", None), ("t1", "2", "b", "24:10:00", "24:11:00"), ("t1", "3", "c", "24:20:00", "24:20:00"), ("t2", "1", "a", "08:00:00", "08:00:00"), ("t2", "2", "far", "09:00:00", "09:00:00")], "trip_id string, stop_sequence string, stop_id string, arrival_time string, departure_time string")
    trips = spark.createDataFrame([("t1", "r,1", "s", None), ("t2", "r2", "s", "ag")], "trip_id string, route_id string, service_id string, agency_id string")
    active = spark.createDataFrame([("s", dt.date(2024, 5, 3))], "service_id string, date date")
    targets = spark.createDataFrame([("s", dt.date(2024, 5, 4))], "service_id string, target_date date")
    edges, schedules, mapping = gtfs.bundle(times, trips, stops, places, active, targets, 2)
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(1, 2), (2, 3)]
    rows = sorted((r["route"], r["departure"], r["arrival"]) for r in schedules.collect())
    assert rows == [("2->()->r_1->s", dt.datetime(2024, 5, 3, 23, 59), dt.datetime(2024, 5, 4, 0, 10)), ("2->()->r_1->s", dt.datetime(2024, 5, 4, 0, 11), dt.datetime(2024, 5, 4, 0, 20))]
    assert mapping.first()["dates"] == {dt.date(2024, 5, 4): dt.date(2024, 5, 3)}
    with pytest.raises(ValueError):
        gtfs.bundle(times, trips, stops, places, active, targets, missing="fail")
    sinks.bundle(edges, schedules, mapping, str(tmp_path / "b"))
    assert spark.read.parquet(f"{tmp_path}/b/schedules").count() == 2


def test_date_picking(spark):
    d = dt.date
    active = spark.createDataFrame([("s", d(2024, 5, 1)), ("s", d(2024, 5, 6)), ("s", d(2024, 5, 20))], "service_id string, date date")
    targets = spark.createDataFrame([("s", d(2024, 5, 1)), ("s", d(2024, 5, 13)), ("s", d(2024, 5, 18)), ("s", d(2030, 1, 1))], "service_id string, target_date date")
    got = {r["target_date"]: r["picked_date"] for r in sched.pick_dates(targets, active, 100).collect()}
    assert got == {d(2024, 5, 1): d(2024, 5, 1), d(2024, 5, 13): d(2024, 5, 6), d(2024, 5, 18): d(2024, 5, 20)}


def test_shapes_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2", "1.0", "2.0"), ("s", "10", "3.0", "4.0"), ("s", "1", "0.0", "0.0")], "shape_id string, shape_pt_sequence string, shape_pt_lon string, shape_pt_lat string")
    assert gtfs.shapes(rows).first()["geometry"] == "LINESTRING(0.0 0.0,1.0 2.0,3.0 4.0)"
    (tmp_path / "m.csv").write_text("provider,name,municipality,state_code,country_code,data_type,url\na,,,CO,US,gtfs,u\nb,,,,FR,gtfs,u\nc,,,CO,US,gtfs-rt,u\n")
    assert [r["provider"] for r in gtfs.manifest(spark, str(tmp_path / "m.csv"), "US", "gtfs").collect()] == ["a"]


def test_flex(spark):
    relation = spark.createDataFrame([("z1", "z2", 28800, 36000), ("z2", "z1", None, None)], "src_zone string, dst_zone string, start_s int, end_s int")
    at = spark.createDataFrame([(1, "z1"), (2, "z2"), (3, "z3")], "vertex_id long, zone_id string")
    ids = lambda df: sorted(r["vertex_id"] for r in df.collect())
    assert ids(flex.may_depart(at, relation, F.lit(28800))) == [1, 2] and ids(flex.may_depart(at, relation, F.lit(36000))) == [2]
    source = spark.createDataFrame([(9, "z1")], "origin long, zone_id string")
    assert ids(flex.may_alight(source, at, relation)) == [2]


def test_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("vertex_id,jobs,food\n1,2.5,0\n")
    assert tuple(tables.opportunity_file(spark, str(tmp_path / "o.csv"), ["food", "jobs"]).first()) == (1, 0.0, 2.5)
    with pytest.raises(ValueError):
        tables.opportunity_file(spark, str(tmp_path / "o.csv"), ["shops"])
    (tmp_path / "c.txt").write_text("walk\nbike\n")
    assert [tuple(r) for r in tables.categories(spark, str(tmp_path / "c.txt")).collect()] == [(0, "walk"), (1, "bike")]
    (tmp_path / "d.csv").write_text('geometry,time\n"POLYGON((0 0,1 0,1 1,0 0))",3.5\n')
    row = tables.time_delays(spark, str(tmp_path / "d.csv")).first()
    assert row["time"] == 3.5 and len(row["ring"]) == 4
    assert tables.latest_release(["release/2024-01-01.0/", "release/2025-02-19.0/", "x"]) == "release/2025-02-19.0/"


def test_opportunity_errors(spark):
    rows = spark.createDataFrame([(1, "cafe")], "vertex_id long, kind string")
    assert opp.parse_mapping("a->x-y,b") == {"a": ["x", "y"], "b": ["b"]}
    with pytest.raises(Exception, match="unmapped category"):
        opp.mapped_long(rows, "vertex_id", "kind", None, {"bar": ["food"]}).collect()
    zero = spark.createDataFrame([(1, "jobs", 0.0)], "vertex_id long, activity string, count double")
    with pytest.raises(Exception, match="no opportunities"):
        opp.totals(zero).collect()


def test_buildings_beside_places(spark):
    square = "array(struct(0D AS x, 0D AS y), struct(0.01D AS x, 0D AS y), struct(0.01D AS x, 0.01D AS y), struct(0D AS x, 0.01D AS y), struct(0D AS x, 0D AS y))"
    buildings = spark.sql(f"SELECT 1 AS building_id, 0.005D AS x, 0.005D AS y, array(true, true) AS mask, {square} AS ring UNION ALL SELECT 2, 0.005D, 0.005D, array(true, false), {square}")
    places = spark.sql("SELECT 7 AS place_id, 0.001D AS x, 0.001D AS y, array(true, false) AS mask")
    assert sorted(r["mask"] for r in opp.places_and_buildings(places, buildings, ["jobs", "food"]).collect()) == [[True, False], [True, True]]


def test_merged_metrics_and_results(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2)], "edge_id long, lts int"), spark.createDataFrame([(1, 5)], "edge_id long, wci int")
    assert tuple(sinks.merged_metrics(a, b).first()) == (1, 2, 5)
    with pytest.raises(Exception, match="unmatched edge"):
        sinks.merged_metrics(a, b.withColumn("edge_id", F.lit(3))).collect()
    df = spark.sql("SELECT struct(1 AS jobs) AS bin, 'x' AS id")
    sinks.results(df, str(tmp_path / "r"), {"jobs": "bin.jobs", "id": "id"})
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["id", "jobs"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, 5), h % 3, "a", float(h)) for h in range(6)]
    schema = "ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    query = feeds.write(feeds.windowed(feeds.read(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    closed = {r["window"]["start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["window"]["start"]: r["n"] for r in feeds.windowed(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert closed and closed.items() <= batch.items() and len(batch) == 6


def test_matched_stops_cover_the_tolerance(spark):
    from isoreach.sources.gtfs import matched_stops

    places = {"far": (0.0, 10.0, 0.035, 10.0), "north": (20.02, 75.0, 20.0325, 75.0), "date line": (179.999, -40.0, -179.999, -40.0), "south": (50.0, -88.0, 50.1, -88.0)}
    stops = spark.createDataFrame([(k, None, x, y) for k, (x, y, _, _) in places.items()], "stop_id string, parent_station string, stop_lon double, stop_lat double")
    vertices = spark.createDataFrame([(i, x, y) for i, (_, _, x, y) in enumerate(places.values())], "vertex_id long, x double, y double")
    got = lambda meters: {r["stop_id"]: r["vertex_id"] for r in matched_stops(stops, vertices, meters).collect()}
    assert got(5000.0) == {"far": 0, "north": 1, "date line": 2, "south": 3}
    assert got(500.0) == {"north": 1, "date line": 2, "south": 3}
    assert got(300.0) == {"date line": 2}


def test_street_archives(spark, tmp_path):
    k = F.col("id")
    nodes = spark.range(20000).select((k * 7 - 300).alias("osmid"), (k * 0.001 - 10).alias("x"), (50 - k * 0.002).alias("y"), F.when(k % 3 == 0, "stop").alias("highway"), F.when(k % 5 == 0, "café, Zürich").alias("ref"))
    pbf.write(nodes.repartition(3), f"{tmp_path}/n", "nodes")
    rows = lambda df: sorted((r["osmid"], round(r["x"], 7), round(r["y"], 7), r["highway"] or "", r["ref"] or "") for r in df.collect())
    assert len(pbf.blocks(f"{tmp_path}/n")) >= 3
    assert rows(pbf.read(spark, f"{tmp_path}/n", "nodes")) == rows(nodes)
    ways = spark.createDataFrame([(5, [1, 8, -300], {"highway": "residential", "name": "a=b"}), (-6, [], {}), (1 << 40, [1 << 40, 3], {"note": "x"})], "osmid long, nodes array<long>, tags map<string,string>")
    for _ in range(2):
        pbf.write(ways, f"{tmp_path}/w", "ways")
    got = {r["osmid"]: r for r in pbf.read(spark, f"{tmp_path}/w", "ways", "osmid long, nodes array<long>, highway string, tags map<string,string>").collect()}
    assert len(got) == 3 and got[5]["nodes"] == [1, 8, -300] and got[5]["highway"] == "residential" and got[-6]["nodes"] == [] and got[1 << 40]["tags"] == {"note": "x"}


def test_street_archive_of_other_writers(spark, tmp_path):
    """Plain nodes, another granularity, offsets, zstandard and plain blobs, unknown blobs and fields."""
    import struct

    import pyarrow as pa

    z = lambda v: pbf.packed([v], True)
    node = lambda i, lat, lon: pbf.part(1, pbf.packed([1 << 3]) + z(i) + pbf.part(2, pbf.packed([1])) + pbf.part(3, pbf.packed([2])) + pbf.packed([8 << 3]) + z(lat) + pbf.packed([9 << 3]) + z(lon))
    texts = pbf.part(1, b"".join(pbf.part(1, t) for t in (b"", b"highway", b"crossing")))
    block = texts + pbf.part(2, node(-4, -25, 300) + node(9, 40, -7)) + pbf.number(17, 1000) + pbf.number(19, 5_000_000) + pbf.number(20, -1_000_000) + pbf.number(99, 7)
    way = texts + pbf.part(2, pbf.part(3, pbf.number(1, 77) + pbf.part(2, pbf.packed([1])) + pbf.part(3, pbf.packed([2])) + pbf.part(8, pbf.packed([-4, 13, -13], True))) + pbf.part(3, pbf.number(1, 78) + pbf.part(8, pbf.packed([9, 1], True))))
    squeezed = pbf.number(2, len(block)) + pbf.part(7, pa.compress(block, codec="zstd", asbytes=True))
    framed = lambda kind, blob: struct.pack(">I", len(pbf.part(1, kind) + pbf.number(3, len(blob)))) + pbf.part(1, kind) + pbf.number(3, len(blob)) + blob
    data = framed(b"OSMHeader", pbf.part(1, b"")) + framed(b"Other", b"??") + framed(b"OSMData", squeezed) + framed(b"OSMData", pbf.part(1, way))
    (tmp_path / "a.osm.pbf").write_bytes(data)
    path = str(tmp_path / "a.osm.pbf")
    near = lambda r: (r["osmid"], round(r["x"], 9), round(r["y"], 9), r["highway"])
    assert sorted(near(r) for r in pbf.read(spark, path, "nodes").collect()) == [(-4, -0.0007, 0.004975, "crossing"), (9, -0.001007, 0.00504, "crossing")]
    assert pbf.read(spark, path, "nodes").select("osmid").count() == 2
    nodes, ways = osm.read_archive(spark, "file://" + path)
    assert [(r["osmid"], r["nodes"], r["highway"]) for r in ways.collect()] == [(77, [-4, 9, -4], "crossing")] and nodes.count() == 2
    kept, _ = osm.read_archive(spark, path, osm.public_streets(), "POLYGON((-1 -1,1 -1,1 1,-1 1,-1 -1))")
    assert sorted(r["osmid"] for r in kept.collect()) == [-4, 9]
    none, lost = osm.read_archive(spark, path, extent="POLYGON((5 5,6 5,6 6,5 6,5 5))")
    assert none.count() == 0 and lost.count() == 0
    (tmp_path / "cut.pbf").write_bytes(data[:-3])
    with pytest.raises(ValueError, match="cut off"):
        pbf.blocks(str(tmp_path / "cut.pbf"))


def test_varints():
    import numpy as np

    values = np.array([0, 1, -1, 127, 128, -(1 << 63), (1 << 63) - 1, 300, -70000], np.int64)
    for zigzag in (False, True):
        assert (pbf.numbers(pbf.packed(values, zigzag), zigzag) == values).all()
        many = np.tile(values, 20)
        assert (pbf.numbers(pbf.packed(many, zigzag), zigzag) == many).all()
        assert pbf.packed(many, zigzag) == b"".join(pbf.packed([v], zigzag) for v in many)
    assert len(pbf.numbers(b"")) == 0 and pbf.packed([]) == b""


def test_zipped_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("feed/stops.txt", '\ufeffstop_id, stop_lon,stop_lat,extra\r\na,"1,5",2\r\n\r\nb,,3,x\r\n')
        z.writestr("feed/trips.txt", "")
    (tmp_path / "notes.txt").write_text("not an archive")
    got = sorted(tuple(r) for r in gtfs.read_archives(spark, str(tmp_path), "stops").collect())
    assert got == [("one", "a", None, "1,5", "2"), ("one", "b", None, None, "3")]
    assert gtfs.read_archives(spark, str(tmp_path), "shapes").count() == 0 and gtfs.read_archives(spark, str(tmp_path), "trips").count() == 0
    with pytest.raises(Exception, match="one has no routes.txt"):
        gtfs.read_archives(spark, str(tmp_path), "routes").collect()
    stops = spark.createDataFrame([("x/1", "s", 'a "b", c'), ("y", "t", None)], "archive string, stop_id string, stop_name string")
    trips = spark.createDataFrame([("y", "7")], "archive string, trip_id string")
    out = f"{tmp_path}/out"
    assert [sinks.archives({"stops": stops, "trips": trips}, out) for _ in range(2)] == [2, 2]
    back = gtfs.read_archives(spark, out, "stops", ["stop_id", "stop_name"])
    assert sorted(tuple(r) for r in back.collect()) == [("x_1", "s", 'a "b", c'), ("y", "t", None)]
    assert [tuple(r) for r in gtfs.read_archives(spark, out, "trips", ["trip_id"]).collect()] == [("y", "7")]


def test_schedule_errors(spark):
    rows = spark.createDataFrame([(0, "r"), (2, "r"), (0, "q")], "edge_id long, route string")
    with pytest.raises(Exception, match="unknown route q"):
        sched.checked_routes(rows, spark.createDataFrame([("r",)], "route string")).collect()
    assert sched.checked_routes(rows, spark.createDataFrame([("r",), ("q",), ("q",)], "route string")).count() == 3
    with pytest.raises(ValueError, match="not dense"):
        sched.checked_edges(rows, 3)
    assert sched.checked_edges(rows.where("edge_id = 0"), 1).count() == 2 and sched.checked_edges(rows.limit(0), 0).count() == 0


def test_category_file_is_written_beside_its_folder(spark):
    from isoreach.plans.files import category_file

    rows = category_file(spark, "/root/testdata/sf0.001").collect()
    assert [r["label"] for r in rows] == list(range(25)) and [r["category"] for r in rows] == sorted(r["category"] for r in rows)


def test_bundle_places_do_not_meet_around_the_globe(spark, tmp_path):
    from isoreach.plans.files import bundle_files

    rows = {
        "supplier": ([(5,), (18005,), (18006,)], "s_suppkey long"),
        "lineitem": ([(1, 1, "R", 5), (1, 2, "R", 18005), (1, 3, "R", 18006)], "l_orderkey long, l_linenumber int, l_returnflag string, l_suppkey long"),
        "orders": ([(1, "1-URGENT", "F", dt.datetime(1990, 1, 2))], "o_orderkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp"),
    }
    for name, (made, schema) in rows.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(tuple(r) for r in bundle_files(spark, str(tmp_path)).collect()) == [(5, 18005, 1, 60), (18005, 18006, 1, 60)]


def test_stop_pairs_deal_trips_over_all_partitions(spark):
    k = F.col("id")
    times = spark.range(400).select((k % 40).alias("trip_id"), k.alias("stop_sequence"), (k % 7).alias("stop_id"))
    pairs = sched.stop_pairs(times)
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sched.archive_summary(times).first().asDict() == {"trips": 40, "legs": 360, "unique_legs": 280}


def test_street_archive_blocks_are_filled_from_short_batches(spark, tmp_path):
    """Null and empty tags and lists, a tag given as column and in the map, texts that are empty."""
    k = F.col("id")
    tags = F.when(k % 4 != 0, F.map_from_arrays(F.array(F.lit("note"), F.lit("name"), F.concat(F.lit("k"), k % 5)), F.array(F.lit(""), F.lit("map"), F.when(k % 3 != 0, k.cast("string")))))
    ways = spark.range(20000).select((k * 99991 - 10**9).alias("osmid"), F.transform(F.sequence(F.lit(0), k % 6), lambda i: (k - 5000) * i * 10**9).alias("nodes"), F.when(k % 2 == 0, "column").alias("name"), tags.alias("tags"))
    ways = ways.withColumn("nodes", F.when(F.col("osmid") % 7 != 0, F.col("nodes")))
    pbf.write(ways.coalesce(1), f"{tmp_path}/w", "ways")
    assert len(pbf.blocks(f"{tmp_path}/w")) == 3
    schema = "osmid long, nodes array<long>, name string, tags map<string,string>"
    got = {r["osmid"]: (r["nodes"], r["name"], r["tags"]) for r in pbf.read(spark, f"{tmp_path}/w", "ways", schema).collect()}
    want = {}
    for r in ways.collect():
        all_tags = {k: v for k, v in (r["tags"] or {}).items() if v is not None} | ({"name": r["name"]} if r["name"] else {})
        want[r["osmid"]] = (r["nodes"] or [], all_tags.get("name"), all_tags)
    assert got == want and len(want) == 20000


def test_ways_by_columns_are_those_one_by_one():
    import random

    import numpy as np

    draw, one = random.Random(7), lambda: random.Random(draw.random())
    texts = ["", "a", "b", "a", "c"]
    schema = pbf.pa.schema([("osmid", pbf.pa.int64()), ("nodes", pbf.pa.list_(pbf.pa.int64())), ("a", pbf.pa.string()), ("x", pbf.pa.float64()), ("tags", pbf.pa.map_(pbf.pa.string(), pbf.pa.string()))])

    def way(r, odd: bytes) -> bytes:
        n, m = r.randrange(4), r.choice((0, 3, 90))
        parts = [pbf.number(1, r.choice((0, 5, -5, 1 << 62))), pbf.part(2, pbf.packed([r.randrange(1, 5) for _ in range(n)])), pbf.part(3, pbf.packed([r.randrange(5) for _ in range(n)])), pbf.part(8, pbf.packed([r.randrange(-(1 << 40), 1 << 40) for _ in range(m)], True))]
        parts += [pbf.part(4, pbf.number(1, 3) + pbf.number(2, 1 << 33)), pbf.part(9, pbf.packed([-7, 8], True)), pbf.number(77, 1)][: r.randrange(4)] + [pbf.part(8, pbf.packed([-1, 2], True))] * (r.randrange(5) == 0)
        r.shuffle(parts)
        return pbf.part(3, b"".join(parts[r.randrange(2) :]) + odd)

    for odd, fast in ((b"", True), (pbf.part(50, b"plain"), True), (pbf.part(50, b"\xff"), False), (pbf.part(50, b"\xff" * 11 + b"a"), True), (pbf.packed([50 << 3 | 1]) + bytes(8), False)):
        for size in (0, 1, 300):
            group = b"".join(way(one(), odd) for _ in range(size))
            found = pbf._ways(group)
            assert (found is not None) == (fast and size > 0)
            plain = [dict(pbf.fields(v)) for _, v in pbf.fields(group)]
            block = pbf.part(1, b"".join(pbf.part(1, t.encode()) for t in texts)) + pbf.part(2, group)
            rows = [r for part, names in pbf.elements(block, "ways") for r in pbf.batch_of(part, names, schema).to_pylist()]
            want = []
            for f in plain:
                tags = {texts[k]: texts[v] for k, v in zip(pbf.numbers(f.get(2, b"")), pbf.numbers(f.get(3, b"")))}
                want.append((pbf.signed(f.get(1, 0)), np.cumsum(pbf.numbers(f.get(8, b""), True)).tolist(), tags.get("a"), None, tags))
            assert [(r["osmid"], r["nodes"], r["a"], r["x"], dict(r["tags"])) for r in rows] == want


def test_dense_nodes_with_empty_values_or_fewer_tags():
    schema = pbf.pa.schema([("osmid", pbf.pa.int64()), ("a", pbf.pa.string()), ("c", pbf.pa.string())])
    texts = pbf.part(1, b"".join(pbf.part(1, t) for t in (b"", b"a", b"b", b"c")))
    for keys, want in (([1, 0, 0, 0, 1, 2, 3, 1, 0], [("", None), (None, None), ("b", "a")]), ([0, 1, 2, 0, 0], [(None, None), ("b", None), (None, None)]), ([0, 1, 2], [(None, None), ("b", None), (None, None)]), ([], [(None, None)] * 3)):
        dense = pbf.part(1, pbf.packed([5, 1, 1], True)) + pbf.part(8, pbf.packed([0, 0, 0], True)) + pbf.part(9, pbf.packed([0, 0, 0], True)) + pbf.part(10, pbf.packed(keys))
        (rows, names), = pbf.elements(texts + pbf.part(2, pbf.part(2, dense)), "nodes")
        assert [tuple(r.values()) for r in pbf.batch_of(rows, names, schema).to_pylist()] == [(5 + i, *w) for i, w in enumerate(want)]


def test_an_archive_is_written_and_read_in_pieces(spark, tmp_path):
    import csv
    import io
    import zipfile
    import zlib

    from isoreach.sources import zipped

    k = F.col("id")
    rows = spark.range(30_000).select(F.lit("all").alias("archive"), k.alias("trip_id"), F.when(k % 3 == 0, 'a "b",\n c').when(k % 3 == 1, F.lit("é")).alias("route_id"))
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert sinks.archives({"trips": rows, "agency": rows.limit(0).select("archive", "trip_id")}, str(tmp_path / "out")) == 1
        back = gtfs.read_archives(spark, str(tmp_path / "out"), "trips", ["trip_id", "route_id"]).withColumn("task", F.spark_partition_id()).collect()
        assert gtfs.read_archives(spark, str(tmp_path / "out"), "agency").count() == 0
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert len({r["task"] for r in back}) > 1  # one task read an archive before
    made = {str(i): ('a "b",\n c', "é", None)[i % 3] for i in range(30_000)}
    assert len(back) == 30_000 and {r["trip_id"]: r["route_id"] for r in back} == made
    with zipfile.ZipFile(tmp_path / "out/all.zip") as z:  # any reader of zip archives finds whole members
        assert z.testzip() is None and z.namelist() == ["trips.txt", "agency.txt"]
        lines = list(csv.reader(io.TextIOWrapper(z.open("trips.txt"), "utf-8", newline="")))
    assert lines[0] == ["trip_id", "route_id"] and {a: b or None for a, b in lines[1:]} == made
    a, b = b"some text", b"and more of it" * 1000
    assert zipped.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and zipped.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_more_pieces_than_the_directory_holds(tmp_path, monkeypatch):
    import zipfile

    from isoreach.sources import zipped

    monkeypatch.setattr(zipped, "MOST", 4)
    made = []
    for text in [b"n\n"] + [b"%d\n" % i for i in range(12)]:
        piece = zipped.Deflater()
        piece.add(text)
        data = piece.end()
        made.append((zipped.Piece("", 0, len(data), piece.text, piece.crc), data))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        zipped.add_member(out, "stops.txt", [p for p, _ in made], lambda p: iter([dict(made)[p]]))
    with open(tmp_path / "a.zip", "rb") as raw, zipfile.ZipFile(raw) as z:
        assert z.testzip() is None and z.read("stops.txt") == b"n\n" + b"".join(b"%d\n" % i for i in range(12))
        told = zipped.pieces_of(raw, z.getinfo("stops.txt"))
        parts = []
        for at, size, crc in told:
            raw.seek(at)
            parts.append(zipped.inflated(raw.read(size), crc))
    assert len(told) <= 4 and parts[0] == b"n\n" and b"".join(parts[1:]) == b"".join(b"%d\n" % i for i in range(12))
    with pytest.raises(zipfile.BadZipFile, match="checksum"):
        zipped.inflated(made[0][1], 1)


def test_lines_of_uneven_width_are_read_by_row():
    import io

    from isoreach.sources import zipped

    text = "a,b,c\r\n" + "1,,x\n" * 400_000 + '2\n\n3,"p ""q"", r",y,z\n"",s,"t\nu"\n'
    rows = [r for batch in zipped.parsed(lambda: io.BytesIO(text.encode()), 3, [1, -1, 0], True) for r in zip(*(c.to_pylist() for c in batch))]
    assert len(rows) == 400_003 and set(rows[:400_000]) == {(None, None, "1")}
    assert rows[400_000:] == [(None, None, "2"), ('p "q", r', None, "3"), ("s", None, None)]


def test_archive_summaries_merge_joins_on_zipped_text(spark, tmp_path):
    members = {
        "trips": spark.createDataFrame([("x", "1", "s"), ("x", "2", None), ("x", "3", "q"), ("y", "1", "s")], "archive string, trip_id string, shape_id string"),
        "stop_times": spark.createDataFrame([("x", t, i, str(i)) for t in ("1", "2") for i in (9, 10, 11)] + [("x", "3", 1, "1")], "archive string, trip_id string, stop_sequence int, stop_id string"),
        "shapes": spark.createDataFrame([("x", "s"), ("x", "s"), ("z", "s")], "archive string, shape_id string"),
    }
    sinks.archives(members, str(tmp_path))
    made = sched.archive_summaries(*(gtfs.read_archives(spark, str(tmp_path), m) for m in ("stop_times", "trips", "shapes")))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    rows = {r["archive"]: (r["trips"], r["legs"], r["unique_legs"], r["shaped"], r["shapes"], r["coverage"]) for r in made.collect()}
    assert rows == {"x": (3, 4, 4, 1, 1, 1 / 3), "y": (1, 0, 0, 0, 0, 0.0), "z": (0, 0, 0, 0, 1, 0.0)}
