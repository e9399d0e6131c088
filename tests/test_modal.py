"""Networks of several modes: types, speeds, numbers, islands, written files."""

import tomllib

import pytest
from pyspark.sql import functions as F

from isoreach import sinks
from isoreach.functions import geometry as geo
from isoreach.graph.islands import weak_islands
from isoreach.graph.numbering import numbered
from isoreach.operators import modal

BETWEEN = "between:struct<lo:double,hi:double>"
SCHEMA = (
    "id string, wkt string, connectors array<struct<connector_id:string,at:double>>, subtype string, class string, subclass string,"
    f" subclass_rules array<struct<{BETWEEN},value:string>>, speed_limits array<struct<{BETWEEN},mph:double>>,"
    " access_restrictions array<struct<access_type:string,when:struct<heading:string,mode:array<string>,using:array<string>,recognized:array<string>>>>"
)
EAST = "LINESTRING(0 0,0.01 0)"
MODES = [modal.Mode("drive", "class <> 'path'", {"mode": ["car"]}), modal.Mode("walk", "class <> 'motorway'", {"mode": ["foot"]})]


def segments(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("line", geo.from_wkt(F.col("wkt")))


def connectors(spark, names="abcdxyz"):
    return spark.createDataFrame([(n, 0.01 * i, 0.0) for i, n in enumerate(names)], "connector_id string, x double, y double")


@pytest.fixture(scope="module")
def network(spark):
    no_cars = [("denied", (("backward", ["car"], None, None)))]
    rows = [
        ("s1", EAST, [("b", 0.5), ("a", 0.0), ("c", 1.0)], "road", "service", None, [((0.0, 0.5), "alley"), (None, "late")], [((0.0, 0.5), 30.0)], no_cars),
        ("s2", EAST, [("c", 0.0), ("d", 1.0)], "road", "service", "drive_thru", [(None, "alley")], None, None),
        ("s3", EAST, [("x", 0.0), ("y", 1.0)], "road", "path", None, None, None, None),
        ("s4", EAST, [("a", 0.0)], "road", "path", None, None, None, None),
        ("s5", EAST, None, None, None, None, None, None, None),
    ]
    return modal.build(segments(spark, rows), connectors(spark), MODES)


def test_types_speeds_and_numbers(network):
    rows = sorted((r["mode"], r["edge_id"], r["segment_id"], r["heading"], r["class"], r["mph"] and round(r["mph"], 6)) for r in network.edges.collect())
    alley, late, thru = "road-service-alley", "road-service-late", "road-service-drive_thru"
    assert rows[:4] == [("drive", 0, "s1", "forward", alley, 30.0), ("drive", 1, "s1", "forward", late, 30.0), ("drive", 2, "s2", "forward", thru, 30.0), ("drive", 3, "s2", "backward", thru, 30.0)]
    assert [r[1:4] for r in rows[4:]] == [(0, "s1", "forward"), (1, "s1", "forward"), (2, "s2", "forward"), (3, "s3", "forward"), (4, "s1", "backward"), (5, "s1", "backward"), (6, "s2", "backward"), (7, "s3", "backward")]
    assert sorted((r["vertex_id"], r["connector_id"]) for r in network.vertices.collect()) == list(enumerate("abcdxyz"))
    assert {(r["mode"], r["class"]): round(r["mph"], 6) for r in network.speeds.collect()} == {(m, c): 30.0 for m in ("drive", "walk") for c in (None, alley)}


def test_a_mode_without_any_speed(spark):
    made = modal.build(segments(spark, [("s", EAST, [("a", 0.0), ("b", 1.0)], "road", "path", None, None, None, None)]), connectors(spark), MODES)
    assert [(r["mode"], r["mph"]) for r in made.edges.collect()] == [("walk", None)] * 2
    assert made.speeds.count() == 0
    assert [(r["mode"], r["class"], r["edges"], r["mph"]) for r in modal.summary(made).orderBy("class").collect()] == [("walk", None, 2, None), ("walk", "road-path", 2, None)]


def test_islands_go_with_their_vertices(spark):
    rows = [("s1", EAST, [("a", 0.0), ("b", 1.0)], "road", "service", None, None, [(None, 20.0)], None), ("s2", EAST, [("b", 0.0), ("d", 1.0)], "road", "service", None, None, None, None), ("s0", EAST, [("x", 0.0), ("y", 1.0)], "road", "service", None, None, [(None, 40.0)], None)]
    made = modal.build(segments(spark, rows), connectors(spark), MODES, lambda e, v: weak_islands(e, v, 1500.0))
    assert sorted((r["mode"], r["edge_id"], r["segment_id"], r["src"], r["dst"], round(r["mph"], 6)) for r in made.edges.collect()) == [
        (m, i, s, a, b, v) for m in ("drive", "walk") for i, (s, a, b, v) in enumerate([("s1", 0, 1, 20.0), ("s2", 1, 2, 30.0), ("s1", 1, 0, 20.0), ("s2", 2, 1, 30.0)])
    ]
    assert sorted((r["vertex_id"], r["connector_id"]) for r in made.vertices.collect()) == [(0, "a"), (1, "b"), (2, "d")]


def test_unknown_connectors_and_repeated_modes(spark):
    rows = [("s", EAST, [("a", 0.0), ("q", 1.0)], "road", "path", None, None, None, None)]
    with pytest.raises(Exception, match="unknown connector q"):
        modal.build(segments(spark, rows), connectors(spark), MODES)
    with pytest.raises(ValueError, match="repeat"):
        modal.build(segments(spark, rows), connectors(spark), [MODES[0], MODES[0]])


def test_no_segments(spark):
    made = modal.build(segments(spark, []), connectors(spark), MODES)
    assert (made.edges.count(), made.vertices.count(), modal.summary(made).count()) == (0, 7, 0)


def test_numbers_of_ties_and_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("k"))
    rows = numbered(df, "n", ["k"], ["g"]).collect()
    for g in range(3):
        own = sorted((r["n"], r["k"]) for r in rows if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)


def test_written_files(spark, network, tmp_path):
    path = str(tmp_path / "net")
    sinks.modal_network(network, path, {"release": 'a "b"', "study_region": "c"})
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/summary", wholetext=True).collect())
    told = tomllib.loads(text)
    assert told["source"] == {"release": 'a "b"', "study_region": "c"} and told["stats"]["vertices"] == 7
    drive = told["stats"]["edge_list"]["drive"]
    assert (drive["edges"], round(drive["avg_speed_mph"], 6), drive["road_class_stats"]["road-service-drive_thru"]["count"]) == (4, 30.0, 2)
    assert "avg_speed_mph" not in drive["road_class_stats"]["road-service-drive_thru"]
    read = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    assert sorted((r["class"], float(r["mph"])) for r in read("drive/speed_mapping").collect()) == [("_global_", 30.0), ("road-service-alley", 30.0)]
    assert [float(r["bearing"]) for r in read("drive/bearings").orderBy("edge_id").collect()] == [90.0, 90.0, 90.0, 270.0]
    assert read("walk/geometries").count() == 8 and read("vertex_connectors").count() == 7
    sinks.modal_network(network, path, {"release": "later"})  # what exists stays
    assert "later" not in spark.read.text(f"{path}/summary", wholetext=True).first()["value"]


def test_numbers_are_drawn_in_one_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), (100 - F.col("id")).alias("k"))
    rows = numbered(df, "n", ["k"], ["g"])
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["k"] for r in rows.where("g = 1").orderBy("n").collect()] == list(range(1, 100, 2))


def test_lines_are_measured_once(spark):
    """Naming a bound value often does not repeat what it is made of."""
    line = geo.from_wkt(F.lit(EAST))
    plan = spark.range(1).select(geo.sub_line(line, F.col("id") * 0.1, F.lit(0.9)).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("ASIN(") <= 2


def test_written_text_is_not_broadcast(spark):
    from isoreach.plans.files import modal_files

    plan = modal_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_a_stretch_is_one_row_for_all_modes_and_headings(spark, network):
    made = spark.read.parquet(f"{network.scratch.root}/ranges").collect()
    assert sorted((r["segment_id"], r["start"], sorted(r["travel"])) for r in made) == [("s1", 0.0, [0, 2, 3]), ("s1", 0.5, [0, 2, 3]), ("s2", 0.0, [0, 1, 2, 3]), ("s3", 0.0, [2, 3])]
    assert network.scratch.tags == {"speeds", "ranges", "offsets"}  # the steps before are gone


def test_edges_of_many_ranges_are_numbered_without_gaps(spark):
    rows = [(f"s{i:04}", EAST, [("a", 0.0), ("b", 0.5), ("c", 1.0)], "road", "path" if i % 3 else "service", None, None, None, [("denied", ("backward", ["car"], None, None))] if i % 2 else None) for i in range(300)]
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        made = modal.build(segments(spark, rows), connectors(spark), MODES)
        assert spark.read.parquet(f"{made.scratch.root}/ranges").select("_part").distinct().count() > 2
        edges = made.edges.collect()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    for mode in ("drive", "walk"):
        own = sorted((r for r in edges if r["mode"] == mode), key=lambda r: r["edge_id"])
        assert [r["edge_id"] for r in own] == list(range(len(own)))
        place = [(r["heading"] != "forward", r["segment_id"], r["start"]) for r in own]
        assert place == sorted(set(place))
    made.drop()


def test_written_tables_are_read_by_part(spark, network, tmp_path):
    from isoreach.plans.files import modal_files
    from isoreach.sources.tables import modal_tables

    path = str(tmp_path / "net")
    sinks.modal_network(network, path)
    parts = {"edges": "edge_id long, src_vertex_id long, dst_vertex_id long, distance double", "classes": "edge_id long, class string", "speeds": "edge_id long, mph double"}
    got = sorted(tuple(r) for r in modal_tables(spark, path, "walk", parts).collect())
    own = network.edges.where("mode = 'walk'").select("edge_id", "src", "dst", "distance", "class", "mph")
    assert [(*r[:3], round(r[3], 6), r[4], round(r[5], 6)) for r in got] == sorted((*r[:3], round(r[3], 6), r[4], round(r[5], 6)) for r in map(tuple, own.collect()))
    own.where("edge_id <> 2").select("edge_id", "mph").coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/walk/speeds")
    with pytest.raises(Exception, match="tables of walk"):
        modal_tables(spark, path, "walk", parts).collect()
    plan = modal_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(edge_id" not in plan  # rows of five tables were dealt by edge before
