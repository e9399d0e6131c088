"""Output rows, rings of streets, large rings, far neighbours, delay zones."""

import pytest
from pyspark.sql import functions as F

from isoreach.graph import contraction
from isoreach.operators import metrics, output, spatial
from isoreach.operators.bins import Binning
from isoreach.sources import tables


def test_nested_values(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, cost double")
    made = output.set_value(output.set_value(df, "info.a.b", F.lit(1)), "info.a.c", F.col("cost"))
    assert made.first()["info"].asDict(True) == {"a": {"b": 1, "c": 2.0}}
    assert output.set_value(made, "info.a.b", F.lit(5), overwrite=True).first()["info"]["a"]["b"] == 5
    for path in ("info.a.b", "cost", "cost.more", "not a path"):
        with pytest.raises(ValueError):
            output.set_value(made, path, F.lit(1))
    with pytest.raises(ValueError):
        output.scaffold(made, {"a": "x"})


def test_single_values(spark):
    df = spark.createDataFrame([('{"a": {"b": 3}, "l": [{"v": "x"}], "m": [{"v": 1}, {"v": 2}]}',)], "j string")
    assert df.select(output.single_value(F.col("j"), "$.a.b")).first()[0] == "3" and df.select(output.single_value(F.col("j"), "$.l[*].v")).first()[0] == "x"
    for path in ("$.z", "$.m[*].v"):
        with pytest.raises(Exception, match="values"):
            df.select(output.single_value(F.col("j"), path)).collect()


def test_bins_in_order(spark):
    rows = output.scaffold_bins(spark.createDataFrame([(1,)], "id long"), Binning("cost", (40, 5, 10)))
    assert [tuple(r) for r in output.bin_list(rows, ["id"]).collect()] == [(1, "5", 0.0, 5.0), (1, "10", 0.0, 10.0), (1, "40", 0.0, 40.0)]


def test_rings_become_edges(spark):
    edges = spark.createDataFrame([(a, b, 10.0, i, "primary") for i, (a, b) in enumerate([(5, 6), (6, 7), (7, 5), (1, 2), (2, 3)])], "src long, dst long, distance double, way_id long, highway string")
    got = sorted((r["src"], r["dst"], r["distance"], r["nodes"]) for r in contraction.simplify(edges).collect())
    assert got == [(1, 3, 20.0, [1, 2, 3]), (5, 5, 30.0, [5, 6, 7, 5])]


def test_far_neighbours_and_large_rings(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 170.0, 80.0)], "l long, x double, y double")
    right = spark.createDataFrame([(7, -179.0, -80.0), (8, -178.0, -80.0)], "r long, x double, y double")
    assert {r["l"]: r["r"] for r in spatial.nearest(left, right, 0.0001).collect()} == {1: 8, 2: 8}
    assert spatial.nearest(left.limit(0), right, 0.1).count() == 0 and spatial.nearest(left, right.limit(0), 0.1).count() == 0
    corner = lambda x, y: {"x": x, "y": y}
    square = lambda lo, hi: [corner(lo, lo), corner(hi, lo), corner(hi, hi), corner(lo, hi), corner(lo, lo)]
    rings = spark.createDataFrame([(1, square(-50.0, 50.0)), (2, square(0.001, 0.002))], "zone long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.0015, 0.0015), (2, 40.0, -40.0), (3, 60.0, 0.0)], "p long, x double, y double")
    assert sorted((r["p"], r["zone"]) for r in spatial.points_in_rings(points, rings, "zone").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_multipolygon_delays(spark, tmp_path):
    (tmp_path / "d.csv").write_text('geometry,time\n"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1)), ((5 5, 6 5, 6 6, 5 5)))",3\n"POLYGON((8 8, 9 8, 9 9, 8 8))",4\n')
    rows = sorted((r["ring"][0]["x"], len(r["ring"]), r["time"]) for r in tables.time_delays(spark, str(tmp_path / "d.csv")).collect())
    assert rows == [(0.0, 4, 3.0), (5.0, 4, 3.0), (8.0, 4, 4.0)]
    (tmp_path / "e.csv").write_text('geometry,time\n"POINT(1 2)",3\n')
    with pytest.raises(Exception, match="polygon"):
        tables.time_delays(spark, str(tmp_path / "e.csv")).collect()


def test_class_means(spark):
    edges = spark.createDataFrame([(1, None, 10.0, 10.0), (2, "a", 10.0, None), (3, "b", 30.0, 20.0)], "edge_id long, class string, length_m double, mph double")
    speeds = {(r["class"], r["total"]): r["kph"] for r in metrics.class_speeds(edges).collect()}
    assert speeds[None, False] == pytest.approx(16.09344) and speeds["a", False] is None and speeds[None, True] == pytest.approx(17.5 * 1.609344)
    filled = {r["edge_id"]: r["speed"] for r in metrics.fill_speeds(edges).collect()}
    assert filled[2] == pytest.approx(17.5 * 1.609344) and filled[1] == pytest.approx(16.09344)
    with pytest.raises(Exception, match="no edge"):
        metrics.global_speed(edges.where("mph is null")).collect()


def test_study_regions_and_exteriors(spark):
    assert output.study_region(spark).count() == 51 and [r[0] for r in output.study_region(spark, ["08", "56", "08"]).collect()] == ["08", "56"]
    with pytest.raises(ValueError):
        output.study_region(spark, ["x"])
    rows = spark.createDataFrame([(1, "POLYGON((0 0,0.1 0,0.1 0.1,0 0.1,0 0))")], "id long, geometry string")
    with pytest.raises(Exception, match="shrinks"):
        output.scaled_exteriors(rows, "id", -1e6).collect()
