"""Shapes and binary files on small fixtures."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID
from geoflow.operators import geometry, shapes
from geoflow.plans.session import Session
from geoflow.queries import QUERIES
from geoflow.sources import files
from tests.oracle import SF


def layer(spark, *rows):
    """rows: (kind, parts) or None."""
    data = [(k, r and {"type": r[0], "parts": [[{"x": float(x), "y": float(y)} for x, y in p] for p in r[1]]}) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{FID} long, geom {geometry.GEOM}")


def parts(df):
    return [r.geom and [[(p.x, p.y) for p in part] for part in r.geom.parts] for r in df.orderBy(FID).collect()]


SQUARE = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
NEXT = [(2, 0), (2, 2), (4, 2), (4, 0), (2, 0)]
FAR = [(9, 9), (9, 10), (10, 10), (10, 9), (9, 9)]


def test_points_of_lines(spark):
    df = layer(spark, ("polyline", [[(0, 0), (4, 0), (4, 4)]]), None)
    assert parts(shapes.to_points(df, "midpoints")) == [[[(4.0, 0.0)]], None]
    assert parts(shapes.to_points(df, "endpoints")) == [[[(0.0, 0.0)], [(4.0, 4.0)]], None]
    assert len(parts(shapes.to_points(layer(spark, ("polygon", [SQUARE])), "vertices"))[0]) == 4


def test_clip(spark):
    df = layer(spark, ("polyline", [[(-1, 1), (3, 1), (3, 9), (1, 9), (1, 1)]]), ("point", [[(1, 1)], [(8, 8)]]), ("polygon", [SQUARE]), ("polygon", [FAR]))
    out = parts(shapes.clip_box(df, (0, 0, 2, 2)))
    assert out[0] == [[(0.0, 1.0), (2.0, 1.0)], [(1.0, 2.0), (1.0, 1.0)]]
    assert out[1:] == [[[(1.0, 1.0)]], [SQUARE]]
    half = shapes.clip_box(layer(spark, ("polygon", [SQUARE])), (1, -1, 5, 5))
    assert half.select(geometry.planar_area(F.col("geom")).alias("a")).first().a == 2.0
    assert parts(shapes.clip_box(df, (0, 0, 2, 2), erase=True)) == [[[(8.0, 8.0)]]]


def test_islands_and_slivers(spark):
    df = layer(spark, ("polygon", [SQUARE, FAR]), ("polygon", [NEXT]), None)
    assert [x and len(x) for x in parts(shapes.filter_islands(df, min_area=2))] == [1, 1, None]
    assert [x and len(x) for x in parts(shapes.filter_slivers(df, 2))] == [1, 1, None]
    assert shapes.filter_slivers(layer(spark, ("polygon", [FAR])), 2, remove_empty=True).count() == 0


def test_simplify_area(spark):
    line = [(k, math.sin(k / 5) * 10 + (0.01 if k % 2 else 0)) for k in range(100)]
    df = layer(spark, ("polyline", [line]), None)
    out = parts(df.where("geom is not null").withColumn("geom", shapes.simplify_area(F.col("geom"), 0.5)))[0][0]
    assert out[0] == line[0] and out[-1] == line[-1] and 10 < len(out) < 60


def test_dashes_and_buffer(spark):
    out = parts(shapes.dashes(layer(spark, ("polyline", [[(0, 0), (5, 0), (5, 5)]])), 2, 1))[0]
    assert [round(sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)), 9) for p in out] == [2.0, 2.0, 2.0, 1.0]
    area = shapes.buffer_points(layer(spark, ("point", [[(3, 4)]])), 2).select(geometry.planar_area(F.col("geom")).alias("a")).first().a
    assert abs(area - math.pi * 4) < 0.05


def test_projection_round_trips(spark):
    df = layer(spark, ("point", [[(-73.5, 41.25)]]))
    for name in ("merc", "eqc", "sinu"):
        there = df.withColumn("geom", shapes.project(F.col("geom"), name))
        back = parts(there.withColumn("geom", shapes.project(F.col("geom"), name, inverse=True)))[0][0][0]
        assert math.dist(back, (-73.5, 41.25)) < 1e-9
    x, y = parts(df.withColumn("geom", shapes.project(F.col("geom"), "aea", lon0=-96)))[0][0][0]
    assert 1_700_000 < x < 2_000_000 and 2_000_000 < y < 2_400_000


def test_crossings_and_neighbours(spark):
    df = layer(spark, ("polyline", [[(0, 0), (4, 4)]]), ("polyline", [[(0, 4), (4, 0)]]), ("polyline", [[(4, 4), (8, 8)]]))
    assert [tuple(r) for r in shapes.crossings(df, 1.5).collect()] == [(0, 1, 2.0, 2.0)]
    out = shapes.border_lines(layer(spark, ("polygon", [SQUARE]), ("polygon", [NEXT])))
    assert {r.TYPE: r.n for r in out.groupBy("TYPE").agg(F.count(F.lit(1)).alias("n")).collect()} == {"inner": 1, "outer": 6}


def test_fuzzy_join(spark):
    cells = layer(spark, ("polygon", [SQUARE]), ("polygon", [NEXT]))
    pts = layer(spark, ("point", [[(1, 1)]]), ("point", [[(0.5, 1)]]), ("point", [[(1, 0.5)]])).withColumn("v", F.when(F.col(FID) == 0, "b").otherwise("a"))
    assert [r.v for r in shapes.fuzzy_join(cells, pts, "v", 2.0).orderBy(FID).collect()] == ["a", "a"]


def test_hexagons(spark):
    got = shapes.hex_grid(spark, (0, 0, 10, 10), 2).select(geometry.planar_area(F.col("geom")).alias("a")).distinct().collect()
    assert all(abs(r.a - 2 * math.sqrt(3)) < 1e-9 for r in got)


def test_shapefile(spark, tmp_path):
    def record(k, body):
        return struct.pack(">2i", k, len(body) // 2) + body

    ring = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in SQUARE)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record(1, ring) + record(2, struct.pack("<i", 0)))
    fields = [("name", "C", 6), ("n", "N", 8), ("ok", "L", 1), ("day", "D", 8)]
    head = struct.pack("<B3BIHH20x", 3, 0, 0, 0, 2, 32 + 32 * 4 + 1, 24) + b"".join(struct.pack("<11sc4xB15x", n.encode(), t.encode(), w) for n, t, w in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" " + "é".encode().ljust(6) + b"   12.50" + b"T" + b"20240229" + b" " + b" " * 6 + b" " * 8 + b"?" + b" " * 8)
    df = files.read(spark, str(tmp_path / "a.shp"))
    a, b = df.orderBy(FID).collect()
    assert (a.name, a.n, a.ok, str(a.day), b.name, b.n, b.ok, b.day, b.geom) == ("é", 12.5, True, "2024-02-29", "", None, None, None, None)
    assert parts(df)[0] == [SQUARE]


def test_topojson(spark, tmp_path):
    topo = {"type": "Topology", "transform": {"scale": [0.5, 0.5], "translate": [1, 1]}, "arcs": [[[0, 0], [0, 2], [2, 0]], [[2, 2], [0, -2], [-2, 0]]], "objects": {"x": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "arcs": [[0, 1]], "properties": {"a": 1}}, {"type": "Point", "coordinates": [4, 2], "properties": {"a": 2}}]}}}
    (tmp_path / "a.topojson").write_text(json.dumps(topo))
    df = files.read(spark, str(tmp_path / "a.topojson"))
    assert parts(df) == [[[(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]], [[(3.0, 2.0)]]]
    assert [r.a for r in df.orderBy(FID).collect()] == [1, 2]


def test_commands(spark):
    s = Session(spark, {"a": layer(spark, ("polygon", [SQUARE]), ("polygon", [FAR]))})
    assert s.run("-clip bbox=0,0,1,1 -each 'area = this.area'").first().area == 1.0
    assert s.run("-points centroid").count() == 1


def test_near_points_by_places(spark):
    """Points at one place are measured and reduced once; -0 is 0, and points without a shape meet none."""
    at = [(k % 7 * 1.5, k % 3 * 2.0) for k in range(60)] + [(-0.0, 0.0), (0.0, -0.0), (100.0, 0.0)]
    df = spark.createDataFrame([(k, *xy) for k, xy in enumerate(at)] + [(63, None, 1.0), (64, None, None)], "__fid long, x double, y double")
    df = geometry.points_from_xy(df).withColumn("k", F.col("__fid") + 100)
    want = [(a, b, math.hypot(p[0] - q[0], p[1] - q[1])) for a, p in enumerate(at) for b, q in enumerate(at)]
    want = [(a, b, d) for a, b, d in want if d <= 2.5]
    assert sorted(map(tuple, geometry.near_points(df, df, 2.5).collect())) == want
    assert sorted(map(tuple, geometry.near_points(df, df, 2.5, digits=1).collect())) == [(a, b, round(d, 1)) for a, b, d in want]
    of = df.select("__fid", "geom", "k")
    out = geometry.join_near_points(df.drop("k"), of, 2.5, calc="n = count(), first = first(k)").orderBy("__fid").collect()
    mine = [[b for a, b, _ in want if a == k] for k in range(65)]
    assert [(x["__fid"], x["n"], x["first"]) for x in out] == [(k, len(m), m[0] + 100 if m else None) for k, m in enumerate(mine)]
    assert "_place" not in out[0].asDict()
    one = df.where("x = 0 and y = 0").withColumn("_place", geometry.place("geom"))
    assert one.count() > 3 and geometry.near_places(one, one, 2.5).count() == 1


@pytest.mark.parametrize("block", [2, 512])
def test_near_pairs_by_blocks(spark, monkeypatch, block):
    """Each two points once, in places of many blocks too, and no task lists most of them."""
    monkeypatch.setattr(geometry, "BLOCK", block)
    at = [(k % 7 * 1.5, k % 3 * 2.0) for k in range(60)] + [(50.0 + k % 2, 50.0) for k in range(60)] + [(-0.0, 0.0), (100.0, 0.0)]
    df = geometry.points_from_xy(spark.createDataFrame([(k, *xy) for k, xy in enumerate(at)] + [(122, None, 1.0)], "__fid long, x double, y double"))
    want = [(a, b, math.hypot(p[0] - q[0], p[1] - q[1])) for a, p in enumerate(at) for b, q in enumerate(at)]
    want = [(a, b, d) for a, b, d in want if d <= 2.5]
    assert sorted(map(tuple, geometry.near_points(df, df, 2.5).collect())) == want
    out = geometry.near_pairs(df, 2.5, digits=1)
    assert sorted(map(tuple, out.collect())) == [(a, b, round(d, 1)) for a, b, d in want if a < b]
    assert geometry.near_pairs(df.where("false"), 2.5).count() == 0


def test_points_near_points_over_tasks(spark):
    """The query's pairs were all listed by the one task that had the places."""
    counts = [r[1] for r in QUERIES["points_near_points"](spark, SF).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
    assert len(counts) > 4 and max(counts) < sum(counts) / 2
