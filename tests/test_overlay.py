"""Overlay, simplification, grids, classes and the files of shapes, on small layers and against brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geoflow.functions import planar, wkb
from geoflow.functions.aggregates import FID
from geoflow.operators import classes, geometry, joins, overlay, rows, shapes
from geoflow.plans.session import Session
from geoflow.sources import binary, files, kml


def blob(r, n=9, cx=0.0, cy=0.0, size=1.0):
    """A ring around its middle, clockwise."""
    ring = []
    for k in range(n):
        a, q = 2 * math.pi * (k + 0.8 * r.random()) / n, size * (1 + r.random())
        ring.append((cx + math.sin(a) * q, cy + math.cos(a) * q))
    return [[*ring, ring[0]]]


def polygons(spark, shapes_, **fields):
    rows_ = [(k, {"type": "polygon", "parts": [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in s]}, *(v[k] for v in fields.values())) for k, s in enumerate(shapes_)]
    kinds = "".join(f", {n} {'string' if isinstance(v[0], str) else 'double'}" for n, v in fields.items())
    return spark.createDataFrame(rows_, f"{FID} long, geom {geometry.GEOM}{kinds}")


def square(x, y, w, h=None):
    h = h or w
    return [[(x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y)]]


def test_areas_add_up():
    r = random.Random(3)
    for _ in range(60):
        a, b, c = (blob(r, cx=r.random() * 2, cy=r.random() * 2) for _ in range(3))
        both, rest, whole = planar.shared_area(a, b), planar.area(planar.difference(a, [b])), planar.area(planar.union([a, b]))
        assert both + rest == pytest.approx(planar.area(a)) and whole == pytest.approx(planar.area(a) + planar.area(b) - both)
        shapes_ = [a, b, c]
        others = lambda k: [(j, s) for j, s in enumerate(shapes_) if j != k]  # noqa: E731, B023
        total = planar.area(planar.union(shapes_))
        made = [t for k, s in enumerate(shapes_) for t in planar.tiles(k, s, others(k))]
        assert sum(planar.area(p) for _, p in made) == pytest.approx(total)
        for owners, p in made:
            x, y = (p[0][0][0] + p[0][1][0]) / 2, (p[0][0][1] + p[0][1][1]) / 2
            dx, dy = p[0][1][1] - p[0][0][1], p[0][0][0] - p[0][1][0]
            inside = [k for k, s in enumerate(shapes_) if sum(planar.within(x + dx * 1e-7, y + dy * 1e-7, ring) for ring in s) % 2]
            assert inside == owners
        edges = [e for k, s in enumerate(shapes_) for e in planar.outline(k, s, others(k))]
        assert planar.area(planar.flat(planar.nest(planar.chain(edges)))) == pytest.approx(total)


def test_union_in_spark_is_that_of_the_kernel(spark):
    r = random.Random(5)
    shapes_ = [blob(r, cx=3 * r.random(), cy=3 * r.random()) for _ in range(12)]
    df = polygons(spark, shapes_, g=[float(k % 2) for k in range(12)])
    got = {row.g: row.a for row in Session(spark, {"s": df}).run("-dissolve2 g").select("g", geometry.planar_area(F.col("geom")).alias("a")).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(planar.area(planar.union([s for k, s in enumerate(shapes_) if k % 2 == g])))


def test_clip_erase_lines_and_points(spark):
    window = polygons(spark, [square(0, 0, 2), square(1, 1, 3)])
    line = spark.createDataFrame([(0, {"type": "polyline", "parts": [[{"x": -1.0, "y": 0.5}, {"x": 5.0, "y": 0.5}]]}), (1, None)], f"{FID} long, geom {geometry.GEOM}")
    size = lambda df: [round(x.n, 9) for x in df.where("geom is not null").select(geometry.length(F.col("geom")).alias("n")).collect()]
    assert size(overlay.clip(line, window)) == [2.0] and size(overlay.clip(line, window, erase=True)) == [4.0]
    assert overlay.clip(line, window).count() == 1 and overlay.clip(line, window, erase=True).count() == 2
    assert overlay.clip(window.where("false"), window).count() == 0
    inside = polygons(spark, [square(0.25, 0.25, 1), square(10, 10, 1)], name=["a", "b"])
    kept = {x.name: x.a for x in overlay.clip(inside, window, erase=True).select("name", geometry.planar_area(F.col("geom")).alias("a")).collect()}
    assert kept == {"b": 1.0}


def test_slice_inlay_divide(spark):
    target, source = polygons(spark, [square(0, 0, 4)], name=["t"]), polygons(spark, [square(1, 1, 2), square(3, 3, 4)], kind=["x", "y"])
    s = Session(spark, {"source": source, "target": target})
    assert {x.layer_name: x.a for x in s.run("-slice source id-field=kind").select("layer_name", geometry.planar_area(F.col("geom")).alias("a")).collect()} == {"x": 4.0, "y": 1.0}
    out = Session(spark, {"source": source, "target": target}).run("-inlay source")
    assert sorted((x.name, x.kind, x.a) for x in out.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), geometry.planar_area(F.col("geom")).alias("a")).collect()) == [("", "x", 4.0), ("", "y", 16.0), ("t", "", 11.0)]


def test_clean_gives_overlaps_and_gaps_to_one(spark):
    df = polygons(spark, [square(0, 0, 2), square(1, 0, 4, 2), square(0, 2, 5, 1), square(0, 3, 2), square(2.5, 3, 2.5, 2), square(0, 5, 5, 1)])
    out = {x[FID]: x.a for x in overlay.clean(df, gap_area=2.0).select(FID, geometry.planar_area(F.col("geom")).alias("a")).collect()}
    assert out[0] == 2.0 and out[1] == 8.0
    assert sum(out.values()) == pytest.approx(5 * 6)  # the gap of 0.5 x 2 is closed
    with pytest.raises(ValueError):
        overlay.clean(df, overlap_rule="first")


def test_largest_overlap_ties_go_to_the_last(spark):
    target, source = polygons(spark, [square(0, 0, 2)]), polygons(spark, [square(0, 0, 1, 2), square(1, 0, 1, 2), square(5, 5, 1)], v=["a", "b", "c"])
    s = Session(spark, {"source": source, "target": target})
    assert s.run("-join source largest-overlap").first().v == "b"
    assert Session(spark, {"source": source, "target": target}).run("-join source interpolate=v").first().v == "a"
    assert Session(spark, {"source": source, "target": target}).run("-join source min-overlap-pct=60% calc='n = count()'").first().n == 0
    assert Session(spark, {"source": source, "target": target}).run("-join source point-method calc='n = count()'").first().n == 2


def test_simplify_keeps_neighbours_together(spark):
    r = random.Random(7)
    border = [(5 + r.random(), k / 10) for k in range(1, 100)]
    left = [[(0, 0), (0, 10), (5, 10), *reversed(border), (5, 0), (0, 0)]]
    right = [[(5, 0), *border, (5, 10), (10, 10), (10, 0), (5, 0)]]
    df = polygons(spark, [left, right])
    for line in ("-simplify 20%", "-simplify dp interval=0.4", "-simplify visvalingam 10%"):
        out = Session(spark, {"s": df}).run(line)
        found = [planar.area(overlay.rings([[p.asDict() for p in part] for part in x.geom.parts])) for x in out.collect()]
        assert sum(found) == pytest.approx(100) and geometry.neighbours(out).count() == 1
        assert out.select(F.sum(F.size(F.col("geom.parts")[0]))).first()[0] < 120
    assert Session(spark, {"s": df}).run("-simplify 0% keep-shapes").where("geom is null").count() == 0
    with pytest.raises(ValueError):
        shapes.simplify_shared(df)


def test_buffers(spark):
    line = spark.createDataFrame([(0, {"type": "polyline", "parts": [[{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}]]}), (1, None)], f"{FID} long, geom {geometry.GEOM}")
    out = Session(spark, {"l": line}).run("-buffer 1 vertices=64").orderBy(FID).collect()
    assert planar.area(overlay.rings([[p.asDict() for p in part] for part in out[0].geom.parts])) == pytest.approx(20 + math.pi, rel=2e-3) and out[1].geom is None
    poly = polygons(spark, [square(0, 0, 10), square(20, 0, 1)])
    shrunk = Session(spark, {"p": poly}).run("-buffer -1").orderBy(FID).select(geometry.planar_area(F.col("geom")).alias("a")).collect()
    assert shrunk[0].a == pytest.approx(64) and shrunk[1].a is None


def test_lines_to_polygons_rotate_snap_smooth_dots(spark):
    kind = f"{FID} long, geom {geometry.GEOM}"
    lines = spark.createDataFrame([(k, {"type": "polyline", "parts": [[{"x": float(x), "y": float(y)} for x, y in p]]}) for k, p in enumerate([[(0, 0), (4, 0), (4, 4)], [(4, 4), (0, 4), (0, 0)], [(0, 2), (4, 2)], [(9, 9), (10, 9)]])], kind)
    faces = overlay.polygons_from_lines(lines)
    assert sorted(x.a for x in faces.select(geometry.planar_area(F.col("geom")).alias("a")).collect()) == [8.0, 8.0]
    point = spark.createDataFrame([(0, {"type": "point", "parts": [[{"x": 30.0, "y": 20.0}]]})], kind)
    turned = shapes.rotate_sphere(point, 40, 30, 10)
    back = shapes.rotate_sphere(turned, 40, 30, 10, invert=True).first().geom.parts[0][0]
    assert (back.x, back.y) == pytest.approx((30, 20)) and turned.first().geom.parts[0][0].x != pytest.approx(70)
    snapped = overlay.snap(polygons(spark, [[[(0.1, 0.1), (0.1, 0.9), (0.12, 1.1), (1.1, 0.9), (0.9, -0.1), (0.1, 0.1)]]]), 1.0).first().geom.parts[0]
    assert [(p.x, p.y) for p in snapped] == [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    zigzag = spark.createDataFrame([(0, {"type": "polyline", "parts": [[{"x": float(k), "y": 0.1 * (k % 2)} for k in range(21)]]})], kind)
    flat = shapes.smooth(zigzag, 4.0).first().geom.parts[0]
    assert len(flat) == 21 and (flat[0].x, flat[-1].x) == (0, 20) and max(abs(p.y - 0.05) for p in flat[5:-5]) < 0.02
    made = shapes.dots(polygons(spark, [square(0, 0, 1), square(5, 5, 1)], n=[30.0, 10.0]), ["n"], per_dot=2)
    spots = made.select("n", F.col("geom.parts")[0][0].alias("p")).collect()
    assert sorted(x.n for x in spots) == [10.0] * 5 + [30.0] * 15 and all((0 < x.p.x < 1) if x.n == 30 else (5 < x.p.x < 6) for x in spots)


def test_dissolve_lines_and_directions(spark):
    kind = f"{FID} long, g string, geom {geometry.GEOM}"
    part = lambda *p: {"type": "polyline", "parts": [[{"x": float(x), "y": float(y)} for x, y in p]]}
    lines = spark.createDataFrame([(0, "a", part((0, 0), (1, 0))), (1, "a", part((2, 0), (1, 0))), (2, "a", part((5, 5), (6, 6))), (3, "b", part((2, 0), (3, 0)))], kind)
    out = {x.g: [[(p.x, p.y) for p in q] for q in x.geom.parts] for x in Session(spark, {"l": lines}).run("-dissolve g").collect()}
    assert sorted(map(len, out["a"])) == [2, 3] and out["b"] == [[(2, 0), (3, 0)]]
    points = spark.createDataFrame([(0, {"type": "point", "parts": [[{"x": 90.0, "y": 45.0}]]}), (1, {"type": "point", "parts": [[{"x": -90.0, "y": 45.0}]]})], f"{FID} long, geom {geometry.GEOM}")
    top = geometry.dissolve_shapes(points, [], sphere=True).first().geom.parts[0][0]
    assert top.y == pytest.approx(90)
    plan = geometry.dissolve_shapes(points, [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbering_over_many_partitions(spark):
    """Written rows have each number once and in order, whatever the number of partitions and with plans that change while they run."""
    df = spark.range(0, 60_000, 1, 13).select(F.col("id").alias(FID), (F.col("id") * 7919 % 60_013).cast("double").alias("v"), F.lit("x" * 40).alias("pad"))
    for partitions in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            out = rows.sort(df, "v")
            got = out.select(FID, "v").collect()
            assert sorted(r[FID] for r in got) == list(range(60_000))
            assert [r.v for r in sorted(got, key=lambda r: r[FID])] == sorted(r.v for r in got)
            both = rows.merge_layers([df, df])
            assert both.count() == len(both.select(FID).distinct().collect()) == 120_000
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_null_keys_meet_without_a_product(spark):
    a = spark.range(3000).select(F.col("id").alias(FID), F.when(F.col("id") < 5, F.col("id")).alias("k"))
    b = spark.range(3000).select(F.col("id").alias(FID), F.when(F.col("id") < 3, F.col("id")).alias("k"), F.lit(1.0).alias("v"))
    out = joins.join(a, b, ("k", "k"), calc="n = count(), s = sum(v)")
    assert {(r.k, r.n, r.s) for r in out.select("k", "n", "s").collect()} == {(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 0, 0.0), (4, 0, 0.0), (None, 2997, 2997.0)}
    told = joins.match_statistics(a, b, ("k", "k"))
    assert (told["matched"], told["used"], told["unmatched_keys"]) == (2998, 3000, [3, 4])


def test_classes(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([3, 12, 18, 27, 33, 41, 58, 66, 79, 93])], f"{FID} long, v double")
    b = classes.nice_breaks(df, "v", 4)
    assert len(b) == 3 and len({round(y - x, 9) for x, y in zip(b, b[1:], strict=False)}) == 1 and all(x == round(x) for x in b)
    down = classes.classify(df, "v", breaks=[60.0, 30.0]).orderBy(FID).collect()
    assert [r["class"] for r in down] == [2, 2, 2, 2, 1, 1, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        classes.classify(df, "v", method="natural")
    cells = geometry.square_grid(spark, (0.0, 0.0, 8.0, 6.0), 1.0)
    out = classes.non_adjacent(cells, 5)
    by = {r[FID]: r["class"] for r in out.collect()}
    assert len(by) == 48 and all(by[r.a_fid] != by[r.b_fid] for r in geometry.neighbours(cells).collect())


def test_unknown_options_are_errors(spark):
    df = geometry.square_grid(spark, (0.0, 0.0, 2.0, 2.0), 1.0)
    for line in ("-sort col size=3", "-filter 'col > 0' nonsense", "-clip bbox=0,0,1,1 radius=2", "-classify col method=natural", "-i nowhere.csv colour=red", "-grid interval=1 type=triangle"):
        with pytest.raises(ValueError):
            Session(spark, {"s": df}).run(line)


def test_generated_layers_and_selections(spark):
    s = Session(spark)
    assert s.run("-grid bbox=0,0,4,2 interval=1").count() == 8
    assert s.run("-point-grid interval=1").count() == 8
    assert s.run("-rectangle bbox=0,0,4,2 offset=1").select(geometry.planar_area(F.col("geom"))).first()[0] == 24.0
    assert s.run("-graticule interval=30").where("type = 'parallel'").count() == 5
    two = polygons(spark, [[*square(0, 0, 1), *square(5, 5, 1)], square(9, 9, 1)])
    out = Session(spark, {"s": two}).run("-filter-geom bbox=0,0,2,2").orderBy(FID).collect()
    assert len(out[0].geom.parts) == 1 and out[1].geom is None
    holes = polygons(spark, [[*square(0, 0, 4), square(1, 1, 1)[0][::-1]]])
    assert Session(spark, {"s": holes}).run("-drop holes").select(geometry.planar_area(F.col("geom"))).first()[0] == 16.0
    halves = Session(spark, {"s": geometry.square_grid(spark, (0.0, 0.0, 8.0, 1.0), 1.0)}).run("-subdivide 'count() > 2'")
    assert sorted(r["count"] for r in halves.groupBy("layer_name").count().collect()) == [2, 2, 2, 2]


def test_expressions_of_shapes_and_text(spark):
    df = polygons(spark, [square(0, 0, 2), square(3, 0, 2)], v=[-1234.5, 7.0])
    out = Session(spark, {"s": df}).run("""-each 'a = this.bboxContainsPoint(1, 1), b = this.bboxIntersectsRectangle(4, 1, 9, 9), s = sprintf("%,.1f|%05d|%s", v, v, v)'""").orderBy(FID).collect()
    assert [(r.a, r.b) for r in out] == [(True, False), (False, True)]
    assert out[0].s == "−1,234.5|−1234|-1234.5" and out[1].s == "7.0|00007|7"
    one = Session(spark, {"s": df}).run("-dissolve calc='w = width(), h = height()'").first()
    assert (one.w, one.h) == (5.0, 2.0)
    lists = spark.createDataFrame([(0, [1.0, 2.0], [2, 4, 2], [0.0, 1.0, 2.0, 3.0]), (1, [10.0, 20.0], [0, 0, 0], [0.0, 1.0, 2.0, 3.0])], f"{FID} long, l array<double>, c array<int>, b array<double>")
    assert Session(spark, {"s": lists}).run("-dissolve calc='t = sums(l)'").first().t == [11.0, 22.0]
    assert [r.m for r in Session(spark, {"s": lists}).run("-each 'm = int_median(c, b)'").orderBy(FID).collect()] == [1.5, None]


def test_files_of_shapes(spark, tmp_path):
    df = polygons(spark, [square(0, 0, 1), [*square(2, 2, 4), square(3, 3, 1)[0][::-1]]], name=["a, \"b\"", "ü & <c>"], n=[1.5, -2.0])
    shape = lambda d: [[[(p.x, p.y) for p in part] for part in r.geom.parts] for r in d.orderBy(FID).collect()]
    s = Session(spark, {"s": df})
    for name in ("out.kml", "out.shp"):
        s.run(f"-o {tmp_path}/{name} " + ("format=shapefile" if name.endswith("shp") else ""))
        back = files.read(spark, f"{tmp_path}/{name}")
        assert shape(back) == shape(df) and sorted(r.name for r in back.collect()) == sorted(r.name for r in df.collect())
    assert [r.n for r in files.read(spark, f"{tmp_path}/out.dbf").orderBy(FID).collect()] == [1.5, -2.0]
    s.run(f"-o {tmp_path}/g format=geoparquet")
    assert shape(files.read(spark, f"{tmp_path}/g")) == shape(df)
    s.run(f"-o {tmp_path}/one.geojson single bbox-index")
    whole = json.loads((tmp_path / "one.geojson").read_text())
    assert whole["type"] == "FeatureCollection" and [f["properties"]["n"] for f in whole["features"]] == [1.5, -2.0]
    assert shape(files.read(spark, f"{tmp_path}/one.geojson")) == shape(df)
    s.run(f"-o {tmp_path}/one.csv single")
    assert (tmp_path / "one.csv").read_text().startswith("name,n\n")
    assert sorted(r.name for r in files.read(spark, f"{tmp_path}/one.csv").collect()) == sorted(r.name for r in df.collect())
    with pytest.raises(ValueError):
        s.run(f"-o {tmp_path}/one.csv single")
    s.save(f"{tmp_path}/session")
    other = Session(spark)
    other.load(f"{tmp_path}/session")
    assert list(other.layers) == ["s"] and shape(other.layers["s"]) == shape(df)
    for r in df.collect():
        g = {"type": "polygon", "parts": [[p.asDict() for p in part] for part in r.geom.parts]}
        assert wkb.decode(wkb.encode(g)) == g
    assert list(kml.placemarks("<kml><Placemark><name>x</name><Point><coordinates>1,2,3</coordinates></Point></Placemark></kml>")) == [('{"name": "x"}', {"type": "point", "parts": [[{"x": 1.0, "y": 2.0}]]})]
    assert binary.shp_record(None) == bytes(4)


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title\nnote\nid,name\n" + "".join(f"0{k},n{k}\n" for k in range(50)))
    out = Session(spark).run(f"-i {tmp_path}/a.csv csv-skip-lines=2 string-fields=id csv-filter='name != \"n3\"'")
    assert [r.id for r in out.orderBy(FID).collect()] == [f"0{k}" for k in range(50) if k != 3] and [r[FID] for r in out.orderBy(FID).collect()] == list(range(49))
    (tmp_path / "f.txt").write_text("name    pop  area\nold ely  12  3.5\nyork      7  1\n")
    assert [tuple(r) for r in files.read(spark, f"{tmp_path}/f.txt").orderBy(FID).select("name", "pop", "area").collect()] == [("old ely", 12.0, 3.5), ("york", 7.0, 1.0)]
    (tmp_path / "q.csv").write_text('a,b\n"x\ny",1\nz,2\n')
    assert [r.a for r in files.read(spark, f"{tmp_path}/q.csv").orderBy(FID).collect()] == ["x\ny", "z"]
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text("v\n" + "\n".join(str(100 * k + j) for j in range(100 - 30 * k)) + "\n")
    many = files.read(spark, f"{tmp_path}/part*.csv")
    assert [(r[FID], r.v) for r in many.orderBy(FID).collect()] == list(enumerate([*range(100), *range(100, 170), *range(200, 240)]))
    (tmp_path / "d.json").write_text('{"x": {"rows": [[{"a": 1}, {"a": 2}], []]}}')
    assert [r.a for r in files.read(spark, f"{tmp_path}/d.json", json_path="x.rows[0]").orderBy(FID).collect()] == [1, 2]
    s = Session(spark)
    s.run("-i '[{\"a\": 1, \"b\": \"x\"}, {\"a\": 2}]' name=t")
    assert [(r.a, r.b) for r in s.layers["t"].orderBy(FID).collect()] == [(1.0, "x"), (2.0, None)]
    assert Session(spark).run("-i 'k,v\\n1,a\\n2,b' name=t -filter 'k > 1'").first().v == "b"
