"""Small fixtures: null rules, ties, expressions, readers and the session."""

import math

import pytest
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID
from geoflow.functions.expressions import ExpressionError, compile_value, parse, scope_of
from geoflow.operators import classes, geometry, groups, joins, rows
from geoflow.plans.session import Session, tokenise
from geoflow.sources import files


def layer(spark, schema, *data):
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(data)], f"{FID} long, {schema}")
    return df


def value(spark, source, schema="a double, s string, n double, b boolean", row=(3.0, "abc", None, True)):
    df = spark.createDataFrame([row], schema)
    return df.select(compile_value(source, scope_of(df.schema)).column.alias("v")).first().v


@pytest.mark.parametrize(
    ("source", "want"),
    [("a + 1", 4), ("s + a", "abc3"), ("n * 2", 0), ("n + 'x'", "nullx"), ("a / 0", math.inf), ("-7 % 3", -1), ("2 ** 3 ** 2", 512), ("a > 2 ? 'y' : 'n'", "y"), ("n == null", True), ("!s", False), ("n || 5", 5), ("s && a", "3"),
     ("Math.round(-2.5)", -2), ("round(2.345, 2)", 2.35), ("Math.max(a, 9, 2)", 9), ("s.substr(-2)", "bc"), ("s.slice(0, -1)", "ab"), ("s.indexOf('c')", 2), ("s.padStart(5, '*')", "**abc"), ("s.length", 3), ("s.replace('b', '-')", "a-c"),
     ("s.toUpperCase().includes('BC')", True), ("a.toFixed(2)", "3.00"), ("Number('12') + 1", 13), ("parseInt('42px')", 42), ("'a,b'.split(',').length", 2), ("[1, 2].join('-')", "1.0-2.0"), ("'1' == 1", True), ("'1' === 1", False), ("typeof a", "number"), ("format_dms(-12.5)", "-12°30'00\""), ("parse_dms('12°30′S')", -12.5)],
)
def test_expressions(spark, source, want):
    assert value(spark, source) == want


def test_expression_errors(spark):
    for bad in ("a +", "zzz + 1", "a.foo", "a = = 2", "#"):
        with pytest.raises(ExpressionError):
            value(spark, bad) if "=" not in bad else parse(bad)


def test_each_order_delete_and_chain(spark):
    df = layer(spark, "a double", (1.0,), (2.0,))
    out = rows.each(df, "b = a + 1, c = b * 2, x = y = 0, delete a")
    assert [r.asDict() for r in out.drop(FID).collect()] == [{"b": 2.0, "c": 4.0, "x": 0.0, "y": 0.0}, {"b": 3.0, "c": 6.0, "x": 0.0, "y": 0.0}]
    assert [r.b for r in rows.each(df, "b = 1", ids=[1]).orderBy(FID).collect()] == [None, 1.0]


def test_filter_needs_boolean(spark):
    df = layer(spark, "a double", (1.0,), (None,))
    with pytest.raises(ExpressionError):
        rows.filter_rows(df, "a + 1")
    assert rows.filter_rows(df, "a > 0").count() == 1
    assert rows.filter_rows(df, "a > 0", invert=True).count() == 1


def test_sort_nulls_last(spark):
    df = layer(spark, "a double", (None,), (1.0,), (math.nan,), (2.0,), (1.0,))
    order = lambda **o: [(r.a, r[FID]) for r in rows.sort(df.withColumn("was", F.col(FID)), "a", **o).orderBy(FID).collect()]
    assert [str(a) for a, _ in order()] == ["1.0", "1.0", "2.0", "nan", "None"]
    assert [str(a) for a, _ in order(descending=True)] == ["2.0", "1.0", "1.0", "nan", "None"]


def test_uniq(spark):
    df = layer(spark, "k string", ("a",), ("b",), ("a",), ("a",))
    ids = lambda **o: [r[FID] for r in rows.uniq(df, "k", **o).orderBy(FID).collect()]
    assert (ids(), ids(max_count=2), ids(invert=True)) == ([0, 1], [0, 1, 2], [2, 3])
    assert [r["index"] for r in rows.uniq(df, "k", index=True).orderBy(FID).collect()] == [1, 1, 2, 3]


def test_aggregates_of_nothing_and_nulls(spark):
    df = layer(spark, "x double, k string", (None, "a"), (4.0, "b"), (2.0, "b"), (math.nan, "a"))
    r = groups.calc(df, "n = count(), s = sum(x), m = mean(x), lo = min(x), md = mode(k), c = collect(x), f = first(x), l = last(k)").first()
    assert (r.n, r.s, r.m, r.lo, r.md, r.f, r.l) == (4, 6, 2, 0, "a", None, "a")
    assert r.c[:3] == [None, 4, 2]
    e = groups.calc(df.where("false"), "n = count(), s = sum(x), m = mean(x), e = every(x > 0), md = mode(k)").first()
    assert (e.n, e.s, e.m, e.e, e.md) == (0, 0, None, False, None)
    assert groups.dissolve(df.where("false"), [], calc="n = count()").count() == 0


def test_dissolve_order_and_where(spark):
    df = layer(spark, "k string, x double", ("b", 1.0), ("a", 2.0), ("b", None), ("c", 4.0))
    out = groups.dissolve(df, ["k"], sum_fields=["x"], calc="n = count()").orderBy(FID).collect()
    assert [(r.k, r.x, r.n) for r in out] == [("b", 1, 2), ("a", 2, 1), ("c", 4, 1)]
    assert groups.dissolve(df, ["k"], where="k == 'b'").count() == 3


def test_join_rules(spark):
    t = layer(spark, "k string, v double", ("a", 1.0), (None, 2.0), ("z", 3.0))
    s = layer(spark, "key string, w double, v double", ("a", 10.0, 7.0), ("a", 20.0, 8.0), (None, 30.0, 9.0), ("q", 40.0, 1.0))
    got = lambda **o: [tuple(r) for r in joins.join(t, s, ("k", "key"), **o).orderBy(FID).drop(FID).collect()]
    assert got() == [("a", 1.0, 10.0), (None, 2.0, 30.0), ("z", 3.0, None)]
    assert got(fields=["v"], force=True) == [("a", 7.0), (None, 9.0), ("z", 3.0)]
    assert got(calc="n = count(), m = mean(w)") == [("a", 1.0, 2, 15.0), (None, 2.0, 1, 30.0), ("z", 3.0, 0, None)]
    assert [r[2] for r in got(fields=["w"], duplication=True)] == [10.0, 30.0, None, 20.0]
    assert joins.join(t, s, ("k", "key"), fields=["w"], prefix="b_").columns[-1] == "b_w"
    assert joins.unmatched(t, s, ("k", "key")).count() == 1
    assert joins.unjoined(t, s, ("k", "key")).count() == 1
    with pytest.raises(ValueError):
        joins.join(t, s, ("k", "w"))
    with pytest.raises(ValueError):
        got(calc="n = count()", duplication=True)


def test_classify(spark):
    df = layer(spark, "x double", (0.0,), (3.0,), (5.0,), (7.0,), (10.0,), (100.0,), (None,))
    got = [r["class"] for r in classes.classify(df, "x", breaks=[3.0, 10.0], null_value=-2).orderBy(FID).collect()]
    assert got == [0, 1, 1, 1, 2, 2, -2]
    c = classes.classify(layer(spark, "x double", (3.0,), (6.0,), (9.0,)), "x", breaks=[1.0, 2.0, 4.0], continuous=True, values=[5.0, 6.0, 7.0, 8.0, 9.0], outer_breaks=(0, 8), save_as="c")
    assert [r.c for r in c.orderBy(FID).collect()] == [7.5, 8.5, None]


def test_geometry(spark):
    unit = spark.range(1).select(F.col("id").alias(FID), geometry.rectangle(*(F.lit(float(v)) for v in (0, 0, 1, 1))).alias("geom"))
    inside = lambda x, y: unit.select(geometry.contains(F.col("geom"), F.lit(x), F.lit(y)).alias("v")).first().v
    assert [inside(0.5, 0.5), inside(0.0, 0.5), inside(1.0, 1.0), inside(1.1, 0.5), inside(0.5, 0.0), inside(-0.1, 0.0)] == [True, True, True, False, True, False]
    r = unit.select(geometry.planar_area(F.col("geom")).alias("a"), geometry.length(geometry.densify(F.col("geom"), 0.3)).alias("l"), F.size(geometry.densify(F.col("geom"), 0.3)["parts"][0]).alias("n")).first()
    assert (r.a, round(r.l, 9), r.n) == (1.0, 4.0, 17)
    dense = spark.createDataFrame(unit.withColumn("geom", geometry.densify(F.col("geom"), 0.3)).collect(), unit.schema)
    assert len(dense.select(geometry.simplify(F.col("geom"), 0.01).alias("s")).first().s.parts[0]) == 5
    two = unit.union(spark.range(1).select((F.col("id") + 1).alias(FID), geometry.rectangle(*(F.lit(float(v)) for v in (1, 0, 2, 1))).alias("geom")))
    whole = groups.dissolve(two, [])
    assert whole.select(geometry.planar_area(F.col("geom")).alias("a"), geometry.length(F.col("geom")).alias("l")).first() == (2.0, 6.0)
    assert geometry.neighbours(two).collect()[0].border == 1.0


def test_text_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;name;big;x\n01;"a ""q""; b";1,234;\n02;;5;NA\n03;c\n')
    df = files.read_delimited(spark, str(p), string_fields=["id"])
    assert df.dtypes == [("id", "string"), ("name", "string"), ("big", "double"), ("x", "string")]
    assert [tuple(r) for r in df.collect()] == [("01", 'a "q"; b', 1234.0, ""), ("02", "", 5.0, "NA"), ("03", "c", None, "")]
    assert files.sniff("a\tb,c") == "\t" and files.unique_names(["a", "a", "b"]) == ["a", "a2", "b"]


def test_geojson_round_trip(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}},{"type":"Feature","properties":{"n":"q"},"geometry":null},{"type":"Feature","properties":{"n":"r"},"geometry":{"type":"Point","coordinates":[3,4]}}]}')
    df = files.read_geojson(spark, str(p))
    assert [(r.n, r.geom and r.geom.type) for r in df.orderBy(FID).collect()] == [("p", "polygon"), ("q", None), ("r", "point")]
    files.write(df, str(tmp_path / "b.geojson"))
    back = files.read_geojson(spark, str(tmp_path / "b.geojson"), lines=True)
    assert sorted(back.select(geometry.planar_area(F.col("geom")).alias("a"), "n").collect(), key=lambda r: r.n)[0].a == 1.0
    files.write(df, str(tmp_path / "c.csv"))
    assert sorted(r.n for r in spark.read.csv(str(tmp_path / "c.csv"), header=True).collect()) == ["p", "q", "r"]


def test_session(spark):
    s = Session(spark, {"data": layer(spark, "g string, a double", ("x", 1.0), ("y", 3.0))})
    out = s.run("""-vars N=2 -calc 'SUM = sum(a)' -each 'pct = a / SUM * 100' -if 'SUM > 3' -each 'big = {{N}}' -else -each 'big = 0' -endif""")
    assert [(r.pct, r.big) for r in out.orderBy(FID).collect()] == [(25.0, 2.0), (75.0, 2.0)]
    s.run("-calc 'sum(a)' + name=stats")
    assert [tuple(r) for r in s.layers["stats"].collect()] == [("sum(a)", 4.0, "data")]
    assert tokenise("a.csv -filter 'x == 1' # no\n") and [c[0] for c in tokenise("a.csv -filter 'x == 1' -o b.csv")] == ["i", "filter", "o"]
    with pytest.raises(ValueError):
        s.run("-nonsense")


def test_stream(spark, tmp_path):
    spark.range(5).selectExpr("id as a", "cast(id as timestamp) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, ts timestamp").parquet(str(tmp_path / "in"))
    out = rows.filter_rows(rows.each(stream, "b = a * 2"), "b > 2")
    q = out.writeStream.format("memory").queryName("stream_rows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.b for r in spark.table("stream_rows").collect()) == [4.0, 6.0, 8.0]
