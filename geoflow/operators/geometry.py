"""Geometry as nested columns: geom struct<type, parts array<array<struct<x, y>>>>.

Measures and predicates are column functions.  Rings run clockwise if outer; holes the other way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from geoflow.functions.aggregates import FID
from geoflow.functions.expressions import Value
from geoflow.operators.rows import field

#: Fixed value: the sphere's radius in metres.
RADIUS = 6378137.0
GEOM = "struct<type:string,parts:array<array<struct<x:double,y:double>>>>"


def point(x: Column, y: Column) -> Column:
    """A point, or null where a coordinate is missing or not finite."""
    x, y = x.cast("double"), y.cast("double")
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(ok, F.struct(F.lit("point").alias("type"), F.array(F.array(F.struct(x.alias("x"), y.alias("y")))).alias("parts"))).cast(GEOM)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A clockwise box as a polygon."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.struct(F.lit("polygon").alias("type"), F.array(F.array(at(x0, y0), at(x0, y1), at(x1, y1), at(x1, y0), at(x0, y0))).alias("parts")).cast(GEOM)


def points_from_xy(df: DataFrame, x: str | None = None, y: str | None = None) -> DataFrame:
    """geom from two fields, found by the usual names if not given; text may be numbers or degrees, minutes and seconds."""
    from geoflow.functions.expressions import parse_dms

    lower = {c.lower(): c for c in df.columns}
    x = x or next((lower[n] for n in ("lng", "lon", "long", "longitude", "x") if n in lower), None)
    y = y or next((lower[n] for n in ("lat", "latitude", "y") if n in lower), None)
    if x is None or y is None:
        raise ValueError("no coordinate fields found")
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}  # their plans stay small without the text's
    as_number = lambda c: field(c).cast("double") if c in numeric else F.coalesce(field(c).try_cast("double"), parse_dms(field(c).cast("string")))
    return df.withColumn("geom", point(as_number(x), as_number(y)))


def coordinates(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def bbox(geom: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax>, null for no coordinates."""
    at = coordinates(geom)
    side = lambda f, n: f(F.transform(at, lambda p: p[n]))
    return F.when(F.size(at) > 0, F.struct(side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax")))


def segments(part: Column) -> Column:
    """struct<a, b> for each pair of neighbours."""
    return F.zip_with(F.slice(part, F.lit(1), F.greatest(F.size(part) - 1, F.lit(0))), F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(items: Column, each) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda t, s: t + each(s))


def ring_area(part: Column) -> Column:
    """Positive if clockwise."""
    return total(segments(part), lambda s: (s["b"]["x"] - s["a"]["x"]) * (s["b"]["y"] + s["a"]["y"])) / 2


def planar_area(geom: Column) -> Column:
    return F.abs(total(geom["parts"], ring_area))


def spherical_ring_area(part: Column) -> Column:
    rad = math.pi / 180
    return total(segments(part), lambda s: (s["b"]["x"] - s["a"]["x"]) * rad * (2 + F.sin(s["a"]["y"] * rad) + F.sin(s["b"]["y"] * rad))) * (RADIUS * RADIUS / 2)


def spherical_area(geom: Column) -> Column:
    return F.abs(total(geom["parts"], spherical_ring_area))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres along the great circle."""
    r = F.radians
    h = F.pow(F.sin((r(by) - r(ay)) / 2), 2) + F.cos(r(ay)) * F.cos(r(by)) * F.pow(F.sin((r(bx) - r(ax)) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def length(geom: Column, *, sphere: bool = False) -> Column:
    step = (lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])) if sphere else (lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))
    return total(geom["parts"], lambda p: total(segments(p), step))


def compactness(geom: Column) -> Column:
    """4 pi area / perimeter squared."""
    p = length(geom)
    return F.when(p > 0, 4 * math.pi * planar_area(geom) / (p * p)).otherwise(0.0)


def largest_ring(geom: Column) -> Column:
    return F.array_max(F.transform(geom["parts"], lambda p: F.struct(F.abs(ring_area(p)).alias("a"), p.alias("p"))))["p"]


def centroid(geom: Column) -> Column:
    """Of the largest ring, holes left out."""
    ring = largest_ring(geom)
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    area = total(segments(ring), cross)
    at = lambda n: total(segments(ring), lambda s: (s["a"][n] + s["b"][n]) * cross(s)) / (3 * area)
    return F.when(area != 0, F.struct(at("x").alias("x"), at("y").alias("y")))


def this_values(df: DataFrame) -> dict[str, Value]:
    """What `this` offers of a shape."""
    g, num = F.col("geom"), lambda c: Value(c, "num")
    b = bbox(g)
    c = centroid(g)
    return {"partCount": num(F.coalesce(F.size(g["parts"]), F.lit(0)).cast("double")), "isNull": Value(g.isNull(), "bool"), "originalArea": num(planar_area(g)), "bounds": Value(F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"]), "list"), "bbox": Value(F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"]), "list"), "area": num(planar_area(g)), "planarArea": num(planar_area(g)), "perimeter": num(length(g)), "length": num(length(g)), "compactness": num(compactness(g)), "width": num(b["xmax"] - b["xmin"]), "height": num(b["ymax"] - b["ymin"]), "centroidX": num(c["x"]), "centroidY": num(c["y"]), "x": num(g["parts"][0][0]["x"]), "y": num(g["parts"][0][0]["y"])}


def affine(df: DataFrame, *, shift: tuple[float, float] = (0, 0), scale: float = 1, rotate: float = 0, anchor: tuple[float, float] | None = None, where: str | None = None) -> DataFrame:
    """Scales, then turns (degrees, anticlockwise) about the anchor (the layer's middle if none), then shifts."""
    from geoflow.operators.rows import condition

    if anchor is None and (scale != 1 or rotate):
        r = extent(df).first()
        anchor = ((r.xmin + r.xmax) / 2, (r.ymin + r.ymax) / 2)
    ax, ay = anchor or (0, 0)
    c, s = math.cos(math.radians(rotate)) * scale, math.sin(math.radians(rotate)) * scale
    move = lambda p: F.struct(((p["x"] - ax) * c - (p["y"] - ay) * s + ax + shift[0]).alias("x"), ((p["x"] - ax) * s + (p["y"] - ay) * c + ay + shift[1]).alias("y"))
    moved = map_points(F.col("geom"), move)
    return df.withColumn("geom", moved if where is None else F.when(condition(df, where), moved).otherwise(F.col("geom")))


def map_points(geom: Column, f) -> Column:
    return F.when(geom.isNotNull(), F.struct(geom["type"].alias("type"), F.transform(geom["parts"], lambda part: F.transform(part, f)).alias("parts"))).cast(GEOM)


def round_points(geom: Column, precision: float) -> Column:
    k = 1 / precision
    return map_points(geom, lambda p: F.struct((F.floor(p["x"] * k + 0.5) / k).alias("x"), (F.floor(p["y"] * k + 0.5) / k).alias("y")))


def densify(geom: Column, interval: float) -> Column:
    """Points at even steps of at most `interval` on each segment, the same ones whichever way it runs."""

    def steps(s: Column) -> Column:
        n = F.greatest(F.ceil(F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]) / interval), F.lit(1))
        p, q = F.least(s["a"], s["b"]), F.greatest(s["a"], s["b"])
        place = lambda i, c: p[c] + (q[c] - p[c]) * F.when(s["a"] <= s["b"], i).otherwise(n - i) / n
        return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.when(i == 0, s["a"]).otherwise(F.struct(place(i, "x").alias("x"), place(i, "y").alias("y"))))

    part = lambda p: F.concat(F.flatten(F.transform(segments(p), steps)), F.slice(p, -1, 1))
    return F.struct(geom["type"].alias("type"), F.transform(geom["parts"], part).alias("parts")).cast(GEOM)


def extent(df: DataFrame) -> DataFrame:
    b = bbox(F.col("geom"))
    return df.select(b.alias("b")).agg(*((F.min if n.endswith("min") else F.max)(F.col("b")[n]).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")))


def rectangles(df: DataFrame) -> DataFrame:
    b = bbox(F.col("geom"))
    return df.withColumn("geom", rectangle(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def explode_parts(df: DataFrame) -> DataFrame:
    """A row for each part; rows without a shape stay.  Holes go with the last outer ring before them."""
    g = F.col("geom")
    outer = F.filter(F.transform(g["parts"], lambda p, i: F.when((g["type"] != "polygon") | (ring_area(p) >= 0) | (i == 0), i).otherwise(-1)), lambda i: i >= 0)
    until = F.concat(F.slice(outer, F.lit(2), F.greatest(F.size(outer), F.lit(1))), F.array(F.size(g["parts"])))
    groups = F.zip_with(outer, until, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = df.select("*", F.posexplode_outer(F.when(g.isNotNull(), groups)).alias("_n", "_r"))
    return out.withColumn("geom", F.when(F.col("_r").isNotNull(), F.struct(g["type"].alias("type"), F.slice(g["parts"], F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a")).alias("parts"))).cast(GEOM)).withColumn("part", F.coalesce("_n", F.lit(0))).drop("_n", "_r")


def point_grid(spark, box: tuple[float, float, float, float], interval: float) -> DataFrame:
    """Points at the middles of square cells, row by row from the lower left."""
    x0, y0, x1, y1 = box
    cols, rows = max(1, int((x1 - x0) / interval)), max(1, int((y1 - y0) / interval))
    dx, dy = ((x1 - x0) - (cols - 1) * interval) / 2, ((y1 - y0) - (rows - 1) * interval) / 2
    at = spark.range(cols * rows).select(F.col("id").alias(FID))
    return at.withColumn("geom", point(F.lit(x0 + dx) + (F.col(FID) % cols) * interval, F.lit(y0 + dy) + F.floor(F.col(FID) / cols) * interval))


def square_grid(spark, box: tuple[float, float, float, float], interval: float) -> DataFrame:
    x0, y0, x1, y1 = box
    cols, rows = max(1, math.ceil((x1 - x0) / interval)), max(1, math.ceil((y1 - y0) / interval))
    at = spark.range(cols * rows).select(F.col("id").alias(FID), (F.col("id") % cols).alias("col"), F.floor(F.col("id") / cols).alias("row"))
    x, y = F.lit(x0) + F.col("col") * interval, F.lit(y0) + F.col("row") * interval
    return at.withColumn("geom", rectangle(x, y, x + interval, y + interval))


def split_on_grid(df: DataFrame, cols: int, rows: int, *, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """layer_name r{row}c{col} by the middle of each shape's box."""
    if box is None:
        r = extent(df).first()
        box = (r.xmin, r.ymin, r.xmax, r.ymax)
    b = bbox(F.col("geom"))
    place = lambda mid, low, high, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((mid - low) / ((high - low) or 1) * n))).cast("string")
    c = place((b["xmin"] + b["xmax"]) / 2, box[0], box[2], cols)
    r = place((b["ymin"] + b["ymax"]) / 2, box[1], box[3], rows)
    return df.withColumn("layer_name", F.concat(F.lit("r"), r, F.lit("c"), c))


def located(geom: Column, x: Column, y: Column) -> Column:
    """0 outside, 1 inside by the even-odd rule over all rings, 2 on the border: one fold over all segments."""

    def step(t: Column, z: Column) -> Column:
        a, b = z["a"], z["b"]
        low, high = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
        level = a["y"] + F.try_divide((x - a["x"]) * (b["y"] - a["y"]), b["x"] - a["x"])
        upright = y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return F.when((t == 2) | (x < low) | (x > high), t).when(F.when(low == high, upright).otherwise(level == y), 2).when((low < x) & (level > y), 1 - t).otherwise(t)

    return F.aggregate(F.flatten(F.transform(geom["parts"], segments)), F.lit(0), step)


def contains(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings; the border belongs to the polygon."""
    return located(geom, x, y) > 0


def meets_box(geom: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a shape has a point in a box: a vertex, a segment that crosses it, or a polygon all around it."""
    x0, y0, x1, y1 = map(float, box)
    b = bbox(geom)
    near = (b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0)
    inside = F.exists(coordinates(geom), lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))
    side = lambda z, x, y: F.signum((z["b"]["x"] - z["a"]["x"]) * (y - z["a"]["y"]) - (z["b"]["y"] - z["a"]["y"]) * (x - z["a"]["x"]))

    def cuts(z: Column) -> Column:
        over = (F.least(z["a"]["x"], z["b"]["x"]) <= x1) & (F.greatest(z["a"]["x"], z["b"]["x"]) >= x0) & (F.least(z["a"]["y"], z["b"]["y"]) <= y1) & (F.greatest(z["a"]["y"], z["b"]["y"]) >= y0)
        sides = [side(z, F.lit(x), F.lit(y)) for x in (x0, x1) for y in (y0, y1)]
        return over & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    crossed = F.exists(F.flatten(F.transform(geom["parts"], segments)), cuts)
    return F.coalesce(near & (inside | ((geom["type"] != "point") & crossed) | ((geom["type"] == "polygon") & contains(geom, F.lit(x0), F.lit(y0)))), F.lit(False))


def filter_geom(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Shapes keep the parts that meet a box; holes go with their ring, and rows without a part lose their shape."""
    out = explode_parts(df.withColumn("_f", F.col(FID)))
    kept = out.where(meets_box(F.col("geom"), box)).groupBy("_f").agg(F.max("geom.type").alias("type"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "geom.parts"))), lambda z: z["parts"])).alias("parts"))
    kept = kept.select("_f", F.struct("type", "parts").cast(GEOM).alias("_geom"))
    return df.join(kept, F.col(FID) == F.col("_f"), "left").withColumn("geom", F.col("_geom")).drop("_f", "_geom")


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """(_p, _g): the `__fid` pairs of points (their first) within polygons.

    Points fall into one cell, polygons into those of their boxes; equal cells meet and are tested exactly.  Without a
    cell, its size follows from the polygons' boxes, so that they fall into about nine cells each.
    """
    from geoflow.operators.overlay import cell_size

    cell = cell or cell_size(polygons)
    at = points.where("geom is not null").select(F.col(FID).alias("_p"), F.col("geom")["parts"][0][0]["x"].alias("_x"), F.col("geom")["parts"][0][0]["y"].alias("_y"))
    at = at.withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell)})
    b = bbox(F.col("geom"))
    over = lambda low, high: F.sequence(F.floor(F.col("_b")[low] / cell), F.floor(F.col("_b")[high] / cell))
    shapes = polygons.where("geom is not null").select(F.col(FID).alias("_g"), F.col("geom").alias("_shape"), b.alias("_b"))
    shapes = shapes.withColumn("_cx", F.explode(over("xmin", "xmax"))).withColumn("_cy", F.explode(over("ymin", "ymax")))
    near = F.col("_x").between(F.col("_b.xmin"), F.col("_b.xmax")) & F.col("_y").between(F.col("_b.ymin"), F.col("_b.ymax"))
    return at.join(shapes, ["_cx", "_cy"]).where(near).where(contains(F.col("_shape"), F.col("_x"), F.col("_y"))).select("_p", "_g")


def join_points_to_polygons(polygons: DataFrame, points: DataFrame, cell: float | None = None, **options) -> DataFrame:
    """Each polygon receives the points within it, by the rules of attach()."""
    from geoflow.operators.joins import attach

    pairs = point_in_polygon(points, polygons, cell)
    found = pairs.join(points.drop("geom"), F.col("_p") == F.col(FID)).select(F.col("_g").alias("_t"), *points.drop("geom").columns)
    return attach(polygons, found, options.pop("fields", []), **options)


def join_polygons_to_points(points: DataFrame, polygons: DataFrame, cell: float | None = None, **options) -> DataFrame:
    """Each point receives the polygons around it, smallest `__fid` first."""
    from geoflow.operators.joins import attach

    pairs = point_in_polygon(points, polygons, cell)
    found = pairs.join(polygons.drop("geom"), F.col("_g") == F.col(FID)).select(F.col("_p").alias("_t"), *polygons.drop("geom").columns)
    return attach(points, found, options.pop("fields", []), **options)


def join_near_points(target: DataFrame, source: DataFrame, most: float, **options) -> DataFrame:
    """Each point receives the points within a planar distance, smallest `__fid` first.

    Points at one place have the same matches, which are made and reduced once for each place.
    """
    from geoflow.operators.joins import attach

    t, s = target.withColumn("_place", place("geom")), source.withColumn("_place", place("geom"))
    near = near_places(t, s, most)
    found = s.drop("geom").join(near, F.col("_place") == F.col("_b")).select(F.col("_a").alias("_t"), *source.drop("geom").columns)
    return attach(t, found, options.pop("fields", []), on="_place", **options).drop("_place")


def place(geom: str) -> Column:
    """Where a point is (its first); null without a shape.  -0 is 0."""
    at = F.col(geom)["parts"][0][0]
    return F.when(F.col(geom).isNotNull(), F.struct((at["x"] + 0.0).alias("x"), (at["y"] + 0.0).alias("y")))


def near_places(target: DataFrame, source: DataFrame, most: float) -> DataFrame:
    """(_a, _b, _d): planar distances up to `most` between the distinct `_place`s of both, by cells of that size and their eight neighbours."""
    a, b = (df.where("_place is not null").select(F.col("_place").alias(n)).distinct() for df, n in ((target, "_a"), (source, "_b")))
    # never null: else Spark looks for null cells among the points, before it makes them distinct
    cell = lambda c: F.coalesce(F.floor(F.col(c) / most), F.lit(0))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = a.withColumn("_cx", around("_a.x")).withColumn("_cy", around("_a.y"))
    b = b.withColumns({"_cx": cell("_b.x"), "_cy": cell("_b.y")})
    d = F.hypot(F.col("_a.x") - F.col("_b.x"), F.col("_a.y") - F.col("_b.y"))
    return a.join(b, ["_cx", "_cy"]).withColumn("_d", d).where(F.col("_d") <= most).select("_a", "_b", "_d")


def near_points(target: DataFrame, source: DataFrame, most: float, *, digits: int | None = None) -> DataFrame:
    """(_t, _s, _d): planar distances up to `most` between points, rounded to `digits`; measured once for each pair of places."""
    t, s = (df.withColumn("_place", place("geom")) for df in (target, source))
    return _met(t, s, _rounded(near_places(t, s, most), digits)).select("_t", "_s", "_d")


def near_pairs(df: DataFrame, most: float, *, digits: int | None = None) -> DataFrame:
    """(_t, _s, _d) of near_points() within one table, each two points once: `_t` is the smaller `__fid`."""
    t = df.withColumn("_place", place("geom"))
    out = _met(t, t, _rounded(near_places(t, t, most).where("_a <= _b"), digits), once=True).where("_t < _s or not _own and _t > _s")
    return out.select(F.least("_t", "_s").alias("_t"), F.greatest("_t", "_s").alias("_s"), "_d")


def _rounded(near: DataFrame, digits: int | None) -> DataFrame:
    return near if digits is None else near.withColumn("_d", F.round("_d", digits))


#: Points of one place that meet others as one row, on average.
BLOCK = 512


def _blocks(df: DataFrame, key: str, number: str, ids: str) -> DataFrame:
    """(key, number, ids): each `_place`'s `__fid`s in numbered blocks of about BLOCK, dealt by hash, so that no place is gathered."""
    at = df.where("_place is not null").select(F.col(FID).alias("_f"), "_place")
    counts = at.groupBy(F.col("_place").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    dealt = at.join(counts, F.col("_place") == F.col("_of")).withColumn(number, F.pmod(F.xxhash64("_f"), F.col("_n")))
    return dealt.groupBy(F.col("_place").alias(key), number).agg(F.collect_list("_f").alias(ids))


def _met(target: DataFrame, source: DataFrame, near: DataFrame, *, once: bool = False) -> DataFrame:
    """(_t, _s, _d, _own): all points of the places that are near each other.

    once: two blocks of one place meet once, and a block meets itself, which `_own` tells.  Pairs of blocks are dealt over
    the tasks and listed there, as a few places can have most of the pairs.
    """
    spark = near.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    out = near.join(_blocks(target, "_ka", "_i", "_ts"), F.col("_a") == F.col("_ka")).join(_blocks(source, "_kb", "_j", "_ss"), F.col("_b") == F.col("_kb"))
    out = out.where("_a < _b or _i <= _j") if once else out
    out = out.withColumn("_own", F.expr("_a = _b and _i = _j")).repartition(tasks, "_a", "_b", "_i", "_j").select("_ts", "_ss", "_d", "_own")
    # Spark doesn't compile a transform() into the loop over _ss, which keeps its rows until its next input: those of one _t, not of all
    return out.withColumn("_t", F.explode(F.transform("_ts", lambda t: t))).withColumn("_s", F.explode("_ss"))


def dissolve_shapes(df: DataFrame, fields: list[str], *, weight: str | None = None, multipart: bool = False, overlapping: bool = False, sphere: bool = False) -> DataFrame:
    """(__fid, geom) of each group: points to their weighted mean, polygons to their outline, lines joined end to end; parts put together if asked.

    sphere: the mean of points in degrees is that of their directions.  overlapping: polygons are cut at each other
    first; else only edges that two share whole go.  Points never leave the JVM.
    """
    from geoflow.operators import overlay

    g = F.col("geom")
    keys = [field(f) for f in fields]
    k = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))
    rows = df.withColumn("_k", k)
    kinds = {r[0] for r in df.where("geom is not null").select("geom.type").distinct().collect()}
    if multipart:
        together = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(FID).alias("f"), g["parts"].alias("p")))), lambda z: z["p"]))
        whole = rows.groupBy("_k").agg(F.min(FID).alias(FID), F.max(g["type"]).alias("_kind"), together.alias("_parts"))
        return whole.select(FID, F.when(F.col("_kind").isNotNull(), F.struct(F.col("_kind").alias("type"), F.col("_parts").alias("parts")).cast(GEOM)).alias("geom"))
    w = F.coalesce(field(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    x, y = g["parts"][0][0]["x"], g["parts"][0][0]["y"]
    ok = g.isNotNull() & (g["type"] == "point")
    mean = lambda v: F.sum(F.when(ok, v * w)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0))
    if sphere:
        turn = (F.cos(F.radians(y)) * F.cos(F.radians(x)), F.cos(F.radians(y)) * F.sin(F.radians(x)), F.sin(F.radians(y)))
        one = rows.groupBy("_k").agg(F.min(FID).alias(FID), *(mean(v).alias(n) for v, n in zip(turn, "abc", strict=True)))
        out = one.select("_k", FID, point(F.degrees(F.atan2("b", "a")), F.degrees(F.atan2(F.col("c"), F.hypot("a", "b")))).alias("geom"))
    else:
        out = rows.groupBy("_k").agg(F.min(FID).alias(FID), mean(x).alias("_x"), mean(y).alias("_y")).select("_k", FID, point(F.col("_x"), F.col("_y")).alias("geom"))
    for kind, made in (("polygon", lambda: overlay.outlines(df, keys, overlapping=overlapping)), ("polyline", lambda: overlay.chained_lines(df, keys))):
        if kind in kinds:
            shapes = made().withColumnRenamed("_k", "_k2")
            out = out.join(shapes, F.col("_k").eqNullSafe(F.col("_k2")), "left").withColumn("geom", F.coalesce("geom", overlay.shaped(kind, F.col("parts")))).drop("_k2", "parts")
    return out.select(FID, "geom")


def inner_lines(df: DataFrame) -> DataFrame:
    """(a_fid, b_fid, line): each edge that two polygons share."""
    g = F.col("geom")
    edge = df.select(F.col(FID).alias("f"), F.explode(F.flatten(F.transform(g["parts"], segments))).alias("s"))
    edge = edge.select("f", F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q"))
    return edge.groupBy("p", "q").agg(F.sort_array(F.collect_set("f")).alias("o")).where(F.size("o") > 1).select(F.col("o")[0].alias("a_fid"), F.col("o")[1].alias("b_fid"), F.struct(F.lit("polyline").alias("type"), F.array(F.array("p", "q")).alias("parts")).cast(GEOM).alias("line"))


def neighbours(df: DataFrame) -> DataFrame:
    """(a_fid, b_fid, border): pairs of polygons with the length of the edges they share."""
    return inner_lines(df).groupBy("a_fid", "b_fid").agg(F.sum(length(F.col("line"))).alias("border"))


def simplify(geom: Column, interval: float) -> Column:
    """Douglas-Peucker on each part alone; end points stay, rings that fall under four points go."""
    from geoflow.operators.shapes import simplify_parts

    return simplify_parts(geom, interval, method="dp")
