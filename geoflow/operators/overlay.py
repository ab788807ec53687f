"""Overlay of polygon layers: each shape meets the neighbours whose boxes overlap its own, and no others.

Pairs of neighbours come from cells of boxes by equi-joins; the geometry of one shape and its neighbours is one
Python call, so that the work is spread over shapes and nothing is gathered but what overlaps.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geoflow.functions import planar
from geoflow.functions.aggregates import FID
from geoflow.operators import geometry as g
from geoflow.operators.rows import field, numbered

PARTS = "array<array<struct<x:double,y:double>>>"
EDGES = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def rings(parts) -> list[planar.Ring]:
    return [[(p["x"], p["y"]) for p in part] for part in parts] if parts is not None else []


def packed(found: list[planar.Ring]) -> list[list[dict]]:
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in found]


def udf1(f, kind: str):
    """A function of one row's value as an Arrow function: nested values come and go as plain lists and dicts."""
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    def run(a: pa.Array) -> pa.Array:
        return pa.array([f(x) for x in a.to_pylist()], arrow)

    return F.arrow_udf(run, kind)


def udf2(f, kind: str):
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], arrow)

    return F.arrow_udf(run, kind)


def udf3(f, kind: str):
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([f(x, y, z) for x, y, z in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)], arrow)

    return F.arrow_udf(run, kind)


def of_shapes(f, kind: str):
    """A function of shapes (dicts of type and parts, or None) as a column function of geom."""
    work = udf2(lambda name, parts: f(None if name is None else {"type": name, "parts": parts}), kind)
    return lambda geom: work(geom["type"], geom["parts"])


def shaped(kind: str, parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.struct(F.lit(kind).alias("type"), parts.alias("parts"))).cast(g.GEOM)


def boxed(df: DataFrame, name: str, *more: Column) -> DataFrame:
    b = g.bbox(F.col("geom"))
    return df.where("geom is not null").select(F.col(FID).alias(name), b.alias(f"{name}b"), *more).where(F.col(f"{name}b").isNotNull())


def cell_size(*layers: DataFrame) -> float:
    """A cell for which all boxes together cover at most about nine cells a shape, whatever the units."""
    every = None
    for df in layers:
        b = boxed(df, "_s").select(F.col("_sb.xmax") - F.col("_sb.xmin"), F.col("_sb.ymax") - F.col("_sb.ymin")).toDF("w", "h")
        every = b if every is None else every.union(b)
    r = every.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("h")).alias("a"), F.sum(F.col("w") + F.col("h")).alias("s")).first()
    return max((r.a / (4 * r.n)) ** 0.5, r.s / (4 * r.n)) or 1.0 if r.n else 1.0


def in_cells(df: DataFrame, box: str, cell: float) -> DataFrame:
    over = lambda low, high: F.explode(F.sequence(F.floor(F.col(box)[low] / cell), F.floor(F.col(box)[high] / cell)))
    return df.withColumn("_cx", over("xmin", "xmax")).withColumn("_cy", over("ymin", "ymax"))


def neighbours(a: DataFrame, b: DataFrame, *, cell: float | None = None) -> DataFrame:
    """(_a, _b): the `__fid` pairs of shapes whose boxes meet, each once: in the cell of the corner where the boxes' overlap begins."""
    cell = cell or cell_size(a, b)
    x, y = in_cells(boxed(a, "_a"), "_ab", cell), in_cells(boxed(b, "_b"), "_bb", cell)
    met = x.join(y, ["_cx", "_cy"])
    p, q = F.col("_ab"), F.col("_bb")
    overlap = (p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"])
    here = (F.floor(F.greatest(p["xmin"], q["xmin"]) / cell) == F.col("_cx")) & (F.floor(F.greatest(p["ymin"], q["ymin"]) / cell) == F.col("_cy"))
    return met.where(overlap & here).select("_a", "_b")


def gathered(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """(_a, _with): the id and parts of each shape's neighbours in order."""
    parts = others.select(F.col(FID).alias("_b"), F.col("geom.parts").alias("parts"))
    return pairs.join(parts, "_b").groupBy("_a").agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("id"), "parts"))).alias("_with"))


def listed(others) -> list[tuple[int, list[planar.Ring]]]:
    return [(int(o["id"]), rings(o["parts"])) for o in others] if others is not None else []


def overlaid(target: DataFrame, source: DataFrame, cell: float | None = None) -> DataFrame:
    """The target's rows with `_with`: the source shapes near each, or null."""
    return target.join(gathered(neighbours(target, source, cell=cell), source), F.col(FID) == F.col("_a"), "left").drop("_a")


def _kind(df: DataFrame) -> str:
    kinds = {r[0] for r in df.where("geom is not null").select("geom.type").distinct().collect()}
    if len(kinds) > 1:
        raise ValueError("a layer holds shapes of one type")
    return kinds.pop() if kinds else "polygon"


def clip(target: DataFrame, source: DataFrame, *, erase: bool = False) -> DataFrame:
    """Points, lines or polygons within the source's polygons (erase: outside them); rows whose shape is cut away go.

    The border belongs to the inside.  Rows without a shape go when clipping and stay when erasing.
    """
    source = source.where("geom.type = 'polygon'")
    kinds = sorted(r[0] for r in target.where("geom is not null").select("geom.type").distinct().collect())
    if len(kinds) > 1:
        each = [clip(target.where(F.col("geom.type") == k if i else F.coalesce(F.col("geom.type") == k, F.lit(True))), source, erase=erase) for i, k in enumerate(kinds)]
        return functools.reduce(DataFrame.unionByName, each)
    kind = kinds[0] if kinds else "polygon"
    if kind == "point":
        at = target.where("geom is not null").select(FID, F.posexplode("geom.parts").alias("n", "p"))
        each = at.select((F.monotonically_increasing_id()).alias("_id"), F.col(FID).alias("f"), "n", "p")
        from geoflow.shared import materialise

        each = materialise(each, "points")
        alone = each.select(F.col("_id").alias(FID), F.struct(F.lit("point").alias("type"), F.array("p").alias("parts")).alias("geom"))
        hits = g.point_in_polygon(alone, source).select(F.col("_p").alias("_id")).distinct()
        kept = each.join(hits, "_id", "left_anti" if erase else "left_semi")
        kept = kept.groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda z: z["p"]).alias("_kept"))
        out = target.join(kept, F.col(FID) == F.col("f"), "left").drop("f")
        new = shaped("point", F.col("_kept"))
    else:
        near = overlaid(target, source)
        if kind == "polygon":
            cut = planar.difference if erase else planar.intersection
            work = udf2(lambda parts, others: packed(cut(rings(parts), [s for _, s in listed(others)])) if parts is not None else [], PARTS)
        else:
            work = udf2(lambda parts, others: packed([p for line in rings(parts) for ids, p in planar.cut_line(line, listed(others)) if bool(ids) != erase]), PARTS)
        # shapes that meet no source never reach Python
        done = near.where("_with is not null").withColumn("_kept", work(F.col("geom.parts"), F.col("_with")))
        alone = near.where("_with is null").withColumn("_kept", F.col("geom.parts") if erase else F.lit(None).cast(PARTS))
        out, new = done.unionByName(alone).drop("_with"), shaped(kind, F.col("_kept"))
    was = F.col("geom").isNull() if erase else F.lit(False)
    return out.withColumn("_was", was).withColumn("geom", new).drop("_kept").where("geom is not null or _was").drop("_was")


def inlay(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target with the source's polygons in place of what they cover; fields by name, null where a layer has none."""
    from geoflow.operators.rows import merge_layers

    return merge_layers([clip(target, source, erase=True), source], force=True)


def slices(target: DataFrame, source: DataFrame, *, id_field: str | None = None) -> DataFrame:
    """The target clipped by each source polygon on its own; layer_name tells which (its id, or id_field's value)."""
    pairs = neighbours(target, source)
    other = source.select(F.col(FID).alias("_b"), F.col("geom.parts").alias("_cutter"), (field(id_field).cast("string") if id_field else (F.col(FID) + 1).cast("string")).alias("layer_name"))
    work = udf2(lambda a, b: packed(planar.intersection(rings(a), [rings(b)])), PARTS)
    out = target.join(pairs, F.col(FID) == F.col("_a")).join(other, "_b").withColumn("geom", shaped("polygon", work(F.col("geom.parts"), F.col("_cutter"))))
    return out.where("geom is not null").drop("_a", "_b", "_cutter")


def divide(lines: DataFrame, polygons: DataFrame, *, fields: list[str] | None = None, calc: str | None = None) -> DataFrame:
    """Lines split at the polygons' borders; each piece gets the fields of the polygon that it lies in (the first of several), null outside."""
    from geoflow.operators.joins import attach

    kind = "array<struct<ids:array<bigint>,part:array<struct<x:double,y:double>>>>"

    def cut(parts, others):
        return [{"ids": ids, "part": packed([p])[0]} for line in rings(parts) for ids, p in planar.cut_line(line, listed(others))]

    near = overlaid(lines, polygons)
    whole = F.transform(F.col("geom.parts"), lambda p: F.struct(F.array().cast("array<bigint>").alias("ids"), p.alias("part")))
    done = near.where("_with is not null").withColumn("_cut", udf2(cut, kind)(F.col("geom.parts"), F.col("_with")))
    pieces = done.unionByName(near.where("_with is null").withColumn("_cut", whole.cast(kind))).drop("_with")
    pieces = pieces.select("*", F.posexplode("_cut").alias("_n", "_piece")).withColumn("geom", shaped("polyline", F.array("_piece.part"))).withColumn("_ids", F.col("_piece.ids")).drop("_cut", "_piece")
    out = numbered(pieces.withColumnRenamed(FID, "_old"), [F.col("_old"), F.col("_n")]).drop("_old", "_n")
    found = out.select(F.col(FID).alias("_t"), F.explode("_ids").alias("_b")).join(polygons.drop("geom").withColumnRenamed(FID, "_b"), "_b").withColumnRenamed("_b", FID)
    every = [c for c in polygons.columns if c not in (FID, "geom")]
    return attach(out.drop("_ids"), found, ([] if calc else every) if fields is None else every if fields == ["*"] else fields, calc=calc)


def mosaic(df: DataFrame, *, calc: str | None = None) -> DataFrame:
    """The connected tiles into which overlapping polygons cut each other: geom, owners (`__fid` of the polygons on top of each other), and calc over the owners' rows.

    A tile is made by its first owner and lies within it, so each shape meets its own neighbours only.
    """
    from geoflow.operators.joins import attach

    df = df.where("geom.type = 'polygon'")
    pairs = neighbours(df, df).where("_a != _b")
    near = df.select(FID, "geom").join(gathered(pairs, df), F.col(FID) == F.col("_a"), "left")
    kind = f"array<struct<owners:array<bigint>,parts:{PARTS}>>"
    work = udf3(lambda me, parts, others: [{"owners": o, "parts": packed(p)} for o, p in planar.tiles(int(me), rings(parts), listed(others))], kind)
    tiles = near.select(F.col(FID).alias("_of"), F.posexplode(work(F.col(FID), F.col("geom.parts"), F.col("_with"))).alias("_n", "t"))
    out = numbered(tiles.select("_of", "_n", F.col("t.owners").alias("owners"), shaped("polygon", F.col("t.parts")).alias("geom")), [F.col("_of"), F.col("_n")]).drop("_of", "_n")
    if calc:
        found = out.select(F.col(FID).alias("_t"), F.explode("owners").alias("_b")).join(df.drop("geom").withColumnRenamed(FID, "_b"), "_b").withColumnRenamed("_b", FID)
        out = attach(out, found, [], calc=calc)
    return out


def union(layers: list[DataFrame], *, fields: list[str] | None = None) -> DataFrame:
    """The tiles of all layers' polygons with the fields of each layer's first polygon there; a name that came before gets _2, _3 …"""
    n = len(layers)
    every = None
    for k, df in enumerate(layers):
        one = df.where("geom.type = 'polygon'").select((F.col(FID) * n + k).alias(FID), "geom")
        every = one if every is None else every.union(one)
    out = mosaic(every)
    taken: set[str] = set()
    for k, df in enumerate(layers):
        names = [c for c in df.columns if c not in (FID, "geom") and (fields is None or fields == ["*"] or c in fields)]
        new = {}
        for c in names:
            name, j = c, 2
            while name in taken:
                name, j = f"{c}_{j}", j + 1
            taken.add(name)
            new[c] = name
        here = F.lit(k)
        mine = F.array_min(F.filter("owners", lambda o: F.pmod(o, F.lit(n)) == here))  # noqa: B023
        side = df.select((F.col(FID) * n + k).alias("_id"), *(field(c).alias(new[c]) for c in names))
        out = out.withColumn("_mine", mine).join(side, F.col("_mine") == F.col("_id"), "left").drop("_mine", "_id")
    return out.drop("owners")


def overlaps(target: DataFrame, source: DataFrame, *, min_area: float | None = None, min_pct: float | None = None) -> DataFrame:
    """(_t, _s, area, target_area, source_area) of the pairs of polygons that share an area."""
    size = g.planar_area(F.col("geom"))
    a = target.where("geom.type = 'polygon'").select(F.col(FID).alias("_a"), F.col("geom.parts").alias("_pa"), size.alias("target_area"))
    b = source.where("geom.type = 'polygon'").select(F.col(FID).alias("_b"), F.col("geom.parts").alias("_pb"), size.alias("source_area"))
    shared = udf2(lambda x, y: planar.shared_area(rings(x), rings(y)), "double")
    pairs = neighbours(target.where("geom.type = 'polygon'"), source.where("geom.type = 'polygon'")).join(a, "_a").join(b, "_b")
    out = pairs.select(F.col("_a").alias("_t"), F.col("_b").alias("_s"), shared("_pa", "_pb").alias("area"), "target_area", "source_area").where("area > 1e-12 * least(target_area, source_area)")
    if min_area is not None:
        out = out.where(F.col("area") >= min_area)
    if min_pct is not None:
        out = out.where(F.col("area") / F.col("target_area") >= min_pct)
    return out


def join_polygons(target: DataFrame, source: DataFrame, *, largest_overlap: bool = False, min_overlap_area: float | None = None, min_overlap_pct: float | None = None, interpolate: list[str] = (), fields: list[str] | None = None, calc: str | None = None, **options) -> DataFrame:
    """Each target polygon receives the source polygons that share an area with it, by the rules of attach().

    largest_overlap keeps the source with the largest shared area (ties: the last).  interpolate: numbers are summed by
    the share of each source's area that lies in the target, other values are those of the largest shared area together.
    """
    from geoflow.operators.joins import attach

    if interpolate and options.get("duplication"):
        raise ValueError("interpolate and duplication don't go together")
    met = overlaps(target, source, min_area=min_overlap_area, min_pct=min_overlap_pct)
    if largest_overlap:
        best = met.groupBy("_t").agg(F.max_by("_s", F.struct("area", "_s")).alias("_s"))
        met = met.join(best, ["_t", "_s"], "left_semi")
    every = [c for c in source.columns if c not in (FID, "geom")]
    if fields is None:
        fields = [] if calc or interpolate else every
    elif fields == ["*"]:
        fields = every
    found = met.join(source.drop("geom").withColumnRenamed(FID, "_s"), "_s").withColumnRenamed("_s", FID)
    out = attach(target, found.drop("area", "target_area", "source_area"), [f for f in fields if f not in interpolate], calc=calc, **options)
    for f in interpolate:
        kind = source.schema[f].dataType.typeName()
        if kind in ("string", "boolean"):
            shares = found.where(field(f).isNotNull()).groupBy("_t", field(f).alias("_v")).agg(F.sum("area").alias("n"), F.min(FID).alias("first"))
            got = shares.groupBy("_t").agg(F.max_by("_v", F.struct("n", -F.col("first"))).alias("_v"))
        else:
            got = found.groupBy("_t").agg(F.sum(F.coalesce(field(f).cast("double"), F.lit(0.0)) * F.col("area") / F.col("source_area")).alias("_v"))
        out = out.drop(f).join(got, F.col(FID) == F.col("_t"), "left").withColumn(f, F.col("_v")).drop("_t", "_v")
    return out


def by_points(target: DataFrame, source: DataFrame, **options) -> DataFrame:
    """point-method: lines by their midpoints; of two polygon layers the one with more shapes (the target if strictly more) by points inside them."""
    from geoflow.operators import shapes

    kind = _kind(target)
    if kind == "polyline":
        mid = shapes.to_points(target, "midpoints")
    elif target.count() > source.count():
        mid = inner_points(target)
    else:
        return g.join_points_to_polygons(target, inner_points(source), **options)
    out = g.join_polygons_to_points(mid, source, **options).drop("geom")
    return out.join(target.select(F.col(FID).alias("_f"), "geom"), F.col(FID) == F.col("_f")).drop("_f")


def inner_points(df: DataFrame) -> DataFrame:
    """A point inside each polygon: the middle of the widest stretch within it along one of some level lines; the one whose stretch is widest."""

    def pick(parts):
        shape = rings(parts)
        ys = [y for r in shape for _, y in r]
        if not ys or min(ys) == max(ys):
            return None
        best = None
        for k in range(1, 16):
            y = min(ys) + (max(ys) - min(ys)) * (k + 0.003) / 16
            xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in shape for a, b in zip(r, r[1:], strict=False) if (a[1] <= y) != (b[1] <= y))
            for u, v in zip(xs[::2], xs[1::2], strict=False):
                if best is None or v - u > best[0] * (1 + 1e-9):
                    best = v - u, (u + v) / 2, y
        return [best[1], best[2]] if best else None

    at = udf1(pick, "array<double>")
    return df.withColumn("_at", at("geom.parts")).withColumn("geom", g.point(F.get("_at", F.lit(0)), F.get("_at", F.lit(1)))).drop("_at")


def outlines(df: DataFrame, keys: list[Column], *, overlapping: bool) -> DataFrame:
    """(_k, parts): the outline of each group's polygons, from the pieces of border that only one side of the group has.

    Without overlaps, edges that two polygons share whole cancel out, counted by edge.  With overlaps each shape is
    first cut at its neighbours of the same group.  Only the pieces that bound the result are gathered.
    """
    df = df.where("geom.type = 'polygon'")
    k = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))
    if overlapping:
        own = df.select(F.col(FID).alias("_a"), k.alias("_k"))
        pairs = neighbours(df, df).where("_a != _b").join(own, "_a").join(own.toDF("_b", "_k2"), "_b").where(F.col("_k").eqNullSafe(F.col("_k2"))).select("_a", "_b")
        near = df.select(FID, k.alias("_k"), "geom").join(gathered(pairs, df), F.col(FID) == F.col("_a"), "left")
        work = udf3(lambda me, parts, others: [{"ax": a[0], "ay": a[1], "bx": b[0], "by": b[1]} for a, b in planar.outline(int(me), rings(parts), listed(others))], EDGES)
        left = near.select("_k", F.explode(work(F.col(FID), F.col("geom.parts"), F.col("_with"))).alias("e")).select("_k", "e.*")
    else:
        edge = df.select(k.alias("_k"), F.explode(F.flatten(F.transform(F.col("geom.parts"), g.segments))).alias("s"))
        up = F.col("s.a") < F.col("s.b")
        edge = edge.where("s.a != s.b").select("_k", F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q"), F.when(up, 1).otherwise(-1).alias("d"))
        net = edge.groupBy("_k", "p", "q").agg(F.sum("d").alias("d")).where("d != 0")
        side = lambda n, first: F.when(F.col("d") > 0, F.col(first)[n]).otherwise(F.col("q" if first == "p" else "p")[n])
        left = net.select("_k", side("x", "p").alias("ax"), side("y", "p").alias("ay"), side("x", "q").alias("bx"), side("y", "q").alias("by"))
    chained = udf1(lambda e: packed(planar.flat(planar.nest(planar.chain([((s["ax"], s["ay"]), (s["bx"], s["by"])) for s in e])))), PARTS)
    return left.groupBy("_k").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_e")).select("_k", chained("_e").alias("parts"))


def clean(df: DataFrame, *, overlap_rule: str = "max-area", gap_area: float | None = None) -> DataFrame:
    """Polygons without overlaps: a tile that several cover goes to the one that the rule names (min-id, max-id, min-area, max-area).

    gap_area: enclosed gaps of up to this area go to the polygon with the longest border on them.
    """
    if overlap_rule not in ("min-id", "max-id", "min-area", "max-area"):
        raise ValueError(f"unknown overlap rule {overlap_rule}")
    tiles = mosaic(df)
    size = df.select(F.col(FID).alias("_o"), g.planar_area(F.col("geom")).alias("_size"))
    owned = tiles.select(F.col(FID).alias("_tile"), F.explode("owners").alias("_o")).join(size, "_o")
    pick = {"min-id": F.min("_o"), "max-id": F.max("_o"), "min-area": F.min_by("_o", F.struct("_size", "_o")), "max-area": F.max_by("_o", F.struct("_size", -F.col("_o")))}[overlap_rule]
    owner = owned.groupBy("_tile").agg(pick.alias("_owner"))
    parts = tiles.join(owner, F.col(FID) == F.col("_tile")).select(F.col("_owner"), "geom")
    if gap_area is not None:
        gaps = _gaps(tiles, gap_area)
        edges = lambda d, n: d.select(F.col(FID).alias(n), F.explode(F.flatten(F.transform(F.col("geom.parts"), g.segments))).alias("s")).select(n, F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q"))
        border = edges(gaps, "_gap").join(edges(parts.withColumnRenamed("_owner", FID), "_o"), ["p", "q"]).groupBy("_gap", "_o").agg(F.sum(F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y"))).alias("n"))
        to = border.groupBy("_gap").agg(F.max_by("_o", F.struct("n", -F.col("_o"))).alias("_owner"))
        parts = parts.unionByName(gaps.join(to, F.col(FID) == F.col("_gap")).select("_owner", "geom"))
    made = outlines(parts.withColumn(FID, F.lit(0)), [F.col("_owner")], overlapping=False).select(F.col("_k.k0").alias("_owner"), "parts")
    return df.join(made, F.col(FID) == F.col("_owner"), "left").withColumn("geom", shaped("polygon", F.col("parts"))).drop("_owner", "parts")


def _gaps(tiles: DataFrame, most: float) -> DataFrame:
    """The holes of all tiles together, up to an area, as polygons with an id."""
    whole = outlines(tiles, [], overlapping=False).select(F.explode("parts").alias("ring"))
    hole = whole.where(g.ring_area(F.col("ring")) < 0).where(F.abs(g.ring_area(F.col("ring"))) <= most)
    return numbered(hole.withColumn("geom", shaped("polygon", F.array(F.reverse("ring")))).drop("ring"), [F.col("geom.parts")[0][0]["x"], F.col("geom.parts")[0][0]["y"], g.ring_area(F.col("geom.parts")[0])])


def buffer(df: DataFrame, radius: float, *, vertices: int = 72) -> DataFrame:
    """What lies within a planar distance of points, lines or polygons; a negative radius shrinks polygons, and shapes that vanish are null."""
    from geoflow.operators import shapes

    kind = _kind(df)
    if kind == "point":
        return shapes.buffer_points(df, radius, vertices)
    work = udf1(lambda parts: packed(planar.buffered(kind, rings(parts), radius, vertices)) if parts is not None else [], PARTS)
    return df.withColumn("geom", shaped("polygon", work("geom.parts")))


def polygons_from_lines(df: DataFrame) -> DataFrame:
    """The faces that a layer's lines enclose, smallest corner first.  Lines that touch are one group, and a group's lines meet in one task."""
    group = _touching(df)
    work = udf1(lambda parts: [packed(f) for f in planar.faces(rings(parts))], f"array<{PARTS}>")
    faces = group.groupBy("_root").agg(F.flatten(F.collect_list("parts")).alias("parts")).select(F.explode(work("parts")).alias("f"))
    return numbered(faces.select(shaped("polygon", F.col("f")).alias("geom")), [F.col("geom.parts")[0][0]["x"], F.col("geom.parts")[0][0]["y"]])


def _touching(df: DataFrame) -> DataFrame:
    """(_root, parts) of lines: those whose boxes meet, directly or over others, have one root, found by passing the least id on until nothing changes."""
    from geoflow.shared import discard, materialise

    pairs = materialise(neighbours(df, df).where("_a != _b"), "touching")
    roots = materialise(df.where("geom is not null").select(F.col(FID).alias("f"), F.col(FID).alias("_root")), "roots")
    while True:
        offer = pairs.join(roots.toDF("_b", "_r"), "_b").groupBy("_a").agg(F.min("_r").alias("_r"))
        step = roots.join(offer, F.col("f") == F.col("_a"), "left").select("f", F.least("_root", F.coalesce("_r", "_root")).alias("_root"), (F.col("_r") < F.col("_root")).alias("_new"))
        up = step.toDF("f", "_root", "_new").join(step.select(F.col("f").alias("_g"), F.col("_root").alias("_up")), F.col("_root") == F.col("_g"), "left").select("f", F.coalesce("_up", "_root").alias("_root"), "_new")
        now = materialise(up, "roots")
        discard(roots)
        roots = now.select("f", "_root")
        roots._written = now._written
        if now.where("_new").isEmpty():
            return df.join(roots, F.col(FID) == F.col("f")).select("_root", F.col("geom.parts").alias("parts"))


def chained_lines(df: DataFrame, keys: list[Column]) -> DataFrame:
    """(_k, parts): each group's lines put together end to end where exactly two ends meet."""

    def join_up(parts):
        lines = [r for r in rings(parts) if len(r) > 1]
        ends: dict[planar.Point, list[int]] = {}
        for k, line in enumerate(lines):
            ends.setdefault(line[0], []).append(k)
            ends.setdefault(line[-1], []).append(k)
        used, out = set(), []
        for k, line in enumerate(lines):
            if k in used:
                continue
            used.add(k)
            path = list(line)
            for _ in range(2):
                while len(ends[path[-1]]) == 2 and path[0] != path[-1]:
                    nxt = next((j for j in ends[path[-1]] if j not in used), None)
                    if nxt is None:
                        break
                    used.add(nxt)
                    other = lines[nxt] if lines[nxt][0] == path[-1] else lines[nxt][::-1]
                    path += other[1:]
                path.reverse()
            out.append(path)
        return packed(out)

    k = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))
    rows = df.where("geom.type = 'polyline'").select(k.alias("_k"), F.col(FID).alias("f"), F.col("geom.parts").alias("p"))
    one = rows.groupBy("_k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("f", "p"))), lambda z: z["p"])).alias("p"))
    return one.select("_k", udf1(join_up, PARTS)("p").alias("parts"))


def snap(df: DataFrame, interval: float) -> DataFrame:
    """Vertices moved to a grid of this interval; neighbours that become equal are one, rings of no area go."""
    moved = g.round_points(F.col("geom"), interval)
    once = lambda part: F.filter(part, lambda p, i: (i == 0) | (p != F.get(part, i - 1)))
    parts = F.transform(moved["parts"], once)
    kept = F.when(moved["type"] == "polygon", F.filter(parts, lambda p: (F.size(p) > 3) & (g.ring_area(p) != 0))).when(moved["type"] == "polyline", F.filter(parts, lambda p: F.size(p) > 1)).otherwise(parts)
    return df.withColumn("geom", F.when(F.size(kept) > 0, F.struct(moved["type"].alias("type"), kept.alias("parts"))).cast(g.GEOM))
