"""More commands on shapes: conversion, clipping to a box, simplification, projections, grids and neighbours."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID, Calc, compile_calc, grouped
from geoflow.functions.expressions import scope_of
from geoflow.operators import geometry as g
from geoflow.operators.rows import field, numbered


def shape(kind: str, parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.struct(F.lit(kind).alias("type"), parts.alias("parts"))).cast(g.GEOM)


def to_points(df: DataFrame, how: str) -> DataFrame:
    """centroid; vertices (distinct ones); endpoints; midpoints of lines (half of the length)."""
    geom = F.col("geom")
    if how == "centroid":
        c = g.centroid(geom)
        return df.withColumn("geom", g.point(c["x"], c["y"]))
    if how == "vertices":
        return df.withColumn("geom", shape("point", F.transform(F.array_distinct(g.coordinates(geom)), lambda p: F.array(p))))
    if how == "endpoints":
        ends = F.flatten(F.transform(geom["parts"], lambda p: F.array(F.element_at(p, 1), F.element_at(p, -1))))
        return df.withColumn("geom", shape("point", F.transform(F.array_distinct(ends), lambda p: F.array(p))))
    if how == "inner":
        from geoflow.operators.overlay import inner_points

        return inner_points(df)
    if how == "midpoints":
        line = F.array_max(F.transform(geom["parts"], lambda p: F.struct(g.total(g.segments(p), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])).alias("n"), p.alias("p"))))
        start = F.struct((line["n"] / 2).alias("left"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

        def walk(t: Column, s: Column) -> Column:
            n = F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
            here = t["x"].isNull() & (n >= t["left"])
            share = F.when(n > 0, t["left"] / n).otherwise(0.0)
            at = lambda c: F.when(here, s["a"][c] + (s["b"][c] - s["a"][c]) * share).otherwise(t[c])
            return F.struct((t["left"] - n).alias("left"), at("x").alias("x"), at("y").alias("y"))

        mid = F.aggregate(g.segments(line["p"]), start, walk)
        return df.withColumn("_mid", mid).withColumn("geom", g.point(F.col("_mid.x"), F.col("_mid.y"))).drop("_mid")
    raise ValueError(f"unknown kind of points: {how}")


def border_lines(df: DataFrame) -> DataFrame:
    """TYPE (inner: two polygons share it; outer: one has it), a_fid, b_fid, geom: every edge of the polygons once."""
    edge = df.select(F.col(FID).alias("f"), F.explode(F.flatten(F.transform(F.col("geom")["parts"], g.segments))).alias("s"))
    edge = edge.select("f", F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q"))
    one = edge.groupBy("p", "q").agg(F.min("f").alias("a_fid"), F.max("f").alias("m"), F.count_distinct("f").alias("n"))
    return one.select(F.when(F.col("n") > 1, "inner").otherwise("outer").alias("TYPE"), "a_fid", F.when(F.col("n") > 1, F.col("m")).alias("b_fid"), shape("polyline", F.array(F.array("p", "q"))).alias("geom"))


def points_to_line(df: DataFrame, groupby: list[str] = ()) -> DataFrame:
    """One polyline for each group, through its points in row order; a line is one row, so a group's points meet there."""
    at = F.array_sort(F.collect_list(F.struct(F.col(FID).alias("f"), F.col("geom")["parts"][0][0].alias("p"))))
    base = df.where("geom is not null").groupBy(*map(field, groupby)) if groupby else df.where("geom is not null").groupBy()
    return base.agg(F.min(FID).alias(FID), F.transform(at, lambda z: z["p"]).alias("_line")).withColumn("geom", shape("polyline", F.when(F.size("_line") > 1, F.array("_line")))).drop("_line")


def filter_parts(df: DataFrame, keep, *, remove_empty: bool = False) -> DataFrame:
    """Drops parts that `keep` refuses; a shape without parts is null."""
    geom = F.col("geom")
    out = df.withColumn("geom", F.when(geom.isNotNull(), F.struct(geom["type"].alias("type"), F.filter(geom["parts"], keep).alias("parts"))).cast(g.GEOM))
    out = out.withColumn("geom", F.when(F.size(F.col("geom")["parts"]) > 0, F.col("geom")))
    return out.where("geom is not null") if remove_empty else out


def filter_slivers(df: DataFrame, min_area: float, *, sliver_control: float = 0.0, remove_empty: bool = False) -> DataFrame:
    """Drops rings whose area, weighted by roundness as much as sliver_control (0 to 1) says, is under min_area."""

    def keep(p: Column) -> Column:
        area = F.abs(g.ring_area(p))
        around = g.total(g.segments(p), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))
        round_ = F.when(around > 0, 4 * math.pi * area / (around * around)).otherwise(0.0)
        return area * (1 - sliver_control + sliver_control * round_) >= min_area

    return filter_parts(df, keep, remove_empty=remove_empty)


def filter_islands(df: DataFrame, *, min_area: float | None = None, min_vertices: int | None = None, remove_empty: bool = False) -> DataFrame:
    """Drops outer rings that share no edge with another ring and are small in area or number of vertices; null if none is left."""
    geom = F.col("geom")
    ring = df.select(F.col(FID).alias("f"), F.posexplode(geom["parts"]).alias("n", "p"))
    edge = ring.select("f", "n", F.explode(g.segments(F.col("p"))).alias("s")).select("f", "n", F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q"))
    single = edge.groupBy("p", "q").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("f", "n")).alias("one"), F.collect_set(F.struct("f", "n")).alias("all")).where("c > 1").select(F.explode("all").alias("r")).select("r.*").distinct()
    small = F.lit(False)
    if min_area is not None:
        small = small | (F.abs(g.ring_area(F.col("p"))) < min_area)
    if min_vertices is not None:
        small = small | (F.size("p") - 1 < min_vertices)
    gone = ring.where(small).join(single, ["f", "n"], "left_anti").groupBy("f").agg(F.collect_set("n").alias("_gone"))
    out = df.join(gone, F.col(FID) == F.col("f"), "left").drop("f")
    parts = F.filter(geom["parts"], lambda p, i: ~F.coalesce(F.array_contains(F.col("_gone"), i), F.lit(False)))
    out = out.withColumn("geom", F.when(F.size(parts) > 0, F.struct(geom["type"].alias("type"), parts.alias("parts"))).cast(g.GEOM)).drop("_gone")
    return out.where("geom is not null") if remove_empty else out


def clip_box(df: DataFrame, box: tuple[float, float, float, float], *, erase: bool = False) -> DataFrame:
    """Points, lines and polygons within a box, or outside it.  Rows whose shape is cut away go; erasing keeps those without one."""
    geom = F.col("geom")
    x0, y0, x1, y1 = map(float, box)
    if erase:
        from geoflow.operators import overlay

        one = df.sparkSession.range(1).select(F.col("id").alias(FID), g.rectangle(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1)).alias("geom"))
        return overlay.clip(df, one, erase=True)
    from geoflow.operators.overlay import PARTS, of_shapes

    cut = of_shapes(_cutter(x0, y0, x1, y1), PARTS)
    whole = df.withColumn("_b", g.bbox(geom))
    fits = F.col("_b.xmin").between(x0, x1) & F.col("_b.xmax").between(x0, x1) & F.col("_b.ymin").between(y0, y1) & F.col("_b.ymax").between(y0, y1)
    near = whole.where((F.col("_b.xmax") >= x0) & (F.col("_b.xmin") <= x1) & (F.col("_b.ymax") >= y0) & (F.col("_b.ymin") <= y1)).withColumn("_in", fits).drop("_b")
    # shapes wholly within the box stay in the JVM
    return near.where("_in").unionByName(near.where("not _in").withColumn("geom", F.struct(geom["type"].alias("type"), cut(geom).alias("parts")).cast(g.GEOM))).where("size(geom.parts) > 0").drop("_in")


def _cutter(x0: float, y0: float, x1: float, y1: float):
    sides = [(0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)]

    def cross(a, b, axis, at):
        t = (at - a[axis]) / (b[axis] - a[axis])
        return (at, a[1] + t * (b[1] - a[1])) if axis == 0 else (a[0] + t * (b[0] - a[0]), at)

    def ring(p):
        for axis, at, sign in sides:
            out = []
            for a, b in zip(p, p[1:] + p[:1], strict=True):
                ina, inb = sign * (a[axis] - at) >= 0, sign * (b[axis] - at) >= 0
                if ina:
                    out.append(a)
                if ina != inb:
                    out.append(cross(a, b, axis, at))
            p = out
            if not p:
                return []
        return [*p, p[0]] if len(p) > 2 else []

    def line(p):
        out, now = [], []
        for a, b in zip(p, p[1:], strict=False):
            t0, t1, (dx, dy) = 0.0, 1.0, (b[0] - a[0], b[1] - a[1])
            for d, q in ((-dx, a[0] - x0), (dx, x1 - a[0]), (-dy, a[1] - y0), (dy, y1 - a[1])):
                if d == 0 and q < 0:
                    t0 = 2.0
                elif d < 0:
                    t0 = max(t0, q / d)
                elif d > 0:
                    t1 = min(t1, q / d)
            if t0 > t1:
                if now:
                    out.append(now)
                now = []
                continue
            start, end = (a[0] + t0 * dx, a[1] + t0 * dy), (a[0] + t1 * dx, a[1] + t1 * dy)
            if not now or now[-1] != start:
                if now:
                    out.append(now)
                now = [start]
            now.append(end)
        return [*out, now] if now else out

    def run(shape):
        got = []
        for part in shape["parts"] if shape is not None else []:
            p = [(q["x"], q["y"]) for q in part]
            if shape["type"] == "point":
                got += [p] if x0 <= p[0][0] <= x1 and y0 <= p[0][1] <= y1 else []
            elif shape["type"] == "polyline":
                got += line(p)
            else:
                got += [r for r in [ring(p[:-1])] if r]
        return [[{"x": x, "y": y} for x, y in p] for p in got]

    return run


def simplify_shared(df: DataFrame, *, percentage: float | None = None, interval: float | None = None, method: str = "weighted", weighting: float = 0.7, keep_shapes: bool = False) -> DataFrame:
    """Removes vertices of lines and polygons so that neighbours keep equal borders.

    Borders are cut into arcs at the places where more or fewer than two edges meet.  Each arc is measured on its own,
    in one direction whichever shape it belongs to, so all its owners find the same threshold for each vertex: the
    interval at which it goes, by triangles (visvalingam; weighted: sharp turns count less) or by distance (dp).
    percentage: the share of removable vertices that stays, each counted once; else those of at least `interval`.
    keep_shapes: each shape's largest ring keeps the vertices that it needs.
    """
    if (percentage is None) == (interval is None):
        raise ValueError("simplify takes a percentage or an interval")
    if method not in ("weighted", "visvalingam", "dp"):
        raise ValueError(f"unknown method {method}")
    geom = F.col("geom")
    seg = df.where("geom.type != 'point'").select(F.explode(F.flatten(F.transform(geom["parts"], g.segments))).alias("s")).where("s.a != s.b")
    edge = seg.select(F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q")).distinct()
    ends = edge.select(F.col("p").alias("v")).union(edge.select("q"))
    node = ends.groupBy("v").count().where("count != 2").select("v")
    own = df.where("geom.type != 'point'").select(F.col(FID).alias("_f"), F.explode(F.array_distinct(g.coordinates(geom))).alias("v"))
    nodes = own.join(node, "v").groupBy("_f").agg(F.collect_list("v").alias("_nodes"))
    kind = "array<array<struct<x:double,y:double,t:double>>>"
    from geoflow.operators.overlay import udf3
    from geoflow.shared import materialise

    measured = df.join(nodes, F.col(FID) == F.col("_f"), "left").drop("_f").withColumn("_t", udf3(_thresholds(method, weighting), kind)(geom["type"], geom["parts"], F.col("_nodes"))).drop("_nodes")
    measured = materialise(measured, "thresholds")
    least = interval
    if percentage is not None:
        each = measured.select(F.explode(F.flatten("_t")).alias("v")).where("v.t < double('infinity')").distinct()
        least = each.agg(F.percentile_approx("v.t", max(0.0, min(1.0, 1 - percentage)), 1_000_000).alias("t")).first().t
        least = float("inf") if percentage <= 0 else 0.0 if least is None or percentage >= 1 else float(least)
    kept = F.transform("_t", lambda part: F.filter(part, lambda v: v["t"] >= least))
    if keep_shapes:
        size = lambda part: F.abs(g.ring_area(part))
        largest = F.array_max(F.transform("_t", size))
        rescue = lambda part: F.filter(part, lambda v: v["t"] >= F.coalesce(F.get(F.sort_array(F.transform(F.slice(part, 1, F.size(part) - 1), lambda z: z["t"]), asc=False), F.lit(2)), F.lit(0.0)))
        kept = F.transform("_t", lambda part: F.when((geom["type"] == "polygon") & (size(part) == largest) & (F.size(F.filter(part, lambda v: v["t"] >= least)) < 4), rescue(part)).otherwise(F.filter(part, lambda v: v["t"] >= least)))
    parts = F.transform(kept, lambda part: F.transform(part, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    sound = F.when(geom["type"] == "polygon", F.filter(parts, lambda p: (F.size(p) > 3) & (g.ring_area(p) != 0))).otherwise(F.filter(parts, lambda p: F.size(p) > 1))
    new = F.when(geom["type"] == "point", geom).when(F.size(sound) > 0, F.struct(geom["type"].alias("type"), sound.alias("parts"))).cast(g.GEOM)
    return measured.withColumn("geom", new).drop("_t")


def simplify_parts(geom: Column, least: float, *, method: str, weighting: float = 0.0) -> Column:
    """Each part on its own, without a look at neighbours: vertices below a threshold go, ends stay, rings under four points too."""
    from geoflow.operators.overlay import PARTS, of_shapes

    measure = _thresholds(method, weighting)

    def run(shape):
        found = measure(shape["type"], shape["parts"], None) if shape is not None else []
        kept = [[{"x": v["x"], "y": v["y"]} for v in part if v["t"] >= least] for part in found]
        return [p for p in kept if shape["type"] != "polygon" or len(p) > 3]

    return F.when(geom.isNotNull(), F.struct(geom["type"].alias("type"), of_shapes(run, PARTS)(geom).alias("parts"))).cast(g.GEOM)


def simplify_area(geom: Column, least: float, *, weighted: float = 0.0) -> Column:
    """Removes, smallest first, the vertices whose triangle with their neighbours is smaller than `least`; weighted: how much (0 to 1) sharp turns count for less."""
    return simplify_parts(geom, 2 * math.sqrt(least), method="weighted", weighting=weighted)


def _thresholds(method: str, weighting: float):
    inf = float("inf")

    def triangles(p):
        before, after, out = list(range(-1, len(p) - 1)), list(range(1, len(p) + 1)), [inf] * len(p)

        def size(k):
            a, b, c = p[before[k]], p[k], p[after[k]]
            area = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2
            if method == "weighted":
                u, v = (a[0] - b[0], a[1] - b[1]), (c[0] - b[0], c[1] - b[1])
                n = math.hypot(*u) * math.hypot(*v)
                area *= 1 - weighting * ((u[0] * v[0] + u[1] * v[1]) / n if n else 0)
            return area

        now = {k: size(k) for k in range(1, len(p) - 1)}
        heap = [(s, k) for k, s in now.items()]
        heapq.heapify(heap)
        top = 0.0
        while heap:
            s, k = heapq.heappop(heap)
            if out[k] != inf or now[k] != s:
                continue
            top = max(top, s)
            out[k] = 2 * math.sqrt(top)
            a, c = before[k], after[k]
            after[a], before[c] = c, a
            for m in (a, c):
                if 0 < m < len(p) - 1 and out[m] == inf:
                    now[m] = size(m)
                    heapq.heappush(heap, (now[m], m))
        return out

    def distances(p):
        out, todo = [inf] * len(p), [(0, len(p) - 1, inf)]
        while todo:
            a, b, most = todo.pop()
            far, at = -1.0, -1
            (ax, ay), (bx, by) = p[a], p[b]
            base = math.hypot(bx - ax, by - ay)
            for k in range(a + 1, b):
                d = abs((bx - ax) * (ay - p[k][1]) - (ax - p[k][0]) * (by - ay)) / base if base else math.hypot(p[k][0] - ax, p[k][1] - ay)
                if d > far:
                    far, at = d, k
            if at >= 0:
                out[at] = min(far, most)
                todo += [(a, at, out[at]), (at, b, out[at])]
        return out

    work = distances if method == "dp" else triangles

    def measure(name, parts, nodes):
        out = []
        stops = {(v["x"], v["y"]) for v in nodes} if nodes is not None else set()
        for part in parts if parts is not None else []:
            p = [(q["x"], q["y"]) for q in part]
            ring = len(p) > 2 and p[0] == p[-1]
            if name == "point" or len(p) < 3:
                out.append([(*q, inf) for q in p])
                continue
            start = 0
            if ring:  # begin at a node, or else where all owners of the ring begin
                body = p[:-1]
                start = next((k for k, q in enumerate(body) if q in stops), min(range(len(body)), key=lambda k: body[k]))
                p = [*body[start:], *body[:start], body[start]]
            cuts = [0, *(k for k in range(1, len(p) - 1) if p[k] in stops), len(p) - 1]
            t = [inf] * len(p)
            for a, b in zip(cuts, cuts[1:], strict=False):
                arc = p[a : b + 1]
                back = (arc[-1], arc[-2]) < (arc[0], arc[1])
                got = work(arc[::-1] if back else arc)
                t[a : b + 1] = got[::-1] if back else got
            done = [(*q, x) for q, x in zip(p, t, strict=True)]
            if ring and start:
                body = done[:-1]
                done = [*body[len(body) - start :], *body[: len(body) - start]]
                done.append(done[0])
                if done[0][2] != inf:  # a ring ends where it begins, whatever goes
                    turn = next(k for k, q in enumerate(done) if q[2] == inf)
                    done = [*done[turn:-1], *done[: turn + 1]]
            out.append(done)
        return [[{"x": x, "y": y, "t": t} for x, y, t in part] for part in out]

    return measure


def smooth(df: DataFrame, distance: float) -> DataFrame:
    """Each inner vertex of lines and polygons becomes the mean of the path near it, weighted by a bell curve of this width along the path; ends stay.

    Corners that turn by over 60 degrees stay too.  Polygons' rings are smoothed all around.
    """
    from geoflow.operators.overlay import of_shapes, packed, rings

    def one(p, closed):
        body = p[:-1] if closed else p
        n = len(body)
        if n < 3:
            return p
        at = lambda k: body[k % n]
        out = []
        for k in range(n):
            a, b, c = at(k - 1), body[k], at(k + 1)
            turn = abs((math.degrees(math.atan2(c[1] - b[1], c[0] - b[0]) - math.atan2(b[1] - a[1], b[0] - a[0])) + 180) % 360 - 180)
            if (not closed and k in (0, n - 1)) or turn > 60:
                out.append(b)
                continue
            total, x, y = 1.0, *b
            for step in (-1, 1):
                gone, j, here = 0.0, k, b
                while abs(j - k) < n and (closed or 0 <= j + step < n):
                    j += step
                    q = at(j)
                    gone += math.hypot(q[0] - here[0], q[1] - here[1])
                    if gone > 2 * distance:
                        break
                    w = math.exp(-2 * (gone / distance) ** 2)
                    total, x, y, here = total + w, x + w * q[0], y + w * q[1], q
            out.append((x / total, y / total))
        return [*out, out[0]] if closed else out

    work = of_shapes(lambda shape: packed([one(p, shape["type"] == "polygon") for p in rings(shape["parts"])]) if shape is not None else [], "array<array<struct<x:double,y:double>>>")
    return df.withColumn("geom", F.when(F.col("geom.type") == "point", F.col("geom")).when(F.col("geom").isNotNull(), F.struct(F.col("geom.type").alias("type"), work(F.col("geom")).alias("parts"))).cast(g.GEOM))


def rotate_sphere(df: DataFrame, lon: float, lat: float = 0.0, roll: float = 0.0, *, invert: bool = False) -> DataFrame:
    """Degrees turned on the sphere: by lon about the poles, then by lat, then by roll."""
    a, b, c = (math.radians(v) for v in (lon, lat, roll))

    def move(p: Column) -> Column:
        x, y = F.radians(p["x"]), F.radians(p["y"])
        if not invert:
            x = x + a
        u, v, w = F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)
        if not invert:
            k = w * math.cos(b) + u * math.sin(b)
            x, y = F.atan2(v * math.cos(c) - k * math.sin(c), u * math.cos(b) - w * math.sin(b)), F.asin(F.greatest(F.least(k * math.cos(c) + v * math.sin(c), F.lit(1.0)), F.lit(-1.0)))
        else:
            k = w * math.cos(c) - v * math.sin(c)
            x, y = F.atan2(v * math.cos(c) + w * math.sin(c), u * math.cos(b) + k * math.sin(b)) - a, F.asin(F.greatest(F.least(k * math.cos(b) - u * math.sin(b), F.lit(1.0)), F.lit(-1.0)))
        turned = F.degrees(x)
        return F.struct((turned - F.floor((turned + 180) / 360) * 360).alias("x"), F.degrees(y).alias("y"))

    return df.withColumn("geom", g.map_points(F.col("geom"), move))


def dots(df: DataFrame, fields: list[str], *, per_dot: float = 1.0, seed: int = 1, save_as: str = "field") -> DataFrame:
    """floor(value / per_dot) random points in each polygon for each field, told by save_as; seeded by the row's id and the field."""
    import random

    from geoflow.functions import planar
    from geoflow.operators.overlay import rings, udf3

    def scatter(me, parts, counts):
        shape, out = rings(parts), []
        xs, ys = [x for r in shape for x, _ in r], [y for r in shape for _, y in r]
        for name, count in zip(fields, counts, strict=True):
            r = random.Random(f"{seed}:{me}:{name}")
            for _ in range(int((count or 0) // per_dot) if shape and planar.area(shape) > 0 else 0):
                while True:
                    x, y = r.uniform(min(xs), max(xs)), r.uniform(min(ys), max(ys))
                    if sum(planar.within(x, y, ring) for ring in shape) % 2:
                        break
                out.append({"n": name, "x": x, "y": y})
        return out

    made = udf3(scatter, "array<struct<n:string,x:double,y:double>>")(F.col(FID), F.col("geom.parts"), F.array(*(field(f).cast("double") for f in fields)))
    out = df.where("geom is not null").select("*", F.posexplode(made).alias("_n", "_d")).withColumn(save_as, F.col("_d.n")).withColumn("geom", g.point(F.col("_d.x"), F.col("_d.y")))
    return numbered(out.withColumnRenamed(FID, "_old"), [F.col("_old"), F.col("_n")]).drop("_old", "_n", "_d")


def rectangle_around(df: DataFrame, *, offset: float = 0.0, aspect: float | None = None) -> DataFrame:
    """One box around a layer, wider by an offset on each side, or to an aspect ratio of width to height."""
    b = g.extent(df)
    w, h = F.col("xmax") - F.col("xmin") + 2 * offset, F.col("ymax") - F.col("ymin") + 2 * offset
    if aspect:
        w, h = F.greatest(w, h * aspect), F.greatest(h, w / aspect)
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return b.select(F.lit(0).cast("long").alias(FID), g.rectangle(x - w / 2, y - h / 2, x + w / 2, y + h / 2).alias("geom"))


def subdivide(df: DataFrame, expression: str, defs: dict | None = None) -> DataFrame:
    """layer_name of parts that are halved again and again, along the longer side of their box at the median of the shapes' middles, while an aggregate expression holds for them."""
    from geoflow.functions.aggregates import grouped
    from geoflow.operators.rows import _scope
    from geoflow.shared import discard, materialise

    b = g.bbox(F.col("geom"))
    now = materialise(df.withColumns({"_x": (b["xmin"] + b["xmax"]) / 2, "_y": (b["ymin"] + b["ymax"]) / 2, "_b": b, "layer_name": F.lit("0"), "_open": F.lit(True)}), "parts")
    while True:
        some = now.where("_open")
        calc = compile_calc(expression, _scope(df, defs))
        calc.out = [("_more", calc.out[-1][1])]
        told = grouped(some, [F.col("layer_name")], calc, F.count(F.lit(1)).alias("_n"), (F.max("_b.xmax") - F.min("_b.xmin") >= F.max("_b.ymax") - F.min("_b.ymin")).alias("_wide"), F.percentile_approx("_x", 0.5, 100_000).alias("_mx"), F.percentile_approx("_y", 0.5, 100_000).alias("_my"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
        told = told.withColumn("_wide", F.when(F.col("_x0") == F.col("_x1"), False).when(F.col("_y0") == F.col("_y1"), True).otherwise(F.col("_wide")))
        told = told.where("_more and _n > 1 and (_x0 < _x1 or _y0 < _y1)").select(F.col("_key0").alias("layer_name"), "_wide", F.when(F.col("_mx") >= F.col("_x1"), (F.col("_x0") + F.col("_x1")) / 2).otherwise(F.col("_mx")).alias("_mx"), F.when(F.col("_my") >= F.col("_y1"), (F.col("_y0") + F.col("_y1")) / 2).otherwise(F.col("_my")).alias("_my"))
        told = materialise(told, "halves")
        if told.isEmpty():
            return now.drop("_x", "_y", "_b", "_open")
        side = F.when(F.col("_wide"), F.col("_x") > F.col("_mx")).otherwise(F.col("_y") > F.col("_my")).cast("int").cast("string")
        split = now.join(told, "layer_name", "left").withColumn("_open", F.col("_wide").isNotNull()).withColumn("layer_name", F.when(F.col("_open"), F.concat("layer_name", F.lit("."), side)).otherwise(F.col("layer_name"))).drop("_wide", "_mx", "_my")
        before, now = now, materialise(split, "parts")
        discard(before, told)


def project(geom: Column, name: str, *, inverse: bool = False, lon0: float = 0.0, parallels: tuple[float, float] = (29.5, 45.5), lat0: float = 23.0) -> Column:
    """Spherical Mercator, plate carree, sinusoidal, or Albers (forward), between degrees and metres."""
    r, rad = g.RADIUS, math.pi / 180

    def move(p: Column) -> Column:
        x, y = p["x"], p["y"]
        if name in ("merc", "webmercator"):
            xy = (x / (r * rad) + lon0, (2 * F.atan(F.exp(y / r)) - math.pi / 2) / rad) if inverse else ((x - lon0) * rad * r, F.log(F.tan(math.pi / 4 + y * rad / 2)) * r)
        elif name == "eqc":
            xy = (x / (r * rad) + lon0, y / (r * rad)) if inverse else ((x - lon0) * rad * r, y * rad * r)
        elif name == "sinu":
            xy = (x / (r * F.cos(y / r)) / rad + lon0, y / r / rad) if inverse else ((x - lon0) * rad * F.cos(y * rad) * r, y * rad * r)
        elif name == "aea" and not inverse:
            s1, s2 = (math.sin(p_ * rad) for p_ in parallels)
            n, c = (s1 + s2) / 2, math.cos(parallels[0] * rad) ** 2 + s1 * (s1 + s2)
            rho0 = math.sqrt(c - 2 * n * math.sin(lat0 * rad)) / n
            rho, theta = F.sqrt(c - 2 * n * F.sin(y * rad)) / n, n * (x - lon0) * rad
            xy = (rho * F.sin(theta) * r, (rho0 - rho * F.cos(theta)) * r)
        else:
            raise ValueError(f"unknown projection {name}")
        return F.struct(xy[0].alias("x"), xy[1].alias("y"))

    return g.map_points(geom, move)


def dashes(df: DataFrame, dash: float, gap: float) -> DataFrame:
    """Lines as dashes of one length with gaps of another, by planar length."""

    from geoflow.operators.overlay import PARTS, of_shapes

    def run(shape):
        out = []
        for part in shape["parts"] if shape is not None else []:
            on, left, now = True, dash, [(part[0]["x"], part[0]["y"])]
            for q in part[1:]:
                bx, by = q["x"], q["y"]
                while True:
                    ax, ay = now[-1]
                    n = math.hypot(bx - ax, by - ay)
                    if n < left:
                        left -= n
                        now.append((bx, by))
                        break
                    t = left / n if n else 0
                    cut = (ax + t * (bx - ax), ay + t * (by - ay))
                    now.append(cut)
                    if on:
                        out.append(now)
                    on, left, now = not on, gap if on else dash, [cut]
                    if cut == (bx, by):
                        break
            if on and len(now) > 1:
                out.append(now)
        return [[{"x": x, "y": y} for x, y in p] for p in out]

    work = of_shapes(run, PARTS)
    return df.withColumn("geom", F.when(F.col("geom").isNotNull(), F.struct(F.col("geom.type").alias("type"), work(F.col("geom")).alias("parts"))).cast(g.GEOM))


def buffer_points(df: DataFrame, radius: float, vertices: int = 72) -> DataFrame:
    """Circles around points, planar, clockwise."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(vertices)), lambda k: (k % vertices) * (-2 * math.pi / vertices))
    rings = F.transform(F.col("geom")["parts"], lambda p: F.transform(turn, lambda a: F.struct((p[0]["x"] + radius * F.cos(a)).alias("x"), (p[0]["y"] + radius * F.sin(a)).alias("y"))))
    return df.withColumn("geom", shape("polygon", rings))


def hex_grid(spark, box: tuple[float, float, float, float], interval: float) -> DataFrame:
    """Hexagons with flat sides up and down the columns, `interval` apart, covering a box; col and row tell the place."""
    x0, y0, x1, y1 = box
    side = interval / math.sqrt(3)
    cols, rows = int((x1 - x0) / (1.5 * side)) + 2, int((y1 - y0) / interval) + 2
    at = spark.range(cols * rows).select(F.col("id").alias(FID), (F.col("id") % cols).alias("col"), F.floor(F.col("id") / cols).alias("row"))
    x, y = F.lit(x0) + F.col("col") * (1.5 * side), F.lit(y0) + (F.col("row") + (F.col("col") % 2) / 2) * interval
    corner = lambda k: F.struct((x + side * math.cos(-k * math.pi / 3)).alias("x"), (y + side * math.sin(-k * math.pi / 3)).alias("y"))
    return at.withColumn("geom", shape("polygon", F.array(F.array(*(corner(k % 6) for k in range(7))))))


def graticule(spark, interval: float = 10.0) -> DataFrame:
    """Meridians and parallels as lines with a vertex for each degree; meridians other than each ninth interval end short of the poles."""
    n, m = int(360 / interval), int(180 / interval) - 1
    steps = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    at = spark.range(n + 1 + m).select(F.col("id").alias(FID))
    k = F.col(FID)
    lon = F.lit(-180.0) + k * interval
    lat = F.lit(-90.0) + (k - n) * interval
    meridian = F.transform(steps(-90, 90), lambda y: F.struct(lon.alias("x"), y.cast("double").alias("y")))
    short = F.filter(meridian, lambda p: p["y"].between(-90 + interval, 90 - interval))
    line = F.when(k > n, F.transform(steps(-180, 180), lambda x: F.struct(x.cast("double").alias("x"), lat.alias("y")))).when(lon % 90 == 0, meridian).otherwise(short)
    return at.withColumn("type", F.when(k > n, "parallel").otherwise("meridian")).withColumn("value", F.when(k > n, lat).otherwise(lon)).withColumn("geom", shape("polyline", F.array(line)))


def point_to_grid(points: DataFrame, box: tuple[float, float, float, float], interval: float, *, radius: float | None = None, calc: str | None = None) -> DataFrame:
    """Cells that points' circles reach, with `weight`: the share of the cell that they cover by their circles' boxes, and calc over the points.

    A point goes to the cells around it only, so the number of rows is bounded by the circle's size in cells.
    Cells with a weight of at most 0.05 are left out.
    """
    x0, y0, *_ = box
    half = (radius if radius is not None else interval / 2) * math.sqrt(math.pi) / 2  # a square as large as the circle
    p = points.where("geom is not null").withColumns({"_x": F.col("geom")["parts"][0][0]["x"], "_y": F.col("geom")["parts"][0][0]["y"]})
    span = lambda c, low: F.explode(F.sequence(F.floor((F.col(c) - half - low) / interval), F.floor((F.col(c) + half - low) / interval)))
    p = p.withColumn("col", span("_x", x0)).withColumn("row", span("_y", y0))
    cover = lambda c, n, low: F.greatest(F.least(F.col(c) + half, (F.col(n) + 1) * interval + low) - F.greatest(F.col(c) - half, F.col(n) * interval + low), F.lit(0.0))
    p = p.withColumn("_w", cover("_x", "col", x0) * cover("_y", "row", y0) / (interval * interval)).where("_w > 0")
    compiled = compile_calc(calc, scope_of(points.drop(FID, "geom").schema)) if calc else Calc()
    out = grouped(p, [F.col("col"), F.col("row")], compiled, F.sum("_w").alias("weight")).where("weight > 0.05").withColumnsRenamed({"_key0": "col", "_key1": "row"})
    x, y = F.lit(x0) + F.col("col") * interval, F.lit(y0) + F.col("row") * interval
    return numbered(out, [F.col("row"), F.col("col")]).withColumn("geom", g.rectangle(x, y, x + interval, y + interval))


def data_fill(df: DataFrame, name: str) -> DataFrame:
    """Empty values from the neighbours with the longest shared border (ties: the value that sorts first), round by round until nothing changes."""
    from geoflow.shared import discard, materialise

    pairs = g.neighbours(df)
    both = materialise(pairs.union(pairs.select("b_fid", "a_fid", "border")).toDF("f", "other", "border"), "neighbours")
    empty = field(name).isNull() | (field(name).cast("string") == "")
    values = df.select(F.col(FID).alias("f"), F.when(~empty, field(name)).alias("v"))
    left = None
    while True:
        known = values.where("v is not null").select(F.col("f").alias("other"), F.col("v").alias("w"))
        offers = both.join(values.where("v is null").select("f"), "f").join(known, "other").groupBy("f", "w").agg(F.sum("border").alias("n"))
        best = offers.groupBy("f").agg(F.min_by("w", F.struct(-F.col("n"), F.col("w"))).alias("w"))
        before, values = values, materialise(values.join(best, "f", "left").select("f", F.coalesce("v", "w").alias("v")), "values")
        discard(before)
        now = values.where("v is null").count()
        if now in (0, left):
            break
        left = now
    values = values.toDF("_f", "_v")
    return df.join(values, F.col(FID) == F.col("_f"), "left").withColumn(name, F.col("_v")).drop("_f", "_v")


def crossings(df: DataFrame, cell: float) -> DataFrame:
    """(a_fid, b_fid, x, y): points where segments of the layer cross inside both, found by cells of the segments' boxes."""
    seg = df.select(F.col(FID).alias("f"), F.explode(F.flatten(F.transform(F.col("geom")["parts"], g.segments))).alias("s"))
    seg = seg.select("f", F.least("s.a", "s.b").alias("p"), F.greatest("s.a", "s.b").alias("q")).distinct()
    over = lambda c: F.explode(F.sequence(F.floor(F.least(F.col("p")[c], F.col("q")[c]) / cell), F.floor(F.greatest(F.col("p")[c], F.col("q")[c]) / cell)))
    seg = seg.withColumn("cx", over("x")).withColumn("cy", over("y"))
    other = seg.select(*(F.col(c).alias(c if c[0] == "c" else f"{c}2") for c in seg.columns))
    d = lambda o, a, b: (F.col(a)["x"] - F.col(o)["x"]) * (F.col(b)["y"] - F.col(o)["y"]) - (F.col(a)["y"] - F.col(o)["y"]) * (F.col(b)["x"] - F.col(o)["x"])
    met = seg.join(other, ["cx", "cy"]).where(F.struct("p", "q") < F.struct("p2", "q2"))
    met = met.withColumns({"d1": d("p2", "q2", "p"), "d2": d("p2", "q2", "q"), "d3": d("p", "q", "p2"), "d4": d("p", "q", "q2")}).where("d1 * d2 < 0 and d3 * d4 < 0")
    t = F.col("d1") / (F.col("d1") - F.col("d2"))
    at = lambda c: F.col("p")[c] + t * (F.col("q")[c] - F.col("p")[c])
    return met.select(F.least("f", "f2").alias("a_fid"), F.greatest("f", "f2").alias("b_fid"), at("x").alias("x"), at("y").alias("y")).distinct()


def fuzzy_join(polygons: DataFrame, points: DataFrame, name: str, cell: float | None = None) -> DataFrame:
    """Each polygon gets the most frequent value of the points in it (ties: the first point's), then data-fill where there is none."""
    out = g.join_points_to_polygons(polygons, points, cell, calc=f"{name} = mode({name})")
    return data_fill(out, name)
