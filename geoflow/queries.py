"""Registered queries of the commands, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID
from geoflow.operators import classes, geometry, groups, joins, rows, shapes
from geoflow.plans.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The unique keys that give each table its row order.
KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "part": "p_partkey", "events": "event_id", "documents": "doc_id"}


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn(FID, F.col(KEYS[name]).cast("long")) if name in KEYS else df


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def run(spark: SparkSession, sf_dir: str, table: str, line: str, *more: str) -> DataFrame:
    layers = {t: layer(spark, sf_dir, t) for t in (*more, table)}
    out = Session(spark, layers).run(line)
    return out.drop(FID, "geom")


@query("""select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as rev,
          round(quantile_cont(l_extendedprice, 0.5), 4) as med from lineitem where l_quantity > 10 group by 1, 2""")
def flagship(spark, sf_dir):
    df = layer(spark, sf_dir, "lineitem").withColumn(FID, F.monotonically_increasing_id())
    out = Session(spark, {"lineitem": df}).run("""-filter 'l_quantity > 10' -each 'revenue = l_extendedprice * (1 - l_discount)'
        -dissolve l_returnflag,l_linestatus calc='n = count(), qty = sum(l_quantity), rev = sum(revenue), med = median(l_extendedprice)'
        -each 'qty = round(qty, 2), rev = round(rev, 2), med = round(med, 4)'""")
    return out.drop(FID)


@query("""select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size, upper(substr(o_orderpriority, 1, 1)) || '-' || o_orderstatus as code,
          floor(o_totalprice / 1000 + 0.5) as k, cast(year(o_orderdate) as double) as y from orders""")
def each_expressions(spark, sf_dir):
    return run(spark, sf_dir, "orders", """-each 'size = o_totalprice > 200000 ? "big" : o_totalprice > 100000 ? "mid" : "small", code = o_orderpriority.substr(0, 1).toUpperCase() + "-" + o_orderstatus, k = Math.round(o_totalprice / 1000), y = o_orderdate.getFullYear()' -filter-fields o_orderkey,size,code,k,y""")


@query("select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 2.0 else o_totalprice end as o_totalprice, case when o_orderstatus = 'F' then 'done' end as note from orders")
def each_where(spark, sf_dir):
    return run(spark, sf_dir, "orders", """-each 'o_totalprice = o_totalprice * 2, note = "done"' where='o_orderstatus == "F"' -filter-fields o_orderkey,o_totalprice,note""")


@query("select c_custkey, c_name, c_mktsegment from customer where c_acctbal > 0 and (c_mktsegment = 'BUILDING' or c_custkey % 7 = 3)")
def filter_rows(spark, sf_dir):
    return run(spark, sf_dir, "customer", """-filter 'c_acctbal > 0 && (c_mktsegment == "BUILDING" || c_custkey % 7 == 3)' -filter-fields c_custkey,c_name,c_mktsegment""")


@query("select c_custkey from customer where not (c_acctbal > 0)")
def filter_invert(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-filter 'c_acctbal > 0' invert -filter-fields c_custkey")


@query("select c_custkey as id, c_name as name, c_nationkey from customer")
def rename_and_drop(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-rename-fields id=c_custkey,name=c_name -drop fields=c_acctbal,c_mktsegment")


@query("""select c_custkey, n_name, n_regionkey from customer left join nation on c_nationkey = n_nationkey""")
def join_key(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-join nation keys=c_nationkey,n_nationkey -filter-fields c_custkey,n_name,n_regionkey", "nation")


@query("""select c_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from customer left join orders on c_custkey = o_custkey group by 1""")
def join_first_match(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-join orders keys=c_custkey,o_custkey fields=o_orderkey,o_totalprice -filter-fields c_custkey,o_orderkey,o_totalprice", "orders")


@query("""select c_custkey, cast(count(o_orderkey) as bigint) as n, round(coalesce(sum(o_totalprice), 0), 2) as total, round(max(o_totalprice), 2) as top from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000 group by 1""")
def join_calc(spark, sf_dir):
    return run(spark, sf_dir, "customer", """-join orders keys=c_custkey,o_custkey where='o_totalprice > 300000' calc='n = count(), total = sum(o_totalprice), top = max(o_totalprice)'
        -each 'total = round(total, 2), top = round(top, 2)' -filter-fields c_custkey,n,total,top""", "orders")


@query("""select c_custkey, round(coalesce(sum(o_totalprice), 0), 2) as o_totalprice from customer left join orders on c_custkey = o_custkey group by 1""")
def join_sum_fields(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-join orders keys=c_custkey,o_custkey fields=o_totalprice sum-fields=o_totalprice -each 'o_totalprice = round(o_totalprice, 2)' -filter-fields c_custkey,o_totalprice", "orders")


@query("""select c_custkey, o_orderkey, o_totalprice from customer left join (select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice
          from (select *, max(o_totalprice) over (partition by o_custkey) as m from orders) where o_totalprice = m group by 1) on c_custkey = o_custkey""")
def join_is_max(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-join orders keys=c_custkey,o_custkey where='isMax(o_totalprice)' fields=o_orderkey,o_totalprice -filter-fields c_custkey,o_orderkey,o_totalprice", "orders")


@query("""select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey""")
def join_duplication(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-join orders keys=c_custkey,o_custkey fields=o_orderkey duplication -filter-fields c_custkey,o_orderkey", "orders")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def join_unmatched(spark, sf_dir):
    a, b = layer(spark, sf_dir, "customer"), layer(spark, sf_dir, "orders")
    return joins.unmatched(a, b, ("c_custkey", "o_custkey"), where="o_totalprice > 400000").select("c_custkey")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 5000)")
def join_unjoined(spark, sf_dir):
    a, b = layer(spark, sf_dir, "customer").where("c_acctbal > 5000"), layer(spark, sf_dir, "orders")
    return joins.unjoined(a, b, ("c_custkey", "o_custkey")).select("o_orderkey")


@query("""select cast(count(*) as bigint) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as avg_price, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.75), 4) as q3,
          min(o_totalprice) as low, max(o_totalprice) as high, arg_min(o_orderstatus, o_orderkey) as f, arg_max(o_orderstatus, o_orderkey) as l from orders""")
def calc_layer(spark, sf_dir):
    out = groups.calc(layer(spark, sf_dir, "orders"), "n = count(), total = sum(o_totalprice), avg_price = mean(o_totalprice), q1 = quartile1(o_totalprice), q3 = quartile3(o_totalprice), low = min(o_totalprice), high = max(o_totalprice), f = first(o_orderstatus), l = last(o_orderstatus)")
    return rows.each(out.withColumn(FID, F.lit(0)), "total = round(total, 2), avg_price = round(avg_price, 4), q1 = round(q1, 4), q3 = round(q3, 4)").drop(FID)


@query("""with c as (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as f from orders group by 1, 2)
          select o_custkey, arg_min(o_orderpriority, n * -100000000 + f) as m from c group by 1""")
def dissolve_mode(spark, sf_dir):
    return run(spark, sf_dir, "orders", "-dissolve o_custkey calc='m = mode(o_orderpriority)'")


@query("select o_custkey, list(o_orderkey order by o_orderkey) as ids, bool_and(o_totalprice > 50000) as e, bool_or(o_totalprice > 300000) as s from orders group by 1")
def dissolve_collect(spark, sf_dir):
    return run(spark, sf_dir, "orders", "-dissolve o_custkey calc='ids = collect(o_orderkey), e = every(o_totalprice > 50000), s = some(o_totalprice > 300000)'")


@query("""select c_nationkey, round(sum(c_acctbal), 2) as c_acctbal, arg_min(c_name, c_custkey) as c_name from customer group by 1""")
def dissolve_sum_copy(spark, sf_dir):
    return run(spark, sf_dir, "customer", "-dissolve c_nationkey sum-fields=c_acctbal copy-fields=c_name -each 'c_acctbal = round(c_acctbal, 2)'")


@query("""select cast(row_number() over (order by c_acctbal desc, c_custkey) - 1 as bigint) as place, c_custkey from customer qualify row_number() over (order by c_acctbal desc, c_custkey) <= 20""")
def sort_top(spark, sf_dir):
    out = rows.filter_rows(rows.sort(layer(spark, sf_dir, "customer"), "c_acctbal", descending=True), "this.id < 20")
    return out.select(F.col(FID).cast("long").alias("place"), "c_custkey")


@query("select o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) <= 2")
def uniq_max_count(spark, sf_dir):
    return run(spark, sf_dir, "orders", "-uniq o_custkey max-count=2 -filter-fields o_orderkey")


@query("select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey) as integer) as index from orders")
def uniq_index(spark, sf_dir):
    return run(spark, sf_dir, "orders", "-uniq o_custkey index -filter-fields o_orderkey,index")


@query("select o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) > 1")
def uniq_invert(spark, sf_dir):
    return run(spark, sf_dir, "orders", "-uniq o_custkey invert -filter-fields o_orderkey")


@query("select c_mktsegment as layer_name, cast(count(*) as bigint) as n from customer group by 1")
def split_layers(spark, sf_dir):
    return rows.split(layer(spark, sf_dir, "customer"), "c_mktsegment").groupBy("layer_name").agg(F.count(F.lit(1)).alias("n"))


@query("""select cast(row_number() over (order by l, k) - 1 as bigint) as place, k, c_name, s_name from (select 0 as l, c_custkey as k, c_name, null as s_name from customer union all select 1, s_suppkey, null, s_name from supplier)""")
def merge_layers(spark, sf_dir):
    a = layer(spark, sf_dir, "customer").select(FID, F.col("c_custkey").alias("k"), "c_name")
    b = layer(spark, sf_dir, "supplier").select(FID, F.col("s_suppkey").alias("k"), "s_name")
    return rows.merge_layers([a, b], force=True).select(F.col(FID).cast("long").alias("place"), "k", "c_name", "s_name")


@query("""with v as (select o_totalprice as x, row_number() over (order by o_totalprice, o_orderkey) - 1 as r, count(*) over () as n from orders),
          b as (select i, min(x) as b from v, range(1, 5) t(i) where r = i * n // 5 group by i)
          select o_orderkey, cast((select count(*) from b where o_totalprice >= b.b) as integer) as class from orders""")
def classify_quantile(spark, sf_dir):
    return classes.classify(layer(spark, sf_dir, "orders"), "o_totalprice", classes=5).select("o_orderkey", "class")


@query("""with m as (select min(o_totalprice) as a, max(o_totalprice) as b from orders)
          select o_orderkey, case cast(least(3, floor((o_totalprice - a) / ((b - a) / 4))) as integer) when 0 then 'red' when 1 then 'orange' when 2 then 'yellow' else 'green' end as fill from orders, m""")
def classify_equal_interval(spark, sf_dir):
    return classes.classify(layer(spark, sf_dir, "orders"), "o_totalprice", method="equal-interval", values=["red", "orange", "yellow", "green"], save_as="fill").select("o_orderkey", "fill")


@query("""select c_custkey, case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then 'm' else 'x' end as code from customer""")
def classify_categories(spark, sf_dir):
    return classes.classify(layer(spark, sf_dir, "customer"), "c_mktsegment", categories=["BUILDING", "MACHINERY"], values=["b", "m"], other="x", save_as="code").select("c_custkey", "code")


@query("""select o_orderkey, case when o_totalprice < 100000 then 0 when o_totalprice < 250000 then 1 else 2 end as class from orders""")
def classify_breaks(spark, sf_dir):
    return classes.classify(layer(spark, sf_dir, "orders"), "o_totalprice", breaks=[100000.0, 250000.0]).select("o_orderkey", "class")


def points(spark, sf_dir) -> DataFrame:
    df = layer(spark, sf_dir, "customer")
    xy = df.withColumn("x", ((F.col("c_custkey") * 37) % 360 - 180).cast("double")).withColumn("y", ((F.col("c_custkey") * 53) % 180 - 90).cast("double"))
    return geometry.points_from_xy(xy)


def cells(spark, sf_dir) -> DataFrame:
    """A lattice of 20 degrees around the points, off their whole numbers."""
    return geometry.square_grid(spark, (-180.5, -90.5, 179.5, 89.5), 20.0)


XY_SQL = "(select *, cast((c_custkey * 37) % 360 - 180 as double) as x, cast((c_custkey * 53) % 180 - 90 as double) as y from customer)"


@query(f"select c_custkey, cast(floor((x + 180.5) / 20) as bigint) as col, cast(floor((y + 90.5) / 20) as bigint) as row from {XY_SQL}")
def polygons_to_points(spark, sf_dir):
    out = geometry.join_polygons_to_points(points(spark, sf_dir), cells(spark, sf_dir), 20.0, fields=["col", "row"])
    return out.select("c_custkey", "col", "row")


@query(f"""select g.col, g.row, cast(count(x) as bigint) as n, round(coalesce(sum(c_acctbal), 0), 2) as total from (select * from range(18) a(col), range(9) b(row)) g
          left join {XY_SQL} on col = floor((x + 180.5) / 20) and row = floor((y + 90.5) / 20) group by 1, 2""")
def points_to_polygons(spark, sf_dir):
    out = geometry.join_points_to_polygons(cells(spark, sf_dir), points(spark, sf_dir), 20.0, calc="n = count(), total = sum(c_acctbal)")
    return rows.each(out, "total = round(total, 2)").select("col", "row", "n", "total")


@query(f"select a.c_custkey as a, b.c_custkey as b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) as d from {XY_SQL} a join {XY_SQL} b on a.c_custkey < b.c_custkey and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9")
def points_near_points(spark, sf_dir):
    near = geometry.near_pairs(points(spark, sf_dir), 3.0, digits=6)
    return near.select(F.col("_t").alias("a"), F.col("_s").alias("b"), F.col("_d").alias("d"))


@query(f"select c_nationkey, round(sum(x * c_custkey) / sum(c_custkey), 6) as x, round(sum(y * c_custkey) / sum(c_custkey), 6) as y from {XY_SQL} group by 1 having sum(c_custkey) > 0")
def dissolve_points(spark, sf_dir):
    out = groups.dissolve(points(spark, sf_dir), ["c_nationkey"], weight="c_custkey").where("geom is not null")
    return out.select("c_nationkey", F.round(F.col("geom.parts")[0][0]["x"], 6).alias("x"), F.round(F.col("geom.parts")[0][0]["y"], 6).alias("y"))


@query("""select row, 18 * 20.0 * 20.0 as area, 2 * (18 * 20.0 + 20.0) as perimeter, 1 as rings from range(9) t(row)""")
def dissolve_polygons(spark, sf_dir):
    out = groups.dissolve(cells(spark, sf_dir), ["row"])
    return out.select("row", geometry.planar_area(F.col("geom")).alias("area"), geometry.length(F.col("geom")).alias("perimeter"), F.size("geom.parts").alias("rings"))


@query("""select cast(a.row * 18 + a.col as bigint) as a_fid, cast(b.row * 18 + b.col as bigint) as b_fid, 20.0 as border from (select * from range(18) p(col), range(9) q(row)) a join (select * from range(18) p(col), range(9) q(row)) b
          on (a.row = b.row and b.col = a.col + 1) or (a.col = b.col and b.row = a.row + 1)""")
def polygon_neighbours(spark, sf_dir):
    return geometry.neighbours(cells(spark, sf_dir))


@query("""select cast(row * 18 + col as bigint) as fid, -180.5 + 20 * col as xmin, -90.5 + 20 * row as ymin, 400.0 as area, 80.0 as perimeter, round(pi() / 4, 6) as compactness, -170.5 + 20 * col as cx, -80.5 + 20 * row as cy from range(18) a(col), range(9) b(row)""")
def polygon_measures(spark, sf_dir):
    g = F.col("geom")
    out = cells(spark, sf_dir).select(F.col(FID).alias("fid"), geometry.bbox(g).alias("b"), geometry.planar_area(g).alias("area"), geometry.length(g).alias("perimeter"), F.round(geometry.compactness(g), 6).alias("compactness"), geometry.centroid(g).alias("c"))
    return out.select("fid", "b.xmin", "b.ymin", "area", "perimeter", "compactness", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query(f"""select c_custkey, 'r' || cast(least(3, floor((y - y0) / (y1 - y0) * 4)) as integer) || 'c' || cast(least(4, floor((x - x0) / (x1 - x0) * 5)) as integer) as layer_name
          from {XY_SQL}, (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from {XY_SQL})""")
def split_on_grid(spark, sf_dir):
    return geometry.split_on_grid(points(spark, sf_dir), 5, 4).select("c_custkey", "layer_name")


@query("select cast(i as bigint) as fid, 5.0 + 10 * (i % 4) as x, 5.0 + 10 * (i // 4) as y from range(12) t(i)")
def point_grid(spark, sf_dir):
    g = geometry.point_grid(spark, (0.0, 0.0, 40.0, 30.0), 10.0)
    return g.select(F.col(FID).alias("fid"), F.col("geom.parts")[0][0]["x"].alias("x"), F.col("geom.parts")[0][0]["y"].alias("y"))


@query(f"select c_custkey, x * 2 + 1 as x, y * 2 - 3 as y from {XY_SQL}")
def affine_points(spark, sf_dir):
    out = geometry.affine(points(spark, sf_dir), scale=2, anchor=(0, 0), shift=(1, -3))
    return out.select("c_custkey", F.col("geom.parts")[0][0]["x"].alias("x"), F.col("geom.parts")[0][0]["y"].alias("y"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as double) as k, length(event_type) * 1.0 as len, event_type || ':' || cast(user_id as varchar) as tag, replace(event_type, 'click', 'tap') as renamed, starts_with(event_type, 'p') as p from events""")
def text_functions(spark, sf_dir):
    df = layer(spark, sf_dir, "events").withColumn("props", F.get_json_object("props", "$.k"))
    return rows.filter_fields(rows.each(df, "k = Number(props), len = event_type.length, tag = event_type + ':' + user_id, renamed = event_type.replace('click', 'tap'), p = event_type.startsWith('p')"), ["event_id", "k", "len", "tag", "renamed", "p"]).drop(FID)


@query("""select time_bucket(interval '1 day', ts) as window_start, event_type, cast(count(*) as bigint) as n, round(sum(value), 2) as total from events group by 1, 2""")
def windowed_calc(spark, sf_dir):
    from geoflow.streaming import windowed_calc as calc

    out = calc(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 day", "n = count(), total = sum(value)", keys=["event_type"])
    return out.withColumn("total", F.round("total", 2))


def xy(df: DataFrame, *names: str) -> DataFrame:
    at = F.col("geom")["parts"][0][0]
    return df.select(*names, F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query("""select cast(row * 18 + col as bigint) as fid, -170.5 + 20 * col as x, -80.5 + 20 * row as y from range(18) a(col), range(9) b(row)""")
def points_centroid(spark, sf_dir):
    return xy(shapes.to_points(cells(spark, sf_dir), "centroid").withColumn("fid", F.col(FID)), "fid")


@query("""select 'inner' as kind, cast(17 * 9 + 18 * 8 as bigint) as n, (17 * 9 + 18 * 8) * 20.0 as total union all select 'outer', cast(2 * (18 + 9) as bigint), 2 * (18 + 9) * 20.0""")
def border_lines(spark, sf_dir):
    lines = shapes.border_lines(cells(spark, sf_dir))
    return lines.groupBy(F.col("TYPE").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(geometry.length(F.col("geom"))).alias("total"))


@query(f"""select c_nationkey, cast(count(*) as bigint) as vertices, round(sum(step), 4) as total from (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step from {XY_SQL} window w as (partition by c_nationkey order by c_custkey)) group by 1 having count(*) > 1""")
def points_to_lines(spark, sf_dir):
    lines = shapes.points_to_line(points(spark, sf_dir), ["c_nationkey"]).where("geom is not null")
    return lines.select("c_nationkey", F.size(F.col("geom.parts")[0]).cast("long").alias("vertices"), F.round(geometry.length(F.col("geom")), 4).alias("total"))


@query("""select cast(row * 18 + col as bigint) as fid, (least(50.0, -160.5 + 20 * col) - greatest(-50.0, -180.5 + 20 * col)) * (least(30.0, -70.5 + 20 * row) - greatest(-30.0, -90.5 + 20 * row)) as area
          from range(18) a(col), range(9) b(row) where -160.5 + 20 * col > -50 and -180.5 + 20 * col < 50 and -70.5 + 20 * row > -30 and -90.5 + 20 * row < 30""")
def clip_to_box(spark, sf_dir):
    out = shapes.clip_box(cells(spark, sf_dir), (-50.0, -30.0, 50.0, 30.0))
    return out.select(F.col(FID).alias("fid"), geometry.planar_area(F.col("geom")).alias("area"))


@query(f"""select c_custkey, round(x * pi() / 180 * 6378137, 3) as x, round(ln(tan(pi() / 4 + y * pi() / 360)) * 6378137, 3) as y from {XY_SQL} where y > -90 and y < 90""")
def project_mercator(spark, sf_dir):
    df = points(spark, sf_dir).where("y > -90 and y < 90").drop("x", "y")
    at = F.col("geom")["parts"][0][0]
    return df.withColumn("geom", shapes.project(F.col("geom"), "merc")).select("c_custkey", F.round(at["x"], 3).alias("x"), F.round(at["y"], 3).alias("y"))


@query(f"""select c_custkey, round(x * pi() / 180 * cos(y * pi() / 180) * 6378137, 3) as x, round(y * pi() / 180 * 6378137, 3) as y from {XY_SQL}""")
def project_sinusoidal(spark, sf_dir):
    at = F.col("geom")["parts"][0][0]
    return points(spark, sf_dir).drop("x", "y").withColumn("geom", shapes.project(F.col("geom"), "sinu")).select("c_custkey", F.round(at["x"], 3).alias("x"), F.round(at["y"], 3).alias("y"))


@query("""select case when i <= 36 then 'meridian' else 'parallel' end as type, case when i <= 36 then -180.0 + 10 * i else -90.0 + 10 * (i - 36) end as value,
          cast(case when i > 36 then 361 when (-180 + 10 * i) % 90 = 0 then 181 else 161 end as integer) as vertices from range(54) t(i)""")
def graticule(spark, sf_dir):
    return shapes.graticule(spark).select("type", "value", F.size(F.col("geom.parts")[0]).alias("vertices"))


@query(f"""select cast(x + 180 as bigint) as col, cast(y + 90 as bigint) as row, round(count(*) * pi() / 4, 6) as weight, cast(count(*) as bigint) as n, round(sum(c_acctbal), 2) as total from {XY_SQL} group by 1, 2""")
def point_to_grid(spark, sf_dir):
    out = shapes.point_to_grid(points(spark, sf_dir), (-180.5, -90.5, 180.5, 90.5), 1.0, calc="n = count(), total = sum(c_acctbal)")
    return out.select("col", "row", F.round("weight", 6).alias("weight"), "n", F.round("total", 2).alias("total"))


@query("""select cast(row * 18 + col as bigint) as fid, case when row < 4 then 'south' else 'north' end as side from range(18) a(col), range(9) b(row)""")
def data_fill(spark, sf_dir):
    """Every third column of cells is empty; its neighbours in the same row and column decide."""
    df = cells(spark, sf_dir).withColumn("side", F.when(F.col("col") % 3 != 1, F.when(F.col("row") < 4, "south").otherwise("north")))
    return shapes.data_fill(df, "side").select(F.col(FID).alias("fid"), "side")


@query("select cast(row_number() over (order by o_totalprice desc, o_orderkey) - 1 as bigint) as place, o_orderkey from orders")
def sort_all(spark, sf_dir):
    return rows.sort(layer(spark, sf_dir, "orders"), "o_totalprice", descending=True).select(F.col(FID).alias("place"), "o_orderkey")


@query("""select cast(row_number() over (order by l, k) - 1 as bigint) as place, k, status, segment from (select 0 as l, o_orderkey as k, o_orderstatus as status, null as segment from orders union all select 1, c_custkey, null, c_mktsegment from customer)""")
def merge_all(spark, sf_dir):
    a = layer(spark, sf_dir, "orders").select(FID, F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    b = layer(spark, sf_dir, "customer").select(FID, F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return rows.merge_layers([a, b], force=True).select(F.col(FID).alias("place"), "k", "status", "segment")


@query("""with m as (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderkey) as n from customer left join orders on c_custkey = o_custkey)
          select cast(row_number() over (order by case when n > 1 then 1 else 0 end, c_custkey, o_orderkey) - 1 as bigint) as place, c_custkey, o_orderkey from m""")
def join_duplication_order(spark, sf_dir):
    out = joins.join(layer(spark, sf_dir, "customer"), layer(spark, sf_dir, "orders"), ("c_custkey", "o_custkey"), fields=["o_orderkey"], duplication=True)
    return out.select(F.col(FID).alias("place"), "c_custkey", "o_orderkey")


@query(f"""select a.c_custkey, cast(count(b.c_custkey) as bigint) as n, min(b.c_custkey) as first from {XY_SQL} a join {XY_SQL} b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9 group by 1""")
def join_max_distance(spark, sf_dir):
    a, b = points(spark, sf_dir), points(spark, sf_dir).select(FID, "geom", F.col("c_custkey").alias("k"))
    return Session(spark, {"b": b, "a": a}).run("-join b max-distance=3 calc='n = count(), first = first(k)'").select("c_custkey", F.col("n").cast("long").alias("n"), "first")


def boxes(spark, *sides: tuple[float, float, float, float]) -> DataFrame:
    df = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(sides)], f"{FID} long, x0 double, y0 double, x1 double, y1 double")
    return df.withColumn("geom", geometry.rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))


def shifted(spark, sf_dir) -> DataFrame:
    """The lattice moved by (7, 4), its places named by scol and srow."""
    return geometry.affine(cells(spark, sf_dir), shift=(7, 4)).withColumnsRenamed({"col": "scol", "row": "srow"})


LATTICE_SQL = "(select cast(row * 18 + col as bigint) as fid, col, row, -180.5 + 20 * col as x0, -90.5 + 20 * row as y0 from range(18) a(col), range(9) b(row))"
WINDOWS = ((-50, -30, 50, 30), (0, 0, 100, 60), (0, 0, 50, 30))  # the third is what the others share


def _within_sql(k: int) -> str:
    x0, y0, x1, y1 = WINDOWS[k]
    return f"greatest(0, least({x1}, x0 + 20) - greatest({x0}, x0)) * greatest(0, least({y1}, y0 + 20) - greatest({y0}, y0))"


WINDOW_AREA = f"({_within_sql(0)} + {_within_sql(1)} - {_within_sql(2)})"


@query(f"select fid, round({WINDOW_AREA}, 6) as area from {LATTICE_SQL} where {WINDOW_AREA} > 0")
def clip_polygons(spark, sf_dir):
    s = Session(spark, {"windows": boxes(spark, *WINDOWS[:2]), "cells": cells(spark, sf_dir)})
    return s.run("-clip windows").select(F.col(FID).alias("fid"), F.round(geometry.planar_area(F.col("geom")), 6).alias("area"))


@query(f"select fid, round(400 - {WINDOW_AREA}, 6) as area from {LATTICE_SQL} where {WINDOW_AREA} < 400")
def erase_polygons(spark, sf_dir):
    s = Session(spark, {"windows": boxes(spark, *WINDOWS[:2]), "cells": cells(spark, sf_dir)})
    return s.run("-erase windows").select(F.col(FID).alias("fid"), F.round(geometry.planar_area(F.col("geom")), 6).alias("area"))


@query(f"select c_custkey from {XY_SQL} where (x between -50 and 50 and y between -30 and 30) or (x between 0 and 100 and y between 0 and 60)")
def clip_points(spark, sf_dir):
    return Session(spark, {"windows": boxes(spark, *WINDOWS[:2]), "points": points(spark, sf_dir)}).run("-clip windows").select("c_custkey")


@query(f"select fid from {LATTICE_SQL} where x0 <= 50 and x0 + 20 >= -50 and y0 <= 30 and y0 + 20 >= -30")
def filter_bbox(spark, sf_dir):
    return Session(spark, {"cells": cells(spark, sf_dir)}).run("-filter bbox=-50,-30,50,30").select(F.col(FID).alias("fid"))


OVERLAP_SQL = f"""(select a.fid as t, b.fid as s, b.col, b.row, (least(a.x0 + 27, b.x0 + 20) - greatest(a.x0 + 7, b.x0)) * (least(a.y0 + 24, b.y0 + 20) - greatest(a.y0 + 4, b.y0)) as area
          from {LATTICE_SQL} a join {LATTICE_SQL} b on a.x0 + 27 > b.x0 and b.x0 + 20 > a.x0 + 7 and a.y0 + 24 > b.y0 and b.y0 + 20 > a.y0 + 4)"""


@query(f"select t as fid, arg_max(col, area) as col, arg_max(row, area) as row from {OVERLAP_SQL} group by 1")
def join_largest_overlap(spark, sf_dir):
    out = Session(spark, {"cells": cells(spark, sf_dir), "shifted": shifted(spark, sf_dir)}).run("-join cells largest-overlap fields=col,row")
    return out.select(F.col(FID).alias("fid"), "col", "row")


@query(f"select t as fid, cast(count(*) as bigint) as n, round(sum((col + 10 * row) * area / 400), 6) as v from {OVERLAP_SQL} group by 1")
def join_interpolate(spark, sf_dir):
    source = cells(spark, sf_dir).withColumn("v", F.col("col") + 10 * F.col("row"))
    out = Session(spark, {"cells": source, "shifted": shifted(spark, sf_dir)}).run("-join cells interpolate=v calc='n = count()'")
    return out.select(F.col(FID).alias("fid"), F.col("n").cast("long").alias("n"), F.round("v", 6).alias("v"))


@query(f"""with o as (select cast(sum(area) as double) as shared from {OVERLAP_SQL}) select true as in_a, true as in_b, round(shared, 4) as area from o union all select true, false, round(162 * 400 - shared, 4) from o union all select false, true, round(162 * 400 - shared, 4) from o""")
def union_layers(spark, sf_dir):
    out = Session(spark, {"cells": cells(spark, sf_dir), "shifted": shifted(spark, sf_dir)}).run("-target cells,shifted -union")
    return out.groupBy(F.col("col").isNotNull().alias("in_a"), F.col("scol").isNotNull().alias("in_b")).agg(F.round(F.sum(geometry.planar_area(F.col("geom"))), 4).alias("area"))


@query("""select cast(n as integer) as n, cast(count(*) as bigint) as tiles, round(sum(w * 20.0), 4) as area from (select 1 as n, 20.0 as w from range(9) a(r), range(2) b(k) union all select 1, 10.0 from range(9) a(r), range(1, 17) b(k) union all select 2, 10.0 from range(9) a(r), range(1, 18) b(k)) group by 1""")
def mosaic_tiles(spark, sf_dir):
    """Cells half as wide again, so that each covers half of the next."""
    wide = cells(spark, sf_dir).withColumn("geom", geometry.map_points(F.col("geom"), lambda p: F.struct((F.when(p["x"] > F.col("geom.parts")[0][0]["x"], p["x"] + 10).otherwise(p["x"])).alias("x"), p["y"].alias("y"))))
    out = Session(spark, {"wide": wide}).run("-mosaic calc='n = count()'")
    return out.groupBy(F.col("n").cast("int").alias("n")).agg(F.count(F.lit(1)).alias("tiles"), F.round(F.sum(geometry.planar_area(F.col("geom"))), 4).alias("area"))


@query("select row, (18 * 20.0 + 10) * 20 as area, 1 as rings from range(9) t(row)")
def dissolve_overlapping(spark, sf_dir):
    wide = cells(spark, sf_dir).withColumn("geom", geometry.map_points(F.col("geom"), lambda p: F.struct((F.when(p["x"] > F.col("geom.parts")[0][0]["x"], p["x"] + 10).otherwise(p["x"])).alias("x"), p["y"].alias("y"))))
    out = Session(spark, {"wide": wide}).run("-dissolve2 row")
    return out.select("row", geometry.planar_area(F.col("geom")).alias("area"), F.size("geom.parts").alias("rings"))


@query(f"select fid, 400.0 as area, 5 as vertices from {LATTICE_SQL}")
def simplify_shared(spark, sf_dir):
    out = Session(spark, {"cells": cells(spark, sf_dir)}).run("-densify interval=3 -simplify interval=1")
    return out.select(F.col(FID).alias("fid"), F.round(geometry.planar_area(F.col("geom")), 6).alias("area"), F.size(F.col("geom.parts")[0]).alias("vertices"))


@query(f"select fid, round(400 + 80 + 36 * sin(pi() / 36), 6) as area from {LATTICE_SQL}")
def buffer_polygons(spark, sf_dir):
    out = Session(spark, {"cells": cells(spark, sf_dir)}).run("-buffer 1 vertices=72")
    return out.select(F.col(FID).alias("fid"), F.round(geometry.planar_area(F.col("geom")), 6).alias("area"))


@query("""select value as lat, case when c < 18 then c end as col, case when c < 18 then cast(floor((value + 90.5) / 20) as bigint) end as row, cast(1 as bigint) as n, round(least(180, -160.5 + 20 * c) - greatest(-180, -180.5 + 20 * c), 6) as size
          from (select -90.0 + 10 * i as value from range(1, 18) t(i)), range(19) k(c)""")
def divide_lines(spark, sf_dir):
    lines = shapes.graticule(spark).where("type = 'parallel'").withColumnRenamed("value", "lat").drop("type")
    out = Session(spark, {"cells": cells(spark, sf_dir), "lines": lines}).run("-divide cells")
    return out.groupBy("lat", "col", "row").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(geometry.length(F.col("geom"))), 6).alias("size"))


@query("select cast(162 as bigint) as n, 400.0 as least, 400.0 as most")
def polygons_from_lines(spark, sf_dir):
    lines = rows.with_fid(shapes.border_lines(cells(spark, sf_dir)).withColumn("x", F.col("geom.parts")[0][0]["x"]).withColumn("y", F.col("geom.parts")[0][0]["y"]).withColumn("x2", F.col("geom.parts")[0][1]["x"]), "x", "y", "x2")
    out = Session(spark, {"lines": lines}).run("-polygons")
    area = F.round(geometry.planar_area(F.col("geom")), 6)
    return out.agg(F.count(F.lit(1)).alias("n"), F.min(area).alias("least"), F.max(area).alias("most"))


@query("select c_custkey, case when c_acctbal < 0 then chr(8722) else '+' end || printf('%06.2f', abs(c_acctbal)) as shown from customer where abs(c_acctbal) < 1000")
def sprintf_numbers(spark, sf_dir):
    df = layer(spark, sf_dir, "customer").where("abs(c_acctbal) < 1000")
    return Session(spark, {"c": df}).run("-each 'shown = sprintf(\"%+07.2f\", c_acctbal)'").select("c_custkey", "shown")
