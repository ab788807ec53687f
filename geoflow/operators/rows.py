"""Row-local commands, ordering and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID
from geoflow.functions.expressions import ExpressionError, Lowering, Value, compile_value, parse, scope_of, truth
from geoflow.shared import materialise


def field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, by: list[Column]) -> DataFrame:
    """`__fid` from 0 without gaps in the order of `by`; rows that tie get some order.

    The rows are dealt by ranges, sorted, numbered within each partition and written once to the shared folder, so
    that all later reads agree; then they move up by the sizes of the partitions before.  No task sees more than
    its own range, and the sizes are a row for each partition.
    """
    if "_at" in df.columns:
        raise ValueError("the name _at is taken")
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    written = materialise(dealt, "numbered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = written.groupBy(part.alias("_part")).agg((F.max(at) + 1).alias("_n"))
    offset = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # a row for each partition
    return written.withColumn("_part", part).join(F.broadcast(offset), "_part").withColumn(FID, at + F.col("_offset")).drop("_part", "_at", "_offset")


def with_fid(df: DataFrame, *keys: str) -> DataFrame:
    """Rows numbered from 0 in the order of the keys.  One integer key from 0 without gaps can serve as `__fid` as it is; this is for all others."""
    return numbered(df, [field(k) for k in keys])


def _scope(df: DataFrame, defs: dict | None):
    this = {"id": Value(F.col(FID).cast("double"), "num")} if FID in df.columns else {}
    if "geom" in df.columns:
        from geoflow.operators.geometry import this_values

        this |= this_values(df)
    return scope_of(df.drop(FID).schema, defs, this)


def condition(df: DataFrame, expression: str, defs: dict | None = None) -> Column:
    value = compile_value(expression, _scope(df, defs))
    if value.kind != "bool":
        raise ExpressionError("a filter must be true or false")
    return value.column


def each(df: DataFrame, expression: str, *, where: str | None = None, ids: list[int] | None = None, defs: dict | None = None) -> DataFrame:
    """Runs assignments from left to right; `delete name` drops a field.  Rows outside where or ids keep their values; a new field is null there."""
    on = None
    if where is not None:
        on = condition(df, where, defs)
    if ids is not None:
        chosen = F.col(FID).isin(*ids)
        on = chosen if on is None else on & chosen
    if on is not None:
        df = df.withColumn("_on", on)
    for node in parse(expression):
        if node[0] == "delete":
            df = df.drop(node[1])
        elif node[0] == "set":
            chain, body = [node[1]], node[2]
            while body[0] == "set":
                chain.append(body[1])
                body = body[2]
            value = Lowering(_scope(df.drop("_on"), defs)).lower(body).column
            for name in reversed(chain):
                old = field(name) if name in df.columns else F.lit(None)
                df = df.withColumn(name, value if on is None else F.when(F.col("_on"), value).otherwise(old))
    return df.drop("_on")


def filter_rows(df: DataFrame, expression: str | None = None, *, invert: bool = False, ids: list[int] | None = None, remove_empty: bool = False, bbox: tuple[float, float, float, float] | None = None, defs: dict | None = None) -> DataFrame:
    """Keeps rows that meet all criteria (invert: the others).  An expression must be boolean; null drops the row.

    bbox: the shape meets the box.  remove_empty: there is a shape, and a polygon has an area.
    """
    tests = [] if expression is None else [condition(df, expression, defs)]
    if ids is not None:
        tests.append(F.col(FID).isin(*ids))
    if remove_empty:
        from geoflow.operators.geometry import planar_area

        tests.append(F.col("geom").isNotNull() & ((F.col("geom.type") != "polygon") | (planar_area(F.col("geom")) > 0)))
    if bbox is not None:
        from geoflow.operators.geometry import meets_box

        tests.append(meets_box(F.col("geom"), bbox))
    if not tests:
        return df
    for k, test in enumerate(tests):
        tests[k] = F.coalesce(test, F.lit(False))
    keep = tests[0]
    for test in tests[1:]:
        keep = keep & test
    return df.where(~keep if invert else keep)


def filter_fields(df: DataFrame, fields: list[str], *, invert: bool = False) -> DataFrame:
    """Only these fields, in this order; new=old renames.  Row order and geometry stay."""
    hidden = [c for c in (FID, "geom") if c in df.columns]
    if invert:
        return df.drop(*fields)
    pairs = [f.split("=", 1) if "=" in f else (f, f) for f in fields]
    return df.select(*(field(old).alias(new) for new, old in pairs), *hidden)


def rename_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """new=old; the listed fields come first."""
    pairs = [f.split("=", 1) for f in fields]
    rest = [c for c in df.columns if c not in {old for _, old in pairs} | {new for new, _ in pairs}]
    return df.select(*(field(old).alias(new) for new, old in pairs), *map(field, rest))


def drop(df: DataFrame, fields: list[str] | None = None, *, geometry: bool = False, holes: bool = False) -> DataFrame:
    """Without fields (`*`: all), the geometry, or the holes of polygons."""
    if holes:
        from geoflow.operators.geometry import ring_area

        g = F.col("geom")
        outer = F.filter(g["parts"], lambda p, i: (ring_area(p) >= 0) | (i == 0))
        df = df.withColumn("geom", F.when(g["type"] == "polygon", F.struct(g["type"].alias("type"), outer.alias("parts"))).otherwise(g))
    names = [c for c in df.columns if c not in (FID, "geom")] if fields == ["*"] else list(fields or [])
    return df.drop(*names, *(["geom"] if geometry else []))


def sort(df: DataFrame, expression: str, *, descending: bool = False, defs: dict | None = None) -> DataFrame:
    """Stable; null and NaN come last in both directions.  `__fid` is numbered anew."""
    value = compile_value(expression, _scope(df, defs))
    key = value.column
    keyed = df.withColumn("_null", key.isNull().cast("int") * 2 + (F.coalesce(F.isnan(key), F.lit(False)).cast("int") if value.kind == "num" else 0)).withColumn("_key", key).withColumnRenamed(FID, "_old")
    by = [F.col("_null"), F.col("_key").desc() if descending else F.col("_key").asc(), F.col("_old")]
    return numbered(keyed, by).drop("_null", "_key", "_old")


def uniq(df: DataFrame, expression: str, *, max_count: int = 1, invert: bool = False, index: bool = False, defs: dict | None = None) -> DataFrame:
    """The first max_count rows of each key (invert: the others); index: all rows, with their number within the key in `index`."""
    key = compile_value(expression, _scope(df, defs)).column
    n = F.row_number().over(Window.partitionBy("_key").orderBy(FID))
    numbered = df.withColumn("_key", key).withColumn("_n", n)
    if index:
        return numbered.withColumn("index", F.col("_n")).drop("_key", "_n")
    return numbered.where(F.col("_n") > max_count if invert else F.col("_n") <= max_count).drop("_key", "_n")


def split(df: DataFrame, expression: str | None = None, *, name: str = "layer", defs: dict | None = None) -> DataFrame:
    """One layer for each value, told by `layer_name`; without an expression, one for each row.  One plan, however many layers; write it partitioned by that column."""
    if expression is None:
        return df.withColumn("layer_name", F.concat(F.lit(f"{name}-"), (F.col(FID) + 1).cast("string")))
    from geoflow.functions.expressions import text

    return df.withColumn("layer_name", text(compile_value(expression, _scope(df, defs))))


def merge_layers(layers: list[DataFrame], *, force: bool = False) -> DataFrame:
    """The rows of all layers, in order.  Fields must agree unless forced; kinds of values must always."""
    from geoflow.functions.expressions import kind_of

    names = [set(df.columns) for df in layers]
    if not force and any(n != names[0] for n in names):
        raise ValueError(f"layers have different fields: {sorted(set.union(*names) - set.intersection(*names))}")
    kinds: dict[str, str] = {}
    for df in layers:
        for f in df.schema:
            if kinds.setdefault(f.name, kind_of(f.dataType)) != kind_of(f.dataType):
                raise ValueError(f"field {f.name} holds different types")
    out = None
    for k, df in enumerate(layers):
        df = df.withColumn("_layer", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=force)
    return with_fid(out.withColumnRenamed(FID, "_old"), "_layer", "_old").drop("_layer", "_old")


def flag(df: DataFrame, expression: str, defs: dict | None = None) -> Column:
    return truth(compile_value(expression, _scope(df, defs)))
