"""calc, dissolve and info: aggregates over a layer or its groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID, Calc, compile_calc, group, grouped
from geoflow.operators.rows import _scope, condition, field


def calc(df: DataFrame, expression: str, *, where: str | None = None, defs: dict | None = None, compat: bool = True) -> DataFrame:
    """One row with a column for each assignment (a bare expression: named by its text), also over no rows."""
    if where is not None:
        df = df.where(condition(df, where, defs))
    return grouped(df, [], compile_calc(expression, _scope(df, defs), compat))


def calc_layer(df: DataFrame, expressions: list[str], *, layer_name: str, defs: dict | None = None) -> DataFrame:
    """A row for each expression: expression, value, layer_name."""
    calc = Calc()
    for k, e in enumerate(expressions):
        compile_calc(e, _scope(df, defs), into=calc)
        calc.out = [*calc.out[:k], (f"_{k}", calc.out[-1][1].cast("double"))]
    one = grouped(df, [], calc)
    rows = F.array(*(F.struct(F.lit(e).alias("expression"), F.col(f"_{k}").alias("value")) for k, e in enumerate(expressions)))
    return one.select(F.explode(rows).alias("r")).select("r.*", F.lit(layer_name).alias("layer_name"))


def dissolve(df: DataFrame, fields: list[str], *, calc: str | None = None, sum_fields: list[str] = (), copy_fields: list[str] = (), where: str | None = None, weight: str | None = None, multipart: bool = False, overlapping: bool = False, sphere: bool = False, defs: dict | None = None, compat: bool = True) -> DataFrame:
    """One row for each group, in the order of their first rows: keys, sums (null as 0), the first row's values of copy_fields, calc.

    where: only these rows are dissolved; the others come first, as they are.  Points become the weighted
    centroid (sphere: of directions); polygons lose their shared edges (overlapping: also what covers each other);
    lines are joined end to end (multipart: parts are put together instead).
    """
    rest = None
    if where is not None:
        on = F.coalesce(condition(df, where, defs), F.lit(False))
        df, rest = df.where(on), df.where(~on)
    aggs = [F.sum(F.coalesce(field(f).cast("double"), F.lit(0.0))).alias(f) for f in sum_fields]
    aggs += [F.min_by(F.struct(field(f).alias("v")), F.col(FID))["v"].alias(f) for f in copy_fields if f not in fields]
    out = group(df, list(fields), aggs, compile_calc(calc, _scope(df, defs), compat) if calc else None)
    if "geom" in df.columns:
        from geoflow.operators.geometry import dissolve_shapes

        shapes = dissolve_shapes(df, list(fields), weight=weight, multipart=multipart, overlapping=overlapping, sphere=sphere)
        out = out.join(shapes, FID, "left")
    if rest is not None:
        out = rest.unionByName(out, allowMissingColumns=True)
    return out


def info(df: DataFrame, *, layer_name: str = "layer") -> DataFrame:
    """One row for each field, A to Z: field, kind, first value (as text), nulls, and the layer's number of rows."""
    from geoflow.functions.expressions import kind_of

    names = sorted(c for c in df.columns if c not in (FID, "geom"))
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(field(c).isNull()).alias(f"_null{k}") for k, c in enumerate(names)), *(F.min_by(F.struct(field(c).cast("string").alias("v")), F.col(FID))["v"].alias(f"_first{k}") for k, c in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("kind"), F.col(f"_first{k}").alias("first_value"), F.col(f"_null{k}").alias("nulls")) for k, c in enumerate(names)))
    return one.select(F.lit(layer_name).alias("layer_name"), F.col("n").alias("records"), F.explode(rows).alias("r")).select("layer_name", "records", "r.*")
