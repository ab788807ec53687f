"""The aggregate functions of calc expressions, with the reference's values on empty input and its null rules.

Null counts as 0 in means, extremes and quantiles; NaN takes no part in sums and extremes; first, last,
mode and collect follow the row order in `__fid`.  compat=False gives SQL's null rules instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflow.functions.expressions import ExpressionError, Lowering, Node, Scope, Value, number, parse, truth

FID = "__fid"
NAMES = {"count", "sum", "sums", "average", "mean", "median", "quartile1", "quartile2", "quartile3", "iqr", "quantile", "min", "max", "mode", "collect", "collectIds", "first", "last", "every", "some", "width", "height"}


class Calc:
    """The aggregates that calc expressions need, and what becomes of them.

    Calls are gathered as aggregate columns of their own; modes as their arguments.  grouped() computes both and then
    the assignments, which are plain expressions over their results.
    """

    def __init__(self):
        self.aggs: list[Column] = []
        self.modes: list[Column] = []
        self.lists: list[Column] = []
        self.out: list[tuple[str, Column]] = []

    def add(self, column: Column) -> Column:
        self.aggs.append(column.alias(f"_agg{len(self.aggs)}"))
        return F.col(f"_agg{len(self.aggs) - 1}")

    def sums(self, column: Column) -> Column:
        """Lists added up place by place."""
        self.lists.append(column)
        return F.col(f"_sums{len(self.lists) - 1}")

    def mode(self, column: Column) -> Column:
        self.modes.append(column)
        return F.col(f"_mode{len(self.modes) - 1}")


def grouped(df: DataFrame, keys: list[Column], calc: Calc, *more: Column) -> DataFrame:
    """keys (as _key0, _key1 …), the further aggregates, and calc's names; without keys one row, also over no rows.

    A mode counts by group and value first, so that neither a large group nor a frequent value is ever gathered.
    """
    names = [f"_key{k}" for k in range(len(keys))]
    df = df.withColumns(dict(zip(names, keys, strict=True))) if keys else df
    out = df.groupBy(*names).agg(*more, *calc.aggs, *([] if more or calc.aggs else [F.count(F.lit(1)).alias("_rows")]))
    apart = []
    for k, x in enumerate(calc.modes):
        counted = df.withColumn("_value", x).groupBy(*names, "_value").agg(F.count(F.lit(1)).alias("_n"), F.min(FID).alias("_f"))
        apart.append((f"_mode{k}", counted.groupBy(*names).agg(F.min_by(F.struct(F.col("_value").alias("v")), F.struct(-F.col("_n"), F.col("_f")))["v"].alias(f"_mode{k}"))))
    for k, x in enumerate(calc.lists):
        each = df.select(*names, F.posexplode(x).alias("_at", "_v")).groupBy(*names, "_at").agg(F.sum(F.coalesce(F.col("_v").try_cast("double"), F.lit(0.0))).alias("_v"))
        apart.append((f"_sums{k}", each.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda z: z["_v"]).alias(f"_sums{k}"))))
    for made, best in apart:
        if names:
            best = best.toDF(*(f"_of{n}" for n in names), made)
            same = F.lit(True)
            for n in names:
                same = same & F.col(n).eqNullSafe(F.col(f"_of{n}"))
            out = out.join(best, same, "left").drop(*(f"_of{n}" for n in names))
        else:
            out = out.crossJoin(best)  # one row each
    kept = [F.col(f"`{c}`") for c in out.columns if not c.startswith(("_agg", "_mode", "_sums")) and c != "_rows"]
    return out.select(*kept, *(c.alias(n) for n, c in calc.out))


def aggregate(name: str, args: list[Value], raw: list[Node], compat: bool = True) -> Value:
    """One call, other than mode(), as an aggregate column."""
    if name == "count":
        return Value(F.count(F.lit(1)), "num")
    if name == "collectIds":
        return Value(F.array_sort(F.collect_list(FID)), "list")
    if name in ("width", "height"):
        from geoflow.operators.geometry import bbox

        low, high = ("xmin", "xmax") if name == "width" else ("ymin", "ymax")
        return Value(F.max(bbox(F.col("geom"))[high]) - F.min(bbox(F.col("geom"))[low]), "num")
    v = args[0]
    if name in ("first", "last"):
        pick = F.min_by if name == "first" else F.max_by
        return Value(pick(F.struct(v.column.alias("v")), F.col(FID))["v"], v.kind)
    if name == "collect":
        return Value(F.transform(F.array_sort(F.collect_list(F.struct(F.col(FID).alias("f"), v.column.alias("v")))), lambda s: s["v"]), "list")
    if name in ("every", "some"):
        return Value(F.coalesce((F.bool_and if name == "every" else F.bool_or)(truth(v)), F.lit(False)), "bool")
    if v.kind not in ("num", "bool", "str", "null"):
        raise ExpressionError(f"{name}() needs numbers")
    x = number(v) if compat or v.kind != "num" else v.column.cast("double")
    sound = F.when(~F.isnan(x), x)
    if name == "sum":
        return Value(F.coalesce(F.sum(sound), F.lit(0.0)), "num")
    if name in ("average", "mean"):
        return Value(F.avg(sound), "num")
    if name in ("min", "max"):
        return Value((F.min if name == "min" else F.max)(sound), "num")
    at = lambda p: F.percentile(sound, F.lit(p))
    if name == "quantile":
        if raw[1][0] != "num":
            raise ExpressionError("quantile() takes a constant share")
        return Value(at(raw[1][1]), "num")
    if name == "iqr":
        return Value(at(0.75) - at(0.25), "num")
    shares = {"median": 0.5, "quartile1": 0.25, "quartile2": 0.5, "quartile3": 0.75}
    if name in shares:
        return Value(at(shares[name]), "num")
    raise ExpressionError(f"unknown aggregate {name!r}")


def compile_calc(source: str, scope: Scope, compat: bool = True, into: Calc | None = None, modes: bool = True) -> Calc:
    """Adds each assignment to a Calc; a bare expression is named by its text."""
    calc = into or Calc()
    done: dict[str, Value] = {}
    plain = Lowering(scope)

    def call(name: str, args: list[Node]) -> Value | None:
        if name not in NAMES:
            return None
        lowered = [] if name in ("count", "collectIds", "width", "height") else [plain.lower(a) for a in args]
        if name == "mode":
            if not modes:
                raise ExpressionError("mode() isn't available here")
            return Value(calc.mode(lowered[0].column), lowered[0].kind)
        if name == "sums":
            return Value(calc.sums(lowered[0].column), "list")
        value = aggregate(name, lowered, args, compat)
        return Value(calc.add(value.column), value.kind)

    for node in parse(source):
        name, body = (node[1], node[2]) if node[0] == "set" else (source.strip(), node)
        inner = Scope({**scope.fields, **done}, scope.defs, scope.this)
        value = Lowering(inner, call).lower(body)
        done[name] = value
        calc.out.append((name, value.column))
    return calc


def group(df: DataFrame, keys: list[str], aggs: list[Column], calc: Calc | None = None) -> DataFrame:
    """Groups in the order of their first rows, which their `__fid` tells; no rows, no groups, even without keys."""
    out = grouped(df, [F.col("`" + k.replace("`", "``") + "`") for k in keys], calc or Calc(), F.min(FID).alias("_first"), *aggs)
    out = out.where(F.col("_first").isNotNull())
    named = [F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)]
    return out.select(*named, F.col("_first").alias(FID), *(F.col(f"`{c}`") for c in out.columns if c != "_first" and not c.startswith("_key")))
