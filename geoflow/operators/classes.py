"""classify: class breaks from a field's values, and what each class is given."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID
from geoflow.operators.rows import field, numbered


METHODS = ("quantile", "equal-interval", "hybrid", "nice", "indexed", "categorical", "non-adjacent")


def quantile_breaks(df: DataFrame, name: str, classes: int) -> list[float]:
    """The values at places floor(i * n / classes) of the sorted finite values, found by distributed numbering."""
    x = field(name).cast("double")
    values = df.select(x.alias("x"), F.col(FID).alias("_f")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = values.count()
    places = [i * n // classes for i in range(1, classes)] if n else []
    got = {r[FID]: r.x for r in numbered(values, [F.col("x"), F.col("_f")]).where(F.col(FID).isin(*places)).collect()} if places else {}
    return [got[p] for p in places]


def interval_breaks(df: DataFrame, name: str, classes: int, low: float | None = None, high: float | None = None) -> list[float]:
    x = F.nanvl(field(name).cast("double"), F.lit(None).cast("double"))
    r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if r.a is None:
        return []
    a, b = r.a if low is None else low, r.b if high is None else high
    return [a + i * (b - a) / classes for i in range(1, classes)]


def hybrid_breaks(df: DataFrame, name: str, classes: int) -> list[float]:
    """The outer breaks by quantile, those between at equal steps."""
    q = quantile_breaks(df, name, classes)
    if len(q) < 3:
        return q
    return [q[0] + i * (q[-1] - q[0]) / (len(q) - 1) for i in range(len(q))]


#: Round steps between 10 and 100, and the multiple that the lowest break of each is rounded to.
NICE_STEPS = ((10, 10), (12, 2), (15, 5), (18, 2), (20, 10), (22, 2), (25, 5), (30, 10), (35, 5), (40, 10), (45, 5), (50, 50), (60, 10), (70, 10), (80, 10), (90, 10), (100, 10))


def nice_breaks(df: DataFrame, name: str, classes: int) -> list[float]:
    """Evenly spaced breaks at round numbers, the best of a few by roundness and by how even the outer classes are.

    The candidates come from the outer quantile breaks; what falls into each of their outer classes is counted in one
    job over the table.
    """
    q = quantile_breaks(df, name, classes)
    if not q:
        return []
    n, low, high = len(q), q[0], q[-1]
    step = (high - low) / (n - 1) if n > 1 else max(abs(low), abs(high))
    if not 1e-4 < step < 1e9:
        raise ValueError("the range of the data is too small or too large")
    power = 0
    while step * 10.0**power > 100:
        power -= 1
    while step * 10.0**power < 10:
        power += 1
    real = lambda x: x * 10 ** -power if power < 0 else x / 10**power
    scaled = step * 10.0**power
    at = next(k for k in range(1, len(NICE_STEPS)) if NICE_STEPS[k - 1][0] <= scaled <= NICE_STEPS[k][0])
    found = []
    for interval, multiple in NICE_STEPS[at - 1 : at + 1]:
        unit = real(multiple)
        near = math.floor(low / unit + 0.5) * unit
        roundness = 1 if multiple >= 50 else 0.9 if multiple >= 10 else 0.8 if multiple >= 5 else 0.7
        for first in sorted((near, near + unit if low > near else near - unit)):
            found.append((roundness, [first + real(interval) * i for i in range(n)]))
    x = F.nanvl(field(name).cast("double"), F.lit(None).cast("double"))
    r = df.where(x.isNotNull() & (F.abs(x) < float("inf"))).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(x < b[0]).alias(f"a{k}") for k, (_, b) in enumerate(found)), *(F.count_if(x >= b[-1]).alias(f"b{k}") for k, (_, b) in enumerate(found))).first()
    ideal = r["n"] / (n + 1)
    share = lambda m: ideal / m if m > ideal else ideal / (2 * ideal - m)
    quality = [roundness * (share(r[f"a{k}"]) + share(r[f"b{k}"])) / 2 for k, (roundness, _) in enumerate(found)]
    return found[max(range(len(found)), key=lambda k: quality[k])][1]


def non_adjacent(df: DataFrame, classes: int, save_as: str = "class") -> DataFrame:
    """A class for each polygon that differs from its neighbours' (shared edges), as far as the number of classes allows.

    Each round colours, all at once, the shapes whose random rank is the highest among their uncoloured neighbours, by
    the least used class around them; ranks follow a hash of the id.
    """
    from geoflow.operators.geometry import neighbours
    from geoflow.shared import discard, materialise

    pairs = neighbours(df).select("a_fid", "b_fid")
    both = materialise(pairs.union(pairs.select("b_fid", "a_fid")).toDF("f", "g"), "neighbours")
    done = materialise(df.select(F.col(FID).alias("f"), F.lit(None).cast("int").alias("c")), "classes")
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    while True:
        left = done.where("c is null").select("f")
        if left.isEmpty():
            break
        open_ = both.join(left, "f").join(left.toDF("g"), "g").groupBy("f").agg(F.max(rank("g")).alias("top"))
        turn = left.join(open_, "f", "left").where(F.col("top").isNull() | (rank("f") > F.col("top"))).select("f")
        used = turn.join(both, "f", "left").join(done.toDF("g", "c"), "g", "left").groupBy("f").agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(classes)))
        best = F.array_min(F.array(*(F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("k")) for k in range(classes))))["k"]
        before, done = done, materialise(done.join(used.select("f", best.alias("new")), "f", "left").select("f", F.coalesce("c", "new").alias("c")), "classes")
        discard(before)
    return df.join(done.toDF("_f", "_c"), F.col(FID) == F.col("_f"), "left").withColumn(save_as, F.col("_c")).drop("_f", "_c")


def class_of(x: Column, breaks: list[float]) -> Column:
    """How many breaks are not above the value; -1 where there is no number."""
    x = x.cast("double")
    if not breaks:
        return F.when(x.isNull() | F.isnan(x), -1).otherwise(0)
    n = sum(((x >= b).cast("int") for b in breaks), F.lit(0))
    return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(n)


def classify(df: DataFrame, name: str, *, method: str | None = None, classes: int | None = None, breaks: list[float] | None = None, values: list[Any] | None = None, categories: list[Any] | None = None, null_value: Any = None, other: Any = None, invert: bool = False, continuous: bool = False, outer_breaks: tuple[float, float] | None = None, save_as: str = "class") -> DataFrame:
    """Adds save_as: the class (from 0; null_value or -1 without a number), or the value given for it.

    Methods: quantile (the default), equal-interval, hybrid, nice, indexed (the field is the class), non-adjacent
    (neighbours differ; no field) or categories.  Breaks that descend are taken in ascending order, with the classes the
    other way round.  Without a number of classes: as many as breaks, categories or values tell, else 4 (non-adjacent: 5).
    """
    if method is not None and method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    if method == "non-adjacent":
        out = non_adjacent(df, classes or (len(values) if values else 5), save_as)
        return out.withColumn(save_as, F.get(F.array(*map(F.lit, values)), F.col(save_as))) if values else out
    if breaks is not None and breaks != sorted(breaks):
        if breaks != sorted(breaks, reverse=True):
            raise ValueError("breaks must ascend or descend")
        breaks, invert = breaks[::-1], not invert
    pick = lambda k: F.get(F.array(*map(F.lit, values)), k)
    if categories is not None or method == "categorical":
        if categories is None:
            raise ValueError("categorical needs its categories")
        given = list(values if values is not None else range(len(categories)))[:: -1 if invert else 1]
        out = F.when(field(name).isNull() | (field(name).cast("string") == ""), F.lit(null_value if null_value is not None or values is not None else -1))
        for c, v in zip(categories, given, strict=False):
            out = out.when(field(name).cast("string") == F.lit(str(c)), F.lit(v))
        return df.withColumn(save_as, out.otherwise(F.lit(other)))
    k = classes or (len(breaks) + 1 if breaks is not None else len(values) if values and not continuous else len(values) - 1 if values else 4)
    if method == "indexed":
        at = field(name).cast("int")
    else:
        if breaks is None:
            inner = df
            if outer_breaks:
                inner = df.where(field(name).cast("double").between(*outer_breaks))
            breaks = {"equal-interval": interval_breaks, "hybrid": hybrid_breaks, "nice": nice_breaks}.get(method or "", quantile_breaks)(inner, name, k)
            if outer_breaks and method == "equal-interval":
                a, b = outer_breaks
                breaks = [a + i * (b - a) / k for i in range(1, k)]
        at = class_of(field(name), sorted(breaks))
    none = F.lit(null_value) if null_value is not None else F.lit(None if values else -1)
    if continuous:
        r = df.agg(F.min(field(name)).alias("a"), F.max(field(name)).alias("b")).first()
        a, b = outer_breaks or (r.a, r.b)
        edges = [float(a), *sorted(breaks), float(b)]
        x = field(name).cast("double")
        out = F.lit(None).cast("double")
        steps = values or list(range(len(edges)))
        for i in reversed(range(len(edges) - 1)):
            share = (x - edges[i]) / ((edges[i + 1] - edges[i]) or 1)
            out = F.when((x >= edges[i]) & (x <= edges[i + 1]), F.lit(float(steps[i])) + share * (float(steps[i + 1]) - float(steps[i]))).otherwise(out)
        return df.withColumn(save_as, out)
    if invert:
        at = F.when(at >= 0, k - 1 - at).otherwise(at)
    return df.withColumn(save_as, F.when(at.isNull() | (at < 0), none).otherwise(pick(at) if values else at))


def rank_within(df: DataFrame, name: str, by: str) -> DataFrame:
    """The row's place by a field's descending values within a group, ties in row order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(field(by)).orderBy(field(name).desc_nulls_last(), FID)))
