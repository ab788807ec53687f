"""Joins by key with the reference's rules: left outer, the first match is copied, null matches null."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID, Calc, compile_calc, grouped
from geoflow.functions.expressions import Lowering, Scope, Value, kind_of, parse, scope_of
from geoflow.operators.rows import field


def _check_keys(target: DataFrame, source: DataFrame, keys: tuple[str, str]) -> None:
    kinds = [kind_of(df.schema[k].dataType) for df, k in zip((target, source), keys, strict=True)]
    if kinds[0] != kinds[1] or kinds[0] not in ("num", "str", "bool", "date"):
        raise ValueError(f"can't join a {kinds[0]} key to a {kinds[1]} key")


def _target_refs(where: str | None) -> list[str]:
    return sorted(set(re.findall(r"\btarget\.(\w+)", where or "")))


def _source(source: DataFrame, key: str, where: str | None, defs: dict | None) -> DataFrame:
    """The source rows that can match, with their key as `_t`; where doesn't look at the target."""
    found = source.withColumn("_t", field(key))
    return found if where is None else _match_filter(found, where, [], defs)


def _candidates(target: DataFrame, source: DataFrame, keys: tuple[str, str], where: str | None, defs: dict | None) -> DataFrame:
    """`_t` (target id) and the source row's fields, its `__fid` among them, of all matches that pass where."""
    _check_keys(target, source, keys)
    refs = _target_refs(where)
    left = target.select(F.col(FID).alias("_t"), field(keys[0]).alias("_k"), *(field(r).alias(f"target.{r}") for r in refs))
    if not refs:
        source, where = _source(source, keys[1], where, defs).drop("_t"), None
    found = left.join(source.withColumn("_s", field(keys[1])), F.col("_k").eqNullSafe(F.col("_s"))).drop("_k", "_s")
    if where is not None:
        found = _match_filter(found, where, refs, defs)
    return found.select(*(field(c) for c in found.columns if not c.startswith("target.")))


def _match_filter(found: DataFrame, where: str, refs: list[str], defs: dict | None) -> DataFrame:
    """The rows that a predicate holds for, in which isMax, isMin and isMode compare within the rows of one `_t`.

    What they compare with is aggregated by `_t` (and value) and joined back, so that no group is gathered.
    """
    scope = scope_of(found.drop("_t").schema, defs)
    plain, needed = Lowering(Scope(scope.fields, scope.defs)), []

    def compare(name: str, args) -> Value | None:
        if name not in ("isMax", "isMin", "isMode"):
            return None
        needed.append((name, plain.lower(args[0]).column))
        return Value(F.col(f"_is{len(needed) - 1}"), "bool")

    value = Lowering(scope, compare).lower(parse(where)[0])
    if value.kind != "bool":
        raise ValueError("a join's filter must be true or false")
    out = found
    for k, (name, x) in enumerate(needed):
        if name == "isMode":
            counts = found.withColumn("_v", x).groupBy("_t", "_v").agg(F.count(F.lit(1)).alias("_n"))
            best = counts.join(counts.groupBy(F.col("_t").alias("_t3")).agg(F.max("_n").alias("_m")), F.col("_t").eqNullSafe(F.col("_t3"))).where("_n = _m").select(F.col("_t").alias("_t2"), F.col("_v").alias("_w"), F.lit(True).alias("_most"))
            out = out.join(best, F.col("_t").eqNullSafe(F.col("_t2")) & x.eqNullSafe(F.col("_w")), "left").withColumn(f"_is{k}", F.coalesce("_most", F.lit(False))).drop("_t2", "_w", "_most")
        else:
            best = found.groupBy(F.col("_t").alias("_t2")).agg((F.max if name == "isMax" else F.min)(x).alias("_w"))
            out = out.join(best, F.col("_t").eqNullSafe(F.col("_t2")), "left").withColumn(f"_is{k}", x == F.col("_w")).drop("_t2", "_w")
    return out.where(value.column).drop(*(f"_is{k}" for k in range(len(needed))))


def attach(target: DataFrame, found: DataFrame, fields: list[str], *, on: str = FID, calc: str | None = None, sum_fields: list[str] = (), prefix: str = "", force: bool = False, duplication: bool = False, defs: dict | None = None) -> DataFrame:
    """Copies source fields of matches (`_t`, `__fid`, fields) into the target, or aggregates over all of them.

    `_t` holds the target's value of `on`: its row id, or a join key.  Matches are reduced to a row for each `_t`
    before they meet the target, so that a frequent key costs no more than its rows; duplication alone makes a row
    for each match.
    """
    if calc and duplication:
        raise ValueError("calc and duplication don't go together")
    named = {prefix + f: f for f in fields if f not in sum_fields}
    named = {new: old for new, old in named.items() if force or prefix or new not in target.columns}
    names, zero, compiled = [prefix + f for f in sum_fields], {prefix + f for f in sum_fields}, Calc()
    if calc:
        compile_calc(calc, scope_of(found.drop("_t", FID).schema, defs), into=compiled)
        names += [n for n, _ in compiled.out]
        zero |= {n for n, _ in compiled.out if re.search(rf"(^|[,;])\s*{re.escape(n)}\s*=\s*(count|sum)\s*\([^()]*\)\s*($|[,;])", calc)}
    same = field(on).eqNullSafe(F.col("_key0")) if on != FID else F.col(FID) == F.col("_key0")
    copied_row = F.struct(F.lit(True).alias("_hit"), *(field(old).alias(f"_new_{new}") for new, old in named.items()))
    if duplication:
        rows = found.select(F.col("_t").alias("_key0"), F.col(FID).alias("_order"), copied_row.alias("_row"))
    else:
        rows = grouped(found, [F.col("_t")], Calc() if not calc else _renamed(compiled), F.min_by(copied_row, F.col(FID)).alias("_row"), *(F.sum(F.coalesce(field(f).cast("double"), F.lit(0.0))).alias(f"_out_{prefix}{f}") for f in sum_fields))
    out = target.join(rows, same, "left")
    hit = F.col("_row._hit").isNotNull()
    new = lambda n: field("_row") if not n else F.col("_row")[f"_new_{n}"]
    kept = [field(c) for c in target.columns if c not in named and c not in names]
    copied = [(F.when(hit, new(n)).otherwise(field(n)) if n in target.columns else new(n)).alias(n) for n in named if n not in names]
    made = [(F.coalesce(field(f"_out_{n}"), F.lit(0)) if n in zero else field(f"_out_{n}")).alias(n) for n in names]
    out = out.select(*kept, *copied, *made, *([F.col("_order")] if duplication else []))
    if duplication:
        from geoflow.operators.rows import numbered

        # the first match stays in the target's place, the others come after all rows
        first = found.groupBy("_t").agg(F.min(FID).alias("_first")).toDF("_key0", "_first")
        out = out.join(first, same, "left").drop("_key0")
        out = numbered(out.withColumnRenamed(FID, "_old"), [F.coalesce((F.col("_order") > F.col("_first")).cast("int"), F.lit(0)), F.col("_old"), F.col("_order")]).drop("_first", "_order", "_old")
    return out


def _renamed(calc: Calc) -> Calc:
    calc.out = [(f"_out_{n}", c) for n, c in calc.out]
    return calc


def join(target: DataFrame, source: DataFrame, keys: tuple[str, str], *, fields: list[str] | None = None, calc: str | None = None, sum_fields: list[str] = (), where: str | None = None, prefix: str = "", force: bool = False, duplication: bool = False, defs: dict | None = None) -> DataFrame:
    """Target rows with the first match's fields (default: all but the key; calc: none), in source order; every target row stays.

    where sees source fields and `target.x`; isMax, isMin and isMode compare within the matches.  Of
    equal names the target's stays, unless force (overwritten on a match) or prefix.  Without a match
    copied fields are null, sums and counts 0.  Unless where looks at the target, the source is reduced to a
    row for each key before the join.
    """
    every = [c for c in source.columns if c not in (FID, "geom")]
    if fields is None:
        fields = [] if calc else [c for c in every if c != keys[1]]
    elif fields == ["*"]:
        fields = every
    options = {"calc": calc, "sum_fields": sum_fields, "prefix": prefix, "force": force, "duplication": duplication, "defs": defs}
    if _target_refs(where):
        return attach(target, _candidates(target, source, keys, where, defs), fields, **options)
    _check_keys(target, source, keys)
    return attach(target, _source(source, keys[1], where, defs), fields, on=keys[0], **options)


def match_statistics(target: DataFrame, source: DataFrame, keys: tuple[str, str], *, samples: int = 5) -> dict:
    """How many target rows have a match and how many source rows are used, with some of the keys that have none."""
    lost, unused = unmatched(target, source, keys), unjoined(target, source, keys)
    some = lambda df, k: [r[0] for r in df.select(field(k)).distinct().orderBy(field(k)).limit(samples).collect()]
    n, m, a, b = target.count(), source.count(), lost.count(), unused.count()
    both = [c for c in source.columns if c in target.columns and c not in (FID, "geom", keys[1])]
    return {"targets": n, "matched": n - a, "sources": m, "used": m - b, "unmatched_keys": some(lost, keys[0]), "unused_keys": some(unused, keys[1]), "conflicting_fields": both}


def unmatched(target: DataFrame, source: DataFrame, keys: tuple[str, str], *, where: str | None = None, defs: dict | None = None) -> DataFrame:
    """Target rows without a match."""
    if where is None:
        return target.join(source.select(field(keys[1]).alias("_s")), field(keys[0]).eqNullSafe(F.col("_s")), "left_anti")
    if not _target_refs(where):
        return unmatched(target, _source(source, keys[1], where, defs).drop("_t"), keys)
    return target.join(_candidates(target, source, keys, where, defs).select("_t").distinct(), F.col(FID) == F.col("_t"), "left_anti")


def unjoined(target: DataFrame, source: DataFrame, keys: tuple[str, str], *, where: str | None = None, defs: dict | None = None) -> DataFrame:
    """Source rows that no target row matches."""
    if where is None:
        return source.join(target.select(field(keys[0]).alias("_k")), field(keys[1]).eqNullSafe(F.col("_k")), "left_anti")
    used = (_candidates(target, source, keys, where, defs) if _target_refs(where) else _used(target, source, keys, where, defs)).select(F.col(FID).alias("_used")).distinct()
    return source.join(used, F.col(FID) == F.col("_used"), "left_anti")


def _used(target: DataFrame, source: DataFrame, keys: tuple[str, str], where: str | None, defs: dict | None) -> DataFrame:
    found = _source(source, keys[1], where, defs)
    return found.join(target.select(field(keys[0]).alias("_k")).distinct(), F.col("_t").eqNullSafe(F.col("_k")), "left_semi")
