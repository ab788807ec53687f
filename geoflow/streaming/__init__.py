"""Row-local commands over streams.

The commands each, filter, filter-fields, rename-fields and drop are plain DataFrame expressions, so they
run unchanged on readStream frames; windowed calc adds a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.functions.expressions import scope_of
from geoflow.operators.rows import field


def windowed_calc(df: DataFrame, time: str, window: str, calc: str, *, keys: list[str] = (), late: str = "10 minutes") -> DataFrame:
    """calc over tumbling windows of a stream (or a table); aggregates that need row order aren't available."""
    from geoflow.functions.aggregates import compile_calc

    compiled = compile_calc(calc, scope_of(df.schema), modes=False)
    marked = df.withWatermark(time, late) if df.isStreaming else df
    out = marked.groupBy(F.window(field(time), window).alias("w"), *map(field, keys)).agg(*compiled.aggs)
    return out.select(F.col("w.start").alias("window_start"), *map(field, keys), *(c.alias(n) for n, c in compiled.out))
