"""Ordered computations within series: runs, gaps, interpolation, offsets.  All are windows over one series at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, flag: Column, by: str, *order: str) -> DataFrame:
    """Maximal runs of rows where flag holds: adds ``run``, a number within the series; other rows go."""
    w = Window.partitionBy(by).orderBy(*order)
    change = F.when(flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    return df.withColumn("__flag", flag).withColumn("run", F.sum(change).over(w)).where("__flag").drop("__flag")


def sessions(df: DataFrame, position: Column, gap: int, by: str, *order: str) -> DataFrame:
    """Adds ``session``: a new one begins where the step from the row before is more than gap."""
    w = Window.partitionBy(by).orderBy(*order)
    start = F.when(position - F.lag(position).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("__start", start).withColumn("session", F.sum("__start").over(w)).drop("__start")


def fill_linear(df: DataFrame, value: str, position: str, by: str) -> DataFrame:
    """Nulls become points on the line between the known neighbours, the nearest known value at the ends, 0 where none is known."""
    w = Window.partitionBy(by).orderBy(position)
    back = Window.partitionBy(by).orderBy(F.desc(position))  # running frames both ways: one step a row
    past, future = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, back))
    known = F.when(F.col(value).isNotNull(), F.col(position))
    x0, x1 = F.last(known, True).over(past), F.last(known, True).over(future)
    y0, y1 = F.last(value, True).over(past), F.last(value, True).over(future)
    line = F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (F.col(position) - x0) / (x1 - x0))
    return df.withColumn("filled", F.coalesce(line, y0, y1, F.lit(0.0)))


def resample_time(known: DataFrame, at: str, value: str, by: str, step: int) -> DataFrame:
    """(by, at, value): a point every ``step`` from the first known row of each series to the last, on the line between its
    neighbours.  Each known row makes the points up to the next one, so no join and no search is needed."""
    w = Window.partitionBy(by).orderBy(at)
    first, after, y1 = F.min(at).over(Window.partitionBy(by)), F.lead(at).over(w), F.lead(value).over(w)
    steps = known.select(by, F.col(at).alias("x0"), F.col(value).alias("y0"), first.alias("first"), after.alias("x1"), y1.alias("y1"))
    k0 = F.ceil((F.col("x0") - F.col("first")) / step)
    k1 = F.when(F.col("x1").isNull(), F.floor((F.col("x0") - F.col("first")) / step)).otherwise(F.ceil((F.col("x1") - F.col("first")) / step) - 1)
    points = steps.withColumn("k", F.explode(F.when(k0 <= k1, F.sequence(k0, k1)))).withColumn(at, F.col("first") + F.col("k") * step)
    line = F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * ((F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0"))))
    return points.select(by, at, line.alias("value"))
