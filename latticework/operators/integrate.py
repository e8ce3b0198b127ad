"""Integrals of sampled curves, one a group of rows: differences by window, sums by aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import validation as V


def _grouped(df: DataFrame, group: list[str] | None):
    keys = group or []
    return keys, W.partitionBy(*keys, *([] if keys else [F.lit(0)])), (lambda d: d.groupBy(*keys) if keys else d)


def whole_area(df: DataFrame, x: str, y: str) -> float | None:
    """Trapezoids under all points of ``df`` in the order of (x, y); null if there are none.

    Ranges of x are summed side by side; of each, the area and its two end points reach the driver. Rows with
    a null in either column are no points.
    """
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        area = 0.0
        for b in batches:
            if not b.num_rows:
                continue
            u, v = (b.column(k).to_numpy() for k in (0, 1))
            if last is None:
                first = (u[0], v[0])
            else:
                u, v = np.append(last[0], u), np.append(last[1], v)
            area += float((np.diff(u) * (v[1:] + v[:-1]) / 2).sum())
            last = (u[-1], v[-1])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.float64()) for n in (*first, *last, area)], ["x0", "y0", "x1", "y1", "area"])

    parts = sorted(tuple(r) for r in points.repartitionByRange(ranges, "x").sortWithinPartitions("x", "y").mapInArrow(run, "x0 double, y0 double, x1 double, y1 double, area double").collect())
    between = sum((b[0] - a[2]) * (b[1] + a[3]) / 2 for a, b in zip(parts, parts[1:]))
    return sum(p[4] for p in parts) + between if parts else None


def trapezoidal(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """(group, integral): 0 of one point."""
    if not group:
        return df.sparkSession.createDataFrame([(whole_area(df, x, y) or 0.0,)], "integral double")
    keys, part, by = _grouped(df, group)
    w = part.orderBy(x, y)
    v, u = F.col(y).cast("double"), F.col(x).cast("double")
    s = df.select(*keys, ((u - F.lag(u).over(w)) * (v + F.lag(v).over(w)) / 2).alias("a"))
    return by(s).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("integral"))


def trapezoidal_uniform(df: DataFrame, order: str, y: str, dx: float = 1.0, group: list[str] | None = None) -> DataFrame:
    """Points ``dx`` apart: the sum less half of the ends."""
    keys, _, by = _grouped(df, group)
    v = F.col(y).cast("double")
    s = by(df.select(*keys, F.col(order).alias("o"), v.alias("v"))).agg(F.sum("v").alias("s"), F.min(F.struct("o", "v")).alias("a"), F.max(F.struct("o", "v")).alias("b"))
    return s.select(*keys, (F.lit(float(dx)) * (F.col("s") - (F.col("a.v") + F.col("b.v")) / 2)).alias("integral"))


def _parabola(h0: Column, h1: Column, y0: Column, y1: Column, y2: Column) -> Column:
    """Area under the parabola through three points; 0 widths add nothing."""
    zero = F.lit(0.0)
    r = F.when(h1 == 0, zero).otherwise(h0 / h1)
    inner = F.when(h0 * h1 == 0, zero).otherwise((h0 + h1) * (h0 + h1) / (h0 * h1))
    q = F.when(h0 == 0, zero).otherwise(h1 / h0)
    return (h0 + h1) / 6 * ((2 - q) * y0 + inner * y1 + (2 - r) * y2)


def simpson(df: DataFrame, x: str, y: str, even: str = "avg", group: list[str] | None = None) -> DataFrame:
    """Simpson's rule on pairs of steps. With an even number of points a step is left: "first" takes it by
    trapezoid at the end, "last" at the start, "avg" is the mean of both."""
    V.one_of(even, ("avg", "first", "last"))
    keys, part, by = _grouped(df, group)
    w = part.orderBy("x", "y")
    p = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = p.select(*keys, "x", "y", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(part).alias("n"), *[F.lead(c, k).over(w).alias(f"{c}{k}") for c in ("x", "y") for k in (1, 2)])
    area = _parabola(F.col("x1") - F.col("x"), F.col("x2") - F.col("x1"), F.col("y"), F.col("y1"), F.col("y2"))
    step = (F.col("x1") - F.col("x")) * (F.col("y") + F.col("y1")) / 2
    odd_n, i, n = F.col("n") % 2 == 1, F.col("i"), F.col("n")
    from_first = F.when((i % 2 == 1) & (i <= n - 2), area).otherwise(0.0) + F.when(~odd_n & (i == n - 1), step).otherwise(0.0)
    from_last = F.when(odd_n, F.when((i % 2 == 1) & (i <= n - 2), area).otherwise(0.0)).otherwise(F.when((i % 2 == 0) & (i <= n - 2), area).otherwise(0.0) + F.when((i == 1) & (n > 1), step).otherwise(0.0))
    total = {"first": from_first, "last": from_last, "avg": (from_first + from_last) / 2}[even]
    return by(s.select(*keys, F.coalesce(total, F.lit(0.0)).alias("a"))).agg(F.sum("a").alias("integral"))


def simpson_uniform(df: DataFrame, order: str, y: str, dx: float = 1.0, even: str = "avg", group: list[str] | None = None) -> DataFrame:
    """The same for points ``dx`` apart."""
    keys, part, _ = _grouped(df, group)
    at = (F.row_number().over(part.orderBy(order, y)) - 1) * F.lit(float(dx))
    return simpson(df.withColumn("lw_x", at), "lw_x", y, even, group)
