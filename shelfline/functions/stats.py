"""Trend, acceleration and z-scores over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import col, ratio


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add `idx` (0-based position, oldest first) and `n_points` per key.

    Meant for series already reduced to one row per key and day, so a window partition is
    bounded by the number of days, never by the number of raw rows.
    """
    w = Window.partitionBy(*keys)
    return df.withColumn("idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_points", F.count(F.lit(1)).over(w))


def trend(y: str | Column, min_points: int = 3) -> Column:
    """Least-squares slope over `idx`; 0 below `min_points` points (aggregate expression)."""
    n = F.count(col(y))
    return F.when(n >= min_points, F.regr_slope(col(y).cast("double"), F.col("idx").cast("double"))).otherwise(F.lit(0.0))


def acceleration(y: str | Column, min_points: int = 4) -> Column:
    """Twice the leading coefficient of a degree-2 fit over `idx` (aggregate expression).

    Positions are centred on their mean, so odd power sums vanish and the normal equations
    reduce to one ratio of power sums.
    """
    u = F.col("idx") - (F.col("n_points") - 1) / F.lit(2.0)
    u2 = u * u
    n, v = F.count(F.lit(1)), col(y).cast("double")
    num = n * F.sum(u2 * v) - F.sum(u2) * F.sum(v)
    den = n * F.sum(u2 * u2) - F.sum(u2) * F.sum(u2)
    return F.when(n >= min_points, 2 * ratio(num, den, 0.0)).otherwise(F.lit(0.0))


def zscores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Population z-scores (source column to new column); all totals come from one one-row subquery."""
    t = df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("t")).scalar()
    return df.withColumn("__t", t).withColumns({out: ratio(F.col(c) - F.col(f"__t.m_{c}"), F.col(f"__t.s_{c}")) for c, out in columns.items()}).drop("__t")
