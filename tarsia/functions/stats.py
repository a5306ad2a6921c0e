"""Column expressions and small frames of robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds as a double, sub-second part kept."""
    return (micros(later) - micros(earlier)) / 1e6


def share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole.cast("double"), F.lit(0.0))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def median_mad(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, med, mad: the median and the median absolute deviation of a value."""
    med = df.groupBy(by).agg(F.count(value).alias("n"), median(F.col(value)).alias("med"))
    return df.join(med, by).groupBy(by, "n", "med").agg(median(F.abs(F.col(value) - F.col("med"))).alias("mad"))


def robust_z(x: Column, med: Column, mad: Column, floor: float, n: Column, least: int = 3) -> Column:
    """(x - median) / max(1.4826 MAD, floor); null with fewer than three peers."""
    return F.when(n >= least, (x - med) / F.greatest(1.4826 * mad, F.lit(floor)))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the 95 % Wilson interval, rounded to 4 places; null at n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / m
    centre, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return tuple(F.when(m.isNotNull(), F.bround(end, 4)) for end in (F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """Adds q: the smallest p * m / rank from the largest p down, at most 1. For small frames."""
    ranked = df.withColumn("_r", F.row_number().over(Window.orderBy(p))).withColumn("_m", F.count("*").over(Window.partitionBy()))
    down = Window.orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def fractional_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Adds the average rank (from 1) of a value, ties sharing theirs."""
    return df.withColumn(name, F.rank().over(Window.orderBy(value)) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2.0)


def cusum(df: DataFrame, by: str, order: str, z: str, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """Adds up, down (two-sided tabular sums) and alarm. With C the running sum of z - k, the sum that restarts at
    zero is C - min(0, running minimum of C)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"_u": F.sum(F.col(z) - k).over(w), "_d": F.sum(-F.col(z) - k).over(w)})
    df = df.withColumns({"up": F.col("_u") - F.least(F.lit(0.0), F.min("_u").over(w)), "down": F.col("_d") - F.least(F.lit(0.0), F.min("_d").over(w))})
    return df.withColumn("alarm", (F.col("up") > h) | (F.col("down") > h)).drop("_u", "_d")
