"""Runs, flags and running statistics along lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G

FLAG = "check string, line string, i_start long, i_end long, fid_start double, fid_end double, time_start timestamp, time_end timestamp, x double, y double, lon double, lat double, value double, threshold double, units string, description string"


def runs(df: DataFrame, keys: list[str], order: str, mark: Column) -> DataFrame:
    """Rows of df where mark is true (null: false), with run: a number that the rows of one unbroken run share within keys."""
    df = df.withColumn("__mark", F.coalesce(mark, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - F.row_number().over(Window.partitionBy(*keys, "__mark").orderBy(order))
    return df.withColumn("run", place).filter("__mark").drop("__mark")


def intervals(marked: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """start, end and n of each run."""
    return marked.groupBy(*keys, "run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def extreme(value: str, order: str = "seq") -> Column:
    """Aggregate: the signed value of largest size, the first on ties."""
    v = F.col(value)
    return F.max_by(v, F.when(G.finite(v), F.struct(F.abs(v), -F.col(order))))


def flag_runs(marked: DataFrame, check: str, keys: list[str], value: Column, threshold: Column, units: str, description) -> DataFrame:
    """Flags of runs; x, y, lon and lat are means of a run's two end samples. description takes the value column and gives a text column."""
    ends = {c: F.struct("i", "fid", "time", "x", "y", "lon", "lat") for c in ("a", "b")}
    df = marked.groupBy(*keys, "run").agg(F.min_by(ends["a"], "seq").alias("a"), F.max_by(ends["b"], "seq").alias("b"), value.alias("value"), threshold.alias("threshold"))
    middle = [((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(c) for c in ("x", "y", "lon", "lat")]
    return df.select(
        F.lit(check).alias("check"), "line", F.col("a.i").alias("i_start"), F.col("b.i").alias("i_end"), F.col("a.fid").cast("double").alias("fid_start"), F.col("b.fid").cast("double").alias("fid_end"),
        F.col("a.time").alias("time_start"), F.col("b.time").alias("time_end"), *middle, "value", F.col("threshold").cast("double").alias("threshold"), F.lit(units).alias("units"), description(F.col("value")).alias("description"),
    )


def interpolated(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Fills nulls of value linearly by order, ends with the nearest value."""
    w = Window.partitionBy(*keys)
    back = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)  # a frame to the end would be taken anew for every row
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    a, b = F.last(known, True).over(back), F.last(known, True).over(ahead)
    between = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["o"]) / F.when(b["o"] > a["o"], b["o"] - a["o"])
    return df.withColumn(value, F.coalesce(F.col(value), between, a["v"], b["v"]))


def running_median(df: DataFrame, keys: list[str], order: str, value: str, k: int, out: str) -> DataFrame:
    """Median of k rows around each; k shrinks to the largest odd number of rows; a row near an end takes the nearest whole window's median.

    A whole window is its k neighbours as an array, sorted in generated code: percentile over a sliding frame would count each frame anew.
    """
    h = k // 2
    whole = Window.partitionBy(*keys)
    by = whole.orderBy(order)
    v = F.col(value)
    df = df.withColumns({"__n": F.count("*").over(whole), "__p": F.row_number().over(by)})
    around = {f"__v{d}": (F.lag(value, -d) if d < 0 else F.lead(value, d)).over(by) for d in range(-h, h + 1) if d}
    df = df.withColumns(around)
    window = F.array(*around, v)
    full = F.when((F.col("__p") > h) & (F.col("__p") <= F.col("__n") - h) & ~F.exists(window, F.isnull), F.sort_array(window)[h])
    short = F.col("__n") < k
    df = df.withColumn("__full", full).drop(*around).withColumns(
        {
            "__all": F.percentile(F.when(short, v), 0.5).over(whole),
            "__m1": F.percentile(F.when(short & (F.col("__p") < F.col("__n")), v), 0.5).over(whole),
            "__m2": F.percentile(F.when(short & (F.col("__p") > 1), v), 0.5).over(whole),
        }
    )
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.when(F.col("__p") <= h, F.first("__full", True).over(every)).otherwise(F.last("__full", True).over(every))
    few = F.when(F.col("__n") % 2 == 1, F.col("__all")).when(F.col("__p") <= F.col("__n") / 2, F.col("__m1")).otherwise(F.col("__m2"))
    got = F.when(F.col("__n") < 3, v).when(short, few).otherwise(F.coalesce("__full", ends))
    return df.withColumn(out, got).drop("__n", "__p", "__full", "__all", "__m1", "__m2")


def running(f, value: Column, keys: list[str], order: str, k: int) -> Column:
    """f (max, avg) of k rows around each, fewer at the ends."""
    return f(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k // 2), k // 2))


def running_mean(value: Column, keys: list[str], order: str, k: int) -> Column:
    """Mean of (k - 1) // 2 rows on either side; the value itself in groups of fewer than k rows; null if a row of the frame has no value."""
    h = (k - 1) // 2
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    short = F.count("*").over(Window.partitionBy(*keys)) < k
    return F.when(short, value).when(F.count(value).over(frame) == F.count("*").over(frame), F.avg(value).over(frame))


def fourth_difference(value: Column, window, n: Column, normalize: bool = True) -> Column:
    """v[-2] - 4 v[-1] + 6 v - 4 v[1] + v[2], over 16 if normalized; null at two rows of either end and in segments under 5 rows."""
    at = lambda d: F.lag(value, d).over(window) if d > 0 else F.lead(value, -d).over(window)
    d4 = at(2) - 4 * at(1) + 6 * value - 4 * at(-1) + at(-2)
    return F.when(n >= 5, d4 / 16 if normalize else d4)
