"""Row numbers of input order, from counts of partitions instead of a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def before(counts: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """counts (order, by, n) with before: the sum of n over what comes earlier, of the same by. One row a part of the data, never one a row."""
    window = (Window.partitionBy(*by) if by else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with its rows' numbers, from 1, in the order of its partitions and of the rows in each, as a column in place of any of that name.

    The numbers are those of one reading: the rows are written with their places once, since a second reading may be split otherwise.
    An empty table gives an empty one; rows repeated whole get numbers of their own.
    """
    rest = [c for c in df.columns if c != name]
    rows = cut(df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    ends = before(rows.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("n")), ["part"])
    rows = rows.join(ends.select("part", (F.col("before") + 1 - F.col("first")).alias("shift")), "part")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in rest), (F.col("place") + F.col("shift")).alias(name))
