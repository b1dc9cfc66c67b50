"""Text files as tables of numbered lines, and what lines take over from lines above them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.numbered import before

#: Lines of a block: what is taken over from above goes through blocks apart, and on from block to block by a table of a row a block.
BLOCK = 1 << 16


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n, value): lines of text files in the order of each file, n from 1.

    A split of a file is read in order, so counts of splits and the row's place in its split number the lines, of a file of many splits in many tasks.
    Lines are written with their places once, since a second reading may be split otherwise. Empty files have no lines.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    raw = cut(raw)
    ends = before(raw.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n")), ["split"], ["file"])
    lines = raw.join(ends.select("file", "split", (F.col("before") + 1 - F.col("first")).alias("shift")), ["file", "split"])
    return lines.select("file", (F.col("place") + F.col("shift")).alias("n"), "value")


def in_file():
    return Window.partitionBy("file").orderBy("n")


def up_to_here():
    return in_file().rowsBetween(Window.unboundedPreceding, 0)


def last_above(rows: DataFrame, column: str, size: int = BLOCK) -> DataFrame:
    """rows (file, n, column, ...) whose column is the last one that is not null in the file, at the row or above."""
    rows = rows.withColumn("block", F.floor((F.col("n") - 1) / size))
    ends = rows.filter(F.col(column).isNotNull()).groupBy("file", "block").agg(F.max_by(column, "n").alias("carried"))
    blocks = rows.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.last("carried", True).over(earlier).alias("carried"))
    here = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(blocks, ["file", "block"]).withColumn(column, F.coalesce(F.last(column, True).over(here), "carried"))
    return filled.drop("block", "carried")


def places(rows: DataFrame, name: str, size: int = BLOCK) -> DataFrame:
    """rows (file, n, ...) with name: their number, from 1, by file and n. Counts go by block, their sums by file, and those of files by a row a file."""
    rows = rows.withColumn("block", F.floor((F.col("n") - 1) / size))
    blocks = before(rows.groupBy("file", "block").agg(F.count("*").alias("n")), ["block"], ["file"]).withColumnRenamed("before", "earlier")
    files = before(blocks.groupBy("file").agg(F.sum("n").alias("n")), ["file"])
    shift = blocks.join(files.select("file", "before"), "file").select("file", "block", (F.col("earlier") + F.col("before")).alias("shift"))
    here = Window.partitionBy("file", "block").orderBy("n")
    return rows.join(shift, ["file", "block"]).withColumn(name, F.col("shift") + F.row_number().over(here)).drop("block", "shift")
