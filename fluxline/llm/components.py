"""Connected components of an edge table by alternating large and small stars (native DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) that has a smaller one in its component; root is the least node of the component.

    Large star: every node sends its larger neighbours to the least node it knows; small star: its smaller ones and itself. Both keep the
    components and shrink to stars in a few rounds; each round is two aggregations and joins by node, and ends in a written table. A hub's
    edges are only rows of a join. Self-loops, repeats and empty tables are fine.
    """
    e = C.cut(_pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _pairs(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = C.cut(_pairs(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))))
        roots = e.select(F.col("b").alias("a")).distinct()
        if e.join(roots, "a", "left_semi").isEmpty() and e.groupBy("a").count().filter("count > 1").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _pairs(e: DataFrame) -> DataFrame:
    return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
