"""Cuts leave no shuffle files behind."""

from pyspark.sql import functions as F

from fluxline.operators.lineage import cut


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}


def test_shuffle_files_go_as_a_cut_is_written(spark):
    before = _shuffles(spark)
    out = cut(spark.range(2000).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n")))
    assert not _shuffles(spark) - before
    assert sorted(map(tuple, out.collect())) == [(k, 40) for k in range(50)]
