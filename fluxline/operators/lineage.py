"""Cuts of lineage for plans that use a small frame many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in the folder that spark.checkpoint.dir names and read from there, so that columns and filters still prune its reading.
    The write removes its shuffle files as it ends. A local folder serves in local mode only, where the session names none."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fluxline-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["cut_path"] = path
    return out


def free(*cuts: DataFrame) -> None:
    """Empties the folders of frames that cut returned (others are left alone), once nothing reads them any more."""
    for df in cuts:
        if "cut_path" in df.__dict__:
            df.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(df.__dict__["cut_path"])
