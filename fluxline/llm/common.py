"""Helpers that the training-data operators share: the shared scratch folder, written cuts of lineage, hashing rules and word counts."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only in local mode where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fluxline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor costs no recomputation.

    Spark removes a shuffle's files once the driver has collected the frames that made it, which is after the next cut at best: callers still hold them
    here. So the write is told to remove its own as it ends, and the driver is asked to collect its garbage for those of other actions.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEANUP, "false")
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before)
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["cut_path"] = path
    return out


def free(*cuts: DataFrame) -> None:
    """Empty the files of frames that cut returned, once nothing reads them any more."""
    for df in cuts:
        df.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(df.__dict__["cut_path"])


def mapped(df: DataFrame, column: str, function, out: dict[str, str]) -> DataFrame:
    """df without column, plus the columns out (name: type), which replace any of these names.

    function maps Arrow batches (row, column) to batches (row, *out); row holds all other columns untouched, so no name can clash.
    """
    rest = [c for c in df.columns if c != column and c not in out]
    rows = df.select(F.struct(*(df[f"`{c}`"] for c in rest), F.lit(0).alias("__none")).alias("row"), df[f"`{column}`"].alias(column))
    got = rows.mapInArrow(function, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in out.items()))
    return got.select(*(F.col(f"row.`{c}`").alias(c) for c in rest), *out)


def crc_bucket(column: str | Column, n: int) -> Column:
    """crc32 of an id's decimal text modulo n; a null id hashes as empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(n))


def crc_of(value, n: int) -> int:
    """crc_bucket for one Python value."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
