"""Surveys made of the driver's tables, by arithmetic alone, so that SQL can make the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.survey import as_survey

ORIGIN = (-100.0, 40.0)


def events_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a user: every fifteenth is a tie that crosses the others, which are flown north and south in turn."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    tie, j, wave = F.col("user_id") % 15 == 0, F.floor(F.col("user_id") / 15), 2 * F.sin(F.col("n") / 9)
    pick = lambda a, b: F.when(tie, a).otherwise(b)
    return as_survey(
        e.select(
            F.concat(pick(F.lit("T"), F.lit("L")), F.col("user_id").cast("string")).alias("line"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("fid"), pick(450.0 * F.col("n"), 200.0 * F.col("user_id") + wave).alias("x"),
            pick(30.0 * (j + 1) + wave, F.when(F.col("user_id") % 2 == 1, 600 - 6.0 * F.col("n")).otherwise(6.0 * F.col("n"))).alias("y"), (54000 + F.col("value")).alias("mag_raw"), (60 + (F.col("value") - 250) / 10).alias("radar_alt"),
        ),
        ORIGIN,
    )


def base_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time")).agg(F.avg("value").alias("mag_base"))


def flight_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned lines of every second user, a metre east of where the survey is flown; every twentieth has no length."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 15 <> 0 AND user_id % 2 = 1").select("user_id").distinct()
    east = 200.0 * F.col("user_id") + 1
    return users.select(F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("line"), east.alias("x0"), F.lit(0.0).alias("y0"), east.alias("x1"), F.when(F.col("user_id") % 20 == 1, 0.0).otherwise(600.0).alias("y1"))


def lineitem_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense regular line a supplier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")))
    return as_survey(
        li.select(
            F.concat(F.lit("L"), F.col("l_suppkey").cast("string")).alias("line"), F.timestamp_micros(F.lit(1704067200000000) + F.col("n") * 100000).alias("time"), F.col("n").cast("long").alias("fid"), (200.0 * F.col("l_suppkey")).alias("x"),
            (6.0 * F.col("n")).alias("y"), (54000 + F.col("l_extendedprice") / 1000).alias("mag_raw"), (60 + (F.col("l_quantity") - 25) / 2).alias("radar_alt"),
        ),
        ORIGIN,
    )
