"""Streams of one flight put together: magnetometer samples at the places of GPS fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .lineage import cut

#: Seconds of a bucket of time, within which samples meet fixes.
BUCKET = 3600


def _bucket(t: Column) -> Column:
    return F.floor(t / BUCKET)


def intervals(points: DataFrame, values: list[str]) -> DataFrame:
    """(t0, t1, each value as v0 and v1, bucket) between neighbours in time of points (t, values), a row a bucket that the interval touches.

    Neighbours are found within buckets; only a bucket's first point, a row each, meets the bucket before it in one task.
    """
    p = points.groupBy("t").agg(*(F.first(v).alias(v) for v in values)).withColumn("bucket", _bucket(F.col("t")))
    row = F.struct("t", *values)
    firsts = p.groupBy("bucket").agg(F.min_by(row, "t").alias("first"))
    firsts = firsts.select("bucket", F.lead("first").over(Window.orderBy("bucket")).alias("after"))
    p = p.withColumn("next", F.lead(row).over(Window.partitionBy("bucket").orderBy("t"))).join(firsts, "bucket").withColumn("next", F.coalesce("next", "after"))
    p = p.filter("next IS NOT NULL").select(F.col("t").alias("t0"), F.col("next.t").alias("t1"), *(F.col(v).alias(f"{v}0") for v in values), *(F.col(f"next.{v}").alias(f"{v}1") for v in values))
    return p.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("t0")), _bucket(F.col("t1")))))


def at_times(samples: DataFrame, points: DataFrame, values: list[str], how: str = "inner") -> DataFrame:
    """samples (t, further columns) with each value linear between the points around, gap, the seconds to the nearer one, and t0, that before.

    A sample outside all points has no row (how="left": nulls), one at a point a row for each of its two intervals, with the same values.
    """
    iv = intervals(points, values)
    s = samples.withColumn("__b", _bucket(F.col("t")))
    on = (F.col("__b") == F.col("bucket")) & (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1"))
    met = s.join(iv, on, how)
    share = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    met = met.withColumns({v: F.col(f"{v}0") + (F.col(f"{v}1") - F.col(f"{v}0")) * share for v in values}).withColumn("gap", F.least(F.col("t") - F.col("t0"), F.col("t1") - F.col("t")))
    return met.drop("__b", "bucket", *(f"{v}{i}" for v in values for i in (0, 1)), "t1")


def merge_streams(mag: DataFrame, gps: DataFrame, lag: float = 0.0, max_gap: float = 2.0, origin: tuple[float, float] | None = None) -> DataFrame:
    """(fid, time, lon, lat, gps_alt, x, y, mag_raw, further columns of mag): samples with a GPS fix at most max_gap seconds away, by time.

    lag is added to GPS times. Fixes without a finite place are left out; of equal times one counts. Altitudes are linear between finite ones.
    x and y are metres from origin, by default the mean place of the samples that are kept.
    """
    for df, names in ((mag, ("time", "mag_raw")), (gps, ("time", "lat", "lon"))):
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise ValueError(f"no column {missing[0]}")
        if dict(df.dtypes)["time"] not in ("timestamp", "timestamp_ntz"):
            raise ValueError("time must be a timestamp")
    fixes = gps.filter(G.finite(F.col("lat")) & G.finite(F.col("lon"))).withColumn("t", G.seconds(F.col("time")) + lag)
    if len(fixes.select("t").distinct().take(2)) < 2:
        raise ValueError("fewer than two usable GPS fixes")
    rest = [c for c in mag.columns if c not in ("fid", "time", "lon", "lat", "gps_alt", "x", "y", "mag_raw")]
    samples = mag.select(F.struct("time", "mag_raw", *rest).alias("row"), G.seconds(F.col("time")).alias("t"), F.monotonically_increasing_id().alias("id"))
    placed = at_times(samples, fixes, ["lon", "lat"]).filter(F.col("gap") <= max_gap)
    placed = placed.groupBy("id").agg(*(F.min_by(c, "t0").alias(c) for c in ("row", "t", "lon", "lat")))
    if "alt" in gps.columns:
        # rows go on to their altitudes with their numbers: taken a second time, the numbers could differ
        high = at_times(placed, fixes.filter(G.finite(F.col("alt"))), ["alt"], "left")
        placed = high.groupBy("id").agg(*(F.first(c).alias(c) for c in ("row", "t", "lon", "lat")), F.min_by("alt", "t0").alias("gps_alt"))
    else:
        placed = placed.withColumn("gps_alt", F.lit(None).cast("double"))
    placed = cut(placed)
    if placed.isEmpty():
        raise ValueError("no sample has a GPS fix within max_gap")
    if origin:
        lon0, lat0 = F.lit(float(origin[0])), F.lit(float(origin[1]))
    else:
        placed = placed.crossJoin(F.broadcast(placed.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))))  # one row
        lon0, lat0 = F.col("lon0"), F.col("lat0")
    x, y = G.lonlat_to_enu(F.col("lon"), F.col("lat"), lon0, lat0)
    # numbers in time from counts by bucket, a row each
    placed = placed.withColumn("bucket", _bucket(F.col("t")))
    before = placed.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = placed.join(before, "bucket").withColumn("fid", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("t", "id")))
    return placed.select("fid", F.col("row.time").alias("time"), "lon", "lat", "gps_alt", x.alias("x"), y.alias("y"), F.col("row.mag_raw").alias("mag_raw"), *(F.col(f"row.`{c}`").alias(c) for c in rest))
