"""The survey table: one row a sample, ordered within its line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .numbered import numbered


def by_line():
    return Window.partitionBy("line").orderBy("seq")


def as_survey(df: DataFrame, origin: tuple[float, float] | None = None) -> DataFrame:
    """Validate and complete a table of samples: line, time, x, y and mag or mag_raw; all other columns pass through.

    Adds line_type (a line named T... is a tie), fid (the number of the input row), the missing one of mag and mag_raw, radar_alt, lon and lat (from x, y and
    origin; null without one; both are made anew if either is missing), seq (place in the line by time, then fid) and i (place in the survey:
    traverses, then ties, by line and time). NaN and infinite numbers become null, and so do names of lines that are blank.
    """
    missing = [c for c in ("line", "time", "x", "y") if c not in df.columns]
    if missing or not {"mag", "mag_raw"} & set(df.columns):
        raise ValueError(f"a survey needs {', '.join(missing or ['mag or mag_raw'])}")
    if dict(df.dtypes)["time"] not in ("timestamp", "timestamp_ntz"):
        raise ValueError("time must be a timestamp")
    df = df.withColumn("line", F.col("line").cast("string"))
    if "line_type" not in df.columns:
        df = df.withColumn("line_type", F.when(F.col("line").rlike("(?i)^T"), "tie").otherwise("traverse"))
    else:
        df = df.withColumn("line_type", F.when(F.col("line_type").isin("tie", "traverse"), F.col("line_type")).otherwise(F.raise_error("line_type must be traverse or tie")))
    if "fid" not in df.columns:
        df = numbered(df, "fid")
    for a, b in (("mag", "mag_raw"), ("mag_raw", "mag")):
        if a not in df.columns:
            df = df.withColumn(a, F.col(b))
    if "radar_alt" not in df.columns:
        df = df.withColumn("radar_alt", F.lit(None).cast("double"))
    if not {"lon", "lat"} <= set(df.columns):
        lon, lat = G.enu_to_lonlat(F.col("x"), F.col("y"), *origin) if origin else (F.lit(None), F.lit(None))
        df = df.withColumns({"lon": lon.cast("double"), "lat": lat.cast("double")})
    df = df.withColumns({c: G.or_null(F.col(c)) for c in ("x", "y", "mag", "mag_raw", "radar_alt", "lon", "lat")})
    by_time = Window.partitionBy("line").orderBy(F.col("time").asc_nulls_last(), "fid")
    df = df.withColumn("seq", F.row_number().over(by_time).cast("long"))
    # places in the whole survey from counts by line, never a window over all rows
    per = df.groupBy("line_type", "line").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    order = Window.orderBy(F.col("line_type") == "tie", F.col("line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("line_type").alias("__t"), F.col("line").alias("__l"), (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first") + 1).alias("__before"))
    df = df.join(per, F.col("line").eqNullSafe(F.col("__l")) & (F.col("line_type") == F.col("__t")))
    return df.withColumn("i", F.col("seq") + F.col("__before")).drop("__t", "__l", "__before")


def with_steps(survey: DataFrame) -> DataFrame:
    """Adds dt, step (null on a line's first sample) and along, the distance from the line's start."""
    df = survey.withColumns(
        {"dt": G.seconds(F.col("time")) - F.lag(G.seconds(F.col("time"))).over(by_line()), "step": F.hypot(F.col("x") - F.lag("x").over(by_line()), F.col("y") - F.lag("y").over(by_line()))}
    )
    return df.withColumn("along", F.sum(F.coalesce("step", F.lit(0.0))).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))


def with_segments(survey: DataFrame, max_gap: float) -> DataFrame:
    """Adds seg, which counts the gaps over max_gap seconds before a sample in its line, and pos, the place within the segment."""
    df = with_steps(survey) if "dt" not in survey.columns else survey
    df = df.withColumn("seg", F.sum(F.when(F.col("dt") > max_gap, 1).otherwise(0)).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("line", "seg").orderBy("seq")))


def axes(survey: DataFrame) -> DataFrame:
    """Total least squares axis of each line: n, cx, cy, ux, uy (unit direction), sx, sy (extent), median step."""
    df = with_steps(survey).groupBy("line").agg(
        F.first("line_type").alias("line_type"),
        F.count("*").alias("n"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("theta"),
        *(f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max))),
        F.median("step").alias("median_step"),
    )
    return df.withColumns({"ux": F.cos("theta"), "uy": F.sin("theta")}).drop("theta")
