"""NMEA logs: GGA fixes with the dates of RMC and ZDA and the speeds of RMC sentences. All state is carried along each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .lines import in_file, up_to_here

KEPT, CHECKSUM = r"^\$G[PNLAB](GGA|RMC|ZDA),", r"\*([0-9A-Fa-f]{2})$"
DAY, KNOT = 86400, 0.514444


def checksum(body: Column) -> Column:
    """Exclusive or of all code points as two hexadecimal digits."""
    return F.lpad(F.hex(F.aggregate(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), F.ascii), F.lit(0), lambda a, c: a.bitwiseXOR(c))), 2, "0")


def checksum_ok(line: Column) -> Column:
    """True also of a line without a checksum."""
    body = F.regexp_replace(F.regexp_replace(line, CHECKSUM, ""), r"^\$", "")
    return ~line.rlike(CHECKSUM) | (F.upper(F.regexp_extract(line, CHECKSUM, 1)) == checksum(body))


def time_of_day(text: Column) -> Column:
    """hhmmss.ss in seconds."""
    v = text.try_cast("double")
    h = F.floor(v / 10000)
    m = F.floor((v - h * 10000) / 100)
    return h * 3600 + m * 60 + (v - h * 10000 - m * 100)


def degrees(text: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm, south and west negative."""
    v = text.try_cast("double")
    d = F.floor(v / 100)
    out = d + (v - d * 100) / 60
    return F.when(hemisphere.isin("S", "W"), -out).otherwise(out)


def counts(lines: DataFrame) -> DataFrame:
    """(file, n_sentences, n_bad_checksum)."""
    line = F.trim("value")
    bad = line.rlike(KEPT) & ~checksum_ok(line)
    return lines.groupBy("file").agg(F.count(F.when(line.startswith("$"), 1)).alias("n_sentences"), F.count(F.when(bad, 1)).alias("n_bad_checksum"))


def parse_nmea(lines: DataFrame, date: str | None = None) -> DataFrame:
    """(file, time, lat, lon, alt, quality, n_sat, hdop, speed, course): a row a GGA sentence of lines (file, n, value) with a finite place.

    A date holds until the next one and, of a file's first, from its start; without any, date is needed. If the time of day falls by more than half a
    day, a day is added until the next dated sentence. Speed (m/s) and course come from the last RMC sentence, at most a second old.
    Sentences with a wrong checksum are left out. Null and empty lines are no sentences.
    """
    df = lines.withColumn("value", F.trim("value")).filter(F.col("value").rlike(KEPT)).filter(checksum_ok(F.col("value")))
    df = df.withColumn("f", F.split(F.regexp_replace("value", CHECKSUM, ""), ","))
    f = lambda i: F.get("f", i - 1)
    df = df.select("file", "n", "f", F.substring(f(1), 4, 3).alias("type"), time_of_day(f(2)).alias("tod"))
    rmc, zda = F.when(F.length(f(10)) == 6, F.concat(F.lit("20"), F.substring(f(10), 5, 2), F.lit("-"), F.substring(f(10), 3, 2), F.lit("-"), F.substring(f(10), 1, 2))), F.when(f(5) != "", F.concat_ws("-", f(5), f(4), f(3)))
    own = F.when(F.col("type") == "RMC", rmc).when(F.col("type") == "ZDA", zda).try_cast("date")
    df = df.withColumn("own", own)
    whole = in_file().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = F.lit(date).cast("date") if date else F.raise_error("the log has no RMC or ZDA date: pass date").cast("date")
    day = F.coalesce(F.last("own", True).over(up_to_here()), F.first("own", True).over(whole), given)
    df = df.withColumns({"day": day, "dated": F.count("own").over(up_to_here())})
    df = df.withColumn("t", F.unix_date("day") * F.lit(DAY) + F.col("tod"))
    known = df.filter("t IS NOT NULL")
    fell = known.withColumn("fell", F.coalesce((F.col("t") - F.lag("t").over(in_file()) < -DAY / 2).cast("int"), F.lit(0)))
    since = Window.partitionBy("file", "dated").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = fell.withColumn("t", F.col("t") + F.sum("fell").over(since) * DAY)
    told = F.when(F.col("type") == "RMC", F.struct(F.col("t").alias("at"), (f(8).try_cast("double") * KNOT).alias("speed"), f(9).try_cast("double").alias("course")))
    order = Window.partitionBy("file").orderBy("t", F.when(F.col("type") == "RMC", 0).otherwise(1), "n").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("rmc", F.last(told, True).over(order)).filter("type = 'GGA'")
    recent = lambda c: F.when(F.col("t") - F.col("rmc.at") <= 1, F.col(f"rmc.{c}")).alias(c)
    number = lambda i, kind="double": f(i).try_cast("double").cast(kind)
    out = df.select(
        "file", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("time"), degrees(f(3), f(4)).alias("lat"), degrees(f(5), f(6)).alias("lon"), number(10).alias("alt"), number(7, "int").alias("quality"), number(8, "int").alias("n_sat"),
        number(9).alias("hdop"), recent("speed"), recent("course"),
    )
    return out.filter(G.finite(F.col("lat")) & G.finite(F.col("lon")))
