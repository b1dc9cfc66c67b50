"""Queries of the readers and the stream merge over text made of the events table, and their SQL, which states what the text must give back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import merge_streams as merged
from ..sources import maglog, nmea, xyz

DATE = "2024-01-01"


def _events(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    return e.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _minutes(factor: int) -> Column:
    m = F.col("event_id") * factor % 600000
    return _text(F.lpad(F.floor(m / 10000).cast("string"), 2, "0"), ".", F.lpad((m % 10000).cast("string"), 4, "0"))


def _nmea_lines(spark, sf_dir) -> DataFrame:
    e, tod = _events(spark, sf_dir), F.date_format("ts", "HHmmss.SSS")
    speed = F.col("event_id") % 900
    rmc = _text("GPRMC,", tod, ",A,4000.0000,N,10000.0000,W,", F.floor(speed / 10), ".", speed % 10, ",", F.col("event_id") % 360, ",", F.date_format("ts", "ddMMyy"))
    gga = _text("GPGGA,", tod, ",40", _minutes(7919), ",N,100", _minutes(104729), ",W,1,08,0.9,", F.col("event_id") % 500, ".5,M,0,M,,")
    wrong = F.when(F.col("event_id") % 11 == 0, "X").otherwise("")
    pair = F.array(_text("$", rmc), _text("$", gga, "*", nmea.checksum(_text(gga, wrong))), F.lit("$GPGSV,1"))
    e = e.select(_text("u", F.col("user_id")).alias("file"), "seq", F.posexplode(pair).alias("k", "value"))
    return e.select("file", (F.col("seq") * 3 + F.col("k")).alias("n"), "value")


def nmea_parse(spark, sf_dir):
    df = nmea.parse_nmea(_nmea_lines(spark, sf_dir))
    return df.select("file", F.unix_millis("time").alias("ms"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt", "quality", "n_sat", "hdop", F.round("speed", 6).alias("speed"), "course")


def nmea_counts(spark, sf_dir):
    return nmea.counts(_nmea_lines(spark, sf_dir))


def nmea_checksum(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", nmea.checksum(_text("GPGGA,", F.col("event_id"), ",", F.col("user_id"))).alias("checksum"))


def xyz_parse(spark, sf_dir):
    e = _events(spark, sf_dir)
    file = _text("f", F.col("user_id") % 8)
    value = F.when(F.col("event_id") % 7 == 0, "*").otherwise(_text(F.col("event_id") % 100 + 54000, ".25"))
    data = e.select(file.alias("file"), "user_id", "seq", _text("  ", F.col("event_id") % 1000, " ", F.col("event_id") * 3, "  ", F.unix_seconds("ts") - 1704067200, ".5 ", value, " ", F.col("event_id") % 5 + 60).alias("value"))
    head = e.filter("seq = 1").select(file.alias("file"), "user_id", F.lit(0).alias("seq"), _text(F.when(F.col("user_id") % 15 == 0, "Tie ").otherwise("LINE "), F.col("user_id")).alias("value"))
    notes = [(f"f{i}", -1, s, v) for i in range(8) for s, v in ((0, "/ survey block"), (1, "/ x y TIME MAG RALT"), (2, "  "))]
    lines = data.unionByName(head).unionByName(spark.createDataFrame(notes, "file string, user_id long, seq int, value string"))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("user_id", "seq")).cast("long"))
    df = xyz.read_xyz(lines, col_map={"time": "TIME", "mag_raw": "MAG", "radar_alt": "RALT"}, time_origin=DATE)
    return df.select("line", "line_type", F.unix_millis("time").alias("ms"), "x", "y", "mag_raw", "radar_alt")


def maglog_parse(spark, sf_dir):
    e = _events(spark, sf_dir)
    mag = F.when(F.col("event_id") % 7 == 0, "*").otherwise(_text(F.col("event_id") % 100 + 54000, ".25"))
    row = F.when(F.col("event_id") % 13 == 0, "junk line").otherwise(_text("$ ", mag, ",", F.col("event_id") % 2000, ",", F.date_format("ts", "HH:mm:ss.SSS")))
    lines = e.select(_text("u", F.col("user_id")).alias("file"), F.col("seq").cast("long").alias("n"), row.alias("value"))
    return maglog.parse_mag_log(lines, "geometrics", DATE).select("file", "n", F.unix_millis("time").alias("ms"), "mag_raw", "signal")


def merge_streams(spark, sf_dir):
    e = _events(spark, sf_dir)
    mag = e.filter("event_id % 2 = 0").select(F.col("ts").alias("time"), (54000 + F.col("value")).alias("mag_raw"), "event_id")
    gps = e.filter("event_id % 3 = 0").select(F.col("ts").alias("time"), (40 + F.col("event_id") % 1000 / 1e4).alias("lat"), (-100 + F.col("event_id") % 777 / 1e4).alias("lon"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 500).cast("double").alias("alt"))
    df = merged(mag, gps, lag=30, max_gap=600, origin=(-100.0, 40.0))
    return df.select("fid", "event_id", "mag_raw", *(F.round(c, 5).alias(c) for c in ("lon", "lat", "gps_alt", "x", "y")))


def queries() -> dict:
    return {f.__name__: f for f in (nmea_parse, nmea_counts, nmea_checksum, xyz_parse, maglog_parse, merge_streams)}


def oracle_sql() -> dict:
    return {
        "nmea_parse": """SELECT 'u' || user_id AS file, epoch_us(ts) // 1000 AS ms, round(40 + (event_id * 7919 % 600000) / 10000.0 / 60, 6) AS lat, round(-(100 + (event_id * 104729 % 600000) / 10000.0 / 60), 6) AS lon,
       (event_id % 500 + 0.5)::DOUBLE AS alt, 1 AS quality, 8 AS n_sat, 0.9::DOUBLE AS hdop, round((event_id % 900) / 10.0::DOUBLE * 0.514444::DOUBLE, 6) AS speed, (event_id % 360)::DOUBLE AS course FROM events WHERE event_id % 11 <> 0""",
        "nmea_counts": "SELECT 'u' || user_id AS file, 3 * count(*) AS n_sentences, count(*) FILTER (event_id % 11 = 0) AS n_bad_checksum FROM events GROUP BY user_id",
        "nmea_checksum": """SELECT event_id, printf('%02X', list_reduce(list_transform(string_split('GPGGA,' || event_id || ',' || user_id, ''), lambda c: ascii(c)), lambda a, c: xor(a, c))) AS checksum FROM events""",
        "xyz_parse": """SELECT user_id::VARCHAR AS line, CASE WHEN user_id % 15 = 0 THEN 'tie' ELSE 'traverse' END AS line_type, epoch_us(ts) // 1000000 * 1000 + 500 AS ms, (event_id % 1000)::DOUBLE AS x, (event_id * 3)::DOUBLE AS y,
       CASE WHEN event_id % 7 <> 0 THEN (event_id % 100 + 54000.25)::DOUBLE END AS mag_raw, (event_id % 5 + 60)::DOUBLE AS radar_alt FROM events""",
        "maglog_parse": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) // 1000 % 86400000 AS tod FROM events),
k AS (SELECT *, CASE WHEN tod - lag(tod) OVER (PARTITION BY user_id ORDER BY n) < -43200000 THEN 1 ELSE 0 END AS fell FROM e WHERE event_id % 13 <> 0),
t AS (SELECT *, 1704067200000 + tod + 86400000 * sum(fell) OVER (PARTITION BY user_id ORDER BY n) AS ms FROM k)
SELECT 'u' || user_id AS file, n, ms::BIGINT AS ms, (event_id % 100 + 54000.25)::DOUBLE AS mag_raw, (event_id % 2000)::DOUBLE AS signal FROM t WHERE event_id % 7 <> 0""",
        "merge_streams": """WITH g AS (SELECT epoch_us(ts) / 1e6 + 30 AS t, 40 + event_id % 1000 / 1e4 AS lat, -100 + event_id % 777 / 1e4 AS lon, CASE WHEN event_id % 10 <> 0 THEN (event_id % 500)::DOUBLE END AS alt FROM events WHERE event_id % 3 = 0),
iv AS (SELECT t AS t0, lead(t) OVER w AS t1, lat AS lat0, lead(lat) OVER w AS lat1, lon AS lon0, lead(lon) OVER w AS lon1 FROM g WINDOW w AS (ORDER BY t)),
ia AS (SELECT t AS t0, lead(t) OVER w AS t1, alt AS a0, lead(alt) OVER w AS a1 FROM g WHERE alt IS NOT NULL WINDOW w AS (ORDER BY t)),
m AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, 54000 + value AS mag_raw FROM events WHERE event_id % 2 = 0),
j AS (SELECT m.*, lat0 + (lat1 - lat0) * (t - t0) / (t1 - t0) AS lat, lon0 + (lon1 - lon0) * (t - t0) / (t1 - t0) AS lon FROM m ASOF JOIN iv ON m.t >= iv.t0 WHERE t <= t1 AND least(t - t0, t1 - t) <= 600),
a AS (SELECT m.event_id, a0 + (a1 - a0) * (t - t0) / (t1 - t0) AS alt FROM m ASOF JOIN ia ON m.t >= ia.t0 WHERE t <= t1),
q AS (SELECT j.*, a.alt, radians((40 + lat) / 2) AS p FROM j LEFT JOIN a USING (event_id))
SELECT row_number() OVER (ORDER BY t) AS fid, event_id, mag_raw, round(lon, 5) AS lon, round(lat, 5) AS lat, round(alt, 5) AS gps_alt,
       round((lon + 100) * (111412.84::DOUBLE * cos(p) - 93.5::DOUBLE * cos(3 * p) + 0.118::DOUBLE * cos(5 * p)), 5) AS x,
       round((lat - 40) * (111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(40)) + 1.175::DOUBLE * cos(4 * radians(40)) - 0.0023::DOUBLE * cos(6 * radians(40))), 5) AS y FROM q""",
    }
