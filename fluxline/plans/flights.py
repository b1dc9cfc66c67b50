"""Racetrack flights made of the events table, their lines told from the turns, and the SQL that must find the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flightlines

#: Samples of a flight and of a leg with its turn; a leg is straight for STRAIGHT of them.
FLIGHT, LEG, STRAIGHT = 2000, 100, 70


def track(spark, sf_dir) -> DataFrame:
    """A sample a second: twenty legs a flight, north and south in turn, 200 m apart. Of each flight leg 3 is a slow curve, 10 goes diagonally and the
    last four east and west; leg 5 has a wobble and leg 7 a gap of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    n = F.col("event_id") % FLIGHT
    e = e.withColumns({"flight": F.floor(F.col("event_id") / FLIGHT), "g": F.floor(n / LEG), "m": n % LEG})
    e = e.withColumn("turn", F.col("m") >= STRAIGHT).withColumn("leg", 20 * F.col("flight") + F.col("g"))
    d = 60.0 * F.least(F.col("m"), F.lit(STRAIGHT - 1))
    up = F.when(F.col("g") % 2 == 0, d).otherwise(60.0 * (STRAIGHT - 1) - d)
    out = F.when(F.col("g") % 2 == 0, 1.0).otherwise(-1.0)
    phi = F.when(F.col("turn"), F.lit(3.141592653589793) * (F.col("m") - STRAIGHT + 0.5) / (LEG - STRAIGHT)).otherwise(0.0)
    across = 200.0 * F.col("leg") + 100 - 100 * F.cos(phi) + 0.0003 * F.col("value") + F.when((F.col("g") == 5) & (F.col("m") == 35), 6.0).otherwise(0.0)
    along = up + out * 100 * F.sin(phi)
    theta = F.radians(0.9 * F.col("m"))
    bend, tie, slant = (F.col("g") == 3) & ~F.col("turn"), F.col("g") >= 16, (F.col("g") == 10) & ~F.col("turn")
    x = F.when(bend, 200.0 * F.col("leg") + 3819.7 * (1 - F.cos(theta))).when(slant, 200.0 * F.col("leg") + 42.0 * F.col("m")).when(tie, along).otherwise(across)
    y = F.when(bend, 3819.7 * F.sin(theta)).when(slant, 42.0 * F.col("m")).when(tie, across).otherwise(along)
    at = 1704067200000000 + 1000000 * (86400 * F.col("flight") + F.col("event_id") % FLIGHT + F.when(n >= 740, 20).otherwise(0))
    return e.select("event_id", "flight", F.timestamp_micros(at.cast("long")).alias("time"), x.alias("x"), y.alias("y"))


def plan(spark, sf_dir) -> DataFrame:
    """Every third leg as planned, 10 m east of where it is flown; one in nine has no length."""
    legs = track(spark, sf_dir).groupBy("flight").agg(F.max("event_id").alias("last")).select(F.explode(F.sequence(20 * F.col("flight"), F.floor(F.col("last") / LEG), F.lit(1))).alias("leg")).filter("leg % 3 = 0")
    east = 200.0 * F.col("leg") + 10
    return legs.select(F.concat(F.lit("P"), F.col("leg").cast("string")).alias("line"), F.lit("planned").alias("line_type"), east.alias("x0"), F.lit(0.0).alias("y0"), east.alias("x1"), F.when(F.col("leg") % 9 == 0, 0.0).otherwise(4000.0).alias("y1"))


def _segments(found: flightlines.Assigned) -> DataFrame:
    return found.segments.select("flight", "line", "line_type", "n", F.round(F.col("length_m") + 3e-7, 4).alias("length_m"), F.round(F.col("heading") + 3e-7, 4).alias("heading"))


def assign_lines(spark, sf_dir):
    return _segments(flightlines.assign_lines(track(spark, sf_dir), "flight", azimuth=0))


def assign_lines_plan(spark, sf_dir):
    return _segments(flightlines.assign_lines(track(spark, sf_dir), "flight", azimuth=0, plan=plan(spark, sf_dir)))


def assign_lines_samples(spark, sf_dir):
    return flightlines.assign_lines(track(spark, sf_dir), "flight", azimuth=0, drop_turns=False).samples.select("event_id", "line", "line_type", "dir")


def queries() -> dict:
    return {f.__name__: f for f in (assign_lines, assign_lines_plan, assign_lines_samples)}


_TRACK = f"""
WITH RECURSIVE e AS (
  SELECT event_id, value, event_id // {FLIGHT} AS flight, event_id % {FLIGHT} AS n, event_id % {FLIGHT} // {LEG} AS g, event_id % {LEG} AS m, event_id // {LEG} AS leg FROM events
), p AS (
  SELECT *, m >= {STRAIGHT} AS turn, CASE WHEN g % 2 = 0 THEN 1 ELSE -1 END AS out,
         CASE WHEN g % 2 = 0 THEN 60.0::DOUBLE * least(m, {STRAIGHT - 1}) ELSE 60.0::DOUBLE * ({STRAIGHT - 1} - least(m, {STRAIGHT - 1})) END AS up,
         CASE WHEN m >= {STRAIGHT} THEN pi() * (m - {STRAIGHT} + 0.5::DOUBLE) / {LEG - STRAIGHT} ELSE 0 END AS phi FROM e
), q AS (
  SELECT *, 200.0::DOUBLE * leg + 100 - 100 * cos(phi) + 0.0003::DOUBLE * value + CASE WHEN g = 5 AND m = 35 THEN 6 ELSE 0 END AS across, up + out * 100 * sin(phi) AS along FROM p
), track AS (
  SELECT event_id, flight, n, 86400 * flight + n + CASE WHEN n >= 740 THEN 20 ELSE 0 END AS t,
         CASE WHEN g = 3 AND NOT turn THEN 200.0::DOUBLE * leg + 3819.7::DOUBLE * (1 - cos(radians(0.9::DOUBLE * m))) WHEN g = 10 AND NOT turn THEN 200.0::DOUBLE * leg + 42 * m WHEN g >= 16 THEN along ELSE across END AS x,
         CASE WHEN g = 3 AND NOT turn THEN 3819.7::DOUBLE * sin(radians(0.9::DOUBLE * m)) WHEN g = 10 AND NOT turn THEN 42.0::DOUBLE * m WHEN g >= 16 THEN across ELSE along END AS y FROM q
), smooth AS (
  SELECT *, avg(x) OVER w AS sx, avg(y) OVER w AS sy FROM track WINDOW w AS (PARTITION BY flight ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
), aimed AS (
  SELECT *, atan2(lead(sx) OVER w - sx, lead(sy) OVER w - sy) AS h0, lead(t) OVER w - t AS ahead, t - lag(t) OVER w AS dt FROM smooth WINDOW w AS (PARTITION BY flight ORDER BY n)
), headed AS (
  SELECT *, coalesce(h0, lag(h0) OVER (PARTITION BY flight ORDER BY n)) AS h FROM aimed
), turning AS (
  SELECT *, coalesce(abs(degrees(atan2(sin(lead(h) OVER w - h), cos(lead(h) OVER w - h)))) / ahead, 0) AS rate FROM headed WINDOW w AS (PARTITION BY flight ORDER BY n)
), smoother AS (
  SELECT *, avg(rate) OVER (PARTITION BY flight ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) < 1 AS straight FROM turning
), started AS (
  SELECT *, straight AND (NOT coalesce(lag(straight) OVER w, false) OR coalesce(dt > 10, false)) AS start FROM smoother WINDOW w AS (PARTITION BY flight ORDER BY n)
), numbered AS (
  SELECT *, sum(start::INT) OVER (PARTITION BY flight ORDER BY n) AS run, CASE WHEN NOT start THEN sqrt((x - lag(x) OVER v) ** 2 + (y - lag(y) OVER v) ** 2) END AS step FROM started WINDOW v AS (PARTITION BY flight ORDER BY n)
), apart AS (
  SELECT *, atan2(sum(sin(h)) OVER u, sum(cos(h)) OVER u) AS mean FROM numbered WHERE straight WINDOW u AS (PARTITION BY flight, run)
), runs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY flight ORDER BY run) AS r FROM (
    SELECT flight, run, count(*) AS n, coalesce(sum(step), 0) AS length, sum(sin(h)) AS east, sum(cos(h)) AS north, sum(x) AS sx, sum(y) AS sy,
           max(abs(degrees(atan2(sin(h - mean), cos(h - mean))))) AS spread FROM apart GROUP BY flight, run) WHERE spread <= 30
), folded AS (
  SELECT flight, r, run, run AS segment, n, east, north, sx, sy FROM runs WHERE r = 1
  UNION ALL
  SELECT flight, r, run, CASE WHEN same THEN segment ELSE run END, CASE WHEN same THEN n ELSE 0 END + rn, CASE WHEN same THEN east ELSE 0 END + reast, CASE WHEN same THEN north ELSE 0 END + rnorth,
         CASE WHEN same THEN sx ELSE 0 END + rsx, CASE WHEN same THEN sy ELSE 0 END + rsy
  FROM (SELECT r.flight, r.r, r.run, segment, f.n, f.east, f.north, f.sx, f.sy, r.n AS rn, r.east AS reast, r.north AS rnorth, r.sx AS rsx, r.sy AS rsy,
               abs(degrees(atan2(sin(atan2(r.east, r.north) - atan2(f.east, f.north)), cos(atan2(r.east, r.north) - atan2(f.east, f.north))))) <= 10
               AND abs((r.sx / r.n - f.sx / f.n) * cos(atan2(f.east, f.north)) - (r.sy / r.n - f.sy / f.n) * sin(atan2(f.east, f.north))) <= 50 AS same
        FROM folded f JOIN runs r ON r.flight = f.flight AND r.r = f.r + 1)
), merged AS (
  SELECT f.flight, segment, sum(r.n) AS n, sum(length) AS length, atan2(sum(r.east), sum(r.north)) AS h, sum(r.sx) / sum(r.n) AS cx, sum(r.sy) / sum(r.n) AS cy
  FROM folded f JOIN runs r ON r.flight = f.flight AND r.run = f.run GROUP BY f.flight, segment HAVING sum(length) >= 500
), typed AS (
  SELECT *, CASE WHEN abs(cos(h)) >= cos(radians(15)) THEN 'traverse' WHEN abs(sin(h)) >= cos(radians(15)) THEN 'tie' END AS line_type,
         degrees(h) + CASE WHEN h < 0 THEN 360 ELSE 0 END AS heading FROM merged
), named AS MATERIALIZED (
  SELECT *, CASE WHEN line_type = 'tie' THEN 'T' || (8990 + 10 * row_number() OVER (PARTITION BY line_type ORDER BY cy, flight, segment)) ELSE 'L' || (990 + 10 * row_number() OVER (PARTITION BY line_type ORDER BY cx, flight, segment)) END AS line
  FROM typed WHERE line_type IS NOT NULL
)
"""


def oracle_sql() -> dict:
    near = "round(length + 3e-7, 4) AS length_m, round(heading + 3e-7, 4) AS heading"
    planned = f"""), planned AS (
  SELECT flight, segment, 'P' || arg_min(leg, (abs(cx - 200 * leg - 10), 'P' || leg)) AS to_line FROM named JOIN (SELECT DISTINCT event_id // {LEG} AS leg FROM events) l ON leg % 3 = 0 AND leg % 9 <> 0 AND abs(cx - 200 * leg - 10) <= 50 GROUP BY flight, segment)"""
    return {
        "assign_lines": _TRACK + f"SELECT flight, line, line_type, n::BIGINT AS n, {near} FROM named",
        "assign_lines_plan": _TRACK.rstrip().removesuffix(")") + planned + f" SELECT flight, coalesce(to_line, line) AS line, CASE WHEN to_line IS NULL THEN line_type ELSE 'planned' END AS line_type, n::BIGINT AS n, {near} FROM named LEFT JOIN planned USING (flight, segment)",
        "assign_lines_samples": _TRACK
        + """SELECT event_id, line, line_type, CASE WHEN line IS NOT NULL THEN (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + (round_even(heading / 45, 0)::INT % 8)] END AS dir
FROM numbered s LEFT JOIN folded f ON s.straight AND f.flight = s.flight AND f.run = s.run LEFT JOIN named d ON d.flight = f.flight AND d.segment = f.segment""",
    }
