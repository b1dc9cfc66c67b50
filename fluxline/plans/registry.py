"""Queries of the survey operators and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import checks as K
from ..operators import crossovers as X
from ..operators import runs as R
from ..operators.survey import with_segments, with_steps
from ..spec import SurveySpec
from . import adapters as A
from . import crossing_sql as S
from . import figures, flights, gridded, ingest, qc

#: Limits that make the driver's tables pass and fail in parts.
SPEC = SurveySpec(max_gap=86400, max_along_line_sep=6.2, max_deviation=1.5, clearance_tol=15, line_spacing=210, line_spacing_tol=0.04, max_diurnal_dev=60, diurnal_window=4 * 3600, max_crossover_abs=200, max_crossover_rms=150, max_heading_error=0.5, max_levelled_abs=150, max_levelled_rms=100, fourth_diff_tol=20)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) for c in names})


#: The same for dense lines of noise.
DENSE = SurveySpec(max_gap=86400, spike_nsigma=1.8, fourth_diff_tol=20)
#: A base station's limits.
STORM = SurveySpec(max_diurnal_dev=25, diurnal_window=4 * 3600)


def _near(*names: str) -> dict:
    """Rounded off the ties of short decimals."""
    return {c: F.round(F.col(c) + 3e-7, 4) for c in names}


def _table(flags: DataFrame) -> DataFrame:
    """All sixteen columns of flags; times in microseconds."""
    return flags.withColumns(_near("x", "y", "lon", "lat", "value", "threshold") | {c: F.unix_micros(c) for c in ("time_start", "time_end")})


def _flags(result: K.CheckResult) -> DataFrame:
    return _table(result.flags)


def _metric(result: K.CheckResult) -> DataFrame:
    return _rounded(result.metric.select("value", "threshold"), "value")


def as_survey(spark, sf_dir):
    return _rounded(A.events_survey(spark, sf_dir).select("line", "line_type", "fid", "seq", "i", "x", "y", "mag", "radar_alt"), "x", "y", "radar_alt")


def enu_lonlat(spark, sf_dir):
    return _rounded(A.events_survey(spark, sf_dir).select("line", "seq", "lon", "lat"), "lon", "lat")


def step_bearing(spark, sf_dir):
    w = Window.partitionBy("line").orderBy("seq")
    df = with_steps(A.events_survey(spark, sf_dir)).withColumn("bearing", G.bearing(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return _rounded(df.select("line", "seq", "dt", "step", "along", "bearing", G.compass(F.col("bearing")).alias("compass")), "dt", "step", "along", "bearing")


def segments(spark, sf_dir):
    df = with_segments(A.events_survey(spark, sf_dir), SPEC.max_gap)
    return df.groupBy("line", "seg").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def runs(spark, sf_dir):
    return R.intervals(R.runs(A.events_survey(spark, sf_dir), ["line"], "seq", F.col("mag") > 54250), ["line"]).drop("run")


def fourth_difference(spark, sf_dir):
    s, w = A.lineitem_survey(spark, sf_dir), Window.partitionBy("line")
    d4 = R.fourth_difference(F.col("mag"), w.orderBy("seq"), F.count("*").over(w))
    return s.select("line", "seq", F.round(d4, 3).alias("d4"))


def running_median(spark, sf_dir):
    return _rounded(R.running_median(A.events_survey(spark, sf_dir).select("line", "seq", "mag"), ["line"], "seq", "mag", 21, "median").select("line", "seq", "median"), "median")


def running_max(spark, sf_dir):
    return _rounded(A.lineitem_survey(spark, sf_dir).select("line", "seq", R.running(F.max, F.col("mag"), ["line"], "seq", 21).alias("most")), "most")


def line_stats(spark, sf_dir):
    s = with_steps(A.events_survey(spark, sf_dir))
    return _rounded(s.groupBy("line", "line_type").agg(F.count("*").alias("n"), F.sum("step").alias("length"), F.median("mag").alias("median_mag"), F.percentile("mag", 0.95).alias("p95"), F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("rms_step")), "length", "median_mag", "p95", "rms_step")


def _check(f, part=_flags, survey=A.events_survey):
    return lambda spark, sf_dir: part(f(survey(spark, sf_dir), SPEC))


def diurnal_correction(spark, sf_dir):
    df = K.diurnal_correction(A.events_survey(spark, sf_dir), A.base_station(spark, sf_dir))
    return _rounded(df.select("line", "seq", "mag"), "mag")


def diurnal_chord(spark, sf_dir):
    return _rounded(K.diurnal_chords(A.base_station(spark, sf_dir), SPEC).select("k", "dev", "exceed"), "dev")


def check_diurnal(spark, sf_dir):
    return _flags(K.diurnal(A.events_survey(spark, sf_dir), STORM, A.base_station(spark, sf_dir)))


def check_line_deviation_plan(spark, sf_dir):
    return _flags(K.line_deviation(A.events_survey(spark, sf_dir), SPEC, A.flight_plan(spark, sf_dir)))


def metric_line_deviation_plan(spark, sf_dir):
    m = K.line_deviation(A.events_survey(spark, sf_dir), SPEC, A.flight_plan(spark, sf_dir)).metric
    return m.withColumns(_near("value"))


def _crossings(spark, sf_dir):
    s = A.events_survey(spark, sf_dir)
    return s, X.crossovers(s)


def crossovers(spark, sf_dir):
    x = _crossings(spark, sf_dir)[1]
    return x.withColumns(_near("x", "y", "lon", "lat", "mag_traverse", "mag_tie", "misfit", "alt_traverse", "alt_tie") | {"time": F.unix_micros("time")})


def check_crossovers(spark, sf_dir):
    s, x = _crossings(spark, sf_dir)
    return _flags(X.crossover_misfit(s, SPEC, x))


def check_heading_error(spark, sf_dir):
    s, x = _crossings(spark, sf_dir)
    return _flags(X.heading_error(s, SPEC, x))


def by_heading(spark, sf_dir):
    s, x = _crossings(spark, sf_dir)
    return X.headings(s, SPEC, x).withColumns(_near("mean_misfit"))


def _level(order, part):
    def query(spark, sf_dir):
        s, x = _crossings(spark, sf_dir)
        levelled, coefficients, after = X.level_ties(s, x, order)
        if part == "coefficients":
            return coefficients.withColumns({"c0": F.round(F.col("c0") + 3e-7, 4), "c1": F.round(F.col("c1") + 3e-9, 6)})
        return _flags(X.levelling_residual(levelled, SPEC, after))

    return query


def spike_detect(spark, sf_dir):
    df = K.despike(A.lineitem_survey(spark, sf_dir), DENSE).filter("amplitude IS NOT NULL")
    return df.select("line", "seq", "seg", "amplitude", "z", "cleaned").withColumns(_near("amplitude", "z", "cleaned"))


def _result(spark, sf_dir):
    return qc.run_qc(A.events_survey(spark, sf_dir), SPEC, A.base_station(spark, sf_dir))


def scorecard(spark, sf_dir):
    return _result(spark, sf_dir).scorecard.withColumns(_near("metric", "threshold", "pct_samples"))


def flag_table(spark, sf_dir):
    return qc.flag_table(_result(spark, sf_dir).flags)


def lines(spark, sf_dir):
    df = _result(spark, sf_dir).lines
    return df.withColumns(_near("length_km", "flagged_km") | {c: F.unix_micros(c) for c in ("start", "end")})


def survey_stats(spark, sf_dir):
    df = _result(spark, sf_dir).stats
    return df.withColumns(_near("line_km", "traverse_km", "tie_km", "flagged_km", "accepted_pct", "duration_h") | {c: F.unix_micros(c) for c in ("start", "end")})


def running_mean(spark, sf_dir):
    s = A.events_survey(spark, sf_dir)
    return s.select("line", "seq", R.running_mean(F.col("mag"), ["line"], "seq", 60).alias("mean")).withColumns(_near("mean"))


def decimated_traces(spark, sf_dir):
    return figures.decimated(A.events_survey(spark, sf_dir), 5).select("line", "seq", figures.time_text(F.col("time")).alias("time"), F.round(F.col("mag") + 3e-7, 2).alias("mag"))


def clearance_rows(spark, sf_dir):
    s = A.events_survey(spark, sf_dir)
    return figures.clearance_rows(s, K.clearance(s, SPEC).flags).withColumn("value", F.round(F.col("value") + 3e-7, 1)).select("line", "seq", "flagged")


def crossover_rows(spark, sf_dir):
    s, x = _crossings(spark, sf_dir)
    return figures.crossover_rows(s, X.level_ties(s, x, "linear")[2], SPEC).withColumns(_near("misfit", "misfit_after"))


def line_profile(spark, sf_dir):
    s = A.events_survey(spark, sf_dir)
    noise = K.noise_series(s, SPEC).select("line", "seq", "d4")
    return figures.line_profile(s, noise, K.clearance(s, SPEC).flags, "L7").withColumns(_near("along", "mag", "radar_alt")).drop("d4", "mag_lev")


def geometry(spark, sf_dir):
    """Where neighbouring samples' lines meet the base line, distances to it, a dipole's field and hhmmss texts."""
    s = A.events_survey(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    px, py = G.intersection(x, y, F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(10.0), F.lit(1.0), F.lit(0.5))
    far = G.point_line_distance(x, y, F.lit(0.0), F.lit(0.0), F.lit(300.0), F.lit(400.0))
    dipole = G.dipole_anomaly(x - 15000, y - 100, F.lit(200.0), F.lit(1e9), 60.0, 20.0)
    return s.select("line", "seq", px.alias("px"), py.alias("py"), far.alias("far"), dipole.alias("dipole"), G.hms(F.col("seq") * 1000.256).alias("hms")).withColumns(_near("px", "py", "far", "dipole"))


def queries() -> dict:
    plain = [running_mean, decimated_traces, clearance_rows, crossover_rows, line_profile, geometry, as_survey, enu_lonlat, step_bearing, segments, runs, fourth_difference, running_median, running_max, line_stats, diurnal_correction, diurnal_chord, check_diurnal, check_line_deviation_plan, metric_line_deviation_plan, crossovers, check_crossovers, check_heading_error, by_heading, spike_detect, scorecard, flag_table, lines, survey_stats]
    return {f.__name__: f for f in plain} | {
        "check_sample_interval": _check(K.sample_interval),
        "metric_sample_interval": _check(K.sample_interval, _metric),
        "check_along_line_spacing": _check(K.along_line_spacing),
        "check_line_deviation": _check(K.line_deviation),
        "metric_line_deviation": _check(K.line_deviation, _metric),
        "check_line_separation": _check(K.line_separation),
        "check_clearance": _check(K.clearance),
        "metric_clearance": _check(K.clearance, _metric),
        "check_spikes": lambda spark, sf_dir: _flags(K.spikes(A.lineitem_survey(spark, sf_dir), DENSE)),
        "check_fourth_difference": lambda spark, sf_dir: _flags(K.fourth_difference_noise(A.lineitem_survey(spark, sf_dir), DENSE)),
        "level_ties_constant": _level("constant", "coefficients"),
        "level_ties_linear": _level("linear", "coefficients"),
        "check_levelling_residual": _level("linear", "flags"),
    } | ingest.queries() | gridded.queries() | flights.queries()


EVENTS = """
WITH e AS (
  SELECT event_id, ts, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), e1 AS (
  SELECT CASE WHEN user_id % 15 = 0 THEN 'T' ELSE 'L' END || user_id AS line, ts AS time, event_id AS fid, n AS seq, 54000 + value AS mag, 60 + (value - 250) / 10 AS radar_alt,
         CASE WHEN user_id % 15 = 0 THEN 450.0::DOUBLE * n ELSE 200.0::DOUBLE * user_id + 2 * sin(n / 9) END AS x,
         CASE WHEN user_id % 15 = 0 THEN 30.0::DOUBLE * (user_id // 15 + 1) + 2 * sin(n / 9) WHEN user_id % 2 = 1 THEN 600 - 6.0::DOUBLE * n ELSE 6.0::DOUBLE * n END AS y
  FROM e
), s AS (
  SELECT *, CASE WHEN line LIKE 'T%' THEN 'tie' ELSE 'traverse' END AS line_type, row_number() OVER (ORDER BY line LIKE 'T%', line, seq) AS i,
         epoch_us(time) / 1e6 - lag(epoch_us(time) / 1e6) OVER w AS dt, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step
  FROM e1 WINDOW w AS (PARTITION BY line ORDER BY seq)
)
"""
LINEITEM = """
WITH s AS (
  SELECT 'L' || l_suppkey AS line, 54000 + l_extendedprice / 1000 AS mag,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq
  FROM lineitem
)
"""
BASE = """, b0 AS (
  SELECT date_trunc('hour', ts) AS time, avg(value) AS b FROM events GROUP BY 1
), b AS (
  SELECT time, epoch_us(time) / 1e6 AS t, b, row_number() OVER (ORDER BY time) AS k FROM b0
)
"""


OFFSETS = """, c AS (
  SELECT line, avg(x) AS cx, avg(y) AS cy, 0.5::DOUBLE * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM s GROUP BY line HAVING count(*) >= 3
), o AS (
  SELECT s.*, (x - cx) * -sin(a) + (y - cy) * cos(a) AS dev FROM s JOIN c USING (line)
)
"""


#: After EVENTS: sl, the survey with lon and lat.
PLACED = """, pl AS (SELECT *, 40 + y / (111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(40)) + 1.175::DOUBLE * cos(4 * radians(40)) - 0.0023::DOUBLE * cos(6 * radians(40))) AS lat FROM s),
sl AS MATERIALIZED (SELECT *, -100 + x / (111412.84::DOUBLE * cos(radians((40 + lat) / 2)) - 93.5::DOUBLE * cos(3 * radians((40 + lat) / 2)) + 0.118::DOUBLE * cos(5 * radians((40 + lat) / 2))) AS lon FROM pl)"""
#: After PLACED and BASE: sv, the survey with its corrected field.
CORRECTED = """, bv AS (SELECT *, lead(t) OVER (ORDER BY t) AS t1, lead(b) OVER (ORDER BY t) AS b1 FROM b), bz AS (SELECT median(b) AS datum, arg_min(b, t) AS first, arg_max(b, t) AS last FROM b),
sv AS MATERIALIZED (SELECT sl.* REPLACE (sl.mag - (CASE WHEN v.t IS NULL THEN z.first WHEN v.t1 IS NULL THEN z.last ELSE v.b + (v.b1 - v.b) * (epoch_us(sl.time) / 1e6 - v.t) / (v.t1 - v.t) END - z.datum) AS mag)
  FROM sl ASOF LEFT JOIN bv v ON epoch_us(sl.time) / 1e6 >= v.t CROSS JOIN bz z)"""
#: After LINEITEM: s with places and times.
DENSE_LINES = """WITH s0 AS (
  SELECT 'L' || l_suppkey AS line, 54000 + l_extendedprice / 1000 AS mag, 200.0::DOUBLE * l_suppkey AS x, row_number() OVER w AS seq
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)
), s AS (SELECT *, seq AS fid, 6.0::DOUBLE * seq AS y, make_timestamp(1704067200000000 + seq * 100000) AS time, 0.1 AS dt, row_number() OVER (ORDER BY line, seq) AS i FROM s0)""" + PLACED


def _all_columns(ctes: str, *selects: str) -> str:
    near = ", ".join(f"round({c} + 3e-7, 4) AS {c}" for c in ("x", "y", "lon", "lat", "value", "threshold"))
    return f"{ctes} SELECT * REPLACE ({near}, epoch_us(time_start) AS time_start, epoch_us(time_end) AS time_end) FROM (" + " UNION ALL ".join(selects) + ")"


def _gap_flags(spec, source):
    at = {"line": "line", "i_start": "pi", "i_end": "i", "fid_start": "pfid", "fid_end": "fid", "time_start": "pt", "time_end": "time", "value": "dt", "threshold": f"{spec.max_gap}", "units": "'s'", "description": S.fixed("dt", 1) + " || ' s break in data stream'"}
    at |= {c: f"(p{c} + {c}) / 2" for c in ("x", "y", "lon", "lat")}
    before = ", ".join(f"lag({c}) OVER w AS p{c}" for c in ("i", "fid", "x", "y", "lon", "lat")) + ", lag(time) OVER w AS pt"
    return S.flags("sample_interval", at, f"FROM (SELECT *, {before} FROM {source} WINDOW w AS (PARTITION BY line ORDER BY seq)) WHERE dt > {spec.max_gap}")


def _spacing_flags(spec, source):
    """Runs of long steps, each from the sample before."""
    limit = spec.max_along_line_sep
    before = ", ".join(f"lag({c}) OVER w AS p{c}" for c in ("i", "fid", "x", "y", "lon", "lat")) + ", lag(time) OVER w AS pt"
    marked = f"SELECT *, {before}, coalesce(dt <= {spec.max_gap} AND step > {limit}, false) AS mark FROM {source} WINDOW w AS (PARTITION BY line ORDER BY seq)"
    runs = f"SELECT *, row_number() OVER (PARTITION BY line ORDER BY seq) - row_number() OVER (PARTITION BY line, mark ORDER BY seq) AS run FROM ({marked})"
    ends = ", ".join(f"arg_min(p{c}, seq) AS {c}a, arg_max({c}, seq) AS {c}b" for c in ("i", "fid", "x", "y", "lon", "lat"))
    at = {"line": "line", "time_start": "ta", "time_end": "tb", "value": "value", "threshold": f"{limit}", "units": "'m'", "description": f"'samples up to ' || {S.fixed('value', 1)} || ' m apart (limit {limit:.1f} m)'"}
    at |= {f"{c}_start": f"{c}a" for c in ("i", "fid")} | {f"{c}_end": f"{c}b" for c in ("i", "fid")} | {c: f"({c}a + {c}b) / 2" for c in ("x", "y", "lon", "lat")}
    return S.flags("along_line_spacing", at, f"FROM (SELECT line, {ends}, arg_min(pt, seq) AS ta, arg_max(time, seq) AS tb, max(step) AS value FROM ({runs}) WHERE mark GROUP BY line, run)")


def _offsets(source, planned=False):
    plan = "SELECT line, x0, y0, x1, y1, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM plan" if planned else "SELECT NULL::VARCHAR AS line, 0.0 AS x0, 0.0 AS y0, 0.0 AS x1, 0.0 AS y1, 0.0 AS len"
    head = ", plan AS (SELECT DISTINCT 'L' || user_id AS line, 200.0::DOUBLE * user_id + 1 AS x0, 0.0::DOUBLE AS y0, 200.0::DOUBLE * user_id + 1 AS x1, CASE WHEN user_id % 20 = 1 THEN 0.0 ELSE 600.0 END::DOUBLE AS y1 FROM events WHERE user_id % 15 <> 0 AND user_id % 2 = 1)" if planned else ""
    return head + f""", ac AS (SELECT line, avg(x) AS cx, avg(y) AS cy, 0.5::DOUBLE * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM {source} GROUP BY line HAVING count(*) >= 3),
af AS (SELECT ac.line, coalesce(p.len > 0, false) AS planned, p.line IS NOT NULL AND NOT coalesce(p.len > 0, false) AS bad, CASE WHEN p.len > 0 THEN p.x0 ELSE cx END AS ox, CASE WHEN p.len > 0 THEN p.y0 ELSE cy END AS oy,
  CASE WHEN p.len > 0 THEN (p.x1 - p.x0) / p.len ELSE cos(a) END AS ux, CASE WHEN p.len > 0 THEN (p.y1 - p.y0) / p.len ELSE sin(a) END AS uy FROM ac LEFT JOIN ({plan}) p ON p.line = ac.line),
od AS MATERIALIZED (SELECT q.*, af.planned, af.bad, (x - ox) * -uy + (y - oy) * ux AS dev FROM {source} q JOIN af ON af.line = q.line)""" + S.runs(f"abs(dev) > {SPEC.max_deviation}", "dr", "line", "od")


def _deviation_flags():
    text = f"{S.fixed('value', 0)} || ' m off ' || CASE WHEN planned THEN 'planned' ELSE 'best-fit' END || ' line'"
    return S.run_flags("line_deviation", "dr", "line, planned", "max(abs(dev))", f"{SPEC.max_deviation}", "m", text)


def _separation(source):
    return f""", ce AS (SELECT line, avg(x) AS x, avg(y) AS y, avg(lon) AS lon, avg(lat) AS lat FROM {source} WHERE line_type = 'traverse' GROUP BY line),
se AS MATERIALIZED (SELECT *, x - px AS value, (x - px - {SPEC.line_spacing}) / {SPEC.line_spacing} * 100 AS err FROM (SELECT *, lag(line) OVER w AS pline, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM ce WINDOW w AS (ORDER BY x, line)) WHERE pline IS NOT NULL)"""


def _separation_flags():
    text = f"pline || ' to ' || line || ': ' || {S.fixed('value', 0)} || ' m apart (nominal {SPEC.line_spacing:g} m, ' || printf('%+.0f', round_even(err, 0)) || '%)'"
    at = {"line": "pline || ' / ' || line", "value": "value", "threshold": f"{SPEC.line_spacing}", "units": "'m'", "description": text} | {c: f"(p{c} + {c}) / 2" for c in ("x", "y", "lon", "lat")}
    return S.flags("line_separation", at, f"FROM se WHERE abs(err) > {SPEC.line_spacing_tol * 100}")


def _clearance(source):
    return f", cs AS (SELECT *, radar_alt - {SPEC.nominal_clearance} AS off FROM {source})" + S.runs(f"abs(off) > {SPEC.clearance_tol}", "cr", "line", "cs")


def _clearance_flags():
    text = f"{S.fixed('abs(value)', 0)} || CASE WHEN value > 0 THEN ' m above' ELSE ' m below' END || ' nominal clearance'"
    return S.run_flags("clearance", "cr", "line", "arg_max(off, (abs(off), -seq))", f"{SPEC.clearance_tol}", "m", text)


def _spike_flags(spec):
    at = {"line": "line", "i_start": "i", "i_end": "i", "fid_start": "fid", "fid_end": "fid", "time_start": "time", "time_end": "time", "x": "x", "y": "y", "lon": "lon", "lat": "lat", "value": "abs(amplitude)", "threshold": f"{spec.spike_nsigma} * abs(amplitude / z)", "units": "'nT'"}
    return S.flags("spikes", at | {"description": f"{S.fixed('abs(amplitude)', 1)} || ' nT spike (' || {S.fixed('abs(z)', 0)} || ' sigma)'"}, "FROM sp WHERE amplitude IS NOT NULL")


def _noise(spec):
    w = "OVER (PARTITION BY line, seg ORDER BY seq)"
    scale = 16 if spec.fourth_diff_normalize else 1
    series = f""", no AS MATERIALIZED (SELECT *, CASE WHEN n >= 5 THEN (lag(cleaned, 2) {w} - 4 * lag(cleaned) {w} + 6 * cleaned - 4 * lead(cleaned) {w} + lead(cleaned, 2) {w}) / {scale} END AS e4 FROM (SELECT * EXCLUDE (d4, v, b1, b2, a1, a2) FROM sp))"""
    return series + S.runs(f"abs(e4) > {spec.fourth_diff_tol}", "nr", "line, seg", "no")


def _noise_flags(spec):
    text = f"'fourth difference ' || {S.fixed('value', 3)} || ' nT (limit {spec.fourth_diff_tol:g} nT)'"
    return S.run_flags("fourth_difference", "nr", "line, seg", "max(abs(e4))", f"{spec.fourth_diff_tol}", "nT", text)


def _storm(spec, source):
    """CTEs after BASE and _CHORDS: hw has the samples in windows, numbered by run within line and window, dw the windows."""
    return f""", dx AS (SELECT *, coalesce(max(coalesce(dev > {spec.max_diurnal_dev}, false)) OVER (ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS mark FROM (SELECT d.*, b.time FROM d JOIN b USING (k))),
dg AS (SELECT *, row_number() OVER (ORDER BY k) - row_number() OVER (PARTITION BY mark ORDER BY k) AS run FROM dx),
dw AS MATERIALIZED (SELECT run AS win, min(time) AS ws, max(time) AS we, max(dev) AS peak FROM dg WHERE mark GROUP BY run),
hs AS MATERIALIZED (SELECT q.*, win, ws, we, peak FROM {source} q JOIN dw ON q.time BETWEEN ws AND we),
hw AS MATERIALIZED (SELECT *, seq - row_number() OVER (PARTITION BY line, win ORDER BY seq) AS run FROM hs)"""


def _storm_flags(spec):
    clock = lambda c: f"strftime({c}, '%H:%M:%S')"
    text = f"'acquired during diurnal excursion of ' || {S.fixed('value', 1)} || ' nT over {spec.diurnal_window:g} s (' || {clock('ws')} || ' to ' || {clock('we')} || ' UTC)'"
    lone = S.flags("diurnal", {"time_start": "ws", "time_end": "we", "value": "value", "threshold": f"{spec.max_diurnal_dev}", "units": "'nT'", "description": f"'no samples ' || {text}"}, "FROM (SELECT *, peak AS value FROM dw WHERE win NOT IN (SELECT win FROM hs))")
    return S.run_flags("diurnal", "hw", "line, win, ws, we", "max(peak)", f"{spec.max_diurnal_dev}", "nT", text), lone


def _qc() -> str:
    """CTEs of the whole acceptance run: fl has all flags, me the metrics."""
    parts = EVENTS + PLACED + BASE + CORRECTED + S.crossings("sv") + S.levelled("linear", "sv") + S.headings(SPEC.line_azimuth, "sv") + _offsets("sv") + _separation("sv") + _clearance("sv") + S.segments(SPEC.max_gap, "sv")
    parts += S.spikes(SPEC.spike_window, SPEC.spike_nsigma).replace(", l AS", ", sk_l AS").replace(" FROM l)", " FROM sk_l)").replace(", d AS MATERIALIZED", ", sk_d AS MATERIALIZED").replace("\nd AS MATERIALIZED", "\nsk_d AS MATERIALIZED").replace("FROM d WINDOW", "FROM sk_d WINDOW").replace("\nr AS MATERIALIZED", "\nsk_r AS MATERIALIZED").replace("AS zz FROM r)", "AS zz FROM sk_r)")
    parts += _noise(SPEC) + _CHORDS + _storm(SPEC, "sv")
    flags = [_gap_flags(SPEC, "sv"), _spacing_flags(SPEC, "sv"), _deviation_flags(), _separation_flags(), _clearance_flags(), _spike_flags(SPEC), _noise_flags(SPEC), *_storm_flags(SPEC), S.crossover_flags(SPEC.max_crossover_abs), S.heading_flags(SPEC.max_heading_error, "sv"), S.residual_flags(SPEC.max_levelled_abs)]
    metrics = [
        ("longest gap (s)", "coalesce(greatest(max(dt), 0), 0)", SPEC.max_gap, "sv", "NULL"), ("max sample spacing (m)", "coalesce(max(step), 0)", SPEC.max_along_line_sep, f"sv WHERE dt <= {SPEC.max_gap}", "NULL"),
        ("95th pct departure (m)", "quantile_cont(abs(dev), 0.95)", SPEC.max_deviation, "od", "'measured against a best-fit line; no flight plan supplied'"), ("max separation error (%)", "max(abs(err))", SPEC.line_spacing_tol * 100, "se", "CASE WHEN count(*) = 0 THEN 'fewer than two traverses' END"),
        ("95th pct |clearance error| (m)", "quantile_cont(abs(off), 0.95)", SPEC.clearance_tol, "cs", "CASE WHEN count(off) = 0 THEN 'no radar altitude' END"), ("spike count", "count(*)", 0, "sp WHERE amplitude IS NOT NULL", "NULL"), ("max |4th difference| (nT)", "coalesce(max(abs(e4)), 0)", SPEC.fourth_diff_tol, "no", "NULL"),
        ("max chord departure (nT)", "max(dev)", SPEC.max_diurnal_dev, "d", "CASE WHEN count(dev) = 0 THEN 'base record too short' END"), ("RMS crossover misfit (nT)", "sqrt(avg(misfit * misfit))", SPEC.max_crossover_rms, "xo", "CASE WHEN count(*) = 0 THEN 'no traverse/tie intersections found' END"),
        ("heading error (nT)", "max(value)", SPEC.max_heading_error, "he", "CASE WHEN max(value) IS NULL THEN 'needs crossovers on traverses flown in both directions' END"), ("RMS misfit after levelling (nT)", "sqrt(avg(misfit_after * misfit_after))", SPEC.max_levelled_rms, "xl", f"{S.fixed('sqrt(avg(misfit * misfit))', 2)} || ' nT before levelling'"),
    ]
    rows = " UNION ALL ".join(f"SELECT {i}::INT AS place, '{check}' AS \"check\", '{label}' AS label, '{name}' AS metric_label, ({value})::DOUBLE AS metric, {float(limit)}::DOUBLE AS threshold, ({note})::VARCHAR AS note FROM {source}" for i, ((check, label), (name, value, limit, source, note)) in enumerate(zip(qc.CHECKS, metrics), 1))
    return parts + ", fl AS MATERIALIZED (" + " UNION ALL ".join(flags) + """), me AS MATERIALIZED (""" + rows + """),
hi AS MATERIALIZED (SELECT DISTINCT "check", unnest(range(i_start, i_end + 1)) AS i FROM fl WHERE i_start IS NOT NULL),
ca AS MATERIALIZED (SELECT *, CASE WHEN metric IS NULL THEN 'n/a' WHEN metric > threshold OR n_flags > 0 THEN 'fail' ELSE 'pass' END AS status FROM (
  SELECT me.*, (SELECT count(*) FROM fl WHERE fl."check" = me."check") AS n_flags, (SELECT count(*) FROM hi WHERE hi."check" = me."check") AS n_samples, 100.0 * (SELECT count(*) FROM hi WHERE hi."check" = me."check") / (SELECT count(*) FROM sv) AS pct_samples FROM me)),
li AS MATERIALIZED (SELECT *, CASE WHEN n_flags > 0 THEN 'fail' ELSE 'pass' END AS status FROM (
  SELECT line, line_type, count(*) AS n_samples, min(time) AS start, max(time) AS "end", sum(coalesce(step, 0)) / 1000 AS length_km, sum(CASE WHEN i IN (SELECT i FROM hi) THEN coalesce(step, 0) ELSE 0 END) / 1000 AS flagged_km,
         (SELECT count(*) FROM fl WHERE fl.line = sv.line AND i_start IS NOT NULL) AS n_flags FROM sv GROUP BY line, line_type))"""


def oracle_sql() -> dict:
    near = lambda *names: ", ".join(f"round({c} + 3e-7, 4) AS {c}" for c in names)
    clock = lambda c: f"coalesce(strftime({c}, '%H:%M:%S'), '')"
    signif = lambda c: f"CASE WHEN {c} = 0 THEN 0.0 ELSE round_even({c} * pow(10.0::DOUBLE, 2 - floor(log10(abs({c})))), 0) / pow(10.0::DOUBLE, 2 - floor(log10(abs({c})))) END"
    label = "CASE \"check\" " + " ".join(f"WHEN '{c}' THEN '{name}'" for c, name in qc.CHECKS) + " END"
    base = EVENTS + PLACED
    crossed = base + S.crossings("sl")
    dense = DENSE_LINES + S.segments(DENSE.max_gap, "sl") + S.spikes(DENSE.spike_window, DENSE.spike_nsigma)
    run = _qc()
    coefficients = 'SELECT line, "order", n_crossovers, round(c0 + 3e-7, 4) AS c0, round(c1 + 3e-9, 6) AS c1 FROM co'
    more = {
        "check_sample_interval": _all_columns(base, _gap_flags(SPEC, "sl")),
        "check_along_line_spacing": _all_columns(base, _spacing_flags(SPEC, "sl")),
        "check_line_deviation": _all_columns(base + _offsets("sl"), _deviation_flags()),
        "check_line_deviation_plan": _all_columns(base + _offsets("sl", True), _deviation_flags()),
        "metric_line_deviation_plan": base + _offsets("sl", True) + f" SELECT '95th pct departure (m)' AS label, round(quantile_cont(abs(dev), 0.95) + 3e-7, 4) AS value, {SPEC.max_deviation}::DOUBLE AS threshold, 'zero-length plan segment for ' || (SELECT string_agg(line, ', ' ORDER BY line) FROM af WHERE bad) || '; best-fit line used there' AS note FROM od",
        "check_line_separation": _all_columns(base + _separation("sl"), _separation_flags()),
        "check_clearance": _all_columns(base + _clearance("sl"), _clearance_flags()),
        "running_mean": EVENTS + " SELECT line, seq, round(CASE WHEN count(*) OVER (PARTITION BY line) < 60 THEN mag ELSE avg(mag) OVER w END + 3e-7, 4) AS mean FROM s WINDOW w AS (PARTITION BY line ORDER BY seq ROWS BETWEEN 29 PRECEDING AND 29 FOLLOWING)",
        "decimated_traces": EVENTS + " SELECT line, seq, strftime(time, '%Y-%m-%d %H:%M:%S.') || (epoch_us(time) // 100000 % 10) AS time, round(mag + 3e-7, 2) AS mag FROM (SELECT *, max(seq) OVER (PARTITION BY line) AS last FROM s) WHERE (seq - 1) % 5 = 0 OR seq = last",
        "clearance_rows": EVENTS + f" SELECT line, seq, abs(radar_alt - {SPEC.nominal_clearance}) > {SPEC.clearance_tol} AS flagged FROM (SELECT *, max(seq) OVER (PARTITION BY line) AS last FROM s) WHERE (seq - 1) % 5 = 0 OR seq = last OR abs(radar_alt - {SPEC.nominal_clearance}) > {SPEC.clearance_tol}",
        "crossover_rows": crossed + S.levelled("linear", "sl") + S.headings(SPEC.line_azimuth, "sl") + f" SELECT row_number() OVER (ORDER BY traverse, tie) AS id, traverse || ' x ' || tie AS label, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + (round_even(((degrees(hf.r) % 360 + 360) % 360) / 45, 0)::INT % 8)] || '-bound' AS heading, {near('misfit', 'misfit_after')} FROM xl JOIN hf ON hf.line = xl.traverse",
        "line_profile": EVENTS + f" SELECT seq, fid, strftime(time, '%H:%M:%S') AS time, round(sum(coalesce(step, 0)) OVER (ORDER BY seq) + 3e-7, 4) AS along, {near('mag', 'radar_alt')}, abs(radar_alt - {SPEC.nominal_clearance}) > {SPEC.clearance_tol} AS flagged FROM s WHERE line = 'L7'",
        "geometry": EVENTS + f""", g AS (SELECT line, seq, x + ((0 - x) * 0.5 - (10 - y) * 1) / (1 * 0.5 - 2 * 1)::DOUBLE AS px, y + 2 * ((0 - x) * 0.5 - (10 - y) * 1) / (1 * 0.5 - 2 * 1)::DOUBLE AS py, abs(300 * (0 - y) - (0 - x) * 400) / 500::DOUBLE AS far,
  1e9::DOUBLE * (3 * (cos(radians(60)) * sin(radians(20)) * (x - 15000) + cos(radians(60)) * cos(radians(20)) * (y - 100) - sin(radians(60)) * 200) ** 2 / pow((x - 15000) ** 2 + (y - 100) ** 2 + 40000, 2.5) - 1 / pow((x - 15000) ** 2 + (y - 100) ** 2 + 40000, 1.5)) AS dipole, round_even(seq * 100025.6::DOUBLE, 0)::BIGINT AS u FROM s)
SELECT line, seq, {near('px', 'py', 'far', 'dipole')}, lpad((u // 360000 % 24)::VARCHAR, 2, '0') || lpad((u // 6000 % 60)::VARCHAR, 2, '0') || lpad((u // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((u % 100)::VARCHAR, 2, '0') AS hms FROM g""",
        "spike_detect": dense + f" SELECT line, seq, seg, {near('amplitude', 'z', 'cleaned')} FROM sp WHERE amplitude IS NOT NULL",
        "check_spikes": _all_columns(dense, _spike_flags(DENSE)),
        "check_fourth_difference": _all_columns(dense + _noise(DENSE), _noise_flags(DENSE)),
        "check_diurnal": _all_columns(base + BASE + _CHORDS + _storm(STORM, "sl"), *_storm_flags(STORM)),
        "crossovers": crossed + f" SELECT * EXCLUDE (fid) REPLACE ({near('x', 'y', 'lon', 'lat', 'mag_traverse', 'mag_tie', 'misfit', 'alt_traverse', 'alt_tie')}, epoch_us(time) AS time) FROM xo",
        "check_crossovers": _all_columns(crossed, S.crossover_flags(SPEC.max_crossover_abs)),
        "by_heading": crossed + S.headings(SPEC.line_azimuth, "sl") + f" SELECT forward, n, {near('mean_misfit')}, heading FROM hb",
        "check_heading_error": _all_columns(crossed + S.headings(SPEC.line_azimuth, "sl"), S.heading_flags(SPEC.max_heading_error, "sl")),
        "level_ties_constant": crossed + S.levelled("constant", "sl") + coefficients,
        "level_ties_linear": crossed + S.levelled("linear", "sl") + coefficients,
        "check_levelling_residual": _all_columns(crossed + S.levelled("linear", "sl"), S.residual_flags(SPEC.max_levelled_abs)),
        "scorecard": run + f" SELECT * REPLACE ({near('metric', 'threshold', 'pct_samples')}) FROM ca",
        "lines": run + f" SELECT * REPLACE ({near('length_km', 'flagged_km')}, epoch_us(start) AS start, epoch_us(\"end\") AS \"end\") FROM li",
        "flag_table": run + f" SELECT {label} AS \"check\", coalesce(line, 'survey-wide') AS line, {clock('time_start')} AS start, {clock('time_end')} AS \"end\", CASE WHEN fid_start IS NULL THEN '' WHEN fid_start = fid_end THEN fid_start::BIGINT::VARCHAR ELSE fid_start::BIGINT || '-' || fid_end::BIGINT END AS fid, {signif('value')} AS value, {signif('threshold')} AS \"limit\", units, description AS finding FROM fl",
        "survey_stats": run + f""", a AS (SELECT count(*) AS n_samples, min(time) AS start, max(time) AS fin, (epoch_us(max(time)) - epoch_us(min(time))) / 3.6e9 AS duration_h FROM sv),
lk AS (SELECT count(*) AS n_lines, count(*) FILTER (line_type = 'traverse') AS n_traverse, count(*) FILTER (line_type = 'tie') AS n_tie, sum(length_km) AS line_km, sum(length_km) FILTER (line_type = 'traverse') AS traverse_km, sum(length_km) FILTER (line_type = 'tie') AS tie_km, sum(flagged_km) AS flagged_km FROM li)
SELECT n_samples, epoch_us(start) AS start, epoch_us(fin) AS "end", {near('duration_h', 'line_km', 'traverse_km', 'tie_km', 'flagged_km')}, true AS has_lonlat, n_lines, n_traverse, n_tie, (SELECT count(*) FROM ca WHERE status = 'pass') AS checks_passed, (SELECT count(*) FROM ca WHERE status = 'fail') AS checks_failed,
       (SELECT count(*) FROM ca WHERE status <> 'n/a') AS checks_total, (SELECT count(*) FROM fl) AS n_flags, (SELECT count(*) FROM xo) AS n_crossovers, round(100 * (1 - flagged_km / line_km) + 3e-7, 4) AS accepted_pct, true AS diurnal_corrected FROM a, lk""",
    }
    return more | ingest.oracle_sql() | gridded.oracle_sql() | flights.oracle_sql() | {
        "as_survey": EVENTS + "SELECT line, line_type, fid, seq, i, round(x, 5) AS x, round(y, 5) AS y, mag, round(radar_alt, 5) AS radar_alt FROM s",
        "enu_lonlat": EVENTS
        + """, p AS (SELECT *, 40 + y / (111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(40)) + 1.175::DOUBLE * cos(4 * radians(40)) - 0.0023::DOUBLE * cos(6 * radians(40))) AS la FROM s),
q AS (SELECT *, radians((40 + la) / 2) AS m FROM p)
SELECT line, seq, round(-100 + x / (111412.84::DOUBLE * cos(m) - 93.5::DOUBLE * cos(3 * m) + 0.118::DOUBLE * cos(5 * m)), 5) AS lon, round(la, 5) AS lat FROM q""",
        "step_bearing": EVENTS
        + """, p AS (SELECT line, seq, dt, step, sum(coalesce(step, 0)) OVER w AS along, degrees(atan2(x - lag(x) OVER w, y - lag(y) OVER w)) AS d FROM s WINDOW w AS (PARTITION BY line ORDER BY seq)),
q AS (SELECT *, CASE WHEN d < 0 THEN d + 360 ELSE d END AS bearing FROM p)
SELECT line, seq, round(dt, 5) AS dt, round(step, 5) AS step, round(along, 5) AS along, round(bearing, 5) AS bearing, CASE WHEN bearing IS NOT NULL THEN (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + (round_even(bearing / 45, 0)::INT % 8)] END AS compass FROM q""",
        "segments": EVENTS + f", p AS (SELECT *, sum(CASE WHEN dt > {SPEC.max_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY seq)::BIGINT AS seg FROM s) SELECT line, seg, min(seq) AS first, max(seq) AS last, count(*) AS n FROM p GROUP BY line, seg",
        "runs": EVENTS
        + """, g AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY seq) - row_number() OVER (PARTITION BY line, mag > 54250 ORDER BY seq) AS run FROM s)
SELECT line, min(seq) AS start, max(seq) AS "end", count(*) AS n FROM g WHERE mag > 54250 GROUP BY line, run""",
        "fourth_difference": LINEITEM + "SELECT line, seq, round((lag(mag, 2) OVER w - 4 * lag(mag) OVER w + 6 * mag - 4 * lead(mag) OVER w + lead(mag, 2) OVER w) / 16, 3) AS d4 FROM s WINDOW w AS (PARTITION BY line ORDER BY seq)",
        "running_median": EVENTS
        + """, a AS (SELECT line, seq, mag, count(*) OVER (PARTITION BY line) AS n FROM s),
b AS (SELECT *, CASE WHEN count(mag) OVER f = 21 THEN median(mag) OVER f END AS whole, median(mag) OVER (PARTITION BY line) AS every,
      median(CASE WHEN seq < n THEN mag END) OVER (PARTITION BY line) AS m1, median(CASE WHEN seq > 1 THEN mag END) OVER (PARTITION BY line) AS m2
      FROM a WINDOW f AS (PARTITION BY line ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
SELECT line, seq, round(CASE WHEN n < 3 THEN mag WHEN n >= 21 THEN coalesce(whole, CASE WHEN seq <= 10 THEN first_value(whole IGNORE NULLS) OVER u ELSE last_value(whole IGNORE NULLS) OVER u END)
       WHEN n % 2 = 1 THEN every WHEN seq <= n / 2 THEN m1 ELSE m2 END, 5) AS median
FROM b WINDOW u AS (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "running_max": LINEITEM + "SELECT line, seq, round(max(mag) OVER w, 5) AS most FROM s WINDOW w AS (PARTITION BY line ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)",
        "line_stats": EVENTS + "SELECT line, line_type, count(*) AS n, round(sum(step), 5) AS length, round(median(mag), 5) AS median_mag, round(quantile_cont(mag, 0.95), 5) AS p95, round(sqrt(avg(step * step)), 5) AS rms_step FROM s GROUP BY line, line_type",
        "metric_sample_interval": EVENTS + f"SELECT round(greatest(max(dt), 0), 5) AS value, {SPEC.max_gap}::DOUBLE AS threshold FROM s",
        "metric_line_deviation": EVENTS + OFFSETS + f"SELECT round(quantile_cont(abs(dev), 0.95), 5) AS value, {SPEC.max_deviation}::DOUBLE AS threshold FROM o",
        "metric_clearance": EVENTS + f"SELECT round(quantile_cont(abs(radar_alt - {SPEC.nominal_clearance}), 0.95), 5) AS value, {SPEC.clearance_tol}::DOUBLE AS threshold FROM s",
        "diurnal_correction": EVENTS
        + BASE
        + """, v AS (SELECT *, lead(t) OVER (ORDER BY t) AS t1, lead(b) OVER (ORDER BY t) AS b1 FROM b), z AS (SELECT median(b) AS datum, arg_min(b, t) AS first, arg_max(b, t) AS last FROM b)
SELECT line, seq, round(mag - (CASE WHEN v.t IS NULL THEN z.first WHEN v.t1 IS NULL THEN z.last ELSE v.b + (v.b1 - v.b) * (epoch_us(s.time) / 1e6 - v.t) / (v.t1 - v.t) END - z.datum), 5) AS mag
FROM s ASOF LEFT JOIN v ON epoch_us(s.time) / 1e6 >= v.t CROSS JOIN z""",
        "diurnal_chord": "WITH one AS (SELECT 1)" + BASE + _CHORDS + "SELECT k, round(dev, 5) AS dev, coalesce(max(coalesce(dev > 60, false)) OVER (ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS exceed FROM d",
    }


_CHORDS = """, r AS (SELECT *, list({'t': t, 'b': b}) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM b),
d AS (SELECT k, CASE WHEN len(l) = 5 THEN list_max(list_transform(l, lambda p: abs(p.b - (l[1].b + (l[5].b - l[1].b) * (p.t - l[1].t) / (l[5].t - l[1].t))))) END AS dev FROM r)
"""
