import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxline.functions import geo as G
from fluxline.operators import checks as K
from fluxline.operators import crossovers as X
from fluxline.operators import runs as R
from fluxline.operators.survey import as_survey
from fluxline.plans import qc
from fluxline.spec import SurveySpec

import spike_oracle as O

T0 = dt.datetime(2024, 6, 14, 8)
SCHEMA = "line string, time timestamp, fid long, x double, y double, mag_raw double, radar_alt double"


def at(k, rate=10):
    return T0 + dt.timedelta(seconds=k / rate)


def flown(spark, **changes):
    """Six traverses of 100 samples, 6 m apart, and two ties across them, without defects; changes: (line, sample) -> values."""
    rows = []
    for i in range(6):
        for k in range(100):
            rows.append([f"L{i}", at(2000 * i + k), k, 200.0 * i, 6.0 * k, 50000 + 0.01 * 200 * i - 0.02 * 6 * k, 60.0])
    for j in range(2):
        for k in range(180):
            rows.append([f"T{j}", at(20000 + 2000 * j + k), k, 6.0 * k, 150.0 + 300 * j, 50000 + 0.01 * 6 * k - 0.02 * (150 + 300 * j), 60.0])
    for r in rows:
        for name, f in changes.items():
            f(r)
    return as_survey(spark.createDataFrame(rows, SCHEMA), (-100.0, 40.0))


def test_spec():
    assert SurveySpec(ground_speed=70, sample_rate=20).max_along_line_sep == 5.25
    assert SurveySpec(line_azimuth=370).line_azimuth == 10
    for bad in ({"spike_window": 20}, {"line_spacing": -1}, {"max_gap": float("nan")}):
        with pytest.raises(ValueError):
            SurveySpec(**bad)


def test_survey_is_ordered_and_checked(spark):
    s = as_survey(spark.createDataFrame([("T9", at(1), 1.0, 1.0, float("nan")), ("L10", at(2), 1.0, 1.0, 2.0), ("L10", at(1), 1.0, 1.0, 1.0)], "line string, time timestamp, x double, y double, mag_raw double"))
    assert [(r.line, r.line_type, r.i, r.mag, r.lon) for r in s.orderBy("i").collect()] == [("L10", "traverse", 1, 1.0, None), ("L10", "traverse", 2, 2.0, None), ("T9", "tie", 3, None, None)]
    with pytest.raises(ValueError):
        as_survey(spark.range(1).select(F.lit("a").alias("line")))
    with pytest.raises(ValueError):
        as_survey(spark.range(1).select(F.lit("a").alias("line"), F.lit(1).alias("time"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("mag")))


def test_enu_round_trip(spark):
    df = spark.createDataFrame([(0.0, 0.0), (12000.0, -9000.0), (-500.0, 7000.0)], "x double, y double")
    lon, lat = G.enu_to_lonlat(F.col("x"), F.col("y"), -108.5, 43.2)
    x, y = G.lonlat_to_enu(F.col("lon"), F.col("lat"), F.lit(-108.5), F.lit(43.2))
    for r in df.select("*", lon.alias("lon"), lat.alias("lat")).select("x", "y", x.alias("x2"), y.alias("y2")).collect():
        assert r.x2 == pytest.approx(r.x, abs=1e-4) and r.y2 == pytest.approx(r.y, abs=1e-4)


def test_runs_take_null_for_false(spark):
    rows = [("a", k, v) for k, v in enumerate([False, True, True, False, None, True], 1)]
    got = R.intervals(R.runs(spark.createDataFrame(rows, "line string, seq long, v boolean"), ["line"], "seq", F.col("v")), ["line"])
    assert sorted((r.start, r.end) for r in got.collect()) == [(2, 3), (6, 6)]


def test_running_median_matches_numpy(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 20, 21, 22, 60):
        v = rng.normal(size=n)
        df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(v)], "line string, seq long, v double")
        got = [r.m for r in R.running_median(df, ["line"], "seq", "v", 21, "m").orderBy("seq").collect()]
        assert np.allclose(got, O.running_median(v, 21))


@pytest.mark.parametrize("seed", range(10))
def test_spike_sensitivity(seed):
    rng = np.random.default_rng(seed)
    v = 200 * np.sin(np.linspace(0, 6, 400)) + rng.normal(0, 0.02, 400)
    assert np.isnan(O.spikes_of(v, 21, 6)[0]).all()
    v[199] += 25 * 0.02 * 1.5
    amplitude, _, cleaned = O.spikes_of(v, 21, 6)
    assert np.flatnonzero(~np.isnan(amplitude)).tolist() == [199] and abs(cleaned[199] - v[198]) < 3.5


def test_clean_survey_has_no_flags(spark):
    s, spec = flown(spark), SurveySpec()
    for f in (K.sample_interval, K.along_line_spacing, K.line_deviation, K.line_separation, K.clearance, K.spikes, K.fourth_difference_noise):
        assert f(s, spec).flags.count() == 0, f.__name__


def test_defects_are_found_on_their_lines(spark):
    def gap(r):
        if r[0] == "L1" and r[2] >= 50:
            r[1] += dt.timedelta(seconds=3)

    def low(r):
        if r[0] == "L2" and 20 <= r[2] < 30:
            r[6] = 30.0

    def off(r):
        if r[0] == "L3" and 40 <= r[2] < 45:
            r[3] += 60

    def spike(r):
        if r[0] == "L4" and r[2] == 33:
            r[5] += 10

    s, spec = flown(spark, a=gap, b=low, c=off, d=spike), SurveySpec()
    one = lambda f: [(r.line, round(r.value, 1)) for r in f(s, spec).flags.collect()]
    assert one(K.sample_interval) == [("L1", 3.1)]
    assert one(K.clearance) == [("L2", -30.0)]
    assert [x for x, _ in one(K.line_deviation)] == ["L3"]
    assert one(K.spikes) == [("L4", 10.0)]


def test_crossings_and_levelling(spark):
    def bias(r):
        if r[0] == "L2":
            r[5] += 5

    s = flown(spark, a=bias)
    x = X.crossovers(s)
    assert {(r.traverse, r.tie): round(r.misfit, 3) + 0.0 for r in x.collect()} == {(f"L{i}", f"T{j}"): 5.0 if i == 2 else 0.0 for i in range(6) for j in range(2)}
    _, coefficients, after = X.level_ties(s, x, "linear")
    assert {r.line: (r.order, round(r.c0, 3) + 0.0) for r in coefficients.collect()} == {f"L{i}": ("constant", 5.0 if i == 2 else 0.0) for i in range(6)}
    assert after.agg(F.max(F.abs("misfit_after"))).first()[0] < 1e-6
    assert X.crossover_misfit(s, SurveySpec(max_crossover_abs=4), x).flags.count() == 2


def test_base_station(spark):
    base = spark.createDataFrame([(at(10 * k), 50000.0 + (20.0 if k == 300 else 0.0)) for k in range(2500)], "time timestamp, mag_base double")
    s, spec = flown(spark), SurveySpec()
    assert K.diurnal_correction(s, base).count() == s.count()
    chords = K.diurnal_chords(base, spec)
    assert chords.filter("exceed").agg(F.min("k"), F.max("k")).first()[:] == (241, 361)
    flags = K.diurnal(s, spec, base).flags.collect()
    assert flags and all(round(f.value, 3) <= 20 for f in flags)


def test_spikes_by_windows_equal_arrays(spark):
    rng, rows = np.random.default_rng(8), []
    for line, n in (("A", 6), ("B", 12), ("C", 20), ("D", 22), ("E", 150), ("F", 151)):
        v = 100 * np.sin(np.linspace(0, 4, n)) + rng.normal(0, 0.02, n)
        for k in rng.choice(n, max(1, n // 30), replace=False):
            v[k] += 8
        v[rng.choice(n, n // 20, replace=False)] = np.nan
        rows += [(line, at(k), k, 0.0, 6.0 * k, float(x), 60.0) for k, x in enumerate(v)]
    found = K.despike(as_survey(spark.createDataFrame(rows, SCHEMA)), SurveySpec()).orderBy("line", "seq").toPandas()
    for line, part in found.groupby("line"):
        amplitude, z, cleaned = O.spikes_of(part["mag"].to_numpy(float), 21, 6)
        for name, want in (("amplitude", amplitude), ("z", z), ("cleaned", cleaned)):
            assert np.allclose(part[name].to_numpy(float), want, equal_nan=True), (line, name)


def test_acceptance_run(spark):
    base = spark.createDataFrame([(at(600 * k), 50000.0) for k in range(60)], "time timestamp, mag_base double")
    spec = SurveySpec(tie_spacing=300, diurnal_window=120)
    run = qc.run_qc(flown(spark), spec, base)
    card = {r.check: r for r in run.scorecard.collect()}
    assert [c for c, _ in qc.CHECKS] == [r.check for r in run.scorecard.orderBy("place").collect()] and {r.status for r in card.values()} <= {"pass", "n/a"}
    stats = run.stats.first()
    assert (stats.n_lines, stats.n_traverse, stats.n_tie, stats.n_crossovers, stats.n_flags, stats.accepted_pct, stats.diurnal_corrected, stats.has_lonlat) == (8, 6, 2, 12, 0, 100.0, True, True)
    assert stats.line_km == pytest.approx(stats.traverse_km + stats.tie_km) and len(run.stats.columns) == 19
    assert {r.status for r in run.lines.collect()} == {"pass"} and run.flags.count() == 0
    without = qc.run_qc(flown(spark, a=lambda r: r.__setitem__(6, 200.0) if r[0] == "L2" and r[2] == 7 else None), spec)
    table = [tuple(r) for r in qc.flag_table(without.flags).collect()]
    assert table == [("Terrain clearance", "L2", "08:06:40", "08:06:40", "7", 140.0, 15.0, "m", "140 m above nominal clearance")]
    card = {r.check: r for r in without.scorecard.collect()}
    assert card["diurnal"].status == "n/a" and card["diurnal"].note == "no base-station record supplied" and card["diurnal"].threshold == 3 and card["clearance"].status == "fail"
    assert {r.line: r.status for r in without.lines.collect()}["L2"] == "fail"


def test_planned_lines(spark):
    plan = spark.createDataFrame([("L0", -40.0, 0.0, -40.0, 600.0), ("L1", 200.0, 0.0, 200.0, 0.0), ("L2", 400.0, 0.0, 400.0, 600.0)], "line string, x0 double, y0 double, x1 double, y1 double")
    got = K.line_deviation(flown(spark), SurveySpec(), plan)
    flag = got.flags.first()
    assert (flag.line, flag.value, flag.description) == ("L0", 40.0, "40 m off planned line") and got.flags.count() == 1
    assert got.metric.first().note == "zero-length plan segment for L1; best-fit line used there"
