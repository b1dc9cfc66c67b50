"""The checks on single lines: each gives flags (runs.FLAG) and one metric row (label, value, threshold, note)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..spec import SurveySpec
from . import runs as R
from .lineage import cut
from .survey import axes, by_line, with_segments, with_steps


@dataclass(frozen=True)
class CheckResult:
    flags: DataFrame
    metric: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def no_flags(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], R.FLAG)


def metric(df: DataFrame, label: str, value: Column, threshold: float, note: Column | None = None) -> DataFrame:
    """One row of aggregates over df."""
    return df.agg(value.cast("double").alias("value"), (F.lit(None).cast("string") if note is None else note).alias("note")).select(F.lit(label).alias("label"), "value", F.lit(float(threshold)).alias("threshold"), "note")


def sample_interval(survey: DataFrame, spec: SurveySpec) -> CheckResult:
    """A flag for every gap of more than max_gap seconds, from the sample before to the one after."""
    df = with_steps(survey)
    ends = {c: F.lag(c).over(by_line()) for c in ("i", "fid", "time", "x", "y", "lon", "lat")}
    gaps = df.withColumns({f"p_{c}": v for c, v in ends.items()}).filter(F.col("dt") > spec.max_gap)
    middle = [((F.col(f"p_{c}") + F.col(c)) / 2).alias(c) for c in ("x", "y", "lon", "lat")]
    flags = gaps.select(
        F.lit("sample_interval").alias("check"), "line", F.col("p_i").alias("i_start"), F.col("i").alias("i_end"), F.col("p_fid").cast("double").alias("fid_start"), F.col("fid").cast("double").alias("fid_end"),
        F.col("p_time").alias("time_start"), F.col("time").alias("time_end"), *middle, F.col("dt").alias("value"), F.lit(float(spec.max_gap)).alias("threshold"), F.lit("s").alias("units"),
        F.concat(G.fixed(F.col("dt"), 1), F.lit(" s break in data stream")).alias("description"),
    )
    return CheckResult(flags, metric(df, "longest gap (s)", F.greatest(F.coalesce(F.max("dt"), F.lit(0.0)), F.lit(0.0)), spec.max_gap))


def along_line_spacing(survey: DataFrame, spec: SurveySpec) -> CheckResult:
    """Runs of steps over the limit, gaps aside; each begins with the sample before its first step."""
    df = with_steps(survey)
    before = {c: F.lag(F.struct("i", "fid", "time", "x", "y", "lon", "lat")).over(by_line()) for c in ("__before",)}
    df = df.withColumns(before)
    ok = G.finite(F.col("step")) & (F.col("dt") <= spec.max_gap)
    limit = float(spec.max_along_line_sep)
    marked = R.runs(df, ["line"], "seq", ok & (F.col("step") > limit))
    got = marked.groupBy("line", "run").agg(F.min_by("__before", "seq").alias("a"), F.max_by(F.struct("i", "fid", "time", "x", "y", "lon", "lat"), "seq").alias("b"), F.max("step").alias("value"))
    middle = [((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(c) for c in ("x", "y", "lon", "lat")]
    flags = got.select(
        F.lit("along_line_spacing").alias("check"), "line", F.col("a.i").alias("i_start"), F.col("b.i").alias("i_end"), F.col("a.fid").cast("double").alias("fid_start"), F.col("b.fid").cast("double").alias("fid_end"),
        F.col("a.time").alias("time_start"), F.col("b.time").alias("time_end"), *middle, "value", F.lit(limit).alias("threshold"), F.lit("m").alias("units"),
        F.concat(F.lit("samples up to "), G.fixed(F.col("value"), 1), F.lit(f" m apart (limit {limit:.1f} m)")).alias("description"),
    )
    return CheckResult(flags, metric(df.filter(ok), "max sample spacing (m)", F.coalesce(F.max("step"), F.lit(0.0)), limit))


def line_offsets(survey: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """survey with off, the signed distance to the planned line (plan: line, x0, y0, x1, y1; the first row of a line counts) or to the line's own
    axis, planned, and bad_plan. Lines under three samples are left out; a planned line without length counts as none."""
    fit = axes(survey).filter("n >= 3").select("line", "cx", "cy", "ux", "uy")
    if plan is not None:
        p = plan.withColumn("__place", F.monotonically_increasing_id()).groupBy("line").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "__place").alias("p"))
        fit = fit.join(p, "line", "left").withColumn("length", F.hypot(F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0")))
        good = G.finite(F.col("length")) & (F.col("length") > 0)
        pick = lambda a, b: F.when(good, a).otherwise(b)
        fit = fit.select(
            "line", good.alias("planned"), (F.col("p").isNotNull() & ~good).alias("bad_plan"), pick(F.col("p.x0"), F.col("cx")).alias("cx"), pick(F.col("p.y0"), F.col("cy")).alias("cy"),
            pick((F.col("p.x1") - F.col("p.x0")) / F.col("length"), F.col("ux")).alias("ux"), pick((F.col("p.y1") - F.col("p.y0")) / F.col("length"), F.col("uy")).alias("uy"),
        )
    else:
        fit = fit.withColumns({"planned": F.lit(False), "bad_plan": F.lit(False)})
    off = (F.col("x") - F.col("cx")) * -F.col("uy") + (F.col("y") - F.col("cy")) * F.col("ux")
    return survey.join(fit, "line").withColumn("off", off).drop("cx", "cy", "ux", "uy")


def line_deviation(survey: DataFrame, spec: SurveySpec, plan: DataFrame | None = None) -> CheckResult:
    """Runs of samples over max_deviation metres from the planned or best-fit line."""
    df = line_offsets(survey, plan)
    marked = R.runs(df, ["line", "planned"], "seq", F.abs("off") > spec.max_deviation)
    flags = R.flag_runs(
        marked, "line_deviation", ["line", "planned"], F.abs(R.extreme("off")), F.lit(spec.max_deviation), "m",
        lambda v: F.concat(G.fixed(v, 0), F.lit(" m off "), F.when(F.col("planned"), "planned").otherwise("best-fit"), F.lit(" line")),
    )
    note = F.lit("measured against a best-fit line; no flight plan supplied")
    if plan is not None:
        bad = F.array_sort(F.collect_set(F.when(F.col("bad_plan"), F.col("line"))))  # names of lines, not of samples
        note = F.when(F.size(bad) > 0, F.concat(F.lit("zero-length plan segment for "), F.array_join(bad, ", "), F.lit("; best-fit line used there")))
    return CheckResult(flags, metric(df, "95th pct departure (m)", F.percentile(F.abs("off"), 0.95), spec.max_deviation, note))


def line_separation(survey: DataFrame, spec: SurveySpec) -> CheckResult:
    """Neighbouring traverses whose distance differs from line_spacing by more than line_spacing_tol. The window is over one row a line."""
    az = np.radians(spec.line_azimuth)
    mid = survey.filter("line_type = 'traverse'").groupBy("line").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    mid = mid.withColumn("across", F.col("x") * float(np.cos(az)) - F.col("y") * float(np.sin(az)))
    order = Window.orderBy("across", "line")
    pair = mid.withColumns({f"p_{c}": F.lag(c).over(order) for c in ("line", "across", "x", "y", "lon", "lat")}).filter("p_line IS NOT NULL")
    pair = pair.withColumn("value", F.col("across") - F.col("p_across")).withColumn("error", (F.col("value") - spec.line_spacing) / spec.line_spacing * 100)
    none, no_time = F.lit(None).cast("double"), F.lit(None).cast("timestamp")
    flags = pair.filter(F.abs("error") > spec.line_spacing_tol * 100).select(
        F.lit("line_separation").alias("check"), F.concat("p_line", F.lit(" / "), "line").alias("line"), none.cast("long").alias("i_start"), none.cast("long").alias("i_end"), none.alias("fid_start"), none.alias("fid_end"),
        no_time.alias("time_start"), no_time.alias("time_end"), *(((F.col(f"p_{c}") + F.col(c)) / 2).alias(c) for c in ("x", "y", "lon", "lat")), "value", F.lit(float(spec.line_spacing)).alias("threshold"), F.lit("m").alias("units"),
        F.concat("p_line", F.lit(" to "), "line", F.lit(": "), G.fixed(F.col("value"), 0), F.lit(f" m apart (nominal {G.general(spec.line_spacing)} m, "), G.signed(F.col("error"), 0), F.lit("%)")).alias("description"),
    )
    return CheckResult(flags, metric(pair, "max separation error (%)", F.max(F.abs("error")), spec.line_spacing_tol * 100, F.when(F.count("*") == 0, F.lit("fewer than two traverses"))))


def clearance(survey: DataFrame, spec: SurveySpec) -> CheckResult:
    """Runs of samples whose radar altitude is off nominal_clearance by more than clearance_tol; the value keeps its sign."""
    df = survey.withColumn("off", F.col("radar_alt") - spec.nominal_clearance)
    marked = R.runs(df, ["line"], "seq", F.abs("off") > spec.clearance_tol)
    side = lambda v: F.concat(G.fixed(F.abs(v), 0), F.when(v > 0, " m above").otherwise(" m below"), F.lit(" nominal clearance"))
    flags = R.flag_runs(marked, "clearance", ["line"], R.extreme("off"), F.lit(spec.clearance_tol), "m", side)
    return CheckResult(flags, metric(df, "95th pct |clearance error| (m)", F.percentile(F.abs("off"), 0.95), spec.clearance_tol, F.when(F.count("off") == 0, F.lit("no radar altitude"))))


def _of_segment(mag: np.ndarray, k: int, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, amplitudes and z of the spikes among the readings of one segment (NaN: missing)."""
    n, known = len(mag), np.isfinite(mag)
    if known.sum() < 7:
        return np.zeros(0, int), np.zeros(0), np.zeros(0)
    y = np.interp(np.arange(n), np.flatnonzero(known), mag[known])
    e = np.concatenate([[3 * y[0] - 2 * y[1], 2 * y[0] - y[1]], y, [2 * y[-1] - y[-2], 3 * y[-1] - 2 * y[-2]]])
    # term by term as runs.fourth_difference: sums in another order differ in their last bits, which decide between equal candidates and at decimal halves
    d4 = e[:-4] - 4 * e[1:-3] + 6 * e[2:-2] - 4 * e[3:-1] + e[4:]
    size = np.abs(d4)
    width = min(k, n - 1 + n % 2)
    medians = np.median(np.lib.stride_tricks.sliding_window_view(size, width), axis=-1)
    medians = np.pad(medians, (width // 2, n - len(medians) - width // 2), mode="edge")
    highest = np.lib.stride_tricks.sliding_window_view(np.pad(medians, k // 2, constant_values=0), 2 * (k // 2) + 1).max(axis=-1)
    floor = 0.5 * np.median(size)
    z = d4 / np.maximum(1.4826 * highest, 1.4826 * floor if floor > 0 else np.finfo(float).eps)
    hit = np.flatnonzero(known & (np.abs(z) > sigmas))
    if not len(hit):
        return hit, np.zeros(0), np.zeros(0)
    # the largest of each run of neighbours, the first on ties
    run = np.cumsum(np.diff(hit, prepend=hit[0]) > 1)
    order = np.lexsort((hit, -size[hit], run))
    at = hit[order[np.unique(run[order], return_index=True)[1]]]
    inner = np.where(at < 2, 1, np.where(at >= n - 2, -1, 0))
    ends = y[at] - (2 * y[np.clip(at + inner, 0, n - 1)] - y[np.clip(at + 2 * inner, 0, n - 1)])
    return at, np.where(inner == 0, d4[at] / 6, ends), z[at]


def _spike_rows(survey: DataFrame, k: int, sigmas: float) -> DataFrame:
    """(__line, __seq, amplitude, z) of every spike. A line goes to one task with its field only, and only its spikes come back."""

    def of_line(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        seq, mag = rows["seq"].to_numpy(), rows["mag"].to_numpy(float)
        parts = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows["seg"].to_numpy())) + 1)
        found = [(seq[p[at]], amplitude, z) for p in parts for at, amplitude, z in [_of_segment(mag[p], k, sigmas)] if len(at)]
        at, amplitude, z = map(np.concatenate, zip(*found)) if found else np.zeros((3, 0))
        line = np.full(len(at), None if rows["line"].isna().iloc[0] else rows["line"].iloc[0], object)
        return pd.DataFrame({"__line": pd.Series(line, dtype=object), "__seq": at.astype(int), "amplitude": amplitude, "z": z})

    return survey.select("line", "seg", "seq", "mag").groupBy("line").applyInPandas(of_line, "__line string, __seq long, amplitude double, z double")


def despike(survey: DataFrame, spec: SurveySpec) -> DataFrame:
    """survey with seg, pos, amplitude, z (null but at spikes) and cleaned.

    The fourth difference of a spike stands out against the running scale of its neighbours; of a run of candidates the largest is the spike. Ends are
    extended along their last two samples; missing samples are filled linearly and never are spikes. Segments of a line are taken one by one, as arrays.
    """
    df = with_segments(survey, spec.max_gap)
    found = cut(_spike_rows(df, spec.spike_window, spec.spike_nsigma))  # its shuffles go before those of the survey come
    df = df.join(found, df["line"].eqNullSafe(found["__line"]) & (df["seq"] == found["__seq"]), "left").drop("__line", "__seq")
    return df.withColumn("cleaned", F.col("mag") - F.coalesce("amplitude", F.lit(0.0)))


def spikes(survey: DataFrame, spec: SurveySpec, despiked: DataFrame | None = None) -> CheckResult:
    """A flag a spike; its threshold is the amplitude that would just have passed. despiked is despike() of survey, if that is at hand."""
    df = (despike(survey, spec) if despiked is None else despiked).filter("z IS NOT NULL").withColumn("run", F.col("seq"))
    size = F.first(F.abs("amplitude"))
    flags = R.flag_runs(df.withColumn("zs", F.abs("z")), "spikes", ["line", "zs"], size, F.first(spec.spike_nsigma * F.abs(F.col("amplitude") / F.col("z"))), "nT", lambda v: F.concat(G.fixed(v, 1), F.lit(" nT spike ("), G.fixed(F.col("zs"), 0), F.lit(" sigma)")))
    return CheckResult(flags, metric(df, "spike count", F.count("*"), 0))


def noise_series(survey: DataFrame, spec: SurveySpec, despiked: DataFrame | None = None) -> DataFrame:
    """despike() with d4, the fourth difference of the cleaned field within segments."""
    df = despike(survey, spec) if despiked is None else despiked
    segment = Window.partitionBy("line", "seg")
    return df.withColumn("d4", R.fourth_difference(F.col("cleaned"), segment.orderBy("seq"), F.count("*").over(segment), spec.fourth_diff_normalize))


def fourth_difference_noise(survey: DataFrame, spec: SurveySpec, despiked: DataFrame | None = None) -> CheckResult:
    df = noise_series(survey, spec, despiked)
    marked = R.runs(df, ["line", "seg"], "seq", F.abs("d4") > spec.fourth_diff_tol)
    flags = R.flag_runs(marked, "fourth_difference", ["line", "seg"], F.abs(R.extreme("d4")), F.lit(spec.fourth_diff_tol), "nT", lambda v: F.concat(F.lit("fourth difference "), G.fixed(v, 3), F.lit(f" nT (limit {G.general(spec.fourth_diff_tol)} nT)")))
    return CheckResult(flags, metric(df, "max |4th difference| (nT)", F.coalesce(F.max(F.abs("d4")), F.lit(0.0)), spec.fourth_diff_tol), {"series": df.select("line", "seq", "i", "time", "d4")})


def base_intervals(base: DataFrame) -> DataFrame:
    """(t0, b0, t1, b1) between neighbouring readings of a base station (time, mag_base), doubled times averaged; the last has no t1."""
    b = base.filter(F.col("time").isNotNull() & G.finite(F.col("mag_base"))).groupBy(G.seconds(F.col("time")).alias("t0")).agg(F.avg("mag_base").alias("b0"))
    order = Window.orderBy("t0")  # one station's readings: at most 86,400 a day
    return b.withColumns({"t1": F.lead("t0").over(order), "b1": F.lead("b0").over(order)})


def diurnal_correction(survey: DataFrame, base: DataFrame) -> DataFrame:
    """mag = mag_raw less the base field's departure from its median, linear between readings and level before and after them.

    Hours bound the search: a reading serves the hours that its interval touches, and samples meet readings of their hour. Samples outside
    all readings take the first or the last.
    """
    b = base_intervals(base)
    ends = b.agg(F.min_by("b0", "t0").alias("first"), F.max_by("b0", "t0").alias("last"), F.min("t0").alias("from"), F.max("t0").alias("to"))
    datum = base.filter(G.finite(F.col("mag_base"))).agg(F.median("mag_base").alias("datum"))
    hour = lambda c: F.floor(c / 3600)
    b = b.filter("t1 IS NOT NULL").select("t0", "b0", "t1", "b1", F.explode(F.sequence(hour(F.col("t0")), hour(F.col("t1")))).alias("h"))
    rows = survey.select(F.struct(*survey.columns).alias("row"), G.seconds(F.col("time")).alias("t")).withColumn("hour", hour(F.col("t")))
    rows = rows.join(b, (F.col("hour") == F.col("h")) & (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")), "left")
    rows = rows.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(datum))  # one row each
    field = F.when(F.col("t") < F.col("from"), F.col("first")).when(F.col("t") >= F.col("to"), F.col("last")).otherwise(F.col("b0") + (F.col("b1") - F.col("b0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    mag = F.col("row.mag_raw") - (field - F.col("datum"))
    return rows.select(*(mag.alias(c) if c == "mag" else F.col(f"row.`{c}`").alias(c) for c in survey.columns))


def diurnal_chords(base: DataFrame, spec: SurveySpec) -> DataFrame:
    """(k, time, t, mag_base, dev, exceed): departure of each reading's next window from its chord, and whether a window over the limit covers it."""
    order = Window.orderBy("t", "mag_base")  # one station's readings
    b = base.filter(F.col("time").isNotNull()).select("time", G.seconds(F.col("time")).alias("t"), G.or_null(F.col("mag_base")).alias("mag_base"))
    b = b.withColumn("k", F.row_number().over(order)).withColumn("gap", F.col("t") - F.lag("t").over(order))
    rate, n = b.agg(F.median("gap"), F.count("*")).first()
    empty = b.select("k", "time", "t", "mag_base", F.lit(None).cast("double").alias("dev"), F.lit(False).alias("exceed"))
    if n < 3 or not rate or rate <= 0:
        return empty
    w = max(2, int(np.rint(spec.diurnal_window / rate)))
    if n <= w:
        return empty
    rows = F.collect_list(F.struct("t", F.coalesce("mag_base", F.lit(float("nan"))).alias("b"))).over(order.rowsBetween(0, w))
    a, z = F.col("rows")[0], F.col("rows")[w]
    chord = lambda p: F.abs(p["b"] - (a["b"] + (z["b"] - a["b"]) * (p["t"] - a["t"]) / (z["t"] - a["t"])))
    sound = (F.size("rows") == w + 1) & ~F.isnan(a["b"]) & ~F.isnan(z["b"]) & (z["t"] > a["t"])
    dev = F.array_max(F.filter(F.transform("rows", chord), lambda d: ~F.isnan(d)))
    b = b.withColumn("rows", rows).withColumn("dev", F.when(F.size("rows") == w + 1, F.when(sound, dev))).drop("rows")
    over = F.max(F.coalesce(F.col("dev") > spec.max_diurnal_dev, F.lit(False))).over(order.rowsBetween(-w, 0))
    return b.withColumn("exceed", over).select("k", "time", "t", "mag_base", "dev", "exceed")


def diurnal(survey: DataFrame, spec: SurveySpec, base: DataFrame) -> CheckResult:
    """Flags of survey samples in windows of disturbed base field; a window without samples gives one flag without a line."""
    stats = diurnal_chords(base, spec)
    marked = R.runs(stats.withColumn("one", F.lit(1)), ["one"], "k", F.col("exceed"))
    windows = marked.groupBy("run").agg(F.min("time").alias("ws"), F.max("time").alias("we"), F.max("dev").alias("peak"))
    hour = lambda c: F.floor(G.seconds(c) / 3600)
    by_hour = windows.withColumn("__hour", F.explode(F.sequence(hour(F.col("ws")), hour(F.col("we")))))  # samples meet windows by the hours that these touch
    hit = survey.withColumn("__hour", hour(F.col("time"))).join(by_hour, "__hour").filter((F.col("time") >= F.col("ws")) & (F.col("time") <= F.col("we"))).drop("__hour")
    hit = hit.withColumn("window", F.col("run")).drop("run")
    inside = R.runs(hit, ["line", "window"], "seq", F.lit(True))
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    told = lambda v, ws, we: F.concat(F.lit("acquired during diurnal excursion of "), G.fixed(v, 1), F.lit(f" nT over {G.general(spec.diurnal_window)} s ("), clock(ws), F.lit(" to "), clock(we), F.lit(" UTC)"))
    flags = R.flag_runs(inside, "diurnal", ["line", "window", "ws", "we"], F.max("peak"), F.lit(spec.max_diurnal_dev), "nT", lambda v: told(v, F.col("ws"), F.col("we")))
    idle = windows.join(hit.select(F.col("window").alias("run")).distinct(), "run", "left_anti")
    none = F.lit(None).cast("double")
    lone = idle.select(
        F.lit("diurnal").alias("check"), none.cast("string").alias("line"), none.cast("long").alias("i_start"), none.cast("long").alias("i_end"), none.alias("fid_start"), none.alias("fid_end"), F.col("ws").alias("time_start"), F.col("we").alias("time_end"),
        *(none.alias(c) for c in ("x", "y", "lon", "lat")), F.col("peak").alias("value"), F.lit(float(spec.max_diurnal_dev)).alias("threshold"), F.lit("nT").alias("units"), F.concat(F.lit("no samples "), told(F.col("peak"), F.col("ws"), F.col("we"))).alias("description"),
    )
    return CheckResult(flags.unionByName(lone), metric(stats, "max chord departure (nT)", F.max("dev"), spec.max_diurnal_dev, F.when(F.count("dev") == 0, F.lit("base record too short"))), {"base_stats": stats})
