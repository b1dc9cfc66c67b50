"""Lines of a flight: straight runs are told from turns, rejoined where a gap or a wobble parted one line, and named by place or by a flight plan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .lineage import cut

#: Runs are rejoined within so many degrees of heading and metres across the earlier one's axis.
SAME_HEADING, SAME_AXIS = 10.0, 50.0
#: Tiles across the extent in which points meet planned lines.
TILES = 256


@dataclass(frozen=True)
class Assigned:
    """samples: the rows with line, line_type and dir; segments: flight, line, line_type, n, length_m and heading of each; n_turns: samples outside lines."""

    samples: DataFrame
    segments: DataFrame
    n_turns: int


def straight_runs(df: DataFrame, window: float = 3.0, max_turn_rate: float = 1.0, max_gap: float = 10.0) -> DataFrame:
    """Rows of df (flight, time, x, y) with seq, hdg, step (null where a run starts) and run, null in turns.

    Places are smoothed over an odd number k of rows, window seconds at the flight's median interval, fewer at its ends and none if it has fewer than k rows;
    the heading to the next row is turned into a rate, smoothed likewise. k differs by flight: a frame of k rows is a range of row numbers over k / 2.
    """
    by = Window.partitionBy("flight")
    t = G.seconds(F.col("time"))
    df = df.withColumn("seq", F.row_number().over(by.orderBy("time", "x", "y")).cast("long"))
    w = by.orderBy("seq")
    df = df.withColumns({"dt": t - F.lag(t).over(w), "__n": F.count("*").over(by)})
    k = F.greatest(F.lit(3), F.rint(window / F.when(F.median("dt").over(by) > 0, F.median("dt").over(by))).cast("int"))
    df = df.withColumn("__k", k + (k % 2 == 0).cast("int"))
    df = df.withColumn("__q", F.col("seq") / (F.floor(F.col("__k") / 2) + 0.5))
    around = by.orderBy("__q").rangeBetween(-1, 1)
    smooth = lambda c: F.when(F.col("__n") < F.col("__k"), F.col(c)).when(F.count(c).over(around) == F.count("*").over(around), F.avg(c).over(around))
    df = df.withColumns({"__sx": smooth("x"), "__sy": smooth("y")})
    df = df.withColumn("hdg", F.when(F.col("seq") < F.col("__n"), G.bearing(F.lead("__sx").over(w) - F.col("__sx"), F.lead("__sy").over(w) - F.col("__sy"))))
    df = df.withColumn("hdg", F.when(F.col("seq") < F.col("__n"), F.col("hdg")).otherwise(F.lag("hdg").over(w)))
    ahead = F.lead("dt").over(w)
    df = df.withColumn("__rate", F.when(F.col("seq") == F.col("__n"), F.lit(0.0)).when(ahead > 0, G.angle_between(F.lead("hdg").over(w), F.col("hdg")) / ahead))
    df = df.withColumn("__straight", F.coalesce(G.finite(smooth("__rate")) & (smooth("__rate") < max_turn_rate), F.lit(False)))
    start = F.col("__straight") & (~F.coalesce(F.lag("__straight").over(w), F.lit(False)) | F.coalesce(F.col("dt") > max_gap, F.lit(False)))
    df = df.withColumn("__start", start)
    run = F.when(F.col("__straight"), F.sum(F.col("__start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.when(F.col("__straight") & ~F.col("__start"), F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return df.withColumns({"run": run, "step": step}).drop("dt", "__n", "__k", "__q", "__sx", "__sy", "__rate", "__straight", "__start")


def _heading(east: Column, north: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def run_table(rows: DataFrame) -> DataFrame:
    """(flight, run, n, length, east, north, spread, sx, sy): sums over the samples of each run; east and north are those of its headings' directions,
    spread the largest departure from their mean."""
    own = Window.partitionBy("flight", "run")
    rows = rows.filter("run IS NOT NULL").withColumns({"e": F.sin(F.radians("hdg")), "m": F.cos(F.radians("hdg"))})
    rows = rows.withColumn("off", G.angle_between(F.col("hdg"), _heading(F.sum("e").over(own), F.sum("m").over(own))))
    sums = {"length": F.coalesce(F.sum("step"), F.lit(0.0)), "east": F.sum("e"), "north": F.sum("m"), "spread": F.max("off"), "sx": F.sum("x"), "sy": F.sum("y")}
    return rows.groupBy("flight", "run").agg(F.count("*").alias("n"), *(v.alias(c) for c, v in sums.items()))


def _rejoin(runs: pd.DataFrame) -> pd.DataFrame:
    """segment of each run of one flight: the first run of the line that it continues."""
    out, now = [], None
    for r in runs.sort_values("run").itertuples(index=False):
        if now is not None:
            heading = np.arctan2(now["east"], now["north"])
            turn = abs((np.degrees(np.arctan2(r.east, r.north) - heading) + 180) % 360 - 180)
            dx, dy = r.sx / r.n - now["sx"] / now["n"], r.sy / r.n - now["sy"] / now["n"]
            if turn <= SAME_HEADING and abs(dx * np.cos(heading) - dy * np.sin(heading)) <= SAME_AXIS:
                now.update({c: now[c] + getattr(r, c) for c in ("n", "east", "north", "sx", "sy")})
                out.append((r.flight, r.run, now["segment"]))
                continue
        now = {c: getattr(r, c) for c in ("n", "east", "north", "sx", "sy")} | {"segment": r.run}
        out.append((r.flight, r.run, r.run))
    return pd.DataFrame(out, columns=["flight", "run", "segment"])


def rejoined(runs: DataFrame) -> DataFrame:
    """runs with segment. Each flight's runs, a row each, are folded in order: a run continues the line before it if its heading is the same and its middle
    lies on that line's axis, which then is that of both."""
    flight = runs.schema["flight"].dataType.simpleString()
    members = runs.groupBy("flight").applyInPandas(_rejoin, f"flight {flight}, run long, segment long")
    return runs.join(members, ["flight", "run"])


def nearest_lines(points: DataFrame, keys: list[str], lines: DataFrame, tolerance: float) -> DataFrame:
    """(keys, to_line, to_type, distance) of the nearest of lines (line, line_type, x0, y0, x1, y1), taken as endless, within tolerance of points (cx, cy).

    Each line is laid over the tiles that it passes within tolerance in the points' extent; points meet the lines of their tile. Lines without length are
    never near; of equally near ones the first by name counts.
    """
    low_high = [f(c).alias(f"{name}_{c}") for c in ("cx", "cy") for name, f in (("a", F.min), ("b", F.max))]
    e = points.agg(*low_high).first()
    if e.a_cx is None:
        return points.select(*keys, F.lit(None).cast("string").alias("to_line"), F.lit(None).cast("string").alias("to_type"), F.lit(None).cast("double").alias("distance"))
    size = max(float(tolerance), (e.b_cx - e.a_cx) / TILES, (e.b_cy - e.a_cy) / TILES, 1e-9)
    tile = lambda c, low: F.floor((c - low) / size)
    pad, flat = 1.5 * tolerance, F.abs(F.col("x1") - F.col("x0")) >= F.abs(F.col("y1") - F.col("y0"))

    def laid(u: str, v: str) -> DataFrame:
        """Lines that run more along u, a row a tile; slope at most one, so that pad across covers tolerance to the line."""
        la, lb, lc = (e[f"a_c{u}"], e[f"b_c{u}"], e[f"a_c{v}"])
        slope = (F.col(f"{v}1") - F.col(f"{v}0")) / (F.col(f"{u}1") - F.col(f"{u}0"))
        at = lambda q: F.col(f"{v}0") + slope * (q - F.col(f"{u}0"))
        edge = F.lit(la) + F.col(f"t{u}") * size
        rows = lines.filter((flat if u == "x" else ~flat) & (F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > 0)).withColumn(f"t{u}", F.explode(F.sequence(F.lit(0), F.floor((F.lit(lb) - la) / size).cast("long"))))
        first, last = tile(F.least(at(edge), at(edge + size)) - pad, lc), tile(F.greatest(at(edge), at(edge + size)) + pad, lc)
        most = int((e[f"b_c{v}"] - lc) // size)
        rows = rows.withColumns({"__a": F.greatest(first, F.lit(0)), "__b": F.least(last, F.lit(most))}).filter("__a <= __b")
        return rows.withColumn(f"t{v}", F.explode(F.sequence("__a", "__b"))).select("line", "line_type", "x0", "y0", "x1", "y1", "tx", "ty")

    met = points.select(*keys, "cx", "cy", tile(F.col("cx"), e.a_cx).alias("tx"), tile(F.col("cy"), e.a_cy).alias("ty")).join(laid("x", "y").unionByName(laid("y", "x")), ["tx", "ty"])
    met = met.withColumn("distance", G.point_line_distance(*(F.col(c) for c in ("cx", "cy", "x0", "y0", "x1", "y1")))).filter(F.col("distance") <= tolerance)
    near = met.groupBy(*keys).agg(F.min(F.struct("distance", "line", "line_type")).alias("m"))
    return near.select(*keys, F.col("m.line").alias("to_line"), F.col("m.line_type").alias("to_type"), F.col("m.distance").alias("distance"))


def assign_lines(
    df: DataFrame, flight: str | None = None, azimuth: float | None = None, window: float = 3.0, max_turn_rate: float = 1.0, min_length: float = 500.0, max_gap: float = 10.0, max_spread: float = 30.0, max_off_axis: float = 15.0,
    plan: DataFrame | None = None, tolerance: float = 50.0, drop_turns: bool = True,
) -> Assigned:
    """Tells the lines of samples (time, x, y) of one flight, or of each value of the column flight, from their turns.

    Straight runs with headings within max_spread of their mean are rejoined, those under min_length metres are dropped. Lines within max_off_axis degrees of
    the axis (azimuth, or the heading of the longest) are traverses, numbered L1000, L1010, ... across it from west to east or south to north; those across
    it are ties, T9000, T9010, ... along it; others are transits and belong to no line. A planned line (line, x0, y0, x1, y1, optionally line_type) within
    tolerance of a line's middle gives it its name. Columns line, line_type and dir of df are replaced.
    """
    for c in ("time", "x", "y"):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    kept = [c for c in df.columns if c not in ("line", "line_type", "dir")]
    rows = df.select(F.struct(*kept).alias("row"), (F.col(flight) if flight else F.lit("")).alias("flight"), "time", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if rows.limit(10).count() < 10:
        raise ValueError("too few samples to segment")
    rows = straight_runs(rows, window, max_turn_rate, max_gap)
    runs = cut(rejoined(run_table(rows).filter(F.col("spread") <= max_spread)))
    sums = ["n", "length", "east", "north", "sx", "sy"]
    found = runs.groupBy("flight", "segment").agg(*(F.sum(c).alias(c) for c in sums)).filter(F.col("length") >= min_length)
    found = cut(found.select("flight", "segment", "n", F.col("length").alias("length_m"), _heading(F.col("east"), F.col("north")).alias("heading"), (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy")))
    longest = found.orderBy(F.desc("length_m"), "flight", "segment").first()
    if longest is None:
        raise ValueError(f"no straight run of at least {min_length:g} m found: see max_turn_rate and min_length")
    axis = (longest.heading if azimuth is None else azimuth) % 180
    off = F.abs(F.pmod(F.col("heading") - axis + 90, F.lit(180.0)) - 90)
    kind = F.when(off <= max_off_axis, "traverse").when(off >= 90 - max_off_axis, "tie")
    found = found.withColumn("line_type", kind).filter("line_type IS NOT NULL")
    if found.isEmpty():
        raise ValueError("no run lies along or across the traverse axis: pass azimuth")
    a = np.radians(axis)
    along, across = ([c if v[int(np.argmax(np.abs(v)))] >= 0 else -c for c in v] for v in ((float(np.sin(a)), float(np.cos(a))), (float(np.cos(a)), -float(np.sin(a)))))
    place = lambda v: F.col("cx") * v[0] + F.col("cy") * v[1]
    traverse = F.col("line_type") == "traverse"
    found = found.withColumn("place", F.when(traverse, place(across)).otherwise(place(along)))
    number = 10 * (F.row_number().over(Window.partitionBy("line_type").orderBy("place", "flight", "segment")) - 1)  # a row a line
    found = found.withColumn("line", F.concat(F.when(traverse, "L").otherwise("T"), (F.when(traverse, 1000).otherwise(9000) + number).cast("string")))
    if plan is not None:
        lines = plan.select(F.col("line").cast("string").alias("line"), (F.col("line_type") if "line_type" in plan.columns else F.lit(None).cast("string")).alias("line_type"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
        found = found.join(nearest_lines(found, ["flight", "segment"], lines, tolerance), ["flight", "segment"], "left")
        found = found.withColumns({"line": F.coalesce("to_line", "line"), "line_type": F.coalesce("to_type", "line_type")})
    found = cut(found)
    names = runs.select("flight", "run", "segment").join(found.select("flight", "segment", "line", "line_type", G.compass(F.col("heading")).alias("dir")), ["flight", "segment"]).drop("segment")
    samples = rows.join(names, ["flight", "run"], "left")
    n_turns = df.count() - (found.agg(F.sum("n")).first()[0] or 0)
    if drop_turns:
        samples = samples.filter("line IS NOT NULL")
    samples = samples.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "line", "line_type", "dir")
    return Assigned(samples, found.select("flight", "line", "line_type", "n", "length_m", "heading"), n_turns)
