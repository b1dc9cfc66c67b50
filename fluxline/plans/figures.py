"""The rows behind plots, maps and tables of an acceptance run, and its CSV and HTML files."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import crossovers as X
from ..operators import grid
from ..operators.survey import by_line, with_steps
from ..spec import SurveySpec
from . import qc

#: What readers call a field channel.
CHANNELS = {"rtp": "residual field reduced to the pole", "mag_res": "residual field (IGRF removed)", "mag_lev": "levelled field", "mag": "field", "mag_raw": "raw field"}


def channel_label(name: str) -> str:
    return CHANNELS.get(name, name)


def time_text(t: Column) -> Column:
    """UTC to a tenth of a second, cut off."""
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.S")


def decimated(survey: DataFrame, every: int = 5) -> DataFrame:
    """Every so many samples of a line, and its last."""
    last = F.max("seq").over(Window.partitionBy("line"))
    return survey.withColumn("__last", last).filter(((F.col("seq") - 1) % every == 0) | (F.col("seq") == F.col("__last"))).drop("__last")


def flag_mask(survey: DataFrame, flags: DataFrame, check: str | None = None) -> DataFrame:
    """survey with flagged: whether a flag (of a check) covers the sample."""
    hit = qc.flagged_samples(flags if check is None else flags.filter(F.col("check") == check)).select("i").distinct().withColumn("flagged", F.lit(True))
    return survey.join(hit, "i", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def clearance_rows(survey: DataFrame, flags: DataFrame, every: int = 5) -> DataFrame:
    """(line, seq, time, value, flagged): thinned radar altitudes, flagged ones all."""
    rows = flag_mask(survey, flags, "clearance")
    keep = decimated(survey, every).select("i").withColumn("thin", F.lit(True))
    rows = rows.join(keep, "i", "left").filter(F.col("flagged") | F.col("thin"))
    return rows.select("line", "seq", time_text(F.col("time")).alias("time"), F.round("radar_alt", 1).alias("value"), "flagged")


def fourth_difference_rows(series: DataFrame, flags: DataFrame) -> DataFrame:
    """(line, seq, time, value, flagged) of the noise series (line, seq, i, time, d4)."""
    return flag_mask(series, flags, "fourth_difference").select("line", "seq", time_text(F.col("time")).alias("time"), F.round("d4", 4).alias("value"), "flagged")


def diurnal_rows(stats: DataFrame) -> DataFrame:
    """(time, mag_base, dev, exceed) of a base station's chords."""
    return stats.select(time_text(F.col("time")).alias("time"), F.round("mag_base", 2).alias("mag_base"), "dev", "exceed")


def crossover_rows(survey: DataFrame, crossings: DataFrame, spec: SurveySpec) -> DataFrame:
    """(id, label, heading, misfit, misfit_after) in the order of traverse and tie; the window is over one row a crossing, as many as a plot shows."""
    ends = survey.filter("line_type = 'traverse'").groupBy("line").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    heading = F.concat(G.compass(G.bearing(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))), F.lit("-bound"))
    df = crossings.join(ends.select(F.col("line").alias("traverse"), heading.alias("heading")), "traverse")
    after = F.col("misfit_after") if "misfit_after" in crossings.columns else F.lit(None).cast("double")
    return df.select(F.row_number().over(Window.orderBy("traverse", "tie")).alias("id"), F.concat("traverse", F.lit(" x "), "tie").alias("label"), "heading", "misfit", after.alias("misfit_after"))


def line_profile(survey: DataFrame, series: DataFrame, flags: DataFrame, line: str) -> DataFrame:
    """(seq, fid, time, along, mag, mag_lev, d4, radar_alt, flagged) of a line; an unknown line is an error."""
    own = survey.filter(F.col("line") == line)
    if own.isEmpty():
        raise ValueError(f"line {line} is not in the survey")
    lev = F.col("mag_lev") if "mag_lev" in survey.columns else F.lit(None).cast("double")
    df = with_steps(own).join(series.filter(F.col("line") == line).select("seq", "d4"), "seq", "left")
    df = flag_mask(df, flags.filter(F.col("line") == line))
    return df.select("seq", "fid", F.date_format("time", "HH:mm:ss").alias("time"), "along", "mag", lev.alias("mag_lev"), "d4", "radar_alt", "flagged")


def map_rows(survey: DataFrame, flags: DataFrame, every: int = 5) -> DataFrame:
    """(line, line_type, seq, lon, lat, x, y, flagged, popup): thinned paths; popup is safe to put into a page."""
    safe = F.replace(F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    df = flag_mask(decimated(survey, every), flags)
    return df.select("line", "line_type", "seq", "lon", "lat", "x", "y", "flagged", F.concat(F.lit("<b>"), safe, F.lit("</b> "), F.date_format("time", "HH:mm:ss")).alias("popup"))


def grid_classes(nodes: DataFrame, classes: int = 256) -> DataFrame:
    """nodes (ix, iy, v) with class 1 to classes, so that each holds about as many nodes (breaks at quantiles; equal breaks count once)."""
    cuts = nodes.filter(G.finite(F.col("v"))).agg(F.array_sort(F.array_distinct(F.percentile("v", F.array(*(F.lit(i / classes) for i in range(classes + 1)))))).alias("cuts"))
    df = nodes.crossJoin(F.broadcast(cuts))  # one row of classes + 1 numbers
    found = F.greatest(F.lit(1), F.least(F.size("cuts") - 1, F.size(F.filter("cuts", lambda c: c <= F.col("v")))))
    share = (found - 1) / (F.size("cuts") - 2 + F.lit(1e-9)) * (classes - 1)
    return df.withColumn("class", F.when(F.size("cuts") < 2, 1).when(G.finite(F.col("v")), F.rint(share).cast("int") + 1)).drop("cuts")


def bounds(survey: DataFrame, at: grid.Frame) -> dict[str, float] | None:
    """West, east, south and north of a grid, from longitude and latitude as planes over x and y; None without a place or an extent. One row of sums reaches the driver."""
    df = survey.filter(G.finite(F.col("lon")) & G.finite(F.col("lat")) & F.col("x").isNotNull() & F.col("y").isNotNull())
    s = df.agg(
        F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
        *(F.covar_pop(a, b).alias(f"{a}_{b}") for a in ("lon", "lat") for b in "xy"),
    ).first()
    if s["n"] < 3 or not s["xx"] or not s["yy"]:
        return None
    det, half = s["xx"] * s["yy"] - s["xy"] ** 2, at.cell / 2
    ends = [(at.x0 - half, at.y0 - half), (at.x0 + (at.nx - 1) * at.cell + half, at.y0 + (at.ny - 1) * at.cell + half)]
    out = {}
    for c in ("lon", "lat"):
        bx, by = (s[f"{c}_x"] * s["yy"] - s[f"{c}_y"] * s["xy"]) / det if det else 0.0, (s[f"{c}_y"] * s["xx"] - s[f"{c}_x"] * s["xy"]) / det if det else 0.0
        out[c] = [s[c] + bx * (x - s["x"]) + by * (y - s["y"]) for x, y in ends]
    return {"west": min(out["lon"]), "east": max(out["lon"]), "south": min(out["lat"]), "north": max(out["lat"])}


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """A base station's CSV file: time (UTC), mag_base."""
    df = spark.read.csv(path, header=True)
    missing = {"time", "mag_base"} - set(df.columns)
    if missing:
        raise ValueError(f"a base station file needs {', '.join(sorted(missing))}")
    return df.select(F.col("time").try_cast("timestamp").alias("time"), F.col("mag_base").try_cast("double").alias("mag_base"))


def write_flags(flags: DataFrame, path: str) -> None:
    """flag_table as CSV files with a header in the folder path."""
    qc.flag_table(flags).write.mode("overwrite").csv(path, header=True, emptyValue="")


def report(run: qc.QcResult, rows: int = 500) -> str:
    """A self-contained page: statistics, scorecard, lines and flags; of tables longer than rows it says how many more there are (the CSV has all)."""

    def table(df: DataFrame) -> str:
        got, n = df.limit(rows + 1).collect(), len(df.columns)
        cell = lambda v: html.escape("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v))
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in got[:rows])
        more = f"<tr><td colspan={n}>and more: {df.count() - rows} rows</td></tr>" if len(got) > rows else ""
        return f"<table><tr>{head}</tr>{body}{more}</table>"

    parts = [("Statistics", run.stats), ("Checks", run.scorecard.orderBy("place")), ("Lines", run.lines.orderBy("line_type", "line")), ("Flags", qc.flag_table(run.flags).orderBy("check", "line", "start"))]
    style = "<style>body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}</style>"
    return f"<!doctype html><html><head><meta charset=utf-8><title>Survey report</title>{style}</head><body>" + "".join(f"<h2>{name}</h2>{table(df)}" for name, df in parts) + f"<p>{html.escape(str(run.spec))}</p></body></html>"
