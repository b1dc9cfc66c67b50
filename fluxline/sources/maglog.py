"""Raw magnetometer logs in many formats, described by MagFormat."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from .lines import in_file, up_to_here

DAY = 86400
#: What a part of a time format matches.
PARTS = {"%Y": r"(\d{4})", "%m": r"(\d{1,2})", "%d": r"(\d{1,2})", "%H": r"(\d{2})", "%M": r"(\d{2})", "%S": r"(\d{2})", "%OS": r"(\d{2}(?:\.\d*)?)"}


@dataclass(frozen=True)
class MagFormat:
    """sep, prefix and strip are regular expressions: of what parts fields, of lines to keep, and of what goes from a line's start. columns gives fields
    (from 1) by name. time: hms (time of day), seconds (of the day), datetime, elapsed (seconds from a start) or index (records from a start at rate Hz)."""

    sep: str = ","
    prefix: str | None = None
    strip: str | None = None
    skip: int = 0
    comment: str = "#"
    columns: dict[str, int] = field(default_factory=lambda: {"time": 1, "mag": 2})
    time: str = "hms"
    time_format: str = "%H:%M:%OS"
    rate: float | None = None
    na: tuple[str, ...] = ("", "NA", "*", "*****")

    def __post_init__(self):
        if self.time not in ("hms", "seconds", "datetime", "elapsed", "index"):
            raise ValueError(f"unknown kind of time {self.time}")
        if "mag" not in self.columns:
            raise ValueError("columns must name mag")
        if self.time != "index" and "time" not in self.columns:
            raise ValueError("columns must name time unless time is index")
        if self.time == "index" and self.rate is None:
            raise ValueError("time index needs rate")

    def __str__(self) -> str:
        how = f" ({self.time_format})" if self.time in ("hms", "datetime") else f" at {self.rate:g} Hz" if self.time == "index" else ""
        return f"magnetometer log: {', '.join(f'{k} = {v}' for k, v in self.columns.items())}; sep {self.sep!r}; time: {self.time}{how}"


#: Formats by name.
PRESETS = {
    "geometrics": MagFormat(sep=",", prefix=r"^\$", strip=r"^\$\s*", columns={"mag": 1, "signal": 2, "time": 3}, time_format="%H:%M:%OS"),
    "gem": MagFormat(sep=r"\s+", prefix=r"^\s*[0-9]", columns={"mag": 1, "signal": 2, "time": 3}, time_format="%H%M%OS"),
}


def parsed_time(text: Column, time_format: str) -> Column:
    """Seconds of the day or, with a date in the format, from 1970 (UTC); null where the text does not fit."""
    names = re.findall(r"%OS|%[YmdHMS]", time_format)
    pattern = "".join(PARTS.get(p, re.escape(p)) for p in re.split(r"(%OS|%[YmdHMS])", time_format))
    part = {p: F.nullif(F.regexp_extract(text, f"^{pattern}$", i + 1), F.lit("")).try_cast("double") for i, p in enumerate(names)}
    at = lambda *ps: next((part[p] for p in ps if p in part), F.lit(0.0))
    seconds = at("%H") * 3600 + at("%M") * 60 + at("%OS", "%S")
    if "%Y" not in part:
        return seconds
    day = F.try_make_timestamp(part["%Y"].cast("int"), at("%m").cast("int"), at("%d").cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return F.unix_micros(day) / 1e6 + seconds


def parse_mag_log(lines: DataFrame, form: MagFormat | str = "geometrics", date: str | None = None) -> DataFrame:
    """(file, n, time, mag_raw, further columns of the format) of lines (file, n, value); rows without a time or a finite field are left out.

    date is the day of the first record (hms, seconds; if the time of day falls by more than half a day, a day is added from there on) or the start
    (elapsed, index). Null lines are empty lines.
    """
    f = PRESETS[form] if isinstance(form, str) else form
    if date is None and f.time != "datetime":
        raise ValueError("this format's time needs date")
    df = lines.filter(F.col("n") > f.skip).withColumn("value", F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))).filter("value <> ''")
    if f.comment:
        df = df.filter(~F.col("value").startswith(f.comment))
    if f.prefix:
        df = df.filter(F.col("value").rlike(f.prefix))
    if f.strip:
        rest = F.substring("value", F.length(F.regexp_extract("value", f.strip, 0)) + 1, F.length("value"))
        df = df.withColumn("value", rest if f.strip.startswith("^") else F.regexp_replace("value", f.strip, ""))
    # a trailing separator makes no field
    df = df.withColumn("p", F.split("value", f.sep)).withColumn("p", F.when(F.element_at("p", -1) == "", F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p")))
    df = df.filter(F.size("p") >= max(f.columns.values()))
    text = lambda k: F.when(~F.trim(F.get("p", k - 1)).isin(list(f.na)), F.trim(F.get("p", k - 1)))
    values = {("mag_raw" if c == "mag" else c): text(k).try_cast("double") for c, k in f.columns.items() if c != "time"}
    start = F.unix_micros(F.lit(date).cast("timestamp")) / 1e6 if date else None
    day = F.floor(start / DAY) * DAY if date else None
    if f.time == "index":
        t = start + (F.row_number().over(in_file()) - 1) / F.lit(float(f.rate))
    elif f.time == "datetime":
        t = parsed_time(text(f.columns["time"]), f.time_format)
    elif f.time == "hms":
        t = day + parsed_time(text(f.columns["time"]), f.time_format)
    else:
        t = (day if f.time == "seconds" else start) + text(f.columns["time"]).try_cast("double")
    df = df.select("file", "n", t.alias("t"), *(v.alias(c) for c, v in values.items()))
    if f.time in ("hms", "seconds"):
        df = df.withColumn("fell", F.coalesce((F.col("t") - F.lag("t").over(in_file()) < -DAY / 2).cast("int"), F.lit(0)))
        df = df.withColumn("t", F.col("t") + F.sum("fell").over(up_to_here()) * DAY)
    df = df.filter(G.finite(F.col("mag_raw")) & F.col("t").isNotNull())
    return df.select("file", "n", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("time"), "mag_raw", *(c for c in values if c != "mag_raw"))
