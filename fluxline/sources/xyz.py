"""XYZ files: comments (/), line and tie headers, columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.survey import as_survey
from .lines import last_above, places

#: Texts that stand for no value.
MISSING = ["*", "NA", "-99999", "1e+32"]
HEADER = r"(?i)^\s*(line|tie)\s+(\S+)"


def _kind() -> Column:
    return F.when(F.trim("value").startswith("/"), "comment").when(F.col("value").rlike(HEADER), "header").otherwise("data")


def column_names(rows: DataFrame) -> list[str]:
    """Names from the last comment before the first data row; all files must agree. One row for each different header reaches the driver."""
    first = rows.filter("kind = 'data'").groupBy("file").agg(F.min("n").alias("first"))
    named = rows.filter("kind = 'comment'").join(first, "file").filter("n < first").groupBy("file").agg(F.max_by("value", "n").alias("names"))
    found = named.select(F.trim(F.regexp_replace("names", "^\\s*/+", "")).alias("names")).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("no header comment before the data: pass columns" if not found else "files have different columns: read them apart or pass columns")
    return found[0]["names"].split()


def parse_xyz(lines: DataFrame, columns: list[str] | None = None, col_map: dict[str, str] | None = None) -> DataFrame:
    """(file, n, line, line_type, a double a column) of lines (file, n, value). Rows before the first header have no line.

    col_map copies columns to further names; a name that differs from its column in case only replaces it. A row with another number of fields than columns is an error when it is read.
    """
    rows = lines.filter(F.trim("value") != "").withColumn("kind", _kind())
    if columns is None:
        if rows.filter("kind = 'data'").isEmpty():
            raise ValueError("no data rows")
        columns = column_names(rows)
    unknown = [c for c in (col_map or {}).values() if c not in columns]
    if unknown:
        raise ValueError(f"col_map: no column {unknown[0]}")
    header = F.when(F.col("kind") == "header", F.struct(F.lower(F.regexp_extract("value", HEADER, 1)).alias("type"), F.regexp_extract("value", HEADER, 2).alias("name")))
    rows = last_above(rows.withColumn("header", header), "header").filter("kind = 'data'").withColumn("fields", F.split(F.trim("value"), r"\s+"))
    whole = F.when(F.size("fields") == len(columns), F.col("fields")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": line "), F.col("n"), F.lit(f" has not {len(columns)} fields"))).cast("array<string>"))
    rows = rows.withColumn("fields", whole)
    number = lambda i: F.when(~F.col("fields")[i].isin(MISSING), F.col("fields")[i].try_cast("double"))
    named = {name.lower() for name in col_map or {}}
    values = [number(i).alias(c) for i, c in enumerate(columns) if c.lower() not in named] + [number(columns.index(c)).alias(name) for name, c in (col_map or {}).items()]
    kind = F.when(F.col("header.type") == "tie", "tie").when(F.col("header").isNotNull(), "traverse")
    return rows.select("file", "n", F.col("header.name").alias("line"), kind.alias("line_type"), *values)


def read_xyz(lines: DataFrame, columns: list[str] | None = None, col_map: dict[str, str] | None = None, time_origin: str = "1970-01-01", origin: tuple[float, float] | None = None) -> DataFrame:
    """The survey of XYZ lines; time is in seconds from time_origin (UTC). Without a column fid, fid is the number of the data row, by file."""
    df = parse_xyz(lines, columns, col_map)
    if "fid" not in df.columns:
        df = places(df, "fid")
    if "time" in df.columns:
        start = F.unix_micros(F.lit(time_origin).cast("timestamp"))
        df = df.withColumn("time", F.timestamp_micros(start + F.round(F.col("time") * 1e6).cast("long")))
    return as_survey(df.drop("file", "n"), origin)
