"""Queries of grids over the survey made of lineitem, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import grid, mainfield, mincurv, pole
from . import adapters as A
from . import figures
from ..operators.lineage import cut

CELL, RADIUS, BLANK = 60.0, 130.0, 100.0


def _nodes(spark, sf_dir):
    s = A.lineitem_survey(spark, sf_dir).select("line", "seq", "x", "y", "mag")
    at = grid.frame_of(s, "mag", CELL)
    return s, at, grid.bin_plane(s, "mag", at)


def _rounded(df, *names):
    return df.withColumns({c: F.round(F.col(c) + 3e-7, 4) for c in names})  # off the ties of short decimals


def bin_plane(spark, sf_dir):
    return _rounded(_nodes(spark, sf_dir)[2], "v")


def dilate_mask(spark, sf_dir):
    _, at, nodes = _nodes(spark, sf_dir)
    return grid.dilate(nodes.filter("n % 2 = 0"), 1, at)


def idw_grid(spark, sf_dir):
    _, at, nodes = _nodes(spark, sf_dir)
    return _rounded(grid.blanked(grid.idw(nodes, RADIUS, at), nodes, BLANK, at), "v")


def bilinear_at(spark, sf_dir):
    s, at, nodes = _nodes(spark, sf_dir)
    points = s.filter("seq % 10 = 0").select("line", "seq", F.col("x").alias("x"), "y")
    return _rounded(grid.bilinear_at(grid.idw(nodes, RADIUS, at), points, at).select("line", "seq", "fit"), "fit")


def grid_classes(spark, sf_dir):
    return figures.grid_classes(_nodes(spark, sf_dir)[2].withColumn("v", F.round("v", 3)), 16).select("ix", "iy", "class")


def mincurv_grid(spark, sf_dir):
    """Every node of the surface: v where it is fixed, and whether the stencil holds (1) or fails (-1) where it is not; 0 within two nodes of an edge."""
    _, at, nodes = _nodes(spark, sf_dir)
    nodes = cut(nodes)
    z, sweeps = mincurv.minimum_curvature(nodes, at)
    z = cut(z)
    rest = mincurv.curvature_residual(z, nodes, at)
    df = z.join(nodes.select("ix", "iy", "n"), ["ix", "iy"], "left").join(rest, ["ix", "iy"], "left")
    return df.select("ix", "iy", F.when(F.col("n").isNotNull(), F.round(F.col("v") + 3e-7, 4)).alias("v"), F.when(F.col("residual").isNull(), 0).when(F.abs("residual") < (0.5 if sweeps else 1e-3), 1).otherwise(-1).alias("smooth"))


def grid_field(spark, sf_dir):
    """Counts of a grid of inverse distances that leaves out every fiftieth sample."""
    s = A.lineitem_survey(spark, sf_dir)
    g = grid.grid_field(s, CELL, "mag", "idw", RADIUS, s.filter("seq % 50 = 0").select("i"))
    values = g.nodes.agg(F.round(F.avg("v") + 3e-7, 4).alias("mean"), F.round(F.max("v") + 3e-7, 4).alias("highest"))
    west, east, south, north = (round(b, 6) for b in g.bounds)
    counts = {"n_data": g.n_data, "n_excluded": g.n_excluded, "n_nodes": g.n_nodes, "n_blank": g.n_blank}
    return values.select("mean", "highest", *(F.lit(v).cast("long").alias(c) for c, v in counts.items()), F.lit(round(g.rms_fit, 4)).alias("rms_fit"), *(F.lit(v).alias(c) for c, v in (("west", west), ("east", east), ("south", south), ("north", north))))


def pole_grid(spark, sf_dir):
    """The surface of inverse distances reduced to the pole. No SQL: tests compare with one transform of the whole."""
    s, at, nodes = _nodes(spark, sf_dir)
    every = spark.range(at.nx * at.ny).select(F.floor(F.col("id") / at.ny).cast("int").alias("ix"), (F.col("id") % at.ny).cast("int").alias("iy"))
    z = every.join(cut(grid.idw(nodes, RADIUS, at)), ["ix", "iy"], "left").select("ix", "iy", (at.x0 + F.col("ix") * at.cell).alias("x"), (at.y0 + F.col("iy") * at.cell).alias("y"), F.coalesce("v", F.lit(54000.0)).alias("v"))
    g = grid.GridResult(z, at, "mag", "idw", RADIUS, 0, 0, 0, 0.0, None, None)
    return pole.reduce_to_pole(g, 65.0, 8.0).nodes.select("ix", "iy", "v")


#: The dipole of a published model of 2020, nT.
DIPOLE = (-29404.8, -1450.9, 4652.5)


def main_field(spark, sf_dir):
    """The dipole's field at every sample, from a 5 x 5 lattice over the survey, and what it leaves of the reading."""
    g, h = np.zeros((2, 2, 2))
    g[1, 0], g[1, 1], h[1, 1] = DIPOLE
    none = np.zeros_like(g)
    model = mainfield.MainField("dipole", (2020.0,), g[None], h[None], (none, none))
    df, _ = mainfield.remove_main_field(A.events_survey(spark, sf_dir), model, 1600.0)
    df, _ = mainfield.field_at(df, model, 1600.0)
    return _rounded(df.select("line", "seq", "mag_igrf", "mag_res", "inclination", "declination"), "mag_igrf", "mag_res", "inclination", "declination")


def queries() -> dict:
    return {f.__name__: f for f in (bin_plane, dilate_mask, idw_grid, bilinear_at, grid_classes, mincurv_grid, grid_field, pole_grid, main_field)}


NODES = f"""WITH s AS (
  SELECT 'L' || l_suppkey AS line, 54000 + l_extendedprice / 1000 AS v, 200.0::DOUBLE * l_suppkey AS x, 6.0::DOUBLE * row_number() OVER w AS y, row_number() OVER w AS seq
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)
), f AS (
  SELECT *, ceil((x1 - x0) / {CELL})::INT + 1 AS nx, ceil((y1 - y0) / {CELL})::INT + 1 AS ny FROM (SELECT floor(min(x) / {CELL}) * {CELL}::DOUBLE AS x0, floor(min(y) / {CELL}) * {CELL}::DOUBLE AS y0, max(x) AS x1, max(y) AS y1 FROM s)
), b AS (
  SELECT *, x - (x0 + ix * {CELL}) AS dx, y - (y0 + iy * {CELL}) AS dy FROM (SELECT *, round_even((x - x0) / {CELL}::DOUBLE, 0)::INT AS ix, round_even((y - y0) / {CELL}::DOUBLE, 0)::INT AS iy FROM s, f)
), t AS (
  SELECT ix, iy, count(*) AS n, avg(dx) AS mx, avg(dy) AS my, avg(v) AS mv, var_pop(dx) + 1 AS xx, var_pop(dy) + 1 AS yy, covar_pop(dx, dy) AS xy, covar_pop(dx, v) AS xv, covar_pop(dy, v) AS yv FROM b GROUP BY ix, iy
), e AS (
  SELECT *, (xv - xy / yy * yv) / (xx - xy / yy * xy) AS east FROM t
), n AS (
  SELECT ix, iy, n, mv - east * mx - (yv - xy * east) / yy * my AS v FROM e
)"""
IDW = f""", o AS (
  SELECT di, dj, 1 / greatest((di * di + dj * dj) * {CELL * CELL}::DOUBLE, 0.01::DOUBLE) AS w FROM range(-2, 3) a(di), range(-2, 3) b(dj) WHERE (di * di + dj * dj) * {CELL * CELL} <= {RADIUS * RADIUS}
), z AS (
  SELECT (ix + di)::INT AS ix, (iy + dj)::INT AS iy, sum(v * w) / sum(w) AS v FROM n, o, f WHERE ix + di BETWEEN 0 AND nx - 1 AND iy + dj BETWEEN 0 AND ny - 1 GROUP BY 1, 2
)"""


def _dilated(mask: str, k: int) -> str:
    return f"SELECT DISTINCT (ix + di)::INT AS ix, (iy + dj)::INT AS iy FROM ({mask}), f, range({-k}, {k + 1}) a(di), range({-k}, {k + 1}) b(dj) WHERE ix + di BETWEEN 0 AND nx - 1 AND iy + dj BETWEEN 0 AND ny - 1"


def _main_field(events: str) -> str:
    """A centred dipole's field on the WGS 84 spheroid as vectors, on a lattice and bilinear between its nodes."""
    g10, g11, h11 = (f"({v})::DOUBLE" for v in DIPOLE)
    lattice = f""", ext AS (SELECT min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM q), k AS (
  SELECT i, j, radians(a + (b - a) * i / 4) AS lam, radians(c + (d - c) * j / 4) AS phi FROM ext, range(5) x(i), range(5) y(j)
), o AS (
  SELECT *, 6378.137::DOUBLE / sqrt(1 - {_E2} * sin(phi) ** 2) AS n FROM k
), v AS (
  SELECT *, (n + 1.6::DOUBLE) * cos(phi) * cos(lam) AS px, (n + 1.6::DOUBLE) * cos(phi) * sin(lam) AS py, (n * (1 - {_E2}) + 1.6::DOUBLE) * sin(phi) AS pz FROM o
), w AS (
  SELECT *, sqrt(px * px + py * py + pz * pz) AS r, {g11} * px + {h11} * py + {g10} * pz AS dot FROM v
), m AS (
  SELECT *, pow(6371.2::DOUBLE / r, 3) * (3 * dot * px / r / r - {g11}) AS fx, pow(6371.2::DOUBLE / r, 3) * (3 * dot * py / r / r - {h11}) AS fy, pow(6371.2::DOUBLE / r, 3) * (3 * dot * pz / r / r - {g10}) AS fz FROM w
), f AS (
  SELECT i, j, -sin(phi) * cos(lam) * fx - sin(phi) * sin(lam) * fy + cos(phi) * fz AS north, -sin(lam) * fx + cos(lam) * fy AS east, -(cos(phi) * cos(lam) * fx + cos(phi) * sin(lam) * fy + sin(phi) * fz) AS down FROM m
), z AS (
  SELECT i, j, sqrt(north ** 2 + east ** 2 + down ** 2) AS ff, degrees(atan2(down, sqrt(north ** 2 + east ** 2))) AS ii, degrees(atan2(east, north)) AS dd FROM f
), p AS (
  SELECT *, fx - i0 AS s, fy - j0 AS t FROM (SELECT *, least(floor(fx), 3)::INT AS i0, least(floor(fy), 3)::INT AS j0 FROM (SELECT q.*, (lon - a) / ((b - a) / 4) AS fx, (lat - c) / ((d - c) / 4) AS fy FROM q, ext))
)"""
    at = lambda c: f"((1 - s) * ((1 - t) * z00.{c} + t * z01.{c}) + s * ((1 - t) * z10.{c} + t * z11.{c}))"
    joins = " ".join(f"JOIN z z{a}{b} ON z{a}{b}.i = i0 + {a} AND z{a}{b}.j = j0 + {b}" for a in (0, 1) for b in (0, 1))
    return events + lattice + f" SELECT line, seq, round({at('ff')} + 3e-7, 4) AS mag_igrf, round(mag - {at('ff')} + 3e-7, 4) AS mag_res, round({at('ii')} + 3e-7, 4) AS inclination, round({at('dd')} + 3e-7, 4) AS declination FROM p {joins}"


_E2 = f"{1 - (6356.752314245 / 6378.137) ** 2!r}::DOUBLE"


def _grid_field() -> str:
    left = NODES.replace("), f AS (", "), f0 AS (SELECT 1), f AS (", 1).replace("FROM s, f)", "FROM s, f WHERE s.seq % 50 <> 0)").replace("max(y) AS y1 FROM s)", "max(y) AS y1 FROM s WHERE seq % 50 <> 0)")
    return (
        left
        + IDW
        + f""", k AS (SELECT z.* FROM z JOIN ({_dilated('SELECT ix, iy FROM n', 3)}) d ON z.ix = d.ix AND z.iy = d.iy),
p AS (SELECT *, fx - i AS t, fy - j AS u FROM (SELECT *, least(floor(fx), nx - 2)::INT AS i, least(floor(fy), ny - 2)::INT AS j FROM (SELECT v, (x - x0) / {CELL}::DOUBLE AS fx, (y - y0) / {CELL}::DOUBLE AS fy, nx, ny FROM s, f WHERE seq % 50 <> 0))),
q AS (SELECT p.v - ((1 - t) * (1 - u) * a.v + t * (1 - u) * b.v + (1 - t) * u * c.v + t * u * d.v) AS miss FROM p LEFT JOIN k a ON a.ix = i AND a.iy = j LEFT JOIN k b ON b.ix = i + 1 AND b.iy = j LEFT JOIN k c ON c.ix = i AND c.iy = j + 1 LEFT JOIN k d ON d.ix = i + 1 AND d.iy = j + 1),
y AS (SELECT 40 + y / (111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * radians(40)) + 1.175::DOUBLE * cos(4 * radians(40)) - 0.0023::DOUBLE * cos(6 * radians(40))) AS lat, x, y FROM s),
l AS (SELECT x, y, lat, -100 + x / (111412.84::DOUBLE * cos(radians((40 + lat) / 2)) - 93.5::DOUBLE * cos(3 * radians((40 + lat) / 2)) + 0.118::DOUBLE * cos(5 * radians((40 + lat) / 2))) AS lon FROM y),
r AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, avg(lon) AS mlon, avg(lat) AS mlat, covar_pop(x, lon) AS xlon, covar_pop(y, lon) AS ylon, covar_pop(x, lat) AS xlat, covar_pop(y, lat) AS ylat FROM l),
g AS (SELECT *, (xlon - xy / yy * ylon) / (xx - xy / yy * xy) AS elon, (xlat - xy / yy * ylat) / (xx - xy / yy * xy) AS elat FROM r),
h AS (SELECT mx, my, mlon, mlat, elon, elat, (ylon - xy * elon) / yy AS nlon, (ylat - xy * elat) / yy AS nlat FROM g),
c AS (SELECT mlon + elon * (x0 - {CELL / 2} - mx) + nlon * (y0 - {CELL / 2} - my) AS lon0, mlon + elon * (x0 + nx * {CELL} - {CELL / 2} - mx) + nlon * (y0 + ny * {CELL} - {CELL / 2} - my) AS lon1,
       mlat + elat * (x0 - {CELL / 2} - mx) + nlat * (y0 - {CELL / 2} - my) AS lat0, mlat + elat * (x0 + nx * {CELL} - {CELL / 2} - mx) + nlat * (y0 + ny * {CELL} - {CELL / 2} - my) AS lat1 FROM h, f)
SELECT round(avg(v) + 3e-7, 4) AS mean, round(max(v) + 3e-7, 4) AS highest, (SELECT count(*) FROM s WHERE seq % 50 <> 0) AS n_data, (SELECT count(*) FROM s WHERE seq % 50 = 0) AS n_excluded, (SELECT (nx * ny)::BIGINT FROM f) AS n_nodes,
       (SELECT (nx * ny)::BIGINT FROM f) - count(*) AS n_blank, (SELECT round(sqrt(avg(miss * miss)), 4) FROM q) AS rms_fit, (SELECT round(least(lon0, lon1), 6) FROM c) AS west, (SELECT round(greatest(lon0, lon1), 6) FROM c) AS east, (SELECT round(least(lat0, lat1), 6) FROM c) AS south, (SELECT round(greatest(lat0, lat1), 6) FROM c) AS north FROM k"""
    )


def oracle_sql() -> dict:
    from .registry import EVENTS, PLACED

    return {
        "mincurv_grid": NODES + " SELECT i::INT AS ix, j::INT AS iy, round(n.v + 3e-7, 4) AS v, CASE WHEN n.v IS NULL AND i BETWEEN 2 AND nx - 3 AND j BETWEEN 2 AND ny - 3 THEN 1 ELSE 0 END AS smooth FROM f, range(nx) a(i), range(ny) b(j) LEFT JOIN n ON n.ix = i AND n.iy = j",
        "grid_field": _grid_field(),
        "main_field": _main_field(EVENTS + PLACED + ", q AS (SELECT * FROM sl)"),
        "bin_plane": NODES + "SELECT ix, iy, round(v + 3e-7, 4) AS v, n FROM n",
        "dilate_mask": NODES + _dilated("SELECT ix, iy FROM n WHERE n % 2 = 0", 1),
        "idw_grid": NODES + IDW + f"SELECT z.ix, z.iy, round(z.v + 3e-7, 4) AS v FROM z JOIN ({_dilated('SELECT ix, iy FROM n', 2)}) d ON z.ix = d.ix AND z.iy = d.iy",
        "grid_classes": NODES
        + """, r AS (SELECT ix, iy, round(v, 3) AS v FROM n), k AS (SELECT list_sort(list_distinct(quantile_cont(v, list_transform(range(17), lambda i: i / 16)))) AS cuts FROM r)
SELECT ix, iy, (round_even((greatest(1, least(len(cuts) - 1, len(list_filter(cuts, lambda c: c <= v)))) - 1) / (len(cuts) - 2 + 1e-9::DOUBLE) * 15, 0) + 1)::INT AS class FROM r, k""",
        "bilinear_at": NODES
        + IDW
        + f""", p AS (SELECT *, fx - i AS t, fy - j AS s FROM (SELECT *, least(floor(fx), nx - 2)::INT AS i, least(floor(fy), ny - 2)::INT AS j FROM (SELECT line, seq, (x - x0) / {CELL}::DOUBLE AS fx, (y - y0) / {CELL}::DOUBLE AS fy, nx, ny FROM s, f WHERE seq % 10 = 0)))
SELECT p.line, p.seq, round((1 - t) * (1 - p.s) * a.v + t * (1 - p.s) * b.v + (1 - t) * p.s * c.v + t * p.s * d.v + 3e-7, 4) AS fit
FROM p LEFT JOIN z a ON a.ix = i AND a.iy = j LEFT JOIN z b ON b.ix = i + 1 AND b.iy = j LEFT JOIN z c ON c.ix = i AND c.iy = j + 1 LEFT JOIN z d ON d.ix = i + 1 AND d.iy = j + 1""",
    }
