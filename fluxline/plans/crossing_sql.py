"""SQL of crossings, levelling, spikes, the diurnal check and the acceptance run: the steps of the operators as common table expressions."""

from __future__ import annotations

NEAR = 10
_SIDES = (("traverse", "a"), ("tie", "b"))


def _fit(x: str = "x", y: str = "y") -> str:
    return f"avg({x}) AS cx, avg({y}) AS cy, 0.5::DOUBLE * atan2(2 * covar_pop({x}, {y}), var_pop({x}) - var_pop({y})) AS th"


def _meet(p: str, q: str, px: str, py: str) -> str:
    """Where lines p and q meet; px and py where they are parallel."""
    den = f"(cos({p}.th) * sin({q}.th) - sin({p}.th) * cos({q}.th))"
    t = f"(({q}.cx - {p}.cx) * sin({q}.th) - ({q}.cy - {p}.cy) * cos({q}.th)) / {den}"
    return f"CASE WHEN abs({den}) >= 1e-12 THEN {p}.cx + ({t}) * cos({p}.th) ELSE {px} END AS px, CASE WHEN abs({den}) >= 1e-12 THEN {p}.cy + ({t}) * sin({p}.th) ELSE {py} END AS py"


def crossings(source: str = "s") -> str:
    """CTEs after one named source (line, line_type, seq, i, x, y, step, mag, radar_alt, time, lon, lat): xo has the crossings."""
    out = f""", ax AS MATERIALIZED (
  SELECT line, any_value(line_type) AS line_type, {_fit()}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, median(step) AS ms FROM {source} WHERE line IS NOT NULL GROUP BY line HAVING count(*) >= 3
), c0 AS MATERIALIZED (
  SELECT * FROM (SELECT a.line AS traverse, b.line AS tie, {_meet('a', 'b', 'NULL::DOUBLE', 'NULL::DOUBLE')}, 3 * greatest(a.ms, b.ms) AS md, a.x0 AS ax0, a.x1 AS ax1, a.y0 AS ay0, a.y1 AS ay1, b.x0 AS bx0, b.x1 AS bx1, b.y0 AS by0, b.y1 AS by1
    FROM ax a JOIN ax b ON a.line_type = 'traverse' AND b.line_type = 'tie')
  WHERE px BETWEEN ax0 - md AND ax1 + md AND px BETWEEN bx0 - md AND bx1 + md AND py BETWEEN ay0 - md AND ay1 + md AND py BETWEEN by0 - md AND by1 + md
)"""
    for r in (0, 1, 2):
        for side, p in _SIDES:
            out += f""", n{r}{p} AS MATERIALIZED (
  SELECT c.traverse, c.tie, min(sqrt((x - px) ** 2 + (y - py) ** 2)) AS d, arg_min(seq, (sqrt((x - px) ** 2 + (y - py) ** 2), seq)) AS k FROM c{r} c JOIN {source} s ON s.line = c.{side} GROUP BY c.traverse, c.tie
), f{r}{p} AS MATERIALIZED (
  SELECT n.traverse, n.tie, any_value(n.k) AS k, any_value(n.d) AS d, {_fit()} FROM n{r}{p} n JOIN {source} s ON s.line = n.{side} AND s.seq BETWEEN n.k - {NEAR} AND n.k + {NEAR} GROUP BY n.traverse, n.tie
)"""
        if r < 2:
            out += f""", c{r + 1} AS MATERIALIZED (
  SELECT c.traverse, c.tie, {_meet('a', 'b', 'c.px', 'c.py')}, c.md FROM c{r} c JOIN f{r}a a USING (traverse, tie) JOIN f{r}b b USING (traverse, tie)
)"""
    for side, p in _SIDES:
        at = "(px - f.cx) * cos(f.th) + (py - f.cy) * sin(f.th)"
        out += f""", t{p} AS MATERIALIZED (
  SELECT traverse, tie, p, t, avg(mag) AS mag, avg(radar_alt) AS alt, count(mag) AS nm, count(radar_alt) AS na FROM (
    SELECT c.traverse, c.tie, {at} AS p, (s.x - f.cx) * cos(f.th) + (s.y - f.cy) * sin(f.th) AS t, mag, radar_alt
    FROM c2 c JOIN f2{p} f USING (traverse, tie) JOIN {source} s ON s.line = c.{side} AND s.seq BETWEEN f.k - {NEAR} AND f.k + {NEAR}) GROUP BY traverse, tie, p, t
), v{p} AS MATERIALIZED (
  SELECT traverse, tie, {', '.join(f"CASE WHEN n{c} >= 2 THEN coalesce(a{c}.v + (b{c}.v - a{c}.v) * coalesce((p - a{c}.t) / nullif(b{c}.t - a{c}.t, 0), 0), a{c}.v, b{c}.v) END AS {v}" for c, v in (('m', 'mag'), ('a', 'alt')))} FROM (
    SELECT traverse, tie, p, {', '.join(f"sum(n{c}) AS n{c}, max_by({{'t': t, 'v': {v}}}, t) FILTER ({v} IS NOT NULL AND t <= p) AS a{c}, min_by({{'t': t, 'v': {v}}}, t) FILTER ({v} IS NOT NULL AND t >= p) AS b{c}" for c, v in (('m', 'mag'), ('a', 'alt')))}
    FROM t{p} GROUP BY traverse, tie, p)
)"""
    return (
        out
        + f""", xo AS MATERIALIZED (
  SELECT c.traverse, c.tie, c.px AS x, c.py AS y, s.lon, s.lat, s.time, va.mag AS mag_traverse, vb.mag AS mag_tie, va.mag - vb.mag AS misfit, va.alt AS alt_traverse, vb.alt AS alt_tie, s.i AS i_traverse, q.i AS i_tie, a.k AS k_traverse, b.k AS k_tie, s.fid
  FROM c2 c JOIN f2a a USING (traverse, tie) JOIN f2b b USING (traverse, tie) JOIN va USING (traverse, tie) JOIN vb USING (traverse, tie) JOIN {source} s ON s.line = c.traverse AND s.seq = a.k JOIN {source} q ON q.line = c.tie AND q.seq = b.k
  WHERE a.d <= c.md AND b.d <= c.md
)"""
    )


def levelled(order: str, source: str = "s") -> str:
    """CTEs after crossings: co has the coefficients, xl the crossings with misfit_after."""
    return f""", al AS MATERIALIZED (SELECT line, seq, sum(coalesce(step, 0)) OVER (PARTITION BY line ORDER BY seq) AS along FROM {source}),
xa AS MATERIALIZED (SELECT xo.*, al.along AS along_traverse FROM xo JOIN al ON al.line = xo.traverse AND al.seq = xo.k_traverse),
fi AS (SELECT traverse, count(*) AS n, avg(misfit) AS m, regr_slope(misfit, along_traverse) AS b, regr_intercept(misfit, along_traverse) AS a, max(along_traverse) - min(along_traverse) AS r FROM xa WHERE misfit IS NOT NULL GROUP BY traverse),
co AS MATERIALIZED (SELECT l.line, CASE WHEN n IS NULL THEN 'none' WHEN lin THEN 'linear' ELSE 'constant' END AS "order", coalesce(n, 0) AS n_crossovers, CASE WHEN lin THEN a ELSE m END AS c0, CASE WHEN n IS NULL THEN NULL WHEN lin THEN b ELSE 0 END AS c1
  FROM (SELECT DISTINCT line FROM {source} WHERE line_type = 'traverse') l LEFT JOIN (SELECT *, {"n >= 3 AND r > 0 AND isfinite(b)" if order == "linear" else "false"} AS lin FROM fi) f ON f.traverse = l.line),
xl AS MATERIALIZED (SELECT xa.*, xa.misfit - coalesce(c0 + c1 * along_traverse, 0) AS misfit_after, co."order" AS "order" FROM xa LEFT JOIN co ON co.line = xa.traverse)"""


def _signed(v: str, digits: int) -> str:
    return f"printf('%+.{digits}f', round_even({v}::DOUBLE, {digits}))"


def fixed(v: str, digits: int) -> str:
    return f"printf('%.{digits}f', round_even({v}::DOUBLE, {digits}))"


COLUMNS = ["check", "line", "i_start", "i_end", "fid_start", "fid_end", "time_start", "time_end", "x", "y", "lon", "lat", "value", "threshold", "units", "description"]


def flags(check: str, values: dict[str, str], rest: str) -> str:
    """SELECT of all sixteen columns of a flag; columns without a value are null."""
    kinds = {"line": "VARCHAR", "i_start": "BIGINT", "i_end": "BIGINT", "time_start": "TIMESTAMP", "time_end": "TIMESTAMP", "units": "VARCHAR", "description": "VARCHAR"}
    values = {"check": f"'{check}'"} | values
    return "SELECT " + ", ".join(f'({values.get(c, "NULL")})::{kinds.get(c, "DOUBLE") if c != "check" else "VARCHAR"} AS "{c}"' for c in COLUMNS) + f" {rest}"


def _crossing(check: str, misfit: str, limit: float, text: str, source: str) -> str:
    at = {"line": "traverse || ' x ' || tie", "i_start": "i_traverse", "i_end": "i_traverse", "fid_start": "fid", "fid_end": "fid", "time_start": "time", "time_end": "time", "x": "x", "y": "y", "lon": "lon", "lat": "lat", "value": f"abs({misfit})", "threshold": f"{limit}", "units": "'nT'", "description": text}
    return flags(check, at, f"FROM {source} WHERE abs({misfit}) > {limit}")


def crossover_flags(limit: float) -> str:
    return _crossing("crossovers", "misfit", limit, f"traverse || ' crosses ' || tie || ' with ' || {_signed('misfit', 1)} || ' nT misfit'", "xo")


def residual_flags(limit: float) -> str:
    text = f"{_signed('misfit_after', 1)} || ' nT misfit at ' || traverse || ' x ' || tie || ' survives ' || \"order\" || ' levelling (was ' || {_signed('misfit', 1)} || ' nT)'"
    return _crossing("levelling_residual", "misfit_after", limit, text, "xl")


def headings(azimuth: float, source: str = "s") -> str:
    """CTEs after crossings: hb has a row a direction."""
    bearing = "atan2(arg_max(x, seq) - arg_min(x, seq), arg_max(y, seq) - arg_min(y, seq))"
    return f""", hd AS (SELECT line, {bearing} AS r FROM {source} WHERE line_type = 'traverse' GROUP BY line),
hf AS MATERIALIZED (SELECT line, r, abs((((degrees(r) - {azimuth} + 180) % 360 + 360) % 360) - 180) <= 90 AS forward FROM hd),
hn AS (SELECT forward, ((degrees(atan2(avg(sin(r)), avg(cos(r)))) % 360) + 360) % 360 AS m FROM hf GROUP BY forward),
hb AS MATERIALIZED (SELECT hf.forward, count(*) AS n, avg(misfit) AS mean_misfit, any_value((['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + (round_even(hn.m / 45, 0)::INT % 8)]) AS heading
  FROM xo JOIN hf ON hf.line = xo.traverse JOIN hn ON hn.forward = hf.forward GROUP BY hf.forward),
he AS (SELECT f.n AS fn, f.mean_misfit AS fm, f.heading AS fh, r.n AS rn, r.mean_misfit AS rm, r.heading AS rh, abs(f.mean_misfit - r.mean_misfit) AS value FROM hb f JOIN hb r ON f.forward AND NOT r.forward)"""


def heading_flags(limit: float, source: str = "s") -> str:
    side = lambda c: f"{c}h || '-bound (' || {_signed(c + 'm', 2)} || ' nT, n=' || {c}n || ')'"
    text = f"'mean crossover misfit differs by ' || {fixed('value', 2)} || ' nT between ' || {side('f')} || ' and ' || {side('r')} || ' traverses'"
    at = {c: f"m.{c}" for c in ("x", "y", "lon", "lat")} | {"value": "value", "threshold": f"{limit}", "units": "'nT'", "description": text}
    return flags("heading_error", at, f"FROM he, (SELECT avg(x) AS x, avg(y) AS y, avg(lon) AS lon, avg(lat) AS lat FROM {source} WHERE line_type = 'traverse') m WHERE value > {limit}")


def runs(mark: str, name: str, keys: str = "line", source: str = "s") -> str:
    """CTE: rows of source in unbroken runs of mark, numbered by run within keys."""
    return f""", {name}_m AS (SELECT *, coalesce({mark}, false) AS mark FROM {source}),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq) - row_number() OVER (PARTITION BY {keys}, mark ORDER BY seq) AS run FROM {name}_m) WHERE mark)"""


def run_flags(check: str, source: str, keys: str, value: str, threshold: str, units: str, text: str) -> str:
    """All sixteen columns of the runs of source; value and threshold are aggregates, text has value and v."""
    ends = {f"{c}_{e}": f"arg_{'min' if e == 'start' else 'max'}({c}, seq)" for c in ("i", "fid", "time") for e in ("start", "end")}
    at = {c: c for c in ends} | {c: f"({c}a + {c}b) / 2" for c in ("x", "y", "lon", "lat")} | {"line": "line", "value": "value", "threshold": "threshold", "units": f"'{units}'", "description": text}
    inner = ", ".join([f"{v} AS {c}" for c, v in ends.items()] + [f"arg_min({c}, seq) AS {c}a, arg_max({c}, seq) AS {c}b" for c in ("x", "y", "lon", "lat")])
    return flags(check, at, f"FROM (SELECT {keys}, {inner}, {value} AS value, {threshold} AS threshold FROM {source} GROUP BY {keys}, run)")


def segments(max_gap: float, source: str = "s") -> str:
    return f", sg AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY line, seg ORDER BY seq) AS pos, count(*) OVER (PARTITION BY line, seg) AS n FROM (SELECT *, sum(CASE WHEN dt > {max_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY seq) AS seg FROM {source}))"


def spikes(k: int, sigmas: float) -> str:
    """CTEs after segments, for a field without gaps: sp has amplitude, z and cleaned."""
    h = k // 2
    w = "OVER (PARTITION BY line, seg ORDER BY seq)"
    return f""", l AS (SELECT *, mag AS v, lag(mag) {w} AS b1, lag(mag, 2) {w} AS b2, lead(mag) {w} AS a1, lead(mag, 2) {w} AS a2 FROM sg),
d AS MATERIALIZED (SELECT *, CASE WHEN pos = 1 THEN 3 * v - 2 * a1 WHEN pos = 2 THEN 2 * b1 - v ELSE b2 END - 4 * CASE WHEN pos = 1 THEN 2 * v - a1 ELSE b1 END + 6 * v - 4 * CASE WHEN pos = n THEN 2 * v - b1 ELSE a1 END
     + CASE WHEN pos = n THEN 3 * v - 2 * b1 WHEN pos = n - 1 THEN 2 * a1 - v ELSE a2 END AS d4 FROM l),
m AS MATERIALIZED (SELECT *, abs(d4) AS size, CASE WHEN count(d4) OVER f = {k} THEN median(abs(d4)) OVER f END AS whole, median(abs(d4)) OVER (PARTITION BY line, seg) AS every,
     median(CASE WHEN pos < n THEN abs(d4) END) OVER (PARTITION BY line, seg) AS m1, median(CASE WHEN pos > 1 THEN abs(d4) END) OVER (PARTITION BY line, seg) AS m2
     FROM d WINDOW f AS (PARTITION BY line, seg ORDER BY seq ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
r AS MATERIALIZED (SELECT *, CASE WHEN n < 3 THEN size WHEN n >= {k} THEN coalesce(whole, CASE WHEN pos <= {h} THEN first_value(whole IGNORE NULLS) OVER u ELSE last_value(whole IGNORE NULLS) OVER u END)
     WHEN n % 2 = 1 THEN every WHEN pos <= n / 2 THEN m1 ELSE m2 END AS med FROM m WINDOW u AS (PARTITION BY line, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
z AS (SELECT *, d4 / greatest(1.4826::DOUBLE * max(med) OVER (PARTITION BY line, seg ORDER BY seq ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING), CASE WHEN every > 0 THEN 0.5::DOUBLE * 1.4826::DOUBLE * every ELSE 2.220446049250313e-16::DOUBLE END) AS zz FROM r),
q AS (SELECT *, coalesce(n >= 7 AND abs(zz) > {sigmas}, false) AS hit FROM z),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY line, seg, hit ORDER BY seq) AS grp FROM q),
sp AS MATERIALIZED (SELECT *, v - coalesce(amplitude, 0) AS cleaned FROM (SELECT *, CASE WHEN top THEN CASE WHEN pos <= 2 THEN v - (2 * a1 - a2) WHEN pos >= n - 1 THEN v - (2 * b1 - b2) ELSE d4 / 6 END END AS amplitude, CASE WHEN top THEN zz END AS z
     FROM (SELECT *, hit AND row_number() OVER (PARTITION BY line, seg, hit, grp ORDER BY size DESC, seq) = 1 AS top FROM g)))"""
