"""Column functions: finite values, local metres and degrees, bearings, lines and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def or_null(c: Column) -> Column:
    """NaN and infinity as null."""
    c = c.cast("double")
    return F.when(finite(c), c)


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / F.lit(1e6)


def metres_per_degree(lat0: Column, lat: Column) -> tuple[Column, Column]:
    """WGS 84 series: metres a degree of longitude (at the mean latitude) and of latitude (at lat0)."""
    m = F.radians((lat0 + lat) / 2)
    p = F.radians(lat0)
    lon = 111412.84 * F.cos(m) - 93.5 * F.cos(3 * m) + 0.118 * F.cos(5 * m)
    return lon, 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)


def enu_to_lonlat(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    lat = F.lit(float(lat0)) + y / metres_per_degree(F.lit(float(lat0)), F.lit(float(lat0)))[1]
    return F.lit(float(lon0)) + x / metres_per_degree(F.lit(float(lat0)), lat)[0], lat


def lonlat_to_enu(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    mlon, mlat = metres_per_degree(lat0, lat)
    return (lon - lon0) * mlon, (lat - lat0) * mlat


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def compass(b: Column) -> Column:
    names = F.array(*(F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.when(b.isNotNull(), F.element_at(names, (F.pmod(F.rint(b / 45), F.lit(8)) + 1).cast("int")))


def mean_bearing(b: Column) -> Column:
    """Aggregate: the circular mean."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(b))), F.avg(F.cos(F.radians(b))))), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def intersection(px, py, pdx, pdy, qx, qy, qdx, qdy) -> tuple[Column, Column]:
    """Where two lines (point and direction) meet; null if they are parallel."""
    den = pdx * qdy - pdy * qdx
    t = F.when(F.abs(den) >= 1e-12, ((qx - px) * qdy - (qy - py) * qdx) / den)
    return px + t * pdx, py + t * pdy


def point_line_distance(x, y, x0, y0, x1, y1) -> Column:
    """Metres to the infinite line through two points; infinite if that is not finite."""
    d = F.abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / F.hypot(x1 - x0, y1 - y0)
    return F.when(finite(d), d).otherwise(F.lit(float("inf")))


def dipole_anomaly(x: Column, y: Column, height: Column, moment: Column, inclination: float, declination: float) -> Column:
    """Total-field anomaly of an induced point dipole at the origin, seen from x east, y north, height up."""
    i, d = F.radians(F.lit(float(inclination))), F.radians(F.lit(float(declination)))
    r = F.sqrt(x * x + y * y + height * height)
    along = F.cos(i) * F.sin(d) * x + F.cos(i) * F.cos(d) * y - F.sin(i) * height
    return moment * (3 * along * along / F.pow(r, 5) - 1 / F.pow(r, 3))


def fixed(c: Column, digits: int) -> Column:
    """C's %.nf, for values that a decimal half does not decide."""
    return F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))


def signed(c: Column, digits: int) -> Column:
    """C's %+.nf."""
    return F.format_string(f"%+.{digits}f", F.bround(c.cast("double"), digits))


def general(v: float) -> str:
    """C's %g of a parameter."""
    return f"{v:g}"


def signif(c: Column, digits: int = 3) -> Column:
    p = digits - 1 - F.floor(F.log10(F.abs(c)))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * F.pow(F.lit(10.0), p)) / F.pow(F.lit(10.0), p))


def hms(c: Column, digits: int = 2) -> Column:
    """Seconds of a day as hhmmss.ss, rounded before it is split."""
    units = F.rint(c * 10**digits).cast("long")
    whole = F.floor(units / 10**digits)
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    text = F.concat(two(F.floor(whole / 3600) % 24), two(F.floor(whole / 60) % 60), two(whole % 60))
    return F.concat(text, F.lit("."), F.lpad((units % 10**digits).cast("string"), digits, "0"))
