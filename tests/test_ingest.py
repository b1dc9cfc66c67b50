import datetime as dt
import random

import pytest

from fluxline.operators import grid, merge
from fluxline.sources import lines as L
from fluxline.sources import maglog, nmea, xyz

LINES = "file string, n long, value string"
UTC = dt.timezone.utc


def numbered(spark, text, file="a"):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(text.strip("\n").split("\n"), 1)], LINES)


def clock(t):
    return t.replace(tzinfo=None) if t.tzinfo is None else t.astimezone(UTC).replace(tzinfo=None)


XYZ = """
/ flown over the southern bank
/ EAST NORTH SECS FIELD HEIGHT
Line 20
-7.5 1e3 0.25 31850.75 112.5
-7.5 1007.5 0.5 NA 113

line 21
 40 990 86399.75 31849 -
tie 7
 0 1000 90000 *  99
"""


def test_xyz(spark, tmp_path):
    path = tmp_path / "bank.xyz"
    path.write_text(XYZ)
    df = xyz.read_xyz(L.read_lines(spark, str(path)), col_map={"x": "EAST", "y": "NORTH", "time": "SECS", "mag_raw": "FIELD", "radar_alt": "HEIGHT"}, time_origin="2022-12-31")
    rows = df.orderBy("i").collect()
    assert [(r.line, r.line_type, r.x, r.y, r.mag_raw) for r in rows] == [("20", "traverse", -7.5, 1000.0, 31850.75), ("20", "traverse", -7.5, 1007.5, None), ("21", "traverse", 40.0, 990.0, 31849.0), ("7", "tie", 0.0, 1000.0, None)]
    assert clock(rows[2].time) == dt.datetime(2022, 12, 31, 23, 59, 59, 750000) and clock(rows[3].time) == dt.datetime(2023, 1, 1, 1) and rows[3].radar_alt == 99
    for text, wrong, message in ((XYZ, {"x": "LON"}, "no column"), ("/ A B\nTie 3", None, "no data"), ("Tie 3\n4 5", None, "header")):
        with pytest.raises(ValueError, match=message):
            xyz.parse_xyz(numbered(spark, text), **({"col_map": wrong} if wrong else {}))


def sentence(body, checksum=None):
    x = 0
    for c in body:
        x ^= ord(c)
    return f"${body}*{checksum or format(x, '02X')}"


def plain_fixes(log, day):
    """Fixes of GGA sentences by a loop: (time, lat, lon, alt); day is the date of the first, and a time of day that falls by over half a day starts a new one."""
    out, before = [], None
    for s in log:
        body, _, check = s[1:].partition("*")
        f = body.split(",")
        if f[0][2:] != "GGA" or sentence(body)[-2:] != check:
            continue
        t = int(f[1][:2]) * 3600 + int(f[1][2:4]) * 60 + float(f[1][4:])
        day += dt.timedelta(days=before is not None and t - before < -43200)
        before = t
        angle = lambda v, n, side: (int(v[:n]) + float(v[n:]) / 60) * (-1 if side in "SW" else 1)
        out.append((day + dt.timedelta(seconds=t), angle(f[2], 2, f[3]), angle(f[4], 3, f[5]), float(f[9]) if f[9] else None))
    return out


def test_nmea_of_two_midnights_in_the_south(spark):
    rng, day, t = random.Random(6), dt.datetime(2020, 2, 28), 80_000.0
    log = []
    for k in range(40):  # a fix about every hour and a half, from the eve of a leap day on
        stamp = f"{int(t // 3600) % 24:02}{int(t // 60) % 60:02}{t % 60:05.2f}"
        place = f"{30 + k % 5}{rng.uniform(0, 59):07.4f},S,{141 + k % 3}{rng.uniform(0, 59):07.4f},E"
        log.append(sentence(f"GNGGA,{stamp},{place},2,11,0.7,{'' if k % 9 == 4 else rng.randrange(300)},M,0,M,,", "00" if k % 13 == 6 else None))
        t = (t + 5000.25) % 86400
    log.insert(0, sentence(f"GNRMC,{log[0][7:16]},A,3000.0,S,14100.0,E,10,90,280220"))
    want = plain_fixes(log, day)
    got = nmea.parse_nmea(numbered(spark, "\n".join(log))).orderBy("time").collect()
    assert [(clock(r.time), round(r.lat, 9), round(r.lon, 9), r.alt) for r in got] == [(w[0], round(w[1], 9), round(w[2], 9), w[3]) for w in want]
    assert want[-1][0].date() == dt.date(2020, 3, 2) and dt.date(2020, 2, 29) in {w[0].date() for w in want}
    assert tuple(nmea.counts(numbered(spark, "\n".join(log))).first()) == ("a", 41, 3) and got[0].speed == pytest.approx(5.14444)


def test_nmea_dates(spark):
    fix = lambda t: sentence(f"GPGGA,{t},0030.0,S,00115.0,E,1,9,1.1,20,M,0,M,,")
    undated = [fix("120000"), fix("120002.5")]
    with pytest.raises(Exception, match="pass date"):
        nmea.parse_nmea(numbered(spark, "\n".join(undated))).collect()
    assert clock(nmea.parse_nmea(numbered(spark, "\n".join(undated)), "2019-07-04").agg({"time": "max"}).first()[0]) == dt.datetime(2019, 7, 4, 12, 0, 2, 500000)
    later = [*undated, sentence("GPZDA,120003.00,04,07,2019")]
    assert clock(nmea.parse_nmea(numbered(spark, "\n".join(later))).agg({"time": "min"}).first()[0]) == dt.datetime(2019, 7, 4, 12)
    # a new date soon after midnight, where a fix has come without one: not a day too late
    over = [sentence("GPRMC,235957,A,0030.0,S,00115.0,E,1,1,311219"), fix("235958"), fix("000001"), sentence("GPRMC,000001.5,A,0030.0,S,00115.0,E,1,1,010120"), fix("000003")]
    assert [clock(r.time) for r in nmea.parse_nmea(numbered(spark, "\n".join(over))).orderBy("time").collect() if r.alt is not None] == [dt.datetime(2019, 12, 31, 23, 59, 58), dt.datetime(2020, 1, 1, 0, 0, 1), dt.datetime(2020, 1, 1, 0, 0, 3)]


def test_mag_logs(spark):
    caesium = numbered(spark, "# sortie 9\n$  28001.5,901,23:59:59.750\n!28003\n$ *****,902,00:00:00.000\n$ 28000.25,,00:00:00.250")
    rows = maglog.parse_mag_log(caesium, "geometrics", "2021-12-31").orderBy("n").collect()
    assert [(r.mag_raw, r.signal, clock(r.time)) for r in rows] == [(28001.5, 901.0, dt.datetime(2021, 12, 31, 23, 59, 59, 750000)), (28000.25, None, dt.datetime(2022, 1, 1, 0, 0, 0, 250000))]
    with pytest.raises(ValueError, match="date"):
        maglog.parse_mag_log(caesium)
    potassium = numbered(spark, "station  17\n 61234.5  88  070809.5\n 61235   87 070810\n")
    rows = maglog.parse_mag_log(potassium, "gem", "2018-01-02").orderBy("n").collect()
    assert [clock(r.time) for r in rows] == [dt.datetime(2018, 1, 2, 7, 8, 9, 500000), dt.datetime(2018, 1, 2, 7, 8, 10)] and rows[1].signal == 87


@pytest.mark.parametrize("kind, rate, second", [("seconds", None, dt.datetime(2017, 5, 6, 0, 2, 5, 500000)), ("elapsed", None, dt.datetime(2017, 5, 6, 20, 32, 5, 500000)), ("index", 4.0, dt.datetime(2017, 5, 6, 20, 30, 0, 250000))])
def test_mag_times_of_other_kinds(spark, kind, rate, second):
    form = maglog.MagFormat(sep=";", skip=2, time=kind, rate=rate, columns={"time": 2, "mag": 3, "temp": 1}, na=("-",))
    rows = maglog.parse_mag_log(numbered(spark, "logger 3\ntemp;t;nT\n21;120.0;44000\n-;125.5;44001.5;\n20;130;-"), form, "2017-05-06 20:30:00").orderBy("n").collect()
    assert [(r.mag_raw, r.temp) for r in rows] == [(44000.0, 21.0), (44001.5, None)] and clock(rows[1].time) == second


def test_mag_times_with_dates_and_bad_formats(spark):
    form = maglog.MagFormat(sep=r"\s*\|\s*", time="datetime", time_format="%d.%m.%Y %H-%M-%OS", columns={"mag": 2, "time": 1}, strip="^>+")
    rows = maglog.parse_mag_log(numbered(spark, ">> 29.02.2020 23-59-59.5 | 50\n>01.03.2020 00-00-00|51.5\n>31.02.2020 00-00-00|52"), form).orderBy("n").collect()
    assert [(clock(r.time), r.mag_raw) for r in rows] == [(dt.datetime(2020, 2, 29, 23, 59, 59, 500000), 50.0), (dt.datetime(2020, 3, 1), 51.5)]
    for bad, message in (({"columns": {"time": 3, "height": 2}}, "mag"), ({"columns": {"mag": 2}, "time": "elapsed"}, "time"), ({"time": "index", "columns": {"mag": 1}}, "rate"), ({"time": "epoch"}, "unknown")):
        with pytest.raises(ValueError, match=message):
            maglog.MagFormat(**bad)


def test_streams_merge_with_lag_and_gaps(spark):
    t0 = dt.datetime(2024, 6, 14, 8)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    gps = spark.createDataFrame([(at(k), 43.2 + 1e-4 * k, -108.5, 1600.0) for k in range(21) if not 8 <= k <= 14] + [(at(3), 0.0, 0.0, 0.0), (at(4.5), None, 1.0, 1.0)], "time timestamp, lat double, lon double, alt double").filter("lat IS NULL OR lat > 1")
    mag = spark.createDataFrame([(at(k / 10), 52000.0) for k in range(201)], "time timestamp, mag_raw double")
    got = {clock(r.time): r for r in merge.merge_streams(mag, gps, lag=0.5, max_gap=2).collect()}
    assert got[clock(at(1))].lat == pytest.approx(43.2 + 0.5e-4) and clock(at(11)) not in got and clock(at(0.4)) not in got
    assert sorted(r.fid for r in got.values()) == list(range(1, len(got) + 1))
    with pytest.raises(ValueError, match="two usable"):
        merge.merge_streams(mag, gps.limit(1))
    with pytest.raises(ValueError, match="mag_raw"):
        merge.merge_streams(mag.drop("mag_raw"), gps)


def test_merge_keeps_altitudes_with_their_samples(spark):
    """Numbers of samples are taken once: any layout of the input gives each sample its own altitude."""
    at = lambda s: dt.datetime(2021, 3, 4, 5) + dt.timedelta(seconds=s)
    gps = spark.createDataFrame([(at(k), 10.0 + 1e-4 * k, 20.0, None if k % 4 == 1 else 100.0 + k) for k in range(60)], "time timestamp, lat double, lon double, alt double")
    mag = spark.createDataFrame([(at(k / 4 + 0.1), float(k)) for k in range(230)], "time timestamp, mag_raw double")
    for shuffled in (mag.repartition(7), mag.repartition(3, "mag_raw").sort("mag_raw"), mag.coalesce(1)):
        rows = merge.merge_streams(shuffled, gps.repartition(5)).collect()
        assert len(rows) == 230 and all(r.gps_alt == pytest.approx(100 + r.mag_raw / 4 + 0.1) and r.lat == pytest.approx(10 + 1e-4 * (r.mag_raw / 4 + 0.1)) for r in rows)
    with pytest.raises(ValueError, match="no sample"):
        merge.merge_streams(mag, gps, lag=1e5)


def test_planes_at_nodes_and_growing_masks(spark):
    rng = random.Random(13)
    rows = [(rng.uniform(-900, 100), rng.uniform(300, 900)) for _ in range(3000)]
    plane = spark.createDataFrame([(x, y, 31000 - 0.03 * x + 0.004 * y) for x, y in rows], "x double, y double, mag double")
    at = grid.frame_of(plane, "mag", 80.0)
    assert at.x0 <= min(r[0] for r in rows) < at.x0 + 80 and at.x0 + 80 * (at.nx - 1) >= max(r[0] for r in rows)
    for r in grid.bin_plane(plane, "mag", at).filter("n > 5").collect():
        assert r.v == pytest.approx(31000 - 0.03 * (at.x0 + 80 * r.ix) + 0.004 * (at.y0 + 80 * r.iy), abs=0.05)
    cells = {(0, 0), (6, 3), (6, 4)}
    mask = spark.createDataFrame([(*c, 1.0) for c in cells], "ix int, iy int, v double")
    for k in (0, 1, 3):
        grown = {(i, j) for i in range(9) for j in range(7) if any(max(abs(i - a), abs(j - b)) <= k for a, b in cells)}
        assert {(r.ix, r.iy) for r in grid.dilate(mask, k, grid.Frame(0.0, 0.0, 9, 7, 1.0)).collect()} == grown
    for cell, some in ((-1, plane), (80, plane.limit(9))):
        with pytest.raises(ValueError):
            grid.frame_of(some, "mag", cell)
