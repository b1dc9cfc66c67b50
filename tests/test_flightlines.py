"""Lines of a flight against a plain reimplementation on one flight, and the cases that decide what a line is."""

import math
import random
from datetime import datetime, timedelta

import pytest

from fluxline.operators import flightlines

T0 = datetime(2023, 3, 5, 6, 0, 0)


def fly(legs, speed=50.0, hz=2):
    """(time, x, y) of legs (x, y, heading, seconds, further turn in degrees a second), each from its own start, a second apart."""
    out, t = [], 0.0
    for x, y, heading, seconds, turn in legs:
        for i in range(int(seconds * hz)):
            out.append((T0 + timedelta(seconds=t), x, y))
            h = math.radians(heading + turn * i / hz)
            x, y, t = x + speed / hz * math.sin(h), y + speed / hz * math.cos(h), t + 1 / hz
    return out


def turn(x, y, heading, side):
    return (x, y, heading, 30, 6 * side)


RACE = [
    (0, 0, 0, 60, 0), turn(0, 3000, 0, 1), (400, 3000, 180, 60, 0), turn(400, 0, 180, -1), (800, 0, 0, 60, 0), turn(800, 3000, 0, 1), (1200, 3000, 180, 60, 0), turn(1200, 0, 180, -1),
    (-500, 500, 90, 50, 0), turn(2000, 500, 90, -1), (2000, 1500, 270, 50, 0),
]


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(t, float(x), float(y), *rest) for t, x, y, *rest in rows], "time timestamp, x double, y double" + extra)


def segments(found):
    return {r.line: r for r in found.segments.collect()}


def test_racetrack(spark):
    rows = fly(RACE)
    found = flightlines.assign_lines(frame(spark, rows))
    s = segments(found)
    assert sorted(s) == ["L1000", "L1010", "L1020", "L1030", "T9000", "T9010"]
    assert [round(s[f"L10{i}0"].heading) % 360 for i in range(4)] == [0, 180, 0, 180] and s["T9000"].line_type == "tie"
    kept = found.samples.collect()
    assert found.n_turns > 0 and found.n_turns == len(rows) - len(kept) and {r.line for r in kept} == set(s)
    assert {r.line: r.dir for r in kept}["L1010"] == "S" and {r.dir for r in kept if r.line == "T9010"} == {"W"}
    assert max(r.x for r in kept if r.line == "L1000") < min(r.x for r in kept if r.line == "L1010")
    every = flightlines.assign_lines(frame(spark, rows), drop_turns=False).samples
    assert every.filter("line IS NULL").count() == found.n_turns and every.count() == len(rows)


def test_east_west_axis_and_azimuth(spark):
    rows = fly(RACE)
    s = segments(flightlines.assign_lines(frame(spark, rows), azimuth=270))
    assert sorted((k, v.line_type, round(v.heading)) for k, v in s.items() if k[0] == "L") == [("L1000", "traverse", 90), ("L1010", "traverse", 270)]
    assert len([k for k in s if k[0] == "T"]) == 4
    with pytest.raises(ValueError, match="pass azimuth"):
        flightlines.assign_lines(frame(spark, rows), azimuth=45)


def test_gap_and_wobble_stay_one_line_and_a_shift_does_not(spark):
    straight = fly([(0, 0, 20, 120, 0)])
    gap = [(t + timedelta(seconds=30 if i > 100 else 0), x + (1500 * math.sin(math.radians(20)) if i > 100 else 0), y + (1500 * math.cos(math.radians(20)) if i > 100 else 0)) for i, (t, x, y) in enumerate(straight)]
    s = segments(flightlines.assign_lines(frame(spark, gap)))
    assert list(s) == ["L1000"] and s["L1000"].n == len(gap)
    wobble = [(t, x + (15 if i in (120, 121) else 0), y) for i, (t, x, y) in enumerate(straight)]
    found = flightlines.assign_lines(frame(spark, wobble))
    assert list(segments(found)) == ["L1000"] and 0 < found.n_turns < 30
    shift = [(t, x + (80 if i > 120 else 0), y) for i, (t, x, y) in enumerate(straight)]
    assert sorted(segments(flightlines.assign_lines(frame(spark, shift)))) == ["L1000", "L1010"]


def test_spread_transit_and_short_runs_are_no_lines(spark):
    slow = (3000, 0, 0, 90, 0.8)
    transit = (5000, 0, 40, 60, 0)
    short = (7000, 0, 0, 8, 0)
    rows = fly([RACE[0], RACE[1], slow, turn(0, 0, 72, 1), transit, turn(0, 0, 40, 1), short, turn(0, 0, 0, 1), RACE[2]])
    assert sorted(segments(flightlines.assign_lines(frame(spark, rows)))) == ["L1000", "L1010"]
    assert len(segments(flightlines.assign_lines(frame(spark, rows), max_spread=40, max_off_axis=45))) > 2


def test_flights_apart(spark):
    rows = [(*r, f) for f in ("b", "a") for r in fly([(0 if f == "a" else 400, 0, 0, 60, 0)])]
    found = flightlines.assign_lines(frame(spark, rows, ", sortie string").repartition(7), "sortie")
    assert {(r.flight, r.line) for r in found.segments.collect()} == {("a", "L1000"), ("b", "L1010")} and found.n_turns == 0
    assert found.samples.columns == ["time", "x", "y", "sortie", "line", "line_type", "dir"]


def test_errors(spark):
    rows = fly([(0, 0, 0, 60, 0)])
    with pytest.raises(ValueError, match="no column y"):
        flightlines.assign_lines(frame(spark, rows).drop("y"))
    with pytest.raises(ValueError, match="too few"):
        flightlines.assign_lines(frame(spark, rows[:9]))
    with pytest.raises(ValueError, match="no straight run"):
        flightlines.assign_lines(frame(spark, rows), min_length=1e6)


def test_plan_renames(spark):
    plan = spark.createDataFrame([("west", -30.0, -9e3, -30.0, 0.0), ("none", 400.0, 0.0, 400.0, 0.0), ("oblique", 700.0, 0.0, 900.0, 3000.0), ("far", 1300.0, 0.0, 1300.0, 10.0)], "line string, x0 double, y0 double, x1 double, y1 double")
    found = flightlines.assign_lines(frame(spark, fly(RACE)), plan=plan).segments.collect()
    assert sorted(r.line for r in found) == ["L1010", "L1030", "T9010", "oblique", "oblique", "west"]  # the oblique line also passes the southern tie's middle
    assert {r.line_type for r in found if r.line == "west"} == {"traverse"}
    s = segments(flightlines.assign_lines(frame(spark, fly(RACE)), plan=plan.selectExpr("*", "'tie' AS line_type"), tolerance=150))
    assert s["west"].line_type == "tie" and "far" in s


def test_nearest_lines_equal_all_pairs(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-5000, 5000), rng.uniform(0, 20000)) for i in range(300)]
    lines = []
    for i in range(120):
        x, y, a = rng.uniform(-6000, 6000), rng.uniform(-1000, 21000), rng.choice([0, 90, rng.uniform(0, 180)])
        lines.append((f"p{i:03}", None, x, y, x + 100 * math.sin(math.radians(a)), y + 100 * math.cos(math.radians(a))))
    lines.append(("p000b", None, *lines[0][2:]))
    want = {}
    for i, cx, cy in points:
        far = [(abs((x1 - x0) * (y0 - cy) - (x0 - cx) * (y1 - y0)) / math.hypot(x1 - x0, y1 - y0), n) for n, _, x0, y0, x1, y1 in lines]
        d, n = min(far)
        if d <= 60:
            want[i] = (n, round(d, 6))
    p = spark.createDataFrame(points, "id int, cx double, cy double")
    got = flightlines.nearest_lines(p, ["id"], spark.createDataFrame(lines, "line string, line_type string, x0 double, y0 double, x1 double, y1 double"), 60)
    assert {r.id: (r.to_line, round(r.distance, 6)) for r in got.collect()} == want and len(want) > 50


def plain_runs(rows, window=3.0, most=1.0, gap=10.0):
    """Run number of each sample, None in turns."""
    t = [(r[0] - T0).total_seconds() for r in rows]
    n, steps = len(rows), sorted(b - a for a, b in zip(t, t[1:]))
    middle = (steps[(n - 2) // 2] + steps[(n - 1) // 2]) / 2
    k = max(3, round(window / middle))
    k += k % 2 == 0
    smooth = lambda v: [sum(v[max(0, i - k // 2) : i + k // 2 + 1]) / len(v[max(0, i - k // 2) : i + k // 2 + 1]) for i in range(n)]
    x, y = smooth([r[1] for r in rows]), smooth([r[2] for r in rows])
    h = [math.degrees(math.atan2(x[i + 1] - x[i], y[i + 1] - y[i])) % 360 for i in range(n - 1)]
    h.append(h[-1])
    rate = smooth([abs((h[i + 1] - h[i] + 180) % 360 - 180) / (t[i + 1] - t[i]) for i in range(n - 1)] + [0.0])
    out, run = [], 0
    for i in range(n):
        if rate[i] < most:
            run += i == 0 or not rate[i - 1] < most or t[i] - t[i - 1] > gap
            out.append(run)
        else:
            out.append(None)
    return out


def test_straight_runs_equal_a_plain_loop(spark):
    rng = random.Random(8)
    for hz in (1, 2, 4):
        rows = [(t + timedelta(seconds=40 * (i > 150)), x + rng.gauss(0, 0.2), y + rng.gauss(0, 0.2)) for i, (t, x, y) in enumerate(fly(RACE[:5], hz=hz))]
        df = frame(spark, rows).selectExpr("'f' AS flight", "*").repartition(5)
        got = [r.run for r in flightlines.straight_runs(df).orderBy("seq").collect()]
        assert got == plain_runs(rows)
