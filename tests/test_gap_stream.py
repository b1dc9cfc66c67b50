"""The gap monitor over replayed files against the check on the whole table."""

import random
from datetime import datetime, timedelta

import pytest

from fluxline.operators import checks
from fluxline.operators.survey import as_survey
from fluxline.spec import SurveySpec
from fluxline.streaming import gaps

T0 = datetime(2024, 5, 6, 7, 8, 9)
SCHEMA = "line string, time timestamp, x double, y double, mag double"


def flown(seed=3):
    """Four lines of samples a second, with pauses of various lengths, and one far later sample that lets all others pass."""
    rng = random.Random(seed)
    rows, t = [], 0.0
    for line in "ABCA":
        for _ in range(60):
            rows.append((line, T0 + timedelta(seconds=t), t, 0.0, 1.0))
            t += rng.choice([1.0] * 12 + [1.5, 2.5, 9.0, 40.25])
        t += 30
    return rows


@pytest.mark.parametrize("size, shuffled", [(7, 0), (40, 0), (500, 0), (25, 4)])
def test_replay_gives_the_flags_of_the_check(spark, tmp_path, size, shuffled):
    rows, rng = flown(), random.Random(size)
    if shuffled:  # neighbours change places, well within the delay
        for i in range(0, len(rows) - shuffled, shuffled):
            part = rows[i : i + shuffled]
            rng.shuffle(part)
            rows[i : i + shuffled] = part
    later = [("Z", T0 + timedelta(days=1), 0.0, 0.0, 0.0)], [("Z", T0 + timedelta(days=2), 0.0, 0.0, 0.0)]
    for n, part in enumerate([*(rows[i : i + size] for i in range(0, len(rows), size)), *later]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:04}"))
    out = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = gaps.watch(stream, 2.0, "200 seconds").writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    flags = checks.sample_interval(as_survey(spark.createDataFrame(rows, SCHEMA)), SurveySpec(max_gap=2.0)).flags.collect()
    got = sorted((r.line, r.time_start, r.time_end) for r in out if r.event == "gap" and r.line != "Z")
    assert got == sorted((f.line, f.time_start, f.time_end) for f in flags) and len(got) > 10
    ends = {(r.line, r.time_start) for r in out if r.event == "end"}
    assert {(x, max(r[1] for r in rows if r[0] == x)) for x in "ABC"} <= ends


def test_times_in_order():
    import numpy as np

    events, last, ended = gaps.in_order(5, True, np.array([6, 20, 21]), 3)
    assert events == [("gap", 6, 20)] and last == 21 and ended is False
    assert gaps.in_order(None, False, np.array([], int), 3) == ([], None, False)
