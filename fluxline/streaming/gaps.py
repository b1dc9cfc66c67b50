"""Gaps of a survey as it is flown: a stream of samples in, a stream of gaps and ends of segments out, as soon as no earlier sample can still come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What has been told of a line: the last sample in order, whether its end was told, and samples that wait for their turn. Times are microseconds.
STATE = "last long, ended boolean, waiting array<long>"
OUT = "line string, event string, time_start timestamp, time_end timestamp, seconds double"


def in_order(last: int | None, ended: bool, times: np.ndarray, max_gap: int) -> tuple[list[tuple], int | None, bool]:
    """Gaps (from, to) between sorted times and the last one before them, and the last one after them."""
    out = []
    for t in times.tolist():
        if last is not None and t - last > max_gap:
            out.append(("gap", last, t))
        last, ended = t, False
    return out, last, ended


def watch(samples: DataFrame, max_gap: float, delay: str = "10 seconds") -> DataFrame:
    """(line, event, time_start, time_end, seconds) of a stream of samples (line, time, ...): "gap" for each pause of over max_gap seconds between two samples
    of a line, as the batch check finds them, and "end" (time_end null) once a line has been silent for longer than that.

    Samples may come in any order within delay: each waits in its line's state until the watermark has passed it, and timers wake a line that gets no more of
    them. A sample later than that is dropped, as the watermark promises. Null lines are a line; null times are left out. Equal times count once.
    """
    most = round(max_gap * 1e6)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended, waiting = state.get if state.exists else (None, False, [])
        came = [] if state.hasTimedOut else [p["micros"].to_numpy(np.int64) for p in parts]
        times = np.unique(np.concatenate([np.asarray(waiting if waiting is not None else [], np.int64), *came]))
        seen = state.getCurrentWatermarkMs() * 1000
        ready, times = times[times <= seen], times[times > seen]
        events, last, ended = in_order(last, bool(ended), ready, most)
        if last is not None and not ended and seen - last > most and not (len(times) and times[0] - last <= most):
            events.append(("end", last, None))
            ended = True
        if len(times) or not ended:
            state.update((last, ended, times.tolist()))
            wake = times[0] if len(times) else (last if last is not None else seen) + most
            state.setTimeoutTimestamp(max(int(wake) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.update((last, ended, []))
        yield pd.DataFrame(
            {
                "line": [key[0]] * len(events), "event": [e[0] for e in events], "time_start": pd.to_datetime([e[1] for e in events], unit="us"), "time_end": pd.to_datetime([e[2] for e in events], unit="us"),
                "seconds": [None if e[2] is None else (e[2] - e[1]) / 1e6 for e in events],
            }
        )

    rows = samples.filter("time IS NOT NULL").select(F.col("line").cast("string").alias("line"), F.col("time").cast("timestamp").alias("time")).withColumn("micros", F.unix_micros("time"))
    return rows.withWatermark("time", delay).groupBy("line").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
