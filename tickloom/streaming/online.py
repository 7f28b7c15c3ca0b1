"""Online detection on streams of counter samples: windowed sums, then a state per stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_sums(samples: DataFrame, counters: Sequence[str], time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sum of each counter per stream and window; samples later than ``late`` are dropped, windows are given out once closed."""
    keyed = samples.withWatermark(time, late).groupBy("run_id", "cpu_or_core_id", F.window(time, width))
    sums = keyed.agg(*[F.sum(F.when(F.col("counter") == c, F.col("value"))).alias(f"counter__{c}") for c in counters])
    return sums.select("run_id", "cpu_or_core_id", F.unix_millis("window.start").cast("double").alias("timestamp_ms"), *[f"counter__{c}" for c in counters])


OUT = "run_id string, timestamp_ms double, state int, run_length int, action int, history array<int>"
STATE = "history array<int>, run_length int, last int, pending int, action int, seen double"


def detector(low: float, high: float, value: str, history: int = 4, silence_ms: int = 86_400_000):
    """Function for ``applyInPandasWithState``: state by two cuts, run length, last states, confirmed action.

    The stored state is a few numbers per stream, whatever its length, and goes once
    the stream has been silent for ``silence_ms``; it then begins anew.  Rows of one
    batch are put in order of time; a row that is not later than what was seen is
    dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], stored: GroupState) -> Iterator[pd.DataFrame]:
        if stored.hasTimedOut:
            stored.remove()
            return
        past, run, last, pending, action, seen = stored.get if stored.exists else ([], 0, -1, -1, 1, float("-inf"))
        past = list(past)
        out = []
        rows = pd.concat(list(frames)).sort_values("timestamp_ms")
        given = pd.to_numeric(rows[value])
        states = given.ge(low).astype(int).add(given.ge(high).astype(int)).mask(given.isna(), -1)
        for at, state in zip(rows["timestamp_ms"].tolist(), states.tolist()):
            if at <= seen:
                continue
            seen = float(at)
            run = run + 1 if state == last and past else 1
            if pending == state and past:
                action = max(0, min(2, state))
            last = pending = state
            past = [*past, state][-history:]
            out.append((key[0], seen, state, run, action, list(past)))
        stored.update((past, run, last, pending, action, seen))
        stored.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=["run_id", "timestamp_ms", "state", "run_length", "action", "history"])

    return step


def detect(intervals: DataFrame, value: str, low: float, high: float, history: int = 4, silence_ms: int = 86_400_000) -> DataFrame:
    """Detections of a stream of closed intervals, one per interval."""
    return intervals.groupBy("run_id").applyInPandasWithState(detector(low, high, value, history, silence_ms), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
