"""Online scoring: the last states of each stream and a stored tree's prediction of the next one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.forest import Node

OUT = "run_id string, timestamp_ms double, state int, run_length int, action int, prediction int"
_ROW = "timestamp_ms double, state int"
_RUN = "run_length int, last int, action int, seen double"
#: The store that keeps lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started inside keep their state in the store that lists and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _walk(node: Node, x: dict[str, float]) -> int:
    while node.feature is not None:
        node = node.left if x[node.feature] <= node.threshold else node.right
    return node.prediction


class Scorer(StatefulProcessor):
    """States by two cuts, run lengths, confirmed actions and predictions, in order of event time.

    Rows wait in a list until the watermark has passed them, so neither their order nor
    the clock matters; a timer at the first one's time takes all that is due, and the next is set to
    the first that still waits.  Calls to the store cost more than the rows, so those of a stream that
    come together are stored by one.  Kept by stream: the
    rows that wait, the last ``history`` states, and four numbers.  All goes once the
    watermark is ``silence_ms`` past the last row.
    """

    def __init__(self, value: str, low: float, high: float, tree: Node, history: int, silence_ms: int, start: int = 1):
        self.value, self.low, self.high, self.tree, self.history, self.silence_ms, self.start = value, low, high, tree, history, silence_ms, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.past = handle.getListState("past", _ROW)
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run = self.run.get()
        seen = run[3] if run else float("-inf")
        new = []
        for batch in rows:
            values = pd.to_numeric(batch[self.value])
            states = values.ge(self.low).astype(int).add(values.ge(self.high).astype(int)).mask(values.isna(), -1)
            for at, state in zip(batch["timestamp_ms"].tolist(), states.tolist()):
                if at > seen:
                    new.append((float(at), int(state)))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(int(min(new)[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in waiting if int(r[0]) <= now]
        run = self.run.get()
        length, last, action, seen = run if run else (0, -1, self.start, float("-inf"))
        out = []
        if ready:
            past = [tuple(r) for r in self.past.get()] if self.past.exists() else []
            for at, state in ready:
                if at <= seen:
                    continue
                if past and state == last:
                    length, action = length + 1, max(0, min(2, state))
                else:
                    length = 1
                last, seen = state, at
                past = [*past, (at, state)][-self.history :]
                said = _walk(self.tree, {f"h{i}": s for i, (_, s) in enumerate(past)}) if len(past) == self.history else None
                out.append((key[0], at, state, length, action, said))
            self.waiting.clear()
            if rest := waiting[len(ready) :]:
                self.waiting.put(rest)
                self.handle.registerTimer(int(rest[0][0]))
            self.past.put(past)
            self.run.update((length, last, action, seen))
        if len(ready) == len(waiting) and (run or ready):
            if now >= seen + self.silence_ms:
                self.waiting.clear()
                self.past.clear()
                self.run.clear()
            elif ready:
                self.handle.registerTimer(int(seen) + self.silence_ms)
        frame = pd.DataFrame(out, columns=["run_id", "timestamp_ms", "state", "run_length", "action", "prediction"])
        frame["prediction"] = frame["prediction"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


def scored(intervals: DataFrame, value: str, low: float, high: float, tree: Node, history: int = 4, silence_ms: int = 86_400_000, key: Sequence[str] = ("run_id",)) -> DataFrame:
    """Detections and predictions of a stream of closed intervals with a watermark, one row per interval; no prediction before ``history`` rows.

    ``tree`` reads h0, h1, ... the last ``history`` states, oldest first.  Start the stream
    inside ``state_store``.
    """
    return intervals.groupBy(*key).transformWithStateInPandas(Scorer(value, low, high, tree, history, silence_ms), OUT, "Append", "EventTime")
