"""The stream's detections are those of the batch operators on the same rows."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import forest, merge, phases, sequences
from tickloom.sources import adapter, readers
from tickloom.streaming import online, perf, scoring


def test_stream_equals_batch(spark, sf, tmp_path):
    events = adapter.table(spark, sf, "events").where("user_id < 4").select(
        F.col("user_id").cast("string").alias("run_id"), F.lit("0").alias("cpu_or_core_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("instructions_retired").alias("counter"), "value"
    )
    # one file in order of time, then a far later row that closes the last window
    end = events.agg(F.max("ts")).first()[0]
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    closing = spark.createDataFrame([("z", "0", end.replace(year=end.year + 1), "instructions_retired", 0.0)], events.schema)
    closing.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    sums = online.windowed_sums(source, ["instructions_retired"])
    run = sums.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "sums")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = merge.pivot_sum(events.withColumn("timestamp_ms", F.unix_millis(F.date_trunc("day", "ts")).cast("double")), ["instructions_retired"])
    got = {(r.run_id, r.timestamp_ms): r.counter__instructions_retired for r in spark.read.parquet(str(tmp_path / "sums")).where("run_id <> 'z'").collect()}
    want = {(r.run_id, r.timestamp_ms): r.counter__instructions_retired for r in batch.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

    low, high = 20.0, 40.0
    closed = spark.readStream.schema(spark.read.parquet(str(tmp_path / "sums")).schema).parquet(str(tmp_path / "sums"))
    found = online.detect(closed, "counter__instructions_retired", low, high)
    run = found.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = batch.withColumn("row_index", F.col("timestamp_ms").cast("long")).withColumn("state", phases.state_of(F.col("counter__instructions_retired"), F.lit(low), F.lit(high)))
    both = sequences.with_confirmed(sequences.run_lengths(rows), "state")
    expected = {(r.run_id, r.timestamp_ms): (r.state, r.run_length, max(0, r.action)) for r in both.collect()}
    seen = {(r.run_id, r.timestamp_ms): (r.state, r.run_length, r.action) for r in spark.read.parquet(str(tmp_path / "out")).where("run_id <> 'z'").collect()}
    assert seen == expected


def _run(df, where, name):
    """All that a stream gives over the files that are there, a batch for each."""
    run = df.writeStream.outputMode("append").format("parquet").option("path", f"{where}/{name}").option("checkpointLocation", f"{where}/{name}-c").trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/{name}"), run


LINES = [
    "# started on Tue", "", "0.100,CPU0,1,234,,cycles:u,10,90.0,,", "0.100,CPU0,5,,cycles:u,10,90.0,,", "0.100,CPU0,7,,cycles:u [x],20,40.0,,", "0.100,CPU1,<not counted>,,cycles:u,0,0.0,,", "0.200,CPU0,11,,branches,5,100.0,,",
    "0.200,CPU0,13,,unlisted,5,100.0,,", "0.300,CPU1,1,,unlisted,5,100.0,,", "short,line",
]


def test_text_that_lands_is_what_a_merge_of_files_gives(spark, tmp_path):
    for k, part in enumerate((LINES[:5], LINES[5:], ["100000.000,CPU9,0,,x,0,0,,"])):
        for run in ("r1", "r 2"):
            (tmp_path / "in" / run).mkdir(parents=True, exist_ok=True)
            file = tmp_path / "in" / run / f"{k}.txt"
            file.write_text("\n".join(part) + "\n")
            os.utime(file, (1e9 + k, 1e9 + k))  # the order in which they landed
    names = {"cycles": "cycles", "branches": "branch_instructions"}
    lines = perf.perf_lines(spark, str(tmp_path / "in"), files_a_batch=2)
    got, _ = _run(perf.interval_rows(perf.perf_samples(lines, "1 hour"), names), tmp_path, "out")
    got = {(r.run_id, r.timestamp_ms, r.cpu_or_core_id): r for r in got.where("cpu_or_core_id <> '9'").collect()}
    rest = readers.parse_perf_lines(spark.createDataFrame([(run, x) for run in ("r1", "r 2") for x in LINES], "run_id string, value string"))
    family = spark.createDataFrame(list(names.items()), "event_name_normalized string, counter string")
    want = merge.pivot_sum(rest.where("timestamp_ms is not null").join(family, "event_name_normalized", "left"), list(dict.fromkeys(names.values())), ["run_id", "timestamp_ms", "cpu_or_core_id"], True).collect()
    assert len(got) == len(want) == 8
    for r in want:
        mine = got[r.run_id, r.timestamp_ms, r.cpu_or_core_id]
        assert all(mine[c] == r[c] for c in r.asDict())


def test_nearest_on_streams_is_the_batch_join(spark, tmp_path):
    """A tolerance of the other rows' own step, ties, gaps and rows without a partner."""
    rng = random.Random(2)
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    core = [("a", at(t), i) for i, t in enumerate(sorted(rng.sample(range(0, 9000, 5), 200)))] + [("b", at(70), 900), ("c", at(10), 901)]
    other = [("a", at(t), float(t)) for t in range(0, 6000, 20)] + [("b", at(60), 1.0), ("b", at(80), 2.0), ("b", at(100), 3.0)]
    end = at(10**9)
    c = spark.createDataFrame(core, "run_id string, ts timestamp, n long")
    o = spark.createDataFrame(other, "run_id string, ts timestamp, v double")
    for name, df, last in (("core", c, ("z", end, -1)), ("other", o, ("z", end, 0.0))):
        df.repartition(3).write.parquet(str(tmp_path / name))
        spark.createDataFrame([last], df.schema).write.mode("append").parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(df.schema).parquet(str(tmp_path / name)).withWatermark("ts", "1 day") for name, df in (("core", c), ("other", o)))
    got, _ = _run(perf.nearest_on_streams(a, b, ["v"], "20 milliseconds", row=["n"]), tmp_path, "out")
    ms = F.unix_millis("ts").cast("double").alias("timestamp_ms")
    want = merge.nearest(c.select("run_id", ms, "n"), o.select("run_id", ms, "v"), ["v"])
    rows = sorted((r.n, r.v, r.attached) for r in got.where("run_id <> 'z'").collect())
    assert rows == sorted((r.n, r.v, r.attached) for r in want.where("run_id <> 'c'").collect()) + [(901, None, False)] and len(rows) == 202
    assert [r[1] for r in rows if r[0] == 900] == [2.0]


@pytest.mark.parametrize("files_a_batch", [1, 100])
def test_scores_do_not_depend_on_order_or_batches(spark, tmp_path, files_a_batch):
    """Rows of a stream in any files and order: as at rest; and nothing is kept of a stream that has gone silent."""
    rng = random.Random(5)
    rows = [(f"r{k}", float(1000 * (i + 1)), rng.choice([None, 5.0, 25.0, 55.0])) for k in range(3) for i in range(30)]
    rng.shuffle(rows)
    schema = "run_id string, timestamp_ms double, v double"
    timed = lambda df: df.withColumn("ts", F.timestamp_millis(F.col("timestamp_ms").cast("long")))
    for k in range(3):
        timed(spark.createDataFrame(rows[k::3], schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k in range(3):
        timed(spark.createDataFrame([("z", 1e8 * (k + 1), 0.0)], schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(timed(spark.createDataFrame([], schema)).schema).option("maxFilesPerTrigger", files_a_batch).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    tree = forest.Node(0, {}, "h2", 0.5, forest.Node(0, {}, "h0", 1.5, forest.Node(0, {}), forest.Node(2, {})), forest.Node(1, {}))
    with scoring.state_store(spark):
        got, _ = _run(scoring.scored(source, "v", 20.0, 40.0, tree, 3, 60_000), tmp_path, "out")
    got = {(r.run_id, r.timestamp_ms): r for r in got.where("run_id <> 'z'").collect()}
    assert len(got) == 90
    for k in range(3):
        mine = sorted(r[1:] for r in rows if r[0] == f"r{k}")
        past, length, action = [], 0, 1
        for at, v in mine:
            state = -1 if v is None else int(v >= 20) + int(v >= 40)
            length = length + 1 if past and past[-1] == state else 1
            action = max(0, min(2, state)) if past and past[-1] == state else action
            past.append(state)
            h = past[-3:]
            said = None if len(h) < 3 else (1 if h[2] > 0.5 else 2 if h[0] > 1.5 else 0)
            r = got[f"r{k}", at]
            assert (r.state, r.run_length, r.action, r.prediction) == (state, length, action, said)
    state = spark.read.format("statestore").option("path", str(tmp_path / "out-c")).option("stateVarName", "run").load()
    assert {r.key.run_id for r in state.collect()} <= {"z"}


def test_rows_that_come_together_are_stored_by_one_call():
    """Calls to the store grow with streams and batches, not with rows; what waits has a timer at its first row."""
    calls, timers, stored = [], [], {}

    class Value:
        def get(self):
            return stored.get("run")

        def exists(self):
            return "run" in stored

        def update(self, row):
            stored["run"] = row

    class Rows:
        def __init__(self, name):
            self.name = name

        def get(self):
            return iter(stored.get(self.name, []))

        def exists(self):
            return bool(stored.get(self.name))

        def clear(self):
            stored.pop(self.name, None)

        def put(self, rows):
            stored[self.name] = list(rows)

        def appendValue(self, row):
            calls.append("one")
            stored.setdefault(self.name, []).append(row)

        def appendList(self, rows):
            calls.append("many")
            stored.setdefault(self.name, []).extend(rows)

    class Handle:
        getListState = staticmethod(lambda name, schema: Rows(name))
        getValueState = staticmethod(lambda name, schema: Value())
        registerTimer = staticmethod(timers.append)

    class At:
        def __init__(self, now):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: now

    scorer = scoring.Scorer("v", 20.0, 40.0, forest.Node(0, {}), 3, 1000)
    scorer.init(Handle)
    times = [float(10 * k) for k in range(30, 0, -1)]
    list(scorer.handleInputRows(("r",), iter([pd.DataFrame({"timestamp_ms": times, "v": times})]), At(0)))
    assert calls == ["many"] and timers == [10]
    first = pd.concat(scorer.handleExpiredTimer(("r",), At(0), At(95)))
    assert first["timestamp_ms"].tolist() == [float(10 * k) for k in range(1, 10)] and timers == [10, 100]
    last = pd.concat(scorer.handleExpiredTimer(("r",), At(0), At(500)))
    assert len(first) + len(last) == 30 and timers == [10, 100, 1300]
