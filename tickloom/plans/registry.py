"""Queries over the test tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import evaluation, features, merge, metrics, models, phases, planning, policy, selection, sequences, splits, stats
from ..sources import adapter, readers
from . import frames
from .frames import COUNTERS, VALUE, sql, sql_uniform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COLS = [f"counter__{c}" for c in COUNTERS]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# -- ingest ------------------------------------------------------------------


def _perf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events written as interval text: seconds, CPU, value (every 17th not counted, every 5th with a comma), unit, name, run time, share."""
    e = adapter.table(spark, d, "events")
    value = F.when(F.col("event_id") % 17 == 0, F.lit("<not counted>")).otherwise(F.col("value").cast("string"))
    line = F.concat_ws(",", F.format_string("%.3f", F.col("event_id") / 100), F.concat(F.lit("CPU"), (F.col("user_id") % 4).cast("string")), value, F.lit("msec"), F.concat(F.upper("event_type"), F.lit(":u [annotated]")), (F.col("event_id") * 10).cast("string"), F.get_json_object("props", "$.k"), F.lit(""), F.lit(""))
    return e.select("event_id", line.alias("value"))


@query(
    "s3_parse_perf_interval",
    """SELECT event_id, round(round(event_id / 100.0, 3) * 1000, 3) AS timestamp_ms, CAST(user_id % 4 AS VARCHAR) AS cpu_or_core_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value,
  upper(event_type) || ':u' AS event_name, event_type AS event_name_normalized, CAST(event_id * 10 AS DOUBLE) AS runtime_ns, CAST(json_extract(props, '$.k') AS DOUBLE) AS enabled_pct,
  CASE WHEN event_id % 17 = 0 THEN 'not counted' ELSE 'ok' END AS status FROM events""",
)
def s3(spark, d):
    return readers.parse_perf_lines(_perf_lines(spark, d)).select("event_id", F.round("timestamp_ms", 3).alias("timestamp_ms"), "cpu_or_core_id", "value", "event_name", "event_name_normalized", "runtime_ns", "enabled_pct", "status")


@query("s4_parse_perf_aggregate", "SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value, upper(event_type) || ':u' AS event_name FROM events")
def s4(spark, d):
    lines = _perf_lines(spark, d).withColumn("value", F.regexp_replace("value", r"^[^,]*,CPU\d+,", ""))
    return readers.parse_perf_lines(lines, interval=False).select("event_id", "value", "event_name")


@query("s6_resolve_directories", "SELECT directory, directory IN ('/runs/u' || 1, '/runs/u' || 2, '/runs/u' || 3) AS listed FROM (SELECT DISTINCT '/runs/u' || user_id AS directory FROM events)")
def s6(spark, d):
    files = adapter.table(spark, d, "events").select(F.concat(F.lit("/runs//u"), F.col("user_id").cast("string"), F.lit("/interval_perf.csv")).alias("path"))
    manifest = spark.createDataFrame([("/runs/u1",), ("/runs/u2",), ("/runs/u3",)], "directory string")
    kept, stale = readers.resolve_directories(readers.directories(files), manifest)
    return kept.withColumn("listed", F.lit(True)).unionByName(stale.withColumn("listed", F.lit(False)))


@query(
    "p1_clean_numbers",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN round(value, 2) WHEN 3 THEN NULL ELSE 1000 + event_id % 1000 END AS number, CASE WHEN event_id % 5 = 4 THEN -1 ELSE event_id % 100 END AS whole FROM events""",
)
def p1(spark, d):
    e = adapter.table(spark, d, "events")
    k = F.col("event_id") % 5
    text = F.when(k == 0, "<not supported>").when(k == 1, "").when(k == 2, F.format_string(" %.2f ", "value")).when(k == 3, "nan").otherwise(F.concat(F.lit("1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))
    whole = F.when(k == 4, "x").otherwise((F.col("event_id") % 100).cast("string"))
    return e.select("event_id", fn.safe_float(text).alias("number"), fn.safe_int(whole, -1).cast("long").alias("whole"))


@query("p3_event_names", "SELECT event_id, 'cpu ' || event_type AS normal, event_type || '_' || (event_id % 10) AS slug FROM events")
def p3(spark, d):
    e = adapter.table(spark, d, "events")
    return e.select("event_id", fn.normal_event(F.concat(F.lit(" CPU   "), F.upper("event_type"), F.lit(":u "))).alias("normal"), fn.slug(F.concat(F.lit("/"), F.col("event_type"), F.lit(" // "), (F.col("event_id") % 10).cast("string"), F.lit("!"))).alias("slug"))


@query("p6_keyed_pairs", "SELECT event_id, event_type AS a, CAST(event_id % 7 AS VARCHAR) AS b, 2 AS n FROM events")
def p6(spark, d):
    e = adapter.table(spark, d, "events")
    text = F.concat(F.lit(" a: old ; ;x;"), F.lit("b:"), (F.col("event_id") % 7).cast("string"), F.lit(";a:"), F.col("event_type"), F.lit(";:z"))
    return e.withColumn("m", fn.keyed_pairs(text)).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


# -- merge -------------------------------------------------------------------


@query("a1_interval_pivot", sql("wide", f"SELECT run_id, cpu_or_core_id, timestamp_ms, {sql6(*COLS)} FROM wide"))
def a1(spark, d):
    return frames.wide(spark, d).select("run_id", "cpu_or_core_id", "timestamp_ms", *r6(*COLS))


_A2 = ["A", "N", "R"]


@query("a2_aggregate_pivot", "SELECT l_suppkey AS unit, " + ", ".join(f"round(sum(l_quantity) FILTER (l_returnflag = '{c}'), 6) AS counter__{c}" for c in _A2) + " FROM lineitem GROUP BY l_suppkey")
def a2(spark, d):
    rows = adapter.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("counter"), F.col("l_quantity").alias("value"))
    return merge.pivot_sum(rows, _A2, ["unit"]).select("unit", *r6(*[f"counter__{c}" for c in _A2]))


_QUALITY = [f"{p}__{c}" for c in COUNTERS for p in ("pmu_enabled_pct", "pmu_runtime_ns")]


@query("a3_pmu_quality_columns", sql("wide", f"SELECT run_id, timestamp_ms, {sql6(*_QUALITY)} FROM wide", quality=True))
def a3(spark, d):
    return frames.wide(spark, d, True).select("run_id", "timestamp_ms", *r6(*_QUALITY))


@query(
    "a4_device_totals",
    """SELECT l_partkey AS run_id, CAST(epoch_ms(date_trunc('year', l_shipdate)) AS DOUBLE) AS timestamp_ms, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS counter__read, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS counter__write,
  round(CASE WHEN count(*) FILTER (l_returnflag IN ('A', 'R')) > 0 THEN coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) + coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) END, 6) AS counter__total_memory_bandwidth
  FROM lineitem GROUP BY 1, 2""",
)
def a4(spark, d):
    name = F.when(F.col("l_returnflag") == "A", "read").when(F.col("l_returnflag") == "R", "write")
    rows = adapter.table(spark, d, "lineitem").select(F.col("l_partkey").alias("run_id"), F.unix_millis(F.date_trunc("year", "l_shipdate")).cast("double").alias("timestamp_ms"), name.alias("counter"), F.col("l_quantity").alias("value"))
    return merge.device_totals(rows, "read", "write").select("run_id", "timestamp_ms", *r6("counter__read", "counter__write", "counter__total_memory_bandwidth"))


_A5 = " UNION ALL ".join(
    f"""SELECT '{c}' AS counter, count(pmu_enabled_pct__{c}) AS samples, round(avg(pmu_enabled_pct__{c}), 6) AS enabled_pct_mean, round(quantile_cont(pmu_enabled_pct__{c}, CAST(0.05 AS DOUBLE)), 6) AS enabled_pct_p05,
 min(pmu_enabled_pct__{c}) AS enabled_pct_min, round(avg(CAST(pmu_enabled_pct__{c} < 90 AS DOUBLE)), 6) AS fraction_enabled_below_90pct, round(avg(CAST(pmu_enabled_pct__{c} <= 0 AS DOUBLE)), 6) AS fraction_enabled_zero,
 round(avg(pmu_runtime_ns__{c}), 6) AS runtime_ns_mean FROM wide"""
    for c in COUNTERS
)


@query("a5_collection_quality", sql("wide", _A5, quality=True))
def a5(spark, d):
    return merge.collection_quality(frames.wide(spark, d, True), COUNTERS).select("counter", "samples", *r6("enabled_pct_mean", "enabled_pct_p05"), "enabled_pct_min", *r6("fraction_enabled_below_90pct", "fraction_enabled_zero", "runtime_ns_mean"))


@query("a7_merge_summary", sql("wide", "SELECT count(*) AS rows, count(DISTINCT run_id) AS runs, count(DISTINCT cpu_or_core_id) AS units, " + ", ".join(f"count(counter__{c}) AS rows_{c}" for c in COUNTERS) + " FROM wide"))
def a7(spark, d):
    return merge.merge_summary(frames.wide(spark, d), COUNTERS)


@query(
    "j3_phase_log_range_join",
    sql(
        "wide",
        """, log AS (SELECT run_id, min(timestamp_ms) + o * 86400000.0 * 4 - CASE WHEN o = 2 THEN 86400000.0 ELSE 0 END AS start_ms, min(timestamp_ms) + (o + 1) * 86400000.0 * 4 AS end_ms, 'p' || o AS phase_label, o AS position
  FROM wide, range(5) r(o) GROUP BY run_id, o)
SELECT w.run_id, w.timestamp_ms, coalesce((SELECT arg_min(phase_label, position) FROM log l WHERE l.run_id = w.run_id AND l.start_ms <= w.timestamp_ms AND w.timestamp_ms < l.end_ms), '') AS phase_label FROM wide w""",
    ).replace("\n, log", ",\nlog"),
)
def j3(spark, d):
    rows = frames.wide(spark, d).select("run_id", "timestamp_ms")
    start = rows.groupBy("run_id").agg(F.min("timestamp_ms").alias("t0"))
    day = adapter.DAY_MS
    log = start.select("run_id", "t0", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position")).select(
        "run_id", (F.col("t0") + F.col("position") * day * 4 - F.when(F.col("position") == 2, day).otherwise(0.0)).alias("start_ms"), (F.col("t0") + (F.col("position") + 1) * day * 4).alias("end_ms"), F.concat(F.lit("p"), F.col("position").cast("string")).alias("phase_label"), "position"
    )
    return merge.label_phases(rows, log, bin_ms=7 * day).select("run_id", "timestamp_ms", "phase_label")


@query(
    "j4_nearest_asof",
    """WITH core AS (SELECT user_id AS run_id, CAST(epoch_ms(ts) AS DOUBLE) AS timestamp_ms, event_id FROM events WHERE event_type <> 'view'),
other AS (SELECT user_id AS run_id, CAST(epoch_ms(ts) AS DOUBLE) AS timestamp_ms, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
steps AS (SELECT run_id, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY run_id ORDER BY timestamp_ms) AS s FROM other),
lim AS (SELECT run_id, coalesce(quantile_cont(s, CAST(0.5 AS DOUBLE)) FILTER (s > 0), 15.0) AS tol FROM steps GROUP BY run_id),
cand AS (SELECT c.event_id, c.run_id, o.v, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(o.timestamp_ms - c.timestamp_ms), o.timestamp_ms DESC) AS k, abs(o.timestamp_ms - c.timestamp_ms) AS gap FROM core c JOIN other o USING (run_id))
SELECT c.event_id, CASE WHEN gap <= tol THEN v END AS v, coalesce(gap <= tol, false) AS attached FROM core c LEFT JOIN cand x ON x.event_id = c.event_id AND k = 1 LEFT JOIN lim l ON l.run_id = c.run_id""",
)
def j4(spark, d):
    e = adapter.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("timestamp_ms"), "event_id", "event_type", "value")
    core = e.where("event_type <> 'view'").select("run_id", "timestamp_ms", "event_id")
    other = e.where("event_type = 'view'").groupBy("run_id", "timestamp_ms").agg(F.max("value").alias("v"))
    return merge.nearest(core, other, ["v"]).select("event_id", "v", "attached")


@query(
    "w2_interval_durations",
    sql(
        "wide",
        """, steps AS (SELECT run_id, cpu_or_core_id, timestamp_ms, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms) AS s FROM wide),
usual AS (SELECT run_id, cpu_or_core_id, quantile_cont(s, CAST(0.5 AS DOUBLE)) FILTER (s > 0) AS u FROM steps GROUP BY 1, 2)
SELECT run_id, timestamp_ms, CASE WHEN s > 0 THEN s ELSE coalesce(u, s) END AS interval_duration_ms FROM steps JOIN usual USING (run_id, cpu_or_core_id)""",
    ).replace("\n, steps", ",\nsteps"),
)
def w2(spark, d):
    return merge.with_durations(frames.wide(spark, d)).select("run_id", "timestamp_ms", "interval_duration_ms")


# -- features ----------------------------------------------------------------

_RATES = ["branch_instructions_per_ki", "branch_miss_rate", "llc_refs_per_ki", "llc_misses_per_ki", "llc_miss_rate"]
_SQL_RATES = """counter__branch_instructions / nullif(counter__instructions_retired, 0) * 1000 AS branch_instructions_per_ki, counter__branch_mispredictions / nullif(counter__branch_instructions, 0) AS branch_miss_rate,
  counter__llc_references / nullif(counter__instructions_retired, 0) * 1000 AS llc_refs_per_ki, counter__llc_misses / nullif(counter__instructions_retired, 0) * 1000 AS llc_misses_per_ki, counter__llc_misses / nullif(counter__llc_references, 0) AS llc_miss_rate"""


@query("p8_derived_features", sql("wide", f"rates AS (SELECT *, {_SQL_RATES} FROM wide)", f"SELECT run_id, timestamp_ms, {sql6(*_RATES)} FROM rates"))
def p8(spark, d):
    return features.derived_features(frames.wide(spark, d)).select("run_id", "timestamp_ms", *r6(*_RATES))


@query("p9_signed_log", sql("wide", "SELECT run_id, timestamp_ms, " + ", ".join(f"round(CASE WHEN {c} - 20 >= 0 THEN ln(1 + {c} - 20) ELSE {c} - 20 END, 6) AS {c}" for c in COLS) + " FROM wide"))
def p9(spark, d):
    return features.log_counters(frames.wide(spark, d).withColumns({c: F.col(c) - 20 for c in COLS}), COLS).select("run_id", "timestamp_ms", *r6(*COLS))


@query(
    "p12_family_scores",
    sql("wide", f"rates AS (SELECT *, {_SQL_RATES} FROM wide)", """SELECT run_id, timestamp_ms, round(list_avg([llc_refs_per_ki, llc_misses_per_ki, llc_miss_rate]), 6) AS score__LLC, round(list_avg([branch_instructions_per_ki, branch_miss_rate]), 6) AS score__branch_control,
  counter__instructions_retired AS raw, round(ln(1 + counter__llc_misses), 6) AS chosen__LLC FROM rates""").replace("counter__instructions_retired AS raw, ", ""),
)
def p12(spark, d):
    rows = frames.wide(spark, d)
    chosen = features.family_scores(rows, {"LLC": ["llc_misses"]}).select("run_id", "timestamp_ms", F.round("score__LLC", 6).alias("chosen__LLC"))
    return features.family_scores(rows).select("run_id", "timestamp_ms", *r6("score__LLC", "score__branch_control")).join(chosen, ["run_id", "timestamp_ms"])


@query("a8_train_median_fill", sql("base", "m AS (SELECT " + ", ".join(f"median({c}) AS m{i}" for i, c in enumerate(COLS)) + " FROM base WHERE is_train)", "SELECT row_index, " + ", ".join(f"round(coalesce({c}, m{i}, 0), 6) AS {c}" for i, c in enumerate(COLS)) + " FROM base, m"))
def a8(spark, d):
    return features.fill_train_median(frames.base(spark, d), COLS).select("row_index", *r6(*COLS))


@query(
    "a9_fill_and_scale",
    sql(
        "base",
        "logged AS (SELECT row_index, is_train, " + ", ".join(f"CASE WHEN {c} >= 0 THEN ln(1 + {c}) ELSE {c} END AS {c}" for c in COLS) + " FROM base)",
        "m AS (SELECT " + ", ".join(f"median({c}) AS m{i}" for i, c in enumerate(COLS)) + " FROM logged WHERE is_train)",
        "filled AS (SELECT row_index, is_train, " + ", ".join(f"coalesce({c}, m{i}, 0) AS {c}" for i, c in enumerate(COLS)) + " FROM logged, m)",
        "s AS (SELECT " + ", ".join(f"avg({c}) AS a{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(COLS)) + " FROM filled WHERE is_train)",
        "SELECT row_index, " + ", ".join(f"round(({c} - a{i}) / coalesce(nullif(s{i}, 0), 1), 6) AS {c}" for i, c in enumerate(COLS)) + " FROM filled, s",
    ),
)
def a9(spark, d):
    return frames.scaled(spark, d).select("row_index", *r6(*COLS))


@query("a10_tertile_states", sql("states", "SELECT row_index, state FROM states"))
def a10(spark, d):
    return frames.states(spark, d).select("row_index", "state")


@query(
    "a11_states_per_workload",
    sql(
        "base",
        "c AS (SELECT workload, quantile_cont(counter__instructions_retired, CAST(1 AS DOUBLE) / 3) AS lo, quantile_cont(counter__instructions_retired, CAST(2 AS DOUBLE) / 3) AS hi FROM base WHERE is_train GROUP BY workload)",
        "SELECT row_index, CASE WHEN counter__instructions_retired IS NULL OR lo IS NULL THEN -1 WHEN counter__instructions_retired < lo THEN 0 WHEN counter__instructions_retired < hi THEN 1 ELSE 2 END AS state FROM base LEFT JOIN c USING (workload)",
    ),
)
def a11(spark, d):
    return phases.tertile_states(frames.base(spark, d), VALUE, ["workload"]).select("row_index", "state")


# -- sequences ---------------------------------------------------------------


@query(
    "w3_futures",
    sql(
        "states",
        "f AS (SELECT row_index, state, " + ", ".join(f"coalesce(lead(state, {k}) OVER w, -1) AS future_state_{k}, lead(counter__instructions_retired, {k}) OVER w AS future_value_{k}" for k in (1, 2, 3)) + " FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))",
        "t AS (SELECT *, CASE WHEN state < 0 THEN -1 " + " ".join(f"WHEN future_state_{k} >= 0 AND future_state_{k} <> state THEN {k}" for k in (1, 2, 3)) + " ELSE -1 END AS time_to_change FROM f)",
        "SELECT row_index, state, " + ", ".join(f"future_state_{k}, round(future_value_{k}, 6) AS future_value_{k}" for k in (1, 2, 3)) + ", time_to_change, CAST(time_to_change > 0 AS INT) AS will_change FROM t",
    ),
)
def w3(spark, d):
    f = sequences.futures(frames.states(spark, d), 3, "state", VALUE)
    return f.select("row_index", "state", *[c for k in (1, 2, 3) for c in (F.col(f"future_state_{k}"), F.round(f"future_value_{k}", 6).alias(f"future_value_{k}"))], "time_to_change", "will_change")


@query("w7_run_lengths", sql("examples", "SELECT row_index, state, previous, run_length FROM examples"))
def w7(spark, d):
    return frames.examples(spark, d).select("row_index", "state", "previous", "run_length")


@query(
    "w8_histories",
    sql(
        "states",
        "h AS (SELECT row_index, list(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h, row_number() OVER w AS k, lead(state) OVER w AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))",
        "SELECT row_index, array_to_string(h, ',') AS history, target FROM h WHERE k >= 4 AND target IS NOT NULL",
    ),
)
def w8(spark, d):
    h = sequences.histories(frames.states(spark, d), 4, ["state"])
    return h.select("row_index", F.array_join(F.transform(F.flatten("history"), lambda s: s.cast("string")), ",").alias("history"), "target")


@query("w12_spans", sql("examples", "SELECT run_id, CAST(run_number AS BIGINT) AS run_number, state, min(timestamp_ms) AS start_time, max(timestamp_ms) AS end_time, count(*) AS n_rows FROM examples GROUP BY run_id, cpu_or_core_id, run_number, state"))
def w12(spark, d):
    return sequences.spans(frames.states(spark, d)).select("run_id", "run_number", "state", "start_time", "end_time", "n_rows")


_CONFIRMED = """acted AS (SELECT *, coalesce(last_value(CASE WHEN state = before THEN state END IGNORE NULLS) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS UNBOUNDED PRECEDING), 1) AS action
  FROM (SELECT *, lag(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms) AS before FROM states))"""


@query("w13_confirmed_actions", sql("states", _CONFIRMED, "SELECT row_index, state, action FROM acted"))
def w13(spark, d):
    return sequences.with_confirmed(frames.states(spark, d), "state").select("row_index", "state", "action")


@query("w14_first_rows", sql("base", "SELECT row_index FROM base QUALIFY row_number() OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms) <= 5"))
def w14(spark, d):
    return sequences.first_rows(frames.base(spark, d), 5).select("row_index")


@query("p14_run_length_buckets", sql("examples", "SELECT row_index, CASE WHEN run_length <= 1 THEN 0 WHEN run_length <= 3 THEN 1 WHEN run_length <= 7 THEN 2 WHEN run_length <= 15 THEN 3 ELSE 4 END AS bucket, CASE WHEN run_length <= 1 THEN 1 WHEN run_length <= 3 THEN 3 WHEN run_length <= 7 THEN 7 ELSE 15 END AS edge FROM examples"))
def p14(spark, d):
    e = frames.examples(spark, d)
    return e.select("row_index", fn.bucket_number(F.col("run_length"), [1, 3, 7, 15]).alias("bucket"), fn.bucket_edge(F.col("run_length"), [1, 3, 7, 15]).alias("edge"))


# -- models ------------------------------------------------------------------

_ROW = "CASE WHEN state < 0 THEN 2 ELSE state END"
_BUCKET = "CASE WHEN run_length <= 1 THEN 0 WHEN run_length <= 3 THEN 1 WHEN run_length <= 7 THEN 2 WHEN run_length <= 15 THEN 3 ELSE 4 END"


def _model(name: str, oracle: str):
    return query(name, oracle)


@_model("m9_last_state", sql("examples", "SELECT row_index, state AS prediction FROM examples"))
def m9(spark, d):
    return models.last_state(frames.examples(spark, d)).select("row_index", "prediction")


@_model("m10_majority", sql("examples", "best AS (SELECT target AS prediction FROM examples WHERE is_train AND target >= 0 GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)", "SELECT row_index, prediction FROM examples, best"))
def m10(spark, d):
    return models.majority(frames.examples(spark, d)).select("row_index", "prediction")


@_model(
    "m11_state_majority",
    sql(
        "examples",
        "best AS (SELECT target AS p FROM examples WHERE is_train AND target >= 0 GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)",
        "per AS (SELECT state, target AS q FROM examples WHERE is_train AND target >= 0 AND state >= 0 GROUP BY state, target QUALIFY row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, target) = 1)",
        "SELECT row_index, coalesce(q, p) AS prediction FROM examples LEFT JOIN per USING (state), best",
    ).replace("FROM examples LEFT JOIN per USING (state), best", "FROM examples LEFT JOIN per USING (state) CROSS JOIN best"),
)
def m11(spark, d):
    return models.state_majority(frames.examples(spark, d)).select("row_index", "prediction")


@_model(
    "m12_markov",
    sql(
        "examples",
        "t AS (SELECT s, t, 1 + count(e.row_index) AS n FROM range(3) a(s) CROSS JOIN range(3) b(t) LEFT JOIN examples e ON e.is_train AND e.state = s AND e.target = t GROUP BY s, t)",
        "best AS (SELECT s, t FROM t QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, t) = 1)",
        f"SELECT row_index, t AS prediction FROM examples JOIN best ON s = {_ROW}",
    ),
)
def m12(spark, d):
    return models.markov(frames.examples(spark, d)).select("row_index", F.col("prediction").cast("long").alias("prediction"))


@_model(
    "m13_run_length_markov",
    sql(
        "examples",
        f"x AS (SELECT *, {_BUCKET} AS bucket FROM examples)",
        "t AS (SELECT s, b, t, 1 + count(e.row_index) AS n FROM range(3) a(s) CROSS JOIN range(5) c(b) CROSS JOIN range(3) k(t) LEFT JOIN x e ON e.is_train AND e.state = s AND e.bucket = b AND e.target = t GROUP BY s, b, t)",
        "best AS (SELECT s, b, t FROM t QUALIFY row_number() OVER (PARTITION BY s, b ORDER BY n DESC, t) = 1)",
        f"SELECT row_index, t AS prediction FROM x JOIN best ON s = {_ROW} AND b = bucket",
    ),
)
def m13(spark, d):
    return models.run_length_markov(frames.examples(spark, d)).select("row_index", F.col("prediction").cast("long").alias("prediction"))


@_model(
    "m14_duration_model",
    sql(
        "examples",
        f"x AS (SELECT *, {_BUCKET} AS bucket, {_ROW} AS r FROM examples)",
        "st AS (SELECT r, bucket, (1.0 + count(*) FILTER (target = state)) / (2.0 + count(*)) AS stay FROM x WHERE is_train AND target >= 0 GROUP BY r, bucket)",
        "g AS (SELECT s, t, 1 + count(e.row_index) AS n FROM range(3) a(s) CROSS JOIN range(3) b(t) LEFT JOIN x e ON e.is_train AND e.r = s AND e.target = t AND e.target <> e.state WHERE s <> t GROUP BY s, t)",
        "best AS (SELECT s, t FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, t) = 1)",
        "SELECT row_index, CASE WHEN coalesce(stay, 0.5) >= 0.5 THEN state ELSE t END AS prediction FROM x LEFT JOIN st USING (r, bucket) JOIN best ON s = r",
    ),
)
def m14(spark, d):
    return models.duration_model(frames.examples(spark, d)).select("row_index", F.col("prediction").cast("long").alias("prediction"))


def _mode(keys: str, name: str) -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"{name} AS (SELECT {cols}target AS {name}_t FROM x WHERE is_train GROUP BY {cols}target QUALIFY row_number() OVER ({by}ORDER BY count(*) DESC, min(row_index)) = 1)"


@_model(
    "m20_lookup_backoff",
    sql(
        "examples",
        "x AS (SELECT *, CASE WHEN run_length <= 1 THEN 1 WHEN run_length <= 3 THEN 3 WHEN run_length <= 7 THEN 7 ELSE 15 END AS b, threads AS context FROM examples)",
        _mode("state, previous, b, context", "l0"), _mode("state, b, context", "l1"), _mode("state, b", "l2"), _mode("state", "l3"), _mode("", "l4"),
        "SELECT row_index, coalesce(l0_t, l1_t, l2_t, l3_t, l4_t, 1) AS prediction FROM x LEFT JOIN l0 USING (state, previous, b, context) LEFT JOIN l1 USING (state, b, context) LEFT JOIN l2 USING (state, b) LEFT JOIN l3 USING (state) CROSS JOIN l4",
    ),
)
def m20(spark, d):
    return models.lookup_backoff(frames.examples(spark, d).withColumn("context", F.col("threads"))).select("row_index", "prediction")


@_model(
    "m21_history_lookup",
    sql(
        "states",
        "h AS (SELECT row_index, is_train, list(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h, row_number() OVER w AS k, lead(state) OVER w AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))",
        "x AS (SELECT row_index, is_train, h, target FROM h WHERE k >= 4 AND target IS NOT NULL)",
        "s AS (SELECT row_index, is_train, target, n, array_to_string(h[5 - n:], ',') AS suffix FROM x, range(1, 5) r(n))",
        "best AS (SELECT n, suffix, target AS t FROM s WHERE is_train GROUP BY n, suffix, target QUALIFY row_number() OVER (PARTITION BY n, suffix ORDER BY count(*) DESC, min(row_index)) = 1)",
        "w AS (SELECT target AS t FROM x WHERE is_train GROUP BY target ORDER BY count(*) DESC, min(row_index) LIMIT 1)",
        "SELECT x.row_index, coalesce((SELECT arg_max(b.t, s.n) FROM s JOIN best b USING (n, suffix) WHERE s.row_index = x.row_index), w.t, 1) AS prediction FROM x, w",
    ),
)
def m21(spark, d):
    return models.history_lookup(sequences.histories(frames.states(spark, d), 4, ["state"])).select("row_index", "prediction")


# -- evaluation --------------------------------------------------------------


def _predicted(spark, d) -> DataFrame:
    return models.markov(frames.examples(spark, d))


def _first(a: str, b: str) -> str:
    return f"(SELECT CASE WHEN max(CAST(split = '{a}' AS INT)) = 1 THEN '{a}' ELSE '{b}' END FROM base)"


_PRED = [
    "tt AS (SELECT s, t, 1 + count(e.row_index) AS n FROM range(3) a(s) CROSS JOIN range(3) b(t) LEFT JOIN examples e ON e.is_train AND e.state = s AND e.target = t GROUP BY s, t)",
    "tb AS (SELECT s, t FROM tt QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, t) = 1)",
    f"pred AS (SELECT examples.*, t AS prediction FROM examples JOIN tb ON s = {_ROW})",
    f"test AS (SELECT * FROM pred WHERE split = {_first('test', 'val')} AND target >= 0 AND prediction >= 0)",
]


def _test_rows(spark, d) -> DataFrame:
    return metrics.usable(metrics.mask_rows(_predicted(spark, d), metrics.REPORT))


@query(
    "a12_classification_scores",
    sql(
        "examples", *_PRED,
        "l AS (SELECT workload, label, count(*) FILTER (target = label) AS support, count(*) FILTER (prediction = label) AS said, count(*) FILTER (target = label AND prediction = label) AS hit FROM test, range(3) r(label) GROUP BY workload, label HAVING support + said > 0)",
        """SELECT workload, sum(support) AS rows, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(2.0 * hit / (support + said)), 6) AS macro_f1, round(sum(support * 2.0 * hit / (support + said)) / sum(support), 6) AS weighted_f1,
  round(avg(CASE WHEN support > 0 THEN hit / support END), 6) AS balanced_accuracy, round(coalesce(max(CASE WHEN label = 2 AND support > 0 THEN hit / support END), 0), 6) AS high_recall FROM l GROUP BY workload""",
    ).replace("sum(support) AS rows", "CAST(sum(support) AS BIGINT) AS rows"),
)
def a12(spark, d):
    s = metrics.classification_scores(metrics.confusion(_test_rows(spark, d), ["workload"]), ["workload"])
    return s.select("workload", "rows", *r6("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", "high_recall"))


@query(
    "a14_transition_scores",
    sql(
        "examples", *_PRED,
        "c AS (SELECT workload, count(*) FILTER (target <> state AND prediction <> state) AS tp, count(*) FILTER (target = state AND prediction <> state) AS fp, count(*) FILTER (target <> state AND prediction = state) AS fn, count(*) FILTER (target = state AND prediction = state) AS tn FROM test GROUP BY workload)",
        "SELECT workload, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS event_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS event_recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS event_f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_alarm_rate FROM c",
    ),
)
def a14(spark, d):
    t = metrics.transition_scores(_test_rows(spark, d), ["workload"])
    return t.select("workload", "tp", "fp", "fn", "tn", *r6("event_precision", "event_recall", "event_f1", "false_alarm_rate"))


@query("a15_dense_confusion", sql("examples", *_PRED, "SELECT w.workload, CAST(a AS INT) AS truth, CAST(b AS INT) AS pred, count(x.row_index) AS n FROM (SELECT DISTINCT workload FROM test) w CROSS JOIN range(3) r(a) CROSS JOIN range(3) q(b) LEFT JOIN test x ON x.workload = w.workload AND x.target = a AND x.prediction = b GROUP BY 1, 2, 3"))
def a15(spark, d):
    return metrics.dense_confusion(_test_rows(spark, d), ["workload"])


_DIMS = ["workload", "cpu_or_core_id", "threads"]


@query("a16_group_accuracy", sql("examples", *_PRED, " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS rows, round(avg(CAST(target = prediction AS DOUBLE)), 6) AS accuracy FROM test GROUP BY {c}" for c in _DIMS)))
def a16(spark, d):
    return metrics.group_accuracy(_test_rows(spark, d), _DIMS).select("dimension", "value", "rows", *r6("accuracy"))


_SHARES = [f"{w}_share_{s}" for w in ("now", "next") for s in range(3)]


@query(
    "a17_phase_behavior",
    sql(
        "examples",
        "SELECT workload, count(*) AS rows, round(avg(CAST(state <> target AS DOUBLE)), 6) AS transition_rate, round(avg(CAST(state = target AS DOUBLE)), 6) AS stable_rate, "
        + ", ".join(f"round(avg(CAST({c} = {s} AS DOUBLE)), 6) AS {w}_share_{s}" for w, c in (("now", "state"), ("next", "target")) for s in range(3))
        + ", round(avg(run_length), 6) AS mean_run_length FROM examples WHERE state >= 0 AND target >= 0 GROUP BY workload",
    ),
)
def a17(spark, d):
    return metrics.behavior(frames.examples(spark, d), ["workload"]).select("workload", "rows", *r6("transition_rate", "stable_rate", *_SHARES, "mean_run_length"))


def _two_families(spark, d) -> DataFrame:
    """Truth and a last-state prediction of two counters' tertile states."""
    out = None
    for family, column in (("core_fp", COLS[0]), ("branch_control", COLS[1])):
        s = phases.tertile_states(frames.base(spark, d), column)
        one = s.select("row_index", "run_id", F.lit(family).alias("family"), "split", F.col("state").alias("prediction"), F.coalesce(F.lead("state").over(sequences.stream()), F.lit(-1)).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


def _sql_family(i: int, c: str) -> str:
    return f"""c{i} AS (SELECT quantile_cont({c}, CAST(1 AS DOUBLE) / 3) AS lo, quantile_cont({c}, CAST(2 AS DOUBLE) / 3) AS hi FROM base WHERE is_train),
s{i} AS (SELECT row_index, split, state AS prediction, coalesce(lead(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms), -1) AS target FROM (SELECT base.*, CASE WHEN {c} IS NULL THEN -1 WHEN {c} < lo THEN 0 WHEN {c} < hi THEN 1 ELSE 2 END AS state FROM base, c{i}))"""


@query(
    "a19_tuple_scores",
    sql("base", _sql_family(0, COLS[0]), _sql_family(1, COLS[1]), "SELECT count(*) AS rows, round(avg(CAST(a.target = a.prediction AND b.target = b.prediction AS DOUBLE)), 6) AS exact_tuple_accuracy, round(avg((CAST(a.target <> a.prediction AS INT) + CAST(b.target <> b.prediction AS INT)) / 2.0), 6) AS hamming_distance FROM s0 a JOIN s1 b USING (row_index)"),
)
def a19(spark, d):
    return metrics.tuple_scores(_two_families(spark, d), ["row_index"], ["core_fp", "branch_control"]).select("rows", *r6("exact_tuple_accuracy", "hamming_distance"))


@query("j9_align_families", sql("base", _sql_family(0, COLS[0]), _sql_family(1, COLS[1]), "SELECT row_index, b.prediction AS state__branch_control, a.prediction AS state__core_fp FROM s0 a JOIN s1 b USING (row_index)"))
def j9(spark, d):
    rows = _two_families(spark, d).withColumnRenamed("prediction", "state")
    return planning.align_families({f: rows.where(F.col("family") == f) for f in ("core_fp", "branch_control")})


@query("j10_retention", sql("examples", *_PRED, "SELECT workload, count(*) AS rows, round(avg(CAST(prediction = state AS DOUBLE)), 6) AS retention FROM pred WHERE state >= 0 GROUP BY workload"))
def j10(spark, d):
    student = _predicted(spark, d)
    teacher = models.last_state(frames.examples(spark, d))
    return metrics.retention(student, teacher, ["row_index"], ["workload"]).select("workload", "rows", *r6("retention"))


@query("j13_paired_models", sql("examples", *_PRED, "SELECT workload, count(*) AS rows, round(avg(CAST(prediction = target AS DOUBLE) - CAST(state = target AS DOUBLE)), 6) AS difference FROM test WHERE state >= 0 GROUP BY workload"))
def j13(spark, d):
    second = models.last_state(frames.examples(spark, d)).where("prediction >= 0")
    both = metrics.paired(_test_rows(spark, d), second, ["row_index"])
    right = (F.col("first_prediction") == F.col("target")).cast("double") - (F.col("second_prediction") == F.col("target")).cast("double")
    return both.groupBy("workload").agg(F.count("*").alias("rows"), F.round(F.avg(right), 6).alias("difference"))


@query("f2_evaluation_masks", sql("base", f"SELECT 'report' AS mask, split, count(*) AS rows FROM base WHERE split = {_first('test', 'val')} GROUP BY split UNION ALL SELECT 'select' AS mask, split, count(*) AS rows FROM base WHERE split = {_first('val', 'test')} GROUP BY split"))
def f2(spark, d):
    b = frames.base(spark, d)
    return metrics.mask_rows(b, metrics.REPORT).groupBy("split").agg(F.count("*").alias("rows")).select(F.lit("report").alias("mask"), "split", "rows").unionByName(metrics.mask_rows(b, metrics.SELECT).groupBy("split").agg(F.count("*").alias("rows")).select(F.lit("select").alias("mask"), "split", "rows"))


def _model_scores(spark, d) -> DataFrame:
    """Accuracy of four models by workload, on test rows, from one frame of examples."""
    named = {"last_state": models.last_state, "majority": models.majority, "state_majority": models.state_majority, "markov": models.markov}
    said = evaluation.stacked(frames.examples(spark, d).select("row_index", "workload", "split", "is_train", "state", "target"), named)
    return metrics.scores_by(metrics.usable(said), ["workload", "model"]).select("workload", "model", "rows", "accuracy")


_SCORES = [
    *_PRED,
    "mj AS (SELECT target AS m FROM examples WHERE is_train AND target >= 0 GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)",
    "sm AS (SELECT state, target AS q FROM examples WHERE is_train AND target >= 0 AND state >= 0 GROUP BY state, target QUALIFY row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, target) = 1)",
    "tst AS (SELECT test.*, m, coalesce(q, m) AS smp FROM test LEFT JOIN sm USING (state) CROSS JOIN mj)",
    """scores AS (SELECT workload, 'last_state' AS model, count(*) AS rows, avg(CAST(target = state AS DOUBLE)) AS accuracy FROM tst WHERE state >= 0 GROUP BY workload
  UNION ALL SELECT workload, 'majority', count(*), avg(CAST(target = m AS DOUBLE)) FROM tst GROUP BY workload
  UNION ALL SELECT workload, 'state_majority', count(*), avg(CAST(target = smp AS DOUBLE)) FROM tst GROUP BY workload
  UNION ALL SELECT workload, 'markov', count(*), avg(CAST(target = prediction AS DOUBLE)) FROM tst GROUP BY workload)""",
]


@query(
    "a21_gains_over_baselines",
    sql("examples", *_SCORES, "SELECT s.workload, s.model, s.rows, round(s.accuracy, 6) AS accuracy, round(s.accuracy - a.accuracy, 6) AS gain_over_last_state, round(s.accuracy - b.accuracy, 6) AS gain_over_majority FROM scores s LEFT JOIN scores a ON a.workload = s.workload AND a.model = 'last_state' LEFT JOIN scores b ON b.workload = s.workload AND b.model = 'majority'"),
)
def a21(spark, d):
    g = metrics.gains(_model_scores(spark, d), ["last_state", "majority"], by=["workload"])
    return g.select("workload", "model", "rows", *r6("accuracy", "gain_over_last_state", "gain_over_majority"))


@query("a22_metric_matrix", sql("examples", *_SCORES, "SELECT model, round(avg(accuracy) FILTER (workload = 'w0'), 6) AS set_w0, round(avg(accuracy) FILTER (workload = 'w1'), 6) AS set_w1, round(avg(accuracy), 6) AS mean FROM scores GROUP BY model"))
def a22(spark, d):
    return metrics.metric_matrix(_model_scores(spark, d), ["w0", "w1"], set_col="workload").select("model", *r6("set_w0", "set_w1", "mean"))


@query(
    "m27_adjusted_rand",
    sql(
        "base", _sql_family(0, COLS[0]), _sql_family(1, COLS[1]),
        "x AS (SELECT a.prediction AS a, b.prediction AS b, count(*)::DOUBLE AS n FROM s0 a JOIN s1 b USING (row_index) WHERE a.prediction >= 0 AND b.prediction >= 0 GROUP BY 1, 2)",
        "j AS (SELECT sum(n * (n - 1) / 2) AS j, sum(n) AS t FROM x)", "r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM x GROUP BY a))", "k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM x GROUP BY b))",
        "SELECT round((j - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) AS adjusted_rand FROM j, r, k",
    ),
)
def m27(spark, d):
    rows = _two_families(spark, d).withColumnRenamed("prediction", "state")
    both = planning.align_families({f: rows.where(F.col("family") == f) for f in ("core_fp", "branch_control")})
    return stats.adjusted_rand(both, "state__core_fp", "state__branch_control").select(*r6("adjusted_rand"))


# -- policy, cost, choice ----------------------------------------------------

_POWER = "CASE {c} WHEN 0 THEN 0.82 WHEN 1 THEN 0.94 ELSE 1.0 END"


@query(
    "m31_control_summary",
    sql(
        "examples",
        "y AS (SELECT *, least(greatest(target, 0), 2) AS actual, least(greatest(state, 0), 2) AS desired FROM examples)",
        "b AS (SELECT *, lag(desired) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms) AS before FROM y)",
        "ac AS (SELECT *, coalesce(last_value(CASE WHEN desired = before THEN desired END IGNORE NULLS) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS UNBOUNDED PRECEDING), 1) AS action FROM b)",
        "ch AS (SELECT *, CAST(action <> coalesce(lag(action) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms), 1) AS INT) AS changed FROM ac)",
        f"""SELECT workload, count(*) AS rows, round(100 * avg(CAST(desired = actual AS DOUBLE)), 6) AS prediction_accuracy_pct, round(100 * (1 - avg(CAST({_POWER.format(c='desired')} AS DOUBLE))), 6) AS raw_saving_pct, round(100 * (1 - avg(CAST({_POWER.format(c='action')} AS DOUBLE))), 6) AS guarded_saving_pct,
  round(100 * (1 - avg(CAST({_POWER.format(c='actual')} AS DOUBLE))), 6) AS oracle_saving_pct, round(100 * avg(CAST(action = 0 AS DOUBLE)), 6) AS low_power_pct, round(100 * avg(CAST(action < actual AS DOUBLE)), 6) AS underprovision_pct, round(1000 * avg(changed), 6) AS changes_per_1k FROM ch GROUP BY workload""",
    ),
)
def m31(spark, d):
    s = policy.control_summary(models.last_state(frames.examples(spark, d)), by=["workload"])
    return s.select("workload", "rows", *r6("prediction_accuracy_pct", "raw_saving_pct", "guarded_saving_pct", "oracle_saving_pct", "low_power_pct", "underprovision_pct", "changes_per_1k"))


@query(
    "p26_deployment_cost",
    """SELECT p_partkey, model, memory_bytes, approx_operations, CASE WHEN kind IN ('register', 'table_lookup') AND memory_bytes <= 256 AND approx_operations <= 16 THEN 'Very Low' WHEN kind IN ('table_lookup', 'comparisons', 'integer_arithmetic') AND memory_bytes <= 2048 AND approx_operations <= 128 THEN 'Low'
  WHEN kind IN ('integer_arithmetic', 'comparisons', 'MACs') AND memory_bytes <= 8192 AND approx_operations <= 1024 THEN 'Medium' WHEN kind IN ('MACs', 'softmax') AND memory_bytes <= 65536 AND approx_operations <= 100000 THEN 'High' ELSE 'Very High' END AS complexity
FROM (SELECT p_partkey, model, CASE model WHEN 'markov_phase_predictor' THEN 18.0 WHEN 'tcn_phase_classifier' THEN p_size * 4.0 * 50 ELSE p_size * 2.0 END + ceil(2 * p_size * 2 / 8.0) + 8 AS memory_bytes,
  CASE model WHEN 'markov_phase_predictor' THEN 3.0 WHEN 'tcn_phase_classifier' THEN greatest(128.0, p_size * 50 * 2.0) ELSE greatest(4.0, p_size) END AS approx_operations, CASE model WHEN 'tcn_phase_classifier' THEN 'MACs' ELSE 'table_lookup' END AS kind
  FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'markov_phase_predictor' WHEN 1 THEN 'tcn_phase_classifier' ELSE 'own_table' END AS model FROM part))""",
)
def p26(spark, d):
    part = adapter.table(spark, d, "part")
    k = F.col("p_partkey") % 3
    rows = part.select(
        "p_partkey", F.when(k == 0, "markov_phase_predictor").when(k == 1, "tcn_phase_classifier").otherwise("own_table").alias("model"), F.when(k == 1, F.col("p_size") * 50).otherwise(0).alias("parameter_count"),
        F.when(k == 2, F.col("p_size")).otherwise(0).alias("table_entries"), F.lit(2).alias("online_family_count"), F.col("p_size").alias("history_length"), F.lit(True).alias("uses_clustered_counter_state"),
    )
    return policy.deployment_cost(rows).select("p_partkey", "model", "memory_bytes", "approx_operations", "complexity")


def _counter_scores(spark, d) -> DataFrame:
    """A score per part as if brands were families and parts counters."""
    return adapter.table(spark, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("family"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("counter"), F.col("p_size").cast("double").alias("score"), F.col("p_partkey").alias("position"))


_CS = "cs AS (SELECT 'f' || (p_partkey % 3) AS family, 'c' || p_partkey AS counter, CAST(p_size AS DOUBLE) AS score, p_partkey AS position FROM part)"
_BRANDS = "cs AS (SELECT 'f' || (p_partkey % 3) AS family, p_brand AS counter, avg(p_size) AS score FROM part GROUP BY 1, 2)"


@query("t2_best_counter", f"WITH {_CS} SELECT family, counter, score, CAST(row_number() OVER (PARTITION BY family ORDER BY score DESC, position) = 1 AS INT) AS selected FROM cs")
def t2(spark, d):
    return selection.mark_best(_counter_scores(spark, d), ["family"]).select("family", "counter", "score", "selected")


@query("j16_counter_combinations", f"WITH {_BRANDS} SELECT a.counter || ',' || b.counter || ',' || c.counter AS counter_set, 'f0:' || a.counter || ';f1:' || b.counter || ';f2:' || c.counter AS family_counter_map, round((a.score + b.score + c.score) / 3, 6) AS score FROM cs a, cs b, cs c WHERE a.family = 'f0' AND b.family = 'f1' AND c.family = 'f2'")
def j16(spark, d):
    """Brands as counters, scored over all parts: the lists of options stay short at any size."""
    part = adapter.table(spark, d, "part")
    options = part.groupBy(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("family"), F.col("p_brand").alias("counter")).agg(F.avg("p_size").alias("score"))
    return selection.combinations(options, ["f0", "f1", "f2"]).select("counter_set", "family_counter_map", *r6("score"))


@query("j16_best_combination", f"WITH {_CS}, b AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, position) = 1) SELECT string_agg(family || ':' || counter, ';' ORDER BY family) AS family_counter_map, round(avg(score), 6) AS score FROM b")
def j16b(spark, d):
    return selection.best_combination(_counter_scores(spark, d), ["f0", "f1", "f2"]).select("family_counter_map", *r6("score"))


@query(
    "t3_latest_choice",
    """WITH x AS (SELECT o_custkey % 20 AS family, 'c' || o_orderkey AS counter, round(o_totalprice / 50000) AS score, o_orderkey % 2 AS selected, o_orderkey AS position FROM orders)
SELECT CAST(family AS VARCHAR) AS family, counter FROM x QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, selected DESC, position DESC) = 1""",
)
def t3(spark, d):
    o = adapter.table(spark, d, "orders")
    rows = o.select(F.lit("e").alias("experiment"), F.lit("s").alias("scope"), (F.col("o_custkey") % 20).cast("string").alias("family"), F.lit("singleton").alias("candidate_type"), F.concat(F.lit(" c"), F.col("o_orderkey").cast("string"), F.lit(" ,")).alias("counter_set"), F.round(F.col("o_totalprice") / 50000).alias("validation_score"), (F.col("o_orderkey") % 2).alias("selected"), F.col("o_orderkey").alias("position"))
    return selection.singleton_choice(rows).select("family", "counter")


@query(
    "j7_resolve_choice",
    """SELECT 'e' || (n_nationkey % 4) AS experiment, 's' || n_regionkey AS scope, CASE WHEN n_nationkey % 4 = 0 AND n_regionkey = 1 THEN 'exact' WHEN n_regionkey = 2 THEN 'scope' WHEN n_nationkey % 4 = 1 THEN 'experiment' ELSE 'general' END AS counter FROM nation GROUP BY 1, 2, 3""",
)
def j7(spark, d):
    wanted = adapter.table(spark, d, "nation").select(F.concat(F.lit("e"), (F.col("n_nationkey") % 4).cast("string")).alias("experiment"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("scope")).distinct()
    choice = spark.createDataFrame([("e0", "s1", "L1", "exact"), ("", "s2", "L1", "scope"), ("e1", "", "L1", "experiment"), ("", "", "L1", "general")], "experiment string, scope string, family string, counter string")
    return selection.resolve(wanted, choice).select("experiment", "scope", "counter")


@query("j17_workload_pairs", "SELECT DISTINCT a.w AS first, b.w AS second FROM (SELECT DISTINCT 'w' || (user_id % 7) AS w FROM events) a JOIN (SELECT DISTINCT 'w' || (user_id % 7) AS w FROM events) b ON a.w < b.w")
def j17(spark, d):
    return planning.workload_pairs(adapter.perf_long(spark, d))


@query("j17_chunked_groups", "WITH n AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS p, count(*) OVER () AS t FROM (SELECT DISTINCT 'w' || (user_id % 7) AS w FROM events)), s AS (SELECT slot, max(t) AS t FROM n, range(8) r(slot) GROUP BY slot) SELECT slot // 2 AS chunk, CAST(slot % 2 AS INT) AS member, w AS workload FROM s JOIN n ON p = slot % s.t")
def j17c(spark, d):
    return planning.chunked_groups(adapter.perf_long(spark, d), 2)


@query("a23_task_plan", "SELECT w AS workload, count(*) AS tasks, count(DISTINCT w) AS workloads, array_to_string(list_sort(list_distinct(list(t))), ',') AS thread_values FROM (SELECT DISTINCT 'w' || (user_id % 7) AS w FROM events) CROSS JOIN (VALUES (1), (4)) v(t) CROSS JOIN range(3) r(k) GROUP BY w")
def a23(spark, d):
    return planning.plan_summary(planning.task_plan(adapter.perf_long(spark, d), [1, 4], 3).withColumn("name", F.col("workload")), ["name"]).withColumnRenamed("name", "workload")


@query("v1_incomplete", "SELECT w AS workload, t AS threads FROM (SELECT DISTINCT 'w' || (user_id % 7) AS w FROM events) CROSS JOIN (VALUES (1), (4), (16), (32)) v(t) WHERE (w, t) NOT IN (SELECT 'w' || (user_id % 7), CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 16 END FROM events)")
def v1(spark, d):
    perf = adapter.perf_long(spark, d)
    return planning.incomplete(planning.task_plan(perf, [1, 4, 16, 32], 1), perf, ["workload", "threads"])


@query("p18_scenarios", "SELECT user_id, CASE user_id % 2 WHEN 0 THEN 'a,w' || (user_id % 7) || ',x' ELSE 'w' || (user_id % 7) END AS scenario FROM (SELECT DISTINCT user_id FROM events)")
def p18(spark, d):
    users = adapter.table(spark, d, "events").select("user_id").distinct()
    w = F.concat(F.lit("w"), (F.col("user_id") % 7).cast("string"))
    rows = users.withColumns({"workload": w, "co_running_workloads": F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("x, "), w, F.lit(", ,a"))).otherwise("")})
    return rows.select("user_id", splits.scenario(rows).alias("scenario"))


@query("j6_attach_split", sql("base", "SELECT split, count(*) AS rows, count(DISTINCT run_id) AS runs FROM base GROUP BY split"))
def j6(spark, d):
    rows = frames.wide(spark, d)
    known = adapter.split_by_run(rows).where("split <> 'train'")
    return splits.attach_split(rows, known).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("run_id").alias("runs"))


@query("x6_experiment_splits")
def x6(spark, d):
    """Splits of every mode; drawn by NumPy over sorted groups, so SQL cannot give them."""
    return splits.experiment_splits(frames.base(spark, d))


# -- redundancy --------------------------------------------------------------


@query("o1_drop_reasons", sql("wide", f"SELECT count(*) AS rows, count(*) FILTER ({' AND '.join(f'coalesce({c} > 0, false)' for c in COLS[:2])}) AS rows_kept, " + ", ".join(f"count(*) FILTER (NOT coalesce({c} > 0, false)) AS dropped_{c}" for c in COLS[:2]) + " FROM wide"))
def o1(spark, d):
    return features.drop_reasons(frames.wide(spark, d), COLS[:2])


@query("o2_missing_fractions", sql("wide", " UNION ALL ".join(f"SELECT '{c}' AS column, round(avg(CAST({c} IS NULL AS DOUBLE)), 6) AS missing_fraction FROM wide" for c in COLS).replace("AS column", 'AS "column"')))
def o2(spark, d):
    return features.missing_fractions(frames.wide(spark, d), COLS).select("column", *r6("missing_fraction"))


@query("o3_winsorize", sql("wide", "q AS (SELECT " + ", ".join(f"quantile_cont({c}, CAST(0.01 AS DOUBLE)) AS l{i}, quantile_cont({c}, CAST(0.99 AS DOUBLE)) AS h{i}" for i, c in enumerate(COLS[:2])) + " FROM wide)", "SELECT run_id, timestamp_ms, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, h{i}), l{i}) END, 6) AS {c}" for i, c in enumerate(COLS[:2])) + " FROM wide, q"))
def o3(spark, d):
    return features.winsorize(frames.wide(spark, d), COLS[:2]).select("run_id", "timestamp_ms", *r6(*COLS[:2]))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_PAIRS = [(a, b) for i, a in enumerate(_LI) for b in _LI[i + 1 :]]


@query("o5_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _LI_PAIRS))
def o5(spark, d):
    return stats.correlations(adapter.table(spark, d, "lineitem"), _LI).select("a", "b", *r6("r"))


_RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _LI) + " FROM lineitem)"


@query("o5_spearman", f"WITH {_RANKS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM rk" for a, b in _LI_PAIRS))
def o5s(spark, d):
    return stats.spearman(adapter.table(spark, d, "lineitem"), _LI).select("a", "b", *r6("r"))


@query(
    "o5_kendall",
    """WITH c AS (SELECT l_discount AS x, l_tax AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS s FROM c a JOIN c b ON a.x > b.x), t AS (SELECT sum(n) AS n FROM c),
tx AS (SELECT sum(n * (n - 1) / 2) AS tx FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS ty FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau FROM s, t, tx, ty""",
)
def o5k(spark, d):
    return stats.kendall(adapter.table(spark, d, "lineitem"), "l_discount", "l_tax").select(*r6("tau"))


@query(
    "o5_kendall_many_values",
    """WITH c AS (SELECT o_totalprice AS x, o_custkey AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS s FROM c a JOIN c b ON a.x > b.x), t AS (SELECT sum(n) AS n FROM c),
tx AS (SELECT sum(n * (n - 1) / 2) AS tx FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS ty FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau FROM s, t, tx, ty""",
)
def o5km(spark, d):
    """Nearly as many values as rows; ranges of about 2,000 pairs, so that small tables are cut as well."""
    return stats.kendall(adapter.table(spark, d, "orders"), "o_totalprice", "o_custkey", cells=2000).select(*r6("tau"))


@query("o6_top_correlations", "SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _LI_PAIRS) + ") ORDER BY abs(r) DESC, a, b LIMIT 3")
def o6(spark, d):
    return stats.top_correlations(stats.correlations(adapter.table(spark, d, "lineitem"), _LI), 3).select("a", "b", *r6("r"))


#: Columns that are tied in two groups, and one that stands alone.
_TIED = {"q": "l_quantity", "q2": "l_quantity * 2 + l_tax", "p": "l_extendedprice", "p2": "l_extendedprice - l_discount * 100", "line": "l_linenumber"}
_TIED_PAIRS = [(a, b) for i, a in enumerate(_TIED) for b in list(_TIED)[i + 1 :]]


@query(
    "o7_correlation_groups",
    "WITH RECURSIVE x AS (SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _TIED.items()) + " FROM lineitem), pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM x" for a, b in _TIED_PAIRS)
    + "), e AS (SELECT t, a, b FROM pr, (VALUES (0.7), (0.9), (0.99)) v(t) WHERE abs(r) >= t), s AS (SELECT t, a, b FROM e UNION ALL SELECT t, b, a FROM e), c(t, a, root) AS (SELECT t, a, a FROM s UNION SELECT s.t, s.b, c.root FROM c JOIN s ON s.t = c.t AND s.a = c.a), m AS (SELECT t, a, min(root) AS root FROM c GROUP BY t, a) SELECT string_agg(a, ',' ORDER BY a) AS members, CAST(t AS DOUBLE) AS threshold FROM m GROUP BY t, root",
)
def o7(spark, d):
    rows = adapter.table(spark, d, "lineitem").select(*[F.expr(e).cast("double").alias(c) for c, e in _TIED.items()])
    pairs = stats.correlations(rows, list(_TIED))
    return spark.createDataFrame([(",".join(g), t) for t in (0.7, 0.9, 0.99) for g in stats.correlation_groups(pairs, t)], "members string, threshold double")


@query("o8_variance_inflation", "SELECT c AS \"column\", round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 4) AS vif FROM lineitem CROSS JOIN (VALUES ('l_quantity'), ('l_extendedprice')) v(c) GROUP BY c")
def o8(spark, d):
    vif = stats.variance_inflation(adapter.table(spark, d, "lineitem"), _LI[:2])
    return spark.createDataFrame(vif, "column string, vif double").select("column", F.round("vif", 4).alias("vif"))


# -- learned on the driver's small tables: rows only ---------------------------


@query("m3_kmeans_phases")
def m3(spark, d):
    """States by k-means on scaled counters; the start is drawn by NumPy, so SQL cannot give it."""
    return phases.phase_states(frames.base(spark, d), COLS)[0].select("row_index", "state")


@query("m8_history_tree")
def m8(spark, d):
    """Test accuracy of a tree on four states of history."""
    h = sequences.histories(frames.states(spark, d), 4, ["state"])
    rows = h.select("row_index", "split", "is_train", "target", "state", *[F.col("history")[i][0].alias(f"h{i}") for i in range(4)])
    tree = models.fit_tree(rows.where("is_train"), [f"h{i}" for i in range(4)], "target", 6, 8)
    said = rows.withColumn("prediction", models.tree_expression(tree))
    return metrics.classification_scores(metrics.confusion(metrics.usable(metrics.mask_rows(said)))).withColumns({"internal": F.lit(tree.internal()), "leaves": F.lit(tree.leaves())})


@query("m17_kernel_classifier")
def m17(spark, d):
    """Test accuracy of random kernels with a linear head."""
    h = sequences.histories(frames.states(spark, d), 7, ["state"])
    kernels = models.random_kernels(1, 7, 16)
    rows = models.kernel_features(h.select("row_index", "split", "is_train", "target", "state", "history"), kernels)
    weights = models.ridge_head(rows.where("is_train and target >= 0"), 32)
    said = rows.withColumn("prediction", models.linear_prediction(weights))
    return metrics.classification_scores(metrics.confusion(metrics.usable(metrics.mask_rows(said))))


def _drawn(seed: int, resamples: int, columns: list[str]) -> list[str]:
    """Clauses from ``gc`` (counts by name) to ``drawn``: sums over groups drawn by hash, a row for each resample."""
    return [
        f"gp AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS place, count(*) OVER () AS n_groups FROM gc)",
        f"dr AS (SELECT r AS resample, CAST(floor({sql_uniform(seed, 'r', 'place')} * n_groups) AS BIGINT) AS place FROM gp, range({resamples}) t(r))",
        f"drawn AS (SELECT resample, {', '.join(f'sum({c}) AS {c}' for c in columns)} FROM dr JOIN gp USING (place) GROUP BY resample)",
    ]


_CELLS = [f"c{t}{p}" for t in range(3) for p in range(3)]
_GROUP_COUNTS = ", ".join(f"count(*) FILTER (target = {t} AND prediction = {p}) AS c{t}{p}" for t in range(3) for p in range(3)) + ", count(*) FILTER (target <> state) AS moved, count(*) FILTER (target <> state AND target = prediction) AS moved_right"
_ROWS_OF, _SAID = [f"(c{t}0 + c{t}1 + c{t}2)" for t in range(3)], [f"(c0{p} + c1{p} + c2{p})" for p in range(3)]
_RESAMPLED = (
    f"sc AS (SELECT resample, (c00 + c11 + c22) / CAST({' + '.join(_CELLS)} AS DOUBLE) AS accuracy,"
    f" ({' + '.join(f'coalesce(2.0 * c{t}{t} / nullif({_ROWS_OF[t]} + {_SAID[t]}, 0), 0)' for t in range(3))}) / ({' + '.join(f'CAST({_ROWS_OF[t]} + {_SAID[t]} > 0 AS INT)' for t in range(3))}) AS macro_f1,"
    f" ({' + '.join(f'coalesce(1.0 * c{t}{t} / nullif({_ROWS_OF[t]}, 0), 0)' for t in range(3))}) / ({' + '.join(f'CAST({_ROWS_OF[t]} > 0 AS INT)' for t in range(3))}) AS balanced_accuracy,"
    " moved_right / CAST(nullif(moved, 0) AS DOUBLE) AS transition_accuracy FROM drawn)"
)


def _ends(names) -> str:
    return " UNION ALL ".join(f"SELECT '{n}_{end}' AS metric, round(coalesce(quantile_cont({n}, CAST({q} AS DOUBLE)), 0), 6) AS value FROM sc" for n in names for end, q in (("low", 0.025), ("high", 0.975)))


def _metrics_of(spark, found: dict) -> DataFrame:
    return spark.createDataFrame(sorted((k, float(v)) for k, v in found.items()), "metric string, value double").withColumn("value", F.round("value", 6))


@query("m25_bootstrap_intervals", sql("examples", *_PRED, f"gc AS (SELECT run_id AS name, {_GROUP_COUNTS} FROM test GROUP BY run_id)", *_drawn(17, 500, [*_CELLS, "moved", "moved_right"]), _RESAMPLED, f"SELECT 'groups' AS metric, CAST(count(*) AS DOUBLE) AS value FROM gc UNION ALL SELECT 'resamples', 500 UNION ALL {_ends(stats.SCORES)}"))
def m25(spark, d):
    """500 resamples of the test runs, drawn by hash."""
    return _metrics_of(spark, stats.bootstrap_intervals(_test_rows(spark, d), "run_id", resamples=500))


@query("m26_bootstrap_difference", sql("examples", *_PRED, "gc AS (SELECT run_id AS name, count(*) AS n, count(*) FILTER (prediction = target) - count(*) FILTER (state = target) AS gap, count(*) FILTER (target <> state) AS moved, count(*) FILTER (target <> state AND prediction = target) AS moved_gap FROM test WHERE state >= 0 GROUP BY run_id)", *_drawn(29, 500, ["n", "gap", "moved", "moved_gap"]), "sc AS (SELECT gap / CAST(n AS DOUBLE) AS accuracy_difference, moved_gap / CAST(nullif(moved, 0) AS DOUBLE) AS transition_accuracy_difference FROM drawn)", "SELECT 'groups' AS metric, CAST(count(*) AS DOUBLE) AS value FROM gc UNION ALL SELECT 'resamples', 500 UNION ALL " + _ends(["accuracy_difference", "transition_accuracy_difference"]) + "".join(f" UNION ALL SELECT '{n}', round(avg({n}), 6) FROM sc UNION ALL SELECT '{n}_above_zero', round(avg(CAST({n} > 0 AS DOUBLE)), 6) FROM sc" for n in ("accuracy_difference", "transition_accuracy_difference"))))
def m26(spark, d):
    second = models.last_state(frames.examples(spark, d)).where("prediction >= 0")
    both = metrics.paired(_test_rows(spark, d), second, ["row_index"])
    return _metrics_of(spark, stats.bootstrap_difference(both, "run_id", resamples=500))


_TIMES = " + ".join(f"CAST(u >= {float(b)!r} AS INT)" for b in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]))


@query("m25_poisson_many_groups", f"WITH test AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) % 3 AS target, l_suppkey % 3 AS prediction, l_partkey % 3 AS state FROM lineitem), gc AS (SELECT l_orderkey AS name, {_GROUP_COUNTS} FROM test GROUP BY l_orderkey), du AS (SELECT gc.*, r AS resample, {sql_uniform(3, 'r', 'name')} AS u FROM gc, range(20) t(r)), dt AS (SELECT *, {_TIMES} AS times FROM du), drawn AS (SELECT resample, {', '.join(f'sum({c} * times) AS {c}' for c in [*_CELLS, 'moved', 'moved_right'])} FROM dt GROUP BY resample), {_RESAMPLED} SELECT resample, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(transition_accuracy, 6) AS transition_accuracy FROM sc")
def m25p(spark, d):
    """20 resamples of all orders, a group each: counts drawn from Poisson's distribution, so only sums are shuffled."""
    item = adapter.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("long") % 3).alias("target"), (F.col("l_suppkey") % 3).alias("prediction"), (F.col("l_partkey") % 3).alias("state"))
    return stats.bootstrap_scores(item, "l_orderkey", resamples=20, seed=3, scheme="poisson").select("resample", *r6(*stats.SCORES))


@query("m28_cluster_stability")
def m28(spark, d):
    return spark.createDataFrame([(r["k"], r["seeds"], r["ari_mean"], r["ari_min"], r["least_share_mean"]) for r in stats.stability(frames.base(spark, d), COLS, [2, 3], [17, 18])], "k int, seeds int, ari_mean double, ari_min double, least_share_mean double")


@query("m29_ablation")
def m29(spark, d):
    return selection.ablation(frames.states(spark, d), families={"branch_control": ["branch_instructions", "branch_mispredictions"], "LLC": ["llc_references", "llc_misses"]})


@query("t1_sorted_rows", sql("wide", "SELECT run_id, timestamp_ms, cpu_or_core_id, row_number() OVER (ORDER BY timestamp_ms, cpu_or_core_id, run_id) - 1 AS row_index FROM wide"))
def t1(spark, d):
    return sequences.with_row_index(frames.wide(spark, d).select("run_id", "timestamp_ms", "cpu_or_core_id"), ["timestamp_ms", "cpu_or_core_id", "run_id"])


@query("h11_row_numbers", sql("wide", "SELECT run_id, timestamp_ms, row_number() OVER (ORDER BY timestamp_ms, run_id) - 1 AS row_index FROM wide"))
def h11(spark, d):
    return sequences.with_row_index(frames.wide(spark, d).select("run_id", "timestamp_ms"), ["timestamp_ms", "run_id"])


@query("w16_rank_within", sql("wide", "SELECT run_id, timestamp_ms, row_number() OVER (PARTITION BY workload ORDER BY counter__instructions_retired DESC NULLS LAST, run_id, timestamp_ms) AS rank FROM wide"))
def w16(spark, d):
    return selection.rank_within(frames.wide(spark, d), ["workload"], [F.col(VALUE).desc_nulls_last(), F.col("run_id"), F.col("timestamp_ms")]).select("run_id", "timestamp_ms", "rank")


@query("a25_thread_scaling", sql("examples", *_PRED, "SELECT threads, count(*) AS rows, round(avg(CAST(target = prediction AS DOUBLE)), 6) AS accuracy, round(avg(CASE WHEN target <> state THEN CAST(target = prediction AS DOUBLE) END), 6) AS transition_accuracy, round(avg(CASE WHEN target = state THEN CAST(target = prediction AS DOUBLE) END), 6) AS stable_accuracy FROM test GROUP BY threads"))
def a25(spark, d):
    return metrics.scores_by(_test_rows(spark, d), ["threads"]).select("threads", "rows", *r6("accuracy", "transition_accuracy", "stable_accuracy"))


@query("a24_state_shares", sql("states", "SELECT workload, state, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY workload), 6) AS share FROM states GROUP BY workload, state"))
def a24(spark, d):
    s = frames.states(spark, d).groupBy("workload", "state").agg(F.count("*").alias("rows"))
    return s.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("workload")), 6))


from . import extra as _extra  # noqa: E402, F401  (adds its queries)
from . import more as _more  # noqa: E402, F401
