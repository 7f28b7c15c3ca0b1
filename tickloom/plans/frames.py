"""Frames that several queries share, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import row_mean
from ..operators import features, merge, phases, sequences
from ..sources import adapter

COUNTERS = list(adapter.EVENT_COUNTERS.values())
RUN_KEYS = ["run_id", "workload", "concurrent_group_id", "threads", "cpu_or_core_id", "timestamp_ms"]
VALUE = "counter__instructions_retired"


def samples(spark: SparkSession, d: str) -> DataFrame:
    return merge.map_events(adapter.perf_long(spark, d), adapter.family_map(spark))


def wide(spark: SparkSession, d: str, quality: bool = False) -> DataFrame:
    return merge.pivot_sum(samples(spark, d), COUNTERS, RUN_KEYS, quality, order=["event_id"])


def base(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows with a split by run and a number that follows run and time."""
    rows = wide(spark, d)
    number = F.regexp_extract("run_id", r"(\d+)$", 1).cast("long") * 100_000 + (F.col("timestamp_ms") / adapter.DAY_MS).cast("long")
    split = (F.regexp_extract("run_id", r"(\d+)$", 1).cast("long") / 2).cast("long") % 10
    return rows.withColumns({"row_index": number, "split": F.when(split <= 6, "train").when(split == 7, "val").otherwise("test")}).withColumn("is_train", F.col("split") == "train")


def states(spark: SparkSession, d: str) -> DataFrame:
    return phases.tertile_states(base(spark, d), VALUE)


def examples(spark: SparkSession, d: str) -> DataFrame:
    """States with run length, previous and next state; the last row of a stream has -1 to come."""
    rows = sequences.temporal_features(states(spark, d), context=())
    return rows.withColumn("target", F.coalesce(F.lead("state").over(sequences.stream()), F.lit(-1)))


def mean_of(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("mean", row_mean([F.col(c) for c in columns]))


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return features.fill_and_scale(features.log_counters(base(spark, d), [f"counter__{c}" for c in COUNTERS]), [f"counter__{c}" for c in COUNTERS])


def sql_uniform(*keys) -> str:
    """The number that ``hashed_uniform`` makes of the same keys (SQL expressions)."""
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


SQL_EVENTS = """
perf AS (
  SELECT 'run_' || user_id AS run_id, user_id, 'w' || (user_id % 7) AS workload, 'g' || (user_id // 2) AS concurrent_group_id,
    CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 16 END AS threads, CAST(user_id % 4 AS VARCHAR) AS cpu_or_core_id,
    CAST(epoch_ms(date_trunc('day', ts)) AS DOUBLE) AS timestamp_ms, event_type AS event_name, value,
    CAST(json_extract(props, '$.k') AS DOUBLE) AS enabled_pct, value * 1000 AS runtime_ns,
    CASE event_type WHEN 'view' THEN 'instructions_retired' WHEN 'click' THEN 'branch_instructions' WHEN 'error' THEN 'branch_mispredictions'
      WHEN 'purchase' THEN 'llc_references' WHEN 'signup' THEN 'llc_misses' END AS counter
  FROM events)"""


def sql_wide(quality: bool = False) -> str:
    parts = []
    for c in COUNTERS:
        parts.append(f"sum(value) FILTER (counter = '{c}') AS counter__{c}")
        if quality:
            parts.append(f"min(enabled_pct) FILTER (counter = '{c}') AS pmu_enabled_pct__{c}")
            parts.append(f"sum(runtime_ns) FILTER (counter = '{c}') AS pmu_runtime_ns__{c}")
    return f"wide AS (SELECT {', '.join(RUN_KEYS)}, any_value(user_id) AS user_id, {', '.join(parts)} FROM perf GROUP BY {', '.join(RUN_KEYS)})"


SQL_BASE = """
base AS (
  SELECT *, user_id * 100000 + CAST(timestamp_ms / 86400000.0 AS BIGINT) AS row_index,
    CASE WHEN (user_id // 2) % 10 <= 6 THEN 'train' WHEN (user_id // 2) % 10 = 7 THEN 'val' ELSE 'test' END AS split,
    (user_id // 2) % 10 <= 6 AS is_train
  FROM wide)"""
SQL_STATES = """
cuts AS (SELECT quantile_cont(counter__instructions_retired, CAST(1 AS DOUBLE) / 3) AS lo, quantile_cont(counter__instructions_retired, CAST(2 AS DOUBLE) / 3) AS hi FROM base WHERE is_train),
states AS (
  SELECT base.*, CASE WHEN counter__instructions_retired IS NULL OR lo IS NULL THEN -1 WHEN counter__instructions_retired < lo THEN 0
    WHEN counter__instructions_retired < hi THEN 1 ELSE 2 END AS state
  FROM base, cuts)"""
SQL_EXAMPLES = """
moved AS (
  SELECT *, CASE WHEN state <> lag(state) OVER w THEN 1 ELSE 0 END AS moved, coalesce(lag(state) OVER w, -1) AS previous, coalesce(lead(state) OVER w, -1) AS target
  FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms)),
numbered AS (SELECT *, sum(moved) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms) AS run_number FROM moved),
examples AS (SELECT *, row_number() OVER (PARTITION BY run_id, cpu_or_core_id, run_number ORDER BY timestamp_ms) AS run_length FROM numbered)"""


def sql(*parts: str, quality: bool = False) -> str:
    """WITH clause up to what is asked for, then the query."""
    names = {"perf": SQL_EVENTS, "wide": sql_wide(quality), "base": SQL_BASE, "states": SQL_STATES, "examples": SQL_EXAMPLES}
    order = list(names)
    *extra, query = parts
    upto = extra[0]
    clauses = [names[n] for n in order[: order.index(upto) + 1]] + [x for x in extra[1:]]
    return "WITH " + ",\n".join(clauses) + "\n" + query
