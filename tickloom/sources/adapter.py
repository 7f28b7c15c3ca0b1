"""The star-schema test tables as counter samples.

``events`` holds long samples: a stream per user, a bucket per day, an event per
type.  ``lineitem`` serves as samples without time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event type -> counter that it stands for.
EVENT_COUNTERS = {
    "view": "instructions_retired",
    "click": "branch_instructions",
    "error": "branch_mispredictions",
    "purchase": "llc_references",
    "signup": "llc_misses",
}
DAY_MS = 86_400_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, cpu_or_core_id, timestamp_ms, event_name, value, enabled_pct, runtime_ns and what the run is."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), user.cast("string")).alias("run_id"),
        F.concat(F.lit("w"), (user % 7).cast("string")).alias("workload"),
        F.concat(F.lit("g"), F.floor(user / 2).cast("string")).alias("concurrent_group_id"),
        F.element_at(F.array(F.lit(1), F.lit(4), F.lit(16)), (user % 3 + 1).cast("int")).alias("threads"),
        (user % 4).cast("string").alias("cpu_or_core_id"),
        (F.unix_millis(F.date_trunc("day", "ts"))).cast("double").alias("timestamp_ms"),
        F.col("event_type").alias("event_name"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("enabled_pct"),
        (F.col("value") * 1000).alias("runtime_ns"),
        "event_id",
    )


def family_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, c, i) for i, (e, c) in enumerate(EVENT_COUNTERS.items())], "event_name string, counter string, priority int")


def split_by_run(streams: DataFrame) -> DataFrame:
    """A fixed split for oracle queries: 0-6 of user number mod 10 train, 7 val, 8-9 test, whole groups of two."""
    number = (F.regexp_extract("run_id", r"(\d+)$", 1).cast("long") / 2).cast("long") % 10
    return streams.select("run_id").distinct().select("run_id", F.when(number <= 6, "train").when(number == 7, "val").otherwise("test").alias("split"))
