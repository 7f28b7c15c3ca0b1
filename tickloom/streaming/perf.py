"""Counter text that lands in files while it is measured: parsed, pivoted by a watermark, joined with the nearest sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import parse_perf_lines


def perf_lines(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the lines of text files that land under ``path``/<run>/, with ``run_id``, the folder's name."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return reader.text(path).select("value", F.url_decode(run).alias("run_id"))


def perf_samples(lines: DataFrame, late: str = "10 seconds", interval: bool = True, began: Column | None = None) -> DataFrame:
    """``lines`` (value and any columns) as samples with ``ts``, the event time of the stream: ``began`` (the second day of 1970 without it) plus the line's own time.

    The parser is that of files at rest, so both give the same rows.  Samples later than
    ``late`` may be left out of what follows.
    """
    # a stream begins with a watermark of 1970, before which all is late
    start = F.lit(86_400_000.0) if began is None else F.unix_millis(began).cast("double")
    samples = parse_perf_lines(lines, interval).where("timestamp_ms IS NOT NULL")
    return samples.withColumn("ts", F.timestamp_micros(F.round((start + F.col("timestamp_ms")) * 1000).cast("long"))).withWatermark("ts", late)


def interval_rows(samples: DataFrame, counters: dict[str, str], keys: Sequence[str] = ("run_id", "cpu_or_core_id")) -> DataFrame:
    """A row per key and time once the watermark has passed it: sums of counters, their least enabled share and run time.

    ``counters``: normalised event name -> counter.  A time at which no listed event was
    met has a row of NULLs, as in a merge of files.
    """
    event = F.col("event_name_normalized")
    sums = []
    for name in dict.fromkeys(counters.values()):
        mine = event.isin(*[e for e, c in counters.items() if c == name])
        sums += [F.sum(F.when(mine, F.col("value"))).alias(f"counter__{name}"), F.min(F.when(mine, F.col("enabled_pct"))).alias(f"pmu_enabled_pct__{name}"), F.sum(F.when(mine, F.col("runtime_ns"))).alias(f"pmu_runtime_ns__{name}")]
    return samples.groupBy(*keys, "ts").agg(F.first("timestamp_ms").alias("timestamp_ms"), *sums)


def nearest_on_streams(core: DataFrame, other: DataFrame, carry: Sequence[str], tolerance: str, keys: Sequence[str] = ("run_id",), row: Sequence[str] = (), time: str = "ts") -> DataFrame:
    """As-of join of two streams: each core row with ``carry`` of the nearest other row of its key within ``tolerance``, the later one at a tie; NULL without one.

    Both sides carry a watermark on ``time``.  Core rows meet the other rows of their
    tolerance in a stream-stream interval join, so state holds what the tolerance and
    the watermarks leave open; the best one is a grouped maximum that is given out once
    the watermark has passed the row.  ``row``: columns that with keys and time tell core
    rows apart; equal rows give one.
    """
    sample = F.struct(F.col(time).alias("at"), *[F.col(c) for c in carry]).alias("__sample")
    right = other.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(time).alias("__at"), sample)
    span = F.expr(f"INTERVAL {tolerance}")
    on = (F.col("__at") >= F.col(time) - span) & (F.col("__at") <= F.col(time) + span)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    met = core.join(right, on, "leftOuter")
    gap = F.abs(F.unix_micros("__at") - F.unix_micros(time))
    best = met.groupBy(*keys, *row, time).agg(F.max_by("__sample", F.when(F.col("__at").isNotNull(), F.struct(-gap, F.col("__at")))).alias("__best"))
    return best.select(*keys, *row, time, *[F.col(f"__best.{c}").alias(c) for c in carry], F.col("__best").isNotNull().alias("attached"))
