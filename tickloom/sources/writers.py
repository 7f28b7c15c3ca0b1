"""Writers of result tables, through any store that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import PERF_LONG, directories, resolve_directories


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small value as indented JSON with sorted keys, in one file of a folder."""
    text = json.dumps(value, indent=2, sort_keys=True)
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    """What :func:`write_json` wrote, or any small JSON text."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def summary_of(df: DataFrame) -> dict:
    """The one row of a summary as a dictionary."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    return rows[0].asDict(recursive=True)


def write_perf(df: DataFrame, path: str) -> None:
    """perf_long rows as CSV with the fixed header; columns that are missing are blank."""
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PERF_LONG]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def read_perf_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PERF_LONG).csv(path, header=True)


def write_tables(tables: dict[str, DataFrame], path: str, manifest: dict | None = None) -> dict[str, int]:
    """Each table under its name, and ``manifest`` with their row counts, counted as written; the counts."""
    spark = next(iter(tables.values())).sparkSession
    rows = {}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{name}").count()
    write_json(spark, {**(manifest or {}), "rows": rows}, f"{path}/manifest")
    return rows


def write_merge(interval: DataFrame, aggregate: DataFrame, quality: DataFrame, path: str, files: DataFrame | None = None, manifest: DataFrame | None = None) -> dict:
    """The three tables of a merge and its summary: runs, rows, rows with device samples, columns of memory traffic, and what the manifest left out."""
    memory = sorted(c for c in interval.columns if c.startswith("counter__memory_") or c == "counter__total_memory_bandwidth")
    attached = F.sum(F.col("attached").cast("long")) if "attached" in interval.columns else F.lit(0).cast("long")
    summary = summary_of(interval.agg(F.countDistinct("run_id").alias("run_count"), F.count("*").alias("interval_rows"), F.coalesce(attached, F.lit(0)).alias("uncore_aligned_interval_rows")))
    summary |= {"aggregate_rows": aggregate.count(), "pmu_quality_families": quality.count(), "observed_system_wide_uncore_columns": memory, "manifest_used": manifest is not None}
    if files is not None and manifest is not None:
        kept, stale = resolve_directories(directories(files), manifest)
        summary |= {"manifest_run_count": manifest.select("directory").distinct().count(), "merged_run_count": kept.count(), "filtered_stale_run_count": stale.count()}
    write_tables({"interval": interval, "aggregate": aggregate, "quality": quality}, path, summary)
    return summary


def write_ablation(results: DataFrame, path: str, scope: str, horizon: int) -> None:
    """All rows of an ablation, and the selected ones as JSON."""
    chosen = [r.asDict() for r in results.where("selected = 1").select("family", "candidate_type", "counter_set", "family_counter_map", "validation_score").collect()]  # one per family and one for all
    write_tables({"results": results}, path, {"scope": scope, "horizon": horizon, "selected_rows": chosen})


def write_discovery(listing: DataFrame, aliases: DataFrame, readiness: DataFrame, platform: dict, path: str) -> None:
    """What was found on a machine: the listing of events, its description, the event of each family, and readiness."""
    ready = summary_of(readiness)
    spark = aliases.sparkSession
    listing.write.mode("overwrite").text(f"{path}/perf_list")
    write_json(spark, ready, f"{path}/study_readiness")
    write_json(spark, {**platform, "pmu_study_readiness": ready}, f"{path}/platform_info")
    write_json(spark, {r["family"]: r.asDict() for r in aliases.collect()}, f"{path}/event_alias_map")  # a row per counter family


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The alias table that :func:`write_discovery` wrote."""
    rows = list(read_json(spark, f"{path}/event_alias_map").values())
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)


def write_collection(tasks: DataFrame, results: DataFrame, path: str) -> None:
    """Planned tasks and what came of them, partitioned by set; rows of no set are left out."""
    for name, table in (("manifest", tasks), ("results", results)):
        table.where(F.trim("set_key") != "").write.mode("overwrite").partitionBy("set_key").parquet(f"{path}/{name}")


def key_values(lines: DataFrame, line: str = "value") -> DataFrame:
    """key, value of lines "key: value", cut at the first colon; the last one of a key counts."""
    at = F.instr(line, ":")
    rows = lines.where(at > 0).select(F.monotonically_increasing_id().alias("at"), F.trim(F.expr(f"substring({line}, 1, instr({line}, ':') - 1)")).alias("key"), F.trim(F.expr(f"substring({line}, instr({line}, ':') + 1)")).alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))
