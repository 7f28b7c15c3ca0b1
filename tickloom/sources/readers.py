"""Readers and writers: perf text, CSV, JSON, phase logs, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_event, normal_event, safe_float
from .digests import file_digests  # noqa: F401  (one of the readers)

PERF_LONG = T.StructType(
    [
        T.StructField("timestamp_ms", T.DoubleType()),
        T.StructField("cpu_or_core_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_name_normalized", T.StringType()),
        T.StructField("runtime_ns", T.DoubleType()),
        T.StructField("enabled_pct", T.DoubleType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("metric_unit", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
PHASE_LOG = T.StructType([T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("phase_label", T.StringType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads holds ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of strings with its header; a path that is not there is an empty table of ``schema``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema or "value string")
    return spark.read.csv(path, header=True, inferSchema=False)


def read_metadata(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Run records, a JSON object per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_phase_log(spark: SparkSession, path: str) -> DataFrame:
    """Phase intervals with their position in the file; none if there is no log."""
    rows = read_csv(spark, path, "start_ms string, end_ms string, phase_label string")
    return rows.select(safe_float(F.col("start_ms")).alias("start_ms"), safe_float(F.col("end_ms")).alias("end_ms"), "phase_label", F.monotonically_increasing_id().alias("position"))


def parse_perf_lines(lines: DataFrame, interval: bool = True, line: str = "value") -> DataFrame:
    """``perf stat -x,`` text as perf_long rows.

    Interval lines begin with seconds, and with ``CPUn`` after them if counted per
    CPU, which shifts the other fields; aggregate lines begin with ``CPUn`` or the
    value.  Short lines and comments are skipped.  Other columns are kept.
    """
    parts = F.split(F.col(line), ",", -1)
    first = 1 if interval else 0
    rows = lines.withColumn("__p", parts).where(~F.trim(F.col(line)).startswith("#") & (F.trim(F.col(line)) != "") & (F.size("__p") >= (4 if interval else 3)))
    per_cpu = F.trim(F.get("__p", F.lit(first))).startswith("CPU")
    at = F.lit(first) + per_cpu.cast("int")

    def field(k: int) -> Column:
        return F.trim(F.get("__p", at + k))

    raw = field(0)
    out = {
        "timestamp_ms": safe_float(F.get("__p", F.lit(0))) * 1000.0 if interval else F.lit(None).cast("double"),
        "cpu_or_core_id": F.when(per_cpu, F.substring(F.trim(F.get("__p", F.lit(first))), 4, 12)).otherwise(""),
        "value": safe_float(raw),
        "unit": field(1),
        "event_name": clean_event(field(2)),
        "event_name_normalized": normal_event(clean_event(field(2))),
        "runtime_ns": safe_float(field(3)),
        "enabled_pct": safe_float(field(4)),
        "metric_value": safe_float(field(5)),
        "metric_unit": F.coalesce(field(6), F.lit("")),
        "status": F.when(raw.startswith("<"), F.regexp_replace(raw, "[<>]", "")).otherwise("ok"),
    }
    parsed = rows.withColumns({f"__{k}": v for k, v in out.items()})
    return parsed.select(*[c for c in lines.columns if c != line and c not in out], *[F.col(f"__{k}").alias(k) for k in out])


def read_perf(spark: SparkSession, path: str, interval: bool = True) -> DataFrame:
    return parse_perf_lines(spark.read.text(path), interval)


def union_ragged(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; what a table lacks is NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct resolved folders of a listing of files."""
    clean = F.regexp_replace(F.regexp_replace(F.col(path), r"/+", "/"), r"/[^/]*$", "")
    return files.select(clean.alias("directory")).distinct()


def resolve_directories(found: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders that the manifest names, stale ones that it does not)."""
    listed = manifest.select("directory").distinct()
    return found.join(listed, "directory", "left_semi"), found.join(listed, "directory", "left_anti")
