"""Collection plans, alias tables and checks that a collection is complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_event
from .lineage import small


def numbered(workloads: DataFrame, name: str = "workload") -> DataFrame:
    """Names (a short list) with their place in order."""
    return workloads.select(name).distinct().withColumn("place", F.row_number().over(Window.orderBy(name)) - 1)


def workload_pairs(workloads: DataFrame, name: str = "workload") -> DataFrame:
    """All unordered pairs of different workloads."""
    n = numbered(workloads, name)
    a, b = n.toDF("first", "i"), n.toDF("second", "j")
    return a.join(small(b), F.col("i") < F.col("j")).select("first", "second")


def chunked_groups(workloads: DataFrame, size: int = 2, name: str = "workload") -> DataFrame:
    """Groups of ``size`` in order; the last one is filled up from the front."""
    n = numbered(workloads, name)
    total = n.agg(F.count("*").alias("total"))
    slots = total.select("total", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / size) * size - 1).cast("int"))).alias("slot"))
    return slots.select(F.floor(F.col("slot") / size).alias("chunk"), (F.col("slot") % size).alias("member"), (F.col("slot") % F.col("total")).alias("place")).join(small(n), "place").select("chunk", "member", name)


def task_plan(workloads: DataFrame, threads: Sequence[int], repetitions: int, name: str = "workload") -> DataFrame:
    """A task per workload, thread count and repetition."""
    t = F.explode(F.array(*[F.lit(x) for x in threads]))
    return workloads.select(name).distinct().select(name, t.alias("threads")).select(name, "threads", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))


def plan_summary(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return plan.groupBy(*by).agg(F.count("*").alias("tasks"), F.countDistinct("workload").alias("workloads"), F.array_join(F.sort_array(F.collect_set("threads")), ",").alias("thread_values"))


def event_aliases(listing: DataFrame, line: str = "value") -> DataFrame:
    """normal name -> name out of ``perf list`` text; names of one line are alternatives (``a OR b``), a later line wins."""
    head = F.regexp_replace(F.trim(F.col(line)), r"\s+\[[^\]]*\]\s*$", "")
    names = listing.select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.split(head, r"\s+OR\s+")).alias("k", "name")).where(F.trim("name") != "")
    return names.groupBy(normal_event(F.col("name")).alias("normal")).agg(F.max_by(F.trim("name"), F.struct("at", "k")).alias("event_name"))


def resolve_aliases(candidates: DataFrame, supported: DataFrame) -> DataFrame:
    """Each family's first candidate that the machine has (family, event_name, priority; normal): vendor names before generic ones."""
    met = candidates.withColumn("normal", normal_event(F.col("event_name"))).join(supported.select("normal").distinct(), "normal")
    best = met.groupBy("family").agg(F.min_by("event_name", "priority").alias("event_name"), F.min("priority").alias("priority"))
    return candidates.select("family").distinct().join(best, "family", "left").withColumn("supported", F.col("event_name").isNotNull())


def device_events(spark: SparkSession, families: dict[str, str], devices: Sequence[int], prefix: str = "uncore_imc") -> DataFrame:
    """family x device event names."""
    return spark.createDataFrame([(f, f"{prefix}_{d}/{e}/") for f, e in families.items() for d in devices], "family string, event_name string")


def incomplete(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected combinations that were not found."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def require_complete(expected: DataFrame, found: DataFrame, keys: Sequence[str], what: str) -> None:
    missing = incomplete(expected, found, keys).limit(5).collect()
    if missing:
        raise ValueError(f"{what} is missing, for example: {[tuple(r) for r in missing]}")


def bad_states(df: DataFrame, state: str = "state", classes: int = 3) -> DataFrame:
    """Rows whose state is none of -1 to classes - 1."""
    return df.where(F.col(state).isNull() | ~F.col(state).between(-1, classes - 1) | (F.col(state) != F.floor(F.col(state))))


def require_states(df: DataFrame, state: str = "state", classes: int = 3) -> None:
    """States must be -1 to classes - 1."""
    if not bad_states(df, state, classes).isEmpty():
        raise ValueError(f"{state} holds values that are no state")


def align_families(tables: dict[str, DataFrame], state: str = "state", key: str = "row_index") -> DataFrame:
    """A column of states per family, joined on the row's number; rows that a family lacks are left out."""
    out = None
    for family in sorted(tables):
        mine = tables[family].select(key, F.col(state).alias(f"state__{family}"))
        out = mine if out is None else out.join(mine, key)
    return out
