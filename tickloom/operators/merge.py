"""From long counter samples to one wide row per run, unit and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_event
from .lineage import small
from .quantiles import quantiles

KEYS = ["run_id", "cpu_or_core_id", "timestamp_ms"]


def map_events(samples: DataFrame, aliases: DataFrame, event: str = "event_name") -> DataFrame:
    """Adds ``counter``, NULL where no alias has the event's normal name.

    ``aliases`` (event_name, counter, priority) is a small table of names; of
    aliases that collide the one of the highest priority wins.
    """
    names = aliases.groupBy(normal_event(F.col("event_name")).alias("__name")).agg(F.max_by("counter", "priority").alias("counter"))
    return samples.withColumn("__name", normal_event(F.col(event))).join(small(names), "__name", "left").drop("__name")


def pivot_sum(samples: DataFrame, counters: Sequence[str], keys: Sequence[str] = KEYS, quality: bool = False, value: str = "value", order: Sequence[str] = ()) -> DataFrame:
    """One row per key with the sum of each counter's values, NULL where none was read.

    Keys whose samples match no counter keep a row.  With ``quality`` also the
    least enabled share and the sum of run times.  The list of counters is given,
    so there is no extra pass for it and one shuffle, combined map-side.

    With ``order`` the values of a key are added one after the other in that order (as a
    running sum, not combined map-side), so that the last bits of a sum do not depend on
    how rows are dealt, and rows are ranked or cut by it the same in every run.
    """
    if order:
        at = Window.partitionBy(*keys).orderBy(*order)
        to_here = at.rowsBetween(Window.unboundedPreceding, 0)
        running = {}
        for c in counters:
            mine = F.col("counter") == c
            running[f"counter__{c}"] = F.sum(F.when(mine, F.col(value))).over(to_here)
            if quality:
                running[f"pmu_enabled_pct__{c}"] = F.min(F.when(mine, F.col("enabled_pct"))).over(to_here)
                running[f"pmu_runtime_ns__{c}"] = F.sum(F.when(mine, F.col("runtime_ns"))).over(to_here)
        last = samples.withColumns({**running, "__last": F.lead(F.lit(1)).over(at).isNull()})
        return last.where("__last").select(*keys, *running)
    out = []
    for c in counters:
        mine = F.col("counter") == c
        out.append(F.sum(F.when(mine, F.col(value))).alias(f"counter__{c}"))
        if quality:
            out.append(F.min(F.when(mine, F.col("enabled_pct"))).alias(f"pmu_enabled_pct__{c}"))
            out.append(F.sum(F.when(mine, F.col("runtime_ns"))).alias(f"pmu_runtime_ns__{c}"))
    return samples.groupBy(*keys).agg(*out)


def time_key(timestamp: Column) -> Column:
    """Times that agree to a thousandth of a millisecond are one."""
    return F.round(timestamp, 3)


def with_durations(rows: DataFrame, unit: Sequence[str] = ("run_id", "cpu_or_core_id"), time: str = "timestamp_ms") -> DataFrame:
    """Adds ``interval_duration_ms``: time since the unit's last row.

    The first row, and one that is not later than the last, get the unit's median
    positive step; NULL where there is none.
    """
    w = Window.partitionBy(*unit).orderBy(time)
    step = F.col(time) - F.lag(time).over(w)
    stepped = rows.withColumn("__step", step)
    steps = stepped.select(*unit, F.when(F.col("__step") > 0, F.col("__step")).cast("double").alias("step"))
    usual = quantiles(steps, ["step"], [0.5], unit).select(*unit, F.col("q__step")[0].alias("__usual"))
    u, s = usual.alias("u"), stepped.alias("s")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"u.{c}")) for c in unit]
    return s.join(u, on, "left").select(*[F.col(f"s.`{c}`") for c in rows.columns], F.when(F.col("s.__step") > 0, F.col("s.__step")).otherwise(F.coalesce("u.__usual", "s.__step")).alias("interval_duration_ms"))


def collection_quality(wide: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Per counter: samples, mean, 5th percentile and least enabled share, shares below 90 and at zero, mean run time."""
    present = [c for c in counters if f"pmu_enabled_pct__{c}" in wide.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(f"pmu_enabled_pct__{c}").alias("enabled"), F.col(f"pmu_runtime_ns__{c}").alias("runtime")) for c in present]))
    rows = wide.select(pairs.alias("p")).select("p.*")
    low = quantiles(rows, ["enabled"], [0.05], ["counter"], few_groups=True).select("counter", F.col("q__enabled")[0].alias("enabled_pct_p05"))
    return rows.groupBy("counter").agg(
        F.count("enabled").alias("samples"),
        F.avg("enabled").alias("enabled_pct_mean"),
        F.min("enabled").alias("enabled_pct_min"),
        F.avg((F.col("enabled") < 90).cast("double")).alias("fraction_enabled_below_90pct"),
        F.avg((F.col("enabled") <= 0).cast("double")).alias("fraction_enabled_zero"),
        F.avg("runtime").alias("runtime_ns_mean"),
    ).join(low, "counter", "left")


def device_totals(samples: DataFrame, read: str = "memory_read_bandwidth", write: str = "memory_write_bandwidth", keys: Sequence[str] = ("run_id", "timestamp_ms")) -> DataFrame:
    """Sums over devices per time, and read plus write where either is there."""
    wide = pivot_sum(samples, [read, write], keys)
    r, w = F.col(f"counter__{read}"), F.col(f"counter__{write}")
    total = F.when(r.isNotNull() | w.isNotNull(), F.coalesce(r, F.lit(0.0)) + F.coalesce(w, F.lit(0.0)))
    return wide.withColumn("counter__total_memory_bandwidth", total)


def label_phases(rows: DataFrame, log: DataFrame, keys: Sequence[str] = ("run_id",), time: str = "timestamp_ms", bin_ms: float = 3_600_000.0) -> DataFrame:
    """Adds ``phase_label``: that of the first interval [start, end) of the run's log that holds the time; '' if none does.

    ``log``: keys, start_ms, end_ms, phase_label, position.  Times and intervals meet
    in bins of ``bin_ms``, an equi-join that holds for any number of intervals; of
    several, the least position is found by a grouped minimum.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), F.greatest(F.ceil(F.col("end_ms") / bin_ms) - 1, F.floor(F.col("start_ms") / bin_ms))))
    spans = log.where("end_ms > start_ms").withColumn("__bin", bins)
    times = rows.select(*keys, time).distinct().withColumn("__bin", F.floor(F.col(time) / bin_ms))
    met = times.join(spans, [*keys, "__bin"]).where((F.col("start_ms") <= F.col(time)) & (F.col(time) < F.col("end_ms")))
    first = met.groupBy(*keys, time).agg(F.min_by("phase_label", "position").alias("phase_label"))
    return rows.join(first, [*keys, time], "left").withColumn("phase_label", F.coalesce("phase_label", F.lit("")))


def nearest(core: DataFrame, other: DataFrame, carry: Sequence[str], keys: Sequence[str] = ("run_id",), time: str = "timestamp_ms", default_tolerance: float = 15.0, chunk_ms: float = 3_600_000.0) -> DataFrame:
    """As-of join: each core row gets ``carry`` of the nearest other row of its key, the later one at a tie.

    Nothing is taken from farther than the median positive step of the key's other
    rows.  Both tables go once through a window by key and chunk of ``chunk_ms``: the
    last other row before and the first one from the time on.  What lies in other
    chunks is the last or first row of the nearest chunk that has one, found over a
    row per chunk.  So a long run is many tasks, and no row meets more than two
    candidates.
    """
    chunk = F.floor(F.col(time) / chunk_ms).alias("__chunk")
    sample = F.struct(F.col(time).alias("at"), *[F.col(c) for c in carry])
    right = other.where(F.col(time).isNotNull()).select(*keys, F.col(time), chunk, F.lit(1).alias("__kind"), sample.alias("__sample"))
    left = core.select(*keys, F.col(time), chunk, F.lit(0).alias("__kind"), F.struct(*[F.col(c) for c in core.columns if c not in (*keys, time)]).alias("__row"))
    both = left.unionByName(right, allowMissingColumns=True)
    # a row per key and chunk: its own ends, and those of the chunks about it
    ends = both.groupBy(*keys, "__chunk").agg(F.min_by("__sample", F.when(F.col("__sample").isNotNull(), F.col(time))).alias("first"), F.max_by("__sample", F.when(F.col("__sample").isNotNull(), F.col(time))).alias("last"))
    order = Window.partitionBy(*keys).orderBy("__chunk")
    around = ends.select(*keys, "__chunk", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"), F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    on = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in (*keys, "__chunk")]
    known = both.alias("b").join(around.alias("a"), on, "left").select("b.*", "a.__earlier", "a.__later")
    within = Window.partitionBy(*keys, "__chunk")
    before = within.orderBy(time, "__kind").rowsBetween(Window.unboundedPreceding, -1)
    after = within.orderBy(F.col(time).desc(), F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = known.withColumns({"__prev": F.coalesce(F.last("__sample", ignorenulls=True).over(before), F.col("__earlier")), "__next": F.coalesce(F.last("__sample", ignorenulls=True).over(after), F.col("__later"))})
    step = F.when(F.col(time) > F.col("__prev.at"), F.col(time) - F.col("__prev.at"))
    steps = seen.where("__kind = 1").select(*keys, step.alias("__step"))
    limits = quantiles(steps, ["__step"], [0.5], keys).select(*keys, F.coalesce(F.col("q____step")[0], F.lit(default_tolerance)).alias("__limit"))
    back, ahead = F.col(time) - F.col("__prev.at"), F.col("__next.at") - F.col(time)
    later = F.col("__next").isNotNull() & (F.col("__prev").isNull() | (ahead <= back))
    picked = seen.where("__kind = 0").withColumn("__best", F.when(later, F.col("__next")).otherwise(F.col("__prev"))).withColumn("__gap", F.abs(F.col("__best.at") - F.col(time)))
    joined = picked.join(limits, list(keys), "left")
    near = F.col("__gap") <= F.col("__limit")
    own = [c for c in core.columns if c not in (*keys, time)]
    return joined.select(*keys, time, *[F.col(f"__row.`{c}`").alias(c) for c in own], *[F.when(near, F.col(f"__best.`{c}`")).alias(c) for c in carry], F.coalesce(near, F.lit(False)).alias("attached"))


def unit_identity(samples: DataFrame, topology: Column | None = None, scope: str = "system_wide_cpu", task_unit: str = "cpu_or_core_id") -> DataFrame:
    """Adds ``unit_id``, ``physical_core_id`` and ``collection_scope`` for task-local, per-CPU and per-core collection."""
    cpu = F.trim(F.col("cpu_or_core_id"))
    physical = F.coalesce(F.nullif(F.element_at(topology, cpu), F.lit("")), cpu) if topology is not None else cpu
    blank = F.coalesce(cpu, F.lit("")) == ""
    return samples.withColumns(
        {
            "unit_id": F.when(blank, F.col(task_unit)).otherwise(physical if scope == "system_wide_physical_core" else cpu),
            "physical_core_id": F.when(blank, "").otherwise(physical),
            "collection_scope": F.when(blank, "task_local").otherwise(scope),
        }
    )


def merge_summary(wide: DataFrame, counters: Sequence[str]) -> DataFrame:
    """One row: rows, runs, units, workloads, and rows in which each counter was read."""
    return wide.agg(
        F.count("*").alias("rows"), F.countDistinct("run_id").alias("runs"), F.countDistinct("cpu_or_core_id").alias("units"), *[F.count(f"counter__{c}").alias(f"rows_{c}") for c in counters]
    )


def attach_metadata(rows: DataFrame, runs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with what is known of their run: those of ``columns`` that ``runs`` has."""
    return rows.join(runs.select(key, *[c for c in columns if c in runs.columns]), key, "left")
