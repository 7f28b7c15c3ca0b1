"""Building stored sequences: phases by scope, futures, the written schema, and reading them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import FAMILY_COUNTERS, counters_there, safe_counters
from ..sources.readers import exists, write_partitioned
from .features import _counter
from .lineage import cut
from .phases import grouped_phases, phase_states, tertile_states
from .quantiles import quantiles
from .sequences import STREAM, futures, stream

#: Where a state comes from.
LABEL_SOURCE = "train_split_kmeans_full_safe_counters"
#: Columns that are taken along as they are, blank where a table lacks them.
METADATA = ["timestamp_ms", "interval_duration_ms", "workload", "suite", "run_id", "threads", "cpu_or_core_id", "experiment_set", "concurrent_group_id", "process_index", "process_count", "co_running_workloads", "rep", "split"]
SCOPES = ("global", "per_workload")


def only(df: DataFrame, column: str = "suite", value: str = "parsec") -> DataFrame:
    """Rows of one suite; the condition reaches the scan."""
    return df.where(F.col(column) == value)


def scoped_states(df: DataFrame, scope: str = "global", counters: Sequence[str] | None = None, k: int = 3, seed: int = 17, workload: str = "workload", **how) -> tuple[DataFrame, list[dict]]:
    """``df`` with ``state``, the phase by k-means over all safe counters: over all rows, or within each workload by itself.

    Also what was learned, one entry per clustering.  Workloads are clustered together, a
    round for all of them.  ``df`` has is_train and row_index; a row of no workload has
    state -1.
    """
    columns = list(counters or safe_counters(df.columns))
    if scope == "global":
        states, learned = phase_states(df, columns, k, seed, **how)
        return df.join(states.select("row_index", "state"), "row_index", "left"), [{**learned, "scope": scope, "workload": ""}]
    if scope != "per_workload":
        raise ValueError(f"no such scope: {scope}")
    states, learned = grouped_phases(df, columns, workload, k, seed, **how)
    return df.join(states.select("row_index", "state"), "row_index", "left"), [{**x, "scope": scope, "workload": x["group"]} for x in learned]


def sequence_rows(df: DataFrame, counters: str | Sequence[str], horizon: int, state: str = "state") -> DataFrame:
    """The written rows of one counter or of several: metadata, state, states and values to come, and when the state changes.

    ``df`` has state and row_index; each row is read once and gives one for each counter.
    Columns that it lacks are NULL.
    """
    counters = [counters] if isinstance(counters, str) else list(counters)
    family = {c: next((f for f, names in FAMILY_COUNTERS.items() if c in names), "") for c in counters}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.lit(family[c]).alias("family"), _counter(df, c).cast("double").alias("value")) for c in counters])).alias("__c")
    long = df.select("*", each).select("*", F.col("__c.counter").alias("__counter"), F.col("__c.family").alias("__family"), F.col("__c.value").alias("__value"))
    rows = futures(long, horizon, state, "__value", stream((*STREAM, "__counter")))
    taken = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in METADATA]
    core = (F.col("cpu_or_core_id") if "cpu_or_core_id" in df.columns else F.lit(None)).cast("string").alias("core_id")
    return rows.select(
        *taken, core, "row_index", F.col(state).cast("int").alias("family_state"),
        *[F.col(f"future_state_{k}").cast("int").alias(f"future_state_{k}") for k in range(1, horizon + 1)],
        F.col("will_change").alias("will_change_within_horizon"), "time_to_change", F.col("__counter").alias("counter_name"), F.col("__family").alias("family"), F.lit(LABEL_SOURCE).alias("phase_label_source"),
        F.col("__value").alias("counter_value"), *[F.col(f"future_value_{k}").alias(f"future_counter_value_{k}") for k in range(1, horizon + 1)],
    )


def build_sequences(df: DataFrame, experiment: str, horizon: int, scopes: Sequence[str] = ("global",), counters: Sequence[str] | None = None, selected: dict[str, dict[str, str]] | None = None, seed: int = 17, **how) -> dict[str, DataFrame]:
    """Tables of an experiment: ``sequences`` (a row per scope, counter and interval), ``families`` (those of each family's selected counter), ``summary`` and ``clusters``.

    ``df``: wide rows with is_train, split and row_index; ``selected``: scope -> family ->
    counter.  A family without a selected counter, or whose counter is not there, has
    no rows and says so in ``summary``.
    """
    spark = df.sparkSession
    there = counters_there(df.columns)
    names = list(counters or [c for found in there.values() for c in found])
    sequences, clusters, choice = None, [], []
    for scope in scopes:
        states, learned = scoped_states(df, scope, seed=seed, **how)
        clusters += [(experiment, scope, x["workload"], x["clusters"], ",".join(x["pressure_counters"]), [list(map(float, c)) for c in x["centroids"]]) for x in learned]
        one = sequence_rows(states, names, horizon).withColumns({"experiment": F.lit(experiment), "scope": F.lit(scope)})
        sequences = one if sequences is None else sequences.unionByName(one)
        for family, have in there.items():
            chosen = (selected or {}).get(scope, {}).get(family, "")
            source = "missing_single_ablation_selection" if not chosen else "ablation_selected" if chosen in names else "selected_counter_sequence_missing"
            choice.append((experiment, scope, family, chosen, source, ",".join(have), int(bool(have))))
    sequences = cut(sequences)
    picks = spark.createDataFrame(choice, "experiment string, scope string, family string, selected_counters string, sequence_source string, available_counters string, available int")
    families = sequences.join(F.broadcast(picks.where("sequence_source = 'ablation_selected'").select("scope", "family", F.col("selected_counters").alias("counter_name"))), ["scope", "family", "counter_name"], "left_semi")  # six rows a scope
    counted = families.groupBy("scope", "family").agg(F.count("*").alias("rows"))
    thirds = None
    for scope, family, chosen, source in [(s, f, c, x) for _, s, f, c, x, _, _ in choice if s == "global" and x == "ablation_selected"]:
        one = quantiles(df.where("is_train").withColumn("__v", _counter(df, chosen)), ["__v"], [1 / 3, 2 / 3]).select(F.lit(scope).alias("scope"), F.lit(family).alias("family"), F.col("q____v")[0].alias("global_low_threshold"), F.col("q____v")[1].alias("global_high_threshold"))
        thirds = one if thirds is None else thirds.unionByName(one)
    summary = picks.join(counted, ["scope", "family"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    if thirds is None:
        summary = summary.withColumns({"global_low_threshold": F.lit(None).cast("double"), "global_high_threshold": F.lit(None).cast("double")})
    else:
        summary = summary.join(thirds, ["scope", "family"], "left")
    return {"sequences": sequences, "families": families, "summary": summary, "clusters": spark.createDataFrame(clusters, "experiment string, scope string, workload string, clusters int, pressure_counters string, centroids array<array<double>>")}


def write_sequences(tables: dict[str, DataFrame], path: str) -> None:
    """Sequences as one table partitioned by experiment, scope and counter; families, summary and clusters beside it.

    A partition that is written again is replaced, so no old rows stay.
    """
    spark = tables["sequences"].sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_partitioned(tables["sequences"], f"{path}/sequences", ["experiment", "scope", "counter_name"])
        write_partitioned(tables["families"], f"{path}/families", ["experiment", "scope", "family"])
        write_partitioned(tables["summary"], f"{path}/summary", ["experiment"])
        write_partitioned(tables["clusters"], f"{path}/clusters", ["experiment"])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """experiment, scope of what is stored, found by its partitions; an experiment counts once its summary is written."""
    if not exists(spark, f"{path}/summary"):
        return spark.createDataFrame([], "experiment string, scope string")
    done = spark.read.parquet(f"{path}/summary").select("experiment").distinct()
    return spark.read.parquet(f"{path}/sequences").select("experiment", "scope").distinct().join(done, "experiment", "left_semi")


def family_sequences(spark: SparkSession, path: str, experiment: str, scope: str) -> DataFrame:
    """Rows of each family's selected counter; only their partitions are read."""
    return spark.read.parquet(f"{path}/families").where((F.col("experiment") == experiment) & (F.col("scope") == scope))


def counter_sequences(spark: SparkSession, path: str, experiment: str, scope: str, counters: Sequence[str] | None = None) -> DataFrame:
    """Rows of all stored counters (or those named) of all families."""
    rows = spark.read.parquet(f"{path}/sequences").where((F.col("experiment") == experiment) & (F.col("scope") == scope))
    return rows if counters is None else rows.where(F.col("counter_name").isin(*counters))


def counter_text(summary: DataFrame, scope: str) -> DataFrame:
    """family, text: "counter (source)" for each family of a scope."""
    source = F.coalesce(F.nullif(F.trim("sequence_source"), F.lit("")), F.lit("family_default"))
    chosen = F.coalesce(F.nullif(F.trim("selected_counters"), F.lit("")), F.lit("default_family_features"))
    return summary.where(F.col("scope") == scope).select("family", F.concat(chosen, F.lit(" ("), source, F.lit(")")).alias("text"))


def tertile_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """How many rows and training rows each third has, over all rows or by group."""
    return tertile_states(df, column, by).groupBy(*by, "state").agg(F.count("*").alias("rows"), F.sum(F.col("is_train").cast("long")).alias("train_rows"))


def different_targets(tables: dict[str, DataFrame], key: str = "row_index", target: str = "target") -> DataFrame:
    """Rows whose target is not the same in all families: ``key`` and the number of different targets."""
    rows = None
    for table in tables.values():
        mine = table.select(key, target)
        rows = mine if rows is None else rows.unionByName(mine)
    return rows.groupBy(key).agg(F.countDistinct(target).alias("targets")).where("targets > 1")


def require_same_targets(tables: dict[str, DataFrame], key: str = "row_index", target: str = "target") -> None:
    if not different_targets(tables, key, target).isEmpty():
        raise ValueError("families do not share their targets")
