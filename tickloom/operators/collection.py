"""Tasks of a collection: sets, groups that run together, processors, order."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import SET_NAMES
from .planning import chunked_groups, numbered, workload_pairs


def processors(cpus: Sequence[int], thread_counts: Sequence[int]) -> list[list[int]]:
    """A run of processors for each process, one after the other; an error if they do not suffice."""
    free = list(cpus) or list(range(max(1, sum(thread_counts))))
    if sum(thread_counts) > len(free):
        raise ValueError("not enough processors for the processes that run together")
    out, at = [], 0
    for n in thread_counts:
        out.append(free[at : at + n])
        at += n
    return out


def wanted_workloads(available: DataFrame, requested: Sequence[str], name: str = "workload") -> DataFrame:
    """The requested names that are available, with their place in the request."""
    asked = available.sparkSession.createDataFrame([(w, i) for i, w in enumerate(requested)], f"{name} string, place int")
    return asked.join(available.select(name).distinct(), name, "left_semi")


def build_tasks(workloads: DataFrame, cpus: Sequence[int], repetitions: int, sets: Sequence[str] = ("set1", "set2", "set3"), threads: Sequence[int] = (1, 4, 16), group_size: int = 2, pairing: str = "all_combinations", hybrid_threads: int = 4, name: str = "workload") -> DataFrame:
    """A row per process to start: set_key, experiment_set, rep, concurrent_group_id, process_index, process_count, workload, threads, co_running_workloads, affinity, pairing_mode.

    ``set1`` runs each workload alone at each thread count; ``set2`` groups with one
    thread each; ``set3`` groups with ``hybrid_threads`` each.  Groups are all pairs, or
    with ``chunked`` consecutive runs of ``group_size``.  Workloads are a short list.
    """
    spark = workloads.sparkSession
    reps = F.explode(F.sequence(F.lit(1), F.lit(repetitions)))
    order = numbered(workloads, name)
    parts = []
    if "set1" in sets:
        kinds = spark.createDataFrame([(t, processors(cpus, [t])[0]) for t in threads], "threads int, affinity array<int>")
        alone = order.select(name).crossJoin(F.broadcast(kinds)).select("*", reps.alias("rep"))
        group = F.concat(F.lit("set1_r"), F.col("rep").cast("string"), F.lit("_"), F.col(name), F.lit("_t"), F.col("threads").cast("string"))
        parts.append(alone.select(F.lit("set1").alias("set_key"), "rep", group.alias("concurrent_group_id"), F.lit(0).alias("process_index"), F.lit(1).alias("process_count"), name, "threads", F.col(name).alias("co_running_workloads"), "affinity"))
    if pairing == "chunked":
        groups = chunked_groups(workloads, group_size, name).groupBy(F.col("chunk").alias("g")).agg(F.array_sort(F.collect_list(F.struct("member", name))).alias("m")).select((F.col("g") + 1).cast("int").alias("group_index"), F.col(f"m.{name}").alias("members"))
    else:
        if group_size > 2:
            raise ValueError("all combinations are pairs; use chunked for larger groups")
        pairs = workload_pairs(workloads, name)
        place = order.select(F.col(name).alias("first"), F.col("place").alias("i")), order.select(F.col(name).alias("second"), F.col("place").alias("j"))
        total = order.agg(F.count("*").alias("n"))
        # pair (i, j) of n in order of i and j
        index = F.expr("cast(i * n - i * (i + 1) div 2 + j - i as int)")
        groups = pairs.join(place[0], "first").join(place[1], "second").crossJoin(F.broadcast(total)).select(index.alias("group_index"), F.array("first", "second").alias("members"))
    groups = groups.where(F.size("members") >= 2)
    for key, each in (("set2", 1), ("set3", hybrid_threads)):
        if key not in sets:
            continue
        held = F.array(*[F.array(*map(F.lit, p)) for p in processors(cpus, [each] * max(2, group_size))])
        tail = F.lit("") if key == "set2" else F.lit(f"_t{each}")
        group = F.concat(F.lit(f"{key}_r"), F.col("rep").cast("string"), F.lit("_g"), F.col("group_index").cast("string"), tail)
        rows = groups.select("group_index", "members", reps.alias("rep")).select("*", F.posexplode("members").alias("process_index", name))
        parts.append(rows.select(F.lit(key).alias("set_key"), "rep", group.alias("concurrent_group_id"), "process_index", F.size("members").alias("process_count"), name, F.lit(each).alias("threads"), F.array_join("members", ",").alias("co_running_workloads"), held[F.col("process_index")].alias("affinity")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    names = F.create_map(*[F.lit(x) for pair in SET_NAMES.items() for x in pair])
    return out.withColumns({"experiment_set": names[F.col("set_key")], "pairing_mode": F.lit(pairing)})


def plan_by_set(tasks: DataFrame) -> DataFrame:
    """Per set: tasks, groups, workloads, thread counts in order."""
    return tasks.where(F.trim("set_key") != "").groupBy("set_key").agg(F.count("*").alias("tasks"), F.countDistinct("concurrent_group_id").alias("groups"), F.countDistinct("workload").alias("unique_workloads"), F.array_join(F.transform(F.sort_array(F.collect_set("threads")), lambda t: t.cast("string")), ",").alias("thread_values"))


def group_order(tasks: DataFrame, seed: int, group: str = "concurrent_group_id") -> DataFrame:
    """``group``, ``place``: groups in an order drawn by Python's generator; a plan has few groups, their names come to the driver in order."""
    names = sorted(r[0] for r in tasks.select(group).distinct().collect())
    random.Random(seed).shuffle(names)
    return tasks.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], f"{group} string, place int")


def expected_counts(workloads: int, repetitions: int, threads: int) -> dict[str, tuple[int, int]]:
    """Set -> (tasks, groups) that a complete collection has."""
    pairs = workloads * (workloads - 1) // 2
    alone = workloads * threads * repetitions
    return {"set1": (alone, alone), "set2": (2 * pairs * repetitions, pairs * repetitions), "set3": (2 * pairs * repetitions, pairs * repetitions)}


def collection_errors(tasks: DataFrame, results: DataFrame, workloads: int, repetitions: int, threads: int) -> DataFrame:
    """set_key, problem, expected, found: what a collection lacks; no rows if it is complete.

    ``results``: set_key, returncode.  Counts of tasks, groups and results, failed tasks,
    pairing modes, and pairs met in each repetition.
    """
    spark: SparkSession = tasks.sparkSession
    counts = expected_counts(workloads, repetitions, threads)
    want = spark.createDataFrame([(k, t, g) for k, (t, g) in counts.items()], "set_key string, want_tasks long, want_groups long")
    found = tasks.groupBy("set_key").agg(F.count("*").alias("tasks"), F.countDistinct("concurrent_group_id").alias("groups"), F.sum((F.col("pairing_mode") != "all_combinations").cast("long")).alias("other_pairing"))
    ran = results.groupBy("set_key").agg(F.count("*").alias("results"), F.sum((F.coalesce("returncode", F.lit(1)) != 0).cast("long")).alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    row = want.join(found, "set_key", "left").join(ran, "set_key", "left")
    checks = F.array(*[F.struct(F.lit(name).alias("problem"), w.alias("expected"), zero(f).cast("long").alias("found")) for name, w, f in (("tasks", F.col("want_tasks"), "tasks"), ("groups", F.col("want_groups"), "groups"), ("results", F.col("want_tasks"), "results"), ("failed", F.lit(0).cast("long"), "failed"), ("other_pairing", F.lit(0).cast("long"), "other_pairing"))])
    wrong = row.select("set_key", F.explode(checks).alias("c")).select("set_key", "c.*").where("expected <> found")
    pair = F.array_join(F.array_sort(F.split("co_running_workloads", ",")), ",")
    pairs = tasks.where(F.col("set_key").isin("set2", "set3")).groupBy("set_key", "rep").agg(F.countDistinct(pair).alias("found"))
    lacking = pairs.where(F.col("found") != workloads * (workloads - 1) // 2).select("set_key", F.concat(F.lit("pairs of repetition "), F.col("rep").cast("string")).alias("problem"), F.lit(workloads * (workloads - 1) // 2).cast("long").alias("expected"), "found")
    return wrong.unionByName(lacking)


def holdout_gaps(summary: DataFrame, workloads: DataFrame, models: Sequence[str], name: str = "workload") -> DataFrame:
    """experiment, model: the holdouts over all families that a summary (experiment, family, model) lacks: the grouped one and one per workload."""
    spark = summary.sparkSession
    wanted = workloads.select(F.concat(F.lit("leave_one_workload_out__"), F.col(name)).alias("experiment")).distinct().unionByName(spark.createDataFrame([("config_group_holdout",)], "experiment string"))
    wanted = wanted.select("experiment", F.explode(F.array(*map(F.lit, models))).alias("model"))
    return wanted.join(summary.where("family = '__all_families__'").select("experiment", "model").distinct(), ["experiment", "model"], "left_anti")


def column_gaps(columns: Sequence[str], required: Sequence[str] = ("run_id", "concurrent_group_id", "workload", "rep", "pairing_mode")) -> list[str]:
    """What a merged table lacks of the required columns, and ``counter__*`` if it has no counter."""
    missing = sorted(set(required) - set(columns))
    return missing + ([] if any(c.startswith("counter__") for c in columns) else ["counter__*"])
