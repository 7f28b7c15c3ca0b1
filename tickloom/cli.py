"""Command line: merge runs, build sequences, choose counters, run the detector, plan tasks, or run a registered query."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import domain
from .operators import build, collection, evaluation, features, merge, phases, selection, splits
from .operators.lineage import fresh_path
from .sources import readers, writers


def _split(df: DataFrame, mode: str, workload: str | None) -> DataFrame:
    """Rows with ``split`` and ``is_train`` by one of the modes."""
    named = {"run": splits.run_grouped, "config": splits.config_grouped, "scenario": splits.per_scenario}
    chosen = splits.leave_one_out(df, workload) if mode == "leave_one_out" else named[mode](df)
    return features.train_flag(splits.attach_split(df, chosen))


def _config(path: str | None, spark: SparkSession, full: bool) -> dict:
    override = writers.read_json(spark, path) if path else {}
    return domain.with_profile(domain.merged_config(domain.DEFAULTS, override), full)


def merge_runs(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Long samples (Parquet: run_id, cpu_or_core_id, timestamp_ms, event_name, value, enabled_pct, runtime_ns) and an alias table to the merged tables."""
    samples = merge.map_events(spark.read.parquet(args.samples), spark.read.parquet(args.aliases))
    families = [r[0] for r in samples.select("counter").where("counter is not null").distinct().orderBy("counter").collect()]  # names of counters
    wide = merge.with_durations(merge.pivot_sum(samples, families, quality=True))
    aggregate = merge.pivot_sum(samples, families, ["run_id", "cpu_or_core_id"])
    return writers.write_merge(wide, aggregate, merge.collection_quality(wide, families), args.out)


def build_sequences(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Merged rows (row_index, run_id, workload, counters) to stored sequences of one experiment."""
    df = _split(spark.read.parquet(args.rows), args.mode, args.workload)
    selected = {}
    if args.choice:
        for r in spark.read.parquet(args.choice).select("scope", "family", "counter").collect():  # a row per scope and family
            selected.setdefault(r["scope"], {})[r["family"]] = r["counter"]
    config = _config(args.config, spark, False)
    tables = build.build_sequences(df, args.experiment, args.horizon, args.scopes.split(","), selected=selected, seed=config["seed"], k=config["phases"]["clusters"])
    build.write_sequences(tables, args.out)
    return {"experiment": args.experiment, "rows": tables["sequences"].count(), "families": tables["families"].select("family").distinct().count()}


def run_ablation(spark: SparkSession, args: argparse.Namespace) -> dict:
    df = _split(spark.read.parquet(args.rows), args.mode, args.workload)
    config = _config(args.config, spark, False)
    states, _ = build.scoped_states(df, args.scope, seed=config["seed"])
    tree = config["ablation"]
    results = selection.ablation_table(states, args.scope, max_depth=tree["tree_max_depth"], min_leaf=tree["tree_min_samples_leaf"])
    writers.write_ablation(results, args.out, args.scope, 1)
    return {"scope": args.scope, "selected": {r["family"]: r["counter_set"] for r in spark.read.parquet(f"{args.out}/results").where("selected = 1").collect()}}


def run_detector(spark: SparkSession, args: argparse.Namespace) -> dict:
    df = _split(spark.read.parquet(args.rows), args.mode, args.workload)
    config = _config(args.config, spark, args.full)["detector"]
    column = f"counter__{args.counter}"
    states, _ = phases.one_dimensional_states(df, column)
    keep = [c for c in ("run_id", "workload", "cpu_or_core_id", "threads", "process_count", "split", "is_train", "row_index") if c in df.columns]
    rows = evaluation.examples(states, args.history or config["history_length"], ["state"])
    rows = rows.select(*keep, "state", "run_length", "target", "history", *[c for c in rows.columns if c.startswith("h") and c[1:].isdigit()])
    named = evaluation.predictors(args.history or config["history_length"], [args.counter], config["tree_max_depth"], config["tree_min_samples_leaf"])
    report = evaluation.report(rows, named)
    written = writers.write_tables(evaluation.detector_tables(report), args.out, {"counter": args.counter, "models": sorted(named)})
    best = spark.read.parquet(f"{args.out}/summary").orderBy(F.col("accuracy").desc(), "model").first()
    return {"tables": written, "best": best["model"], "accuracy": best["accuracy"]}


def plan_tasks(spark: SparkSession, args: argparse.Namespace) -> dict:
    workloads = spark.createDataFrame([(w,) for w in args.workloads.split(",")], "workload string")
    tasks = collection.build_tasks(workloads, range(args.cpus), args.repetitions, args.sets.split(","), [int(t) for t in args.threads.split(",")])
    if args.out:
        writers.write_collection(tasks.join(collection.group_order(tasks, args.seed), "concurrent_group_id"), tasks.select("set_key", F.lit(None).cast("int").alias("returncode")).limit(0), args.out)
    return {r["set_key"]: r.asDict() for r in collection.plan_by_set(tasks).collect()}


def run_query(spark: SparkSession, args: argparse.Namespace) -> dict:
    from .plans import registry

    out = args.out or fresh_path(spark, "query")
    registry.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(out)
    return {"query": args.name, "rows": spark.read.parquet(out).count(), "out": out}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tickloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        one = commands.add_parser(name, help=(run.__doc__ or "").split(".")[0] or None)
        for flag, how in options:
            one.add_argument(flag, **how)
        one.set_defaults(run=run)

    need = {"required": True}
    rows = [("--rows", need), ("--out", need), ("--mode", {"default": "run", "choices": ["run", "config", "scenario", "leave_one_out"]}), ("--workload", {}), ("--config", {})]
    command("merge", merge_runs, ("--samples", need), ("--aliases", need), ("--out", need))
    command("build", build_sequences, *rows, ("--experiment", need), ("--horizon", {"type": int, "default": 1}), ("--scopes", {"default": "global"}), ("--choice", {}))
    command("ablate", run_ablation, *rows, ("--scope", {"default": "global", "choices": list(build.SCOPES)}))
    command("detect", run_detector, *rows, ("--counter", need), ("--history", {"type": int}), ("--full", {"action": "store_true"}))
    command("tasks", plan_tasks, ("--workloads", need), ("--cpus", {"type": int, "default": 32}), ("--repetitions", {"type": int, "default": 3}), ("--sets", {"default": "set1,set2,set3"}), ("--threads", {"default": "1,4,16"}), ("--seed", {"type": int, "default": 17}), ("--out", {}))
    command("query", run_query, ("name", {}), ("--tables", need), ("--out", {}))
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    result = args.run(spark or SparkSession.builder.appName("tickloom").getOrCreate(), args)
    print(json.dumps(result, indent=2, sort_keys=True, default=str))
    return result


if __name__ == "__main__":
    main()
