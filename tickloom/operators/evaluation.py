"""Compositions: which predictors run, what they score, what they cost."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import thread_process_group
from . import metrics, models, policy, sequences
from .lineage import cut

#: Predictors that need a library for neural networks.
NEURAL = ["tcn_phase_classifier", "tiny_transformer_phase_classifier"]
#: Predictors that look at the phase alone: run once, not for each family.
ONCE_ONLY = ["baseline_last_state", "majority_phase", "state_conditioned_majority", "markov_phase_predictor", "rle_markov_phase_predictor", "hsmm_duration_phase_predictor"]


def enabled(names: Sequence[str], family: str, first_family: str, wanted: Sequence[str] | None = None, once: Sequence[str] = ONCE_ONLY) -> list[str]:
    """Models to run for a family: those wanted (all if nothing is said), once-only ones for the first family alone."""
    return [n for n in names if (wanted is None or n in wanted) and (family == first_family or n not in once)]


def skipped(spark: SparkSession, names: Sequence[str] = NEURAL, library: str = "torch") -> DataFrame:
    """A row for each model that cannot run here, with the reason; none if the library is there."""
    missing = importlib.util.find_spec(library) is None
    return spark.createDataFrame([(n, "skipped", f"{library} is not installed") for n in names if missing], "model string, status string, reason string")


def predictors(history: int, families: Sequence[str], max_depth: int = 6, min_leaf: int = 8) -> dict[str, Callable[[DataFrame], tuple[DataFrame, dict]]]:
    """Name -> function from examples to (predictions, what the cost model needs).

    Examples: state, run_length, target, is_train, split, row_index, ``history``
    (arrays of ``families`` states) and its flat columns h0, h1, ...
    """
    flat = [f"h{i}" for i in range(history * len(families))]

    def tree(columns: Sequence[str]):
        def run(df: DataFrame) -> tuple[DataFrame, dict]:
            node = models.fit_tree(df.where("is_train"), columns, "target", max_depth, min_leaf)
            return df.withColumn("prediction", models.tree_expression(node)), {"feature_count": len(columns), "tree_internal_nodes": node.internal(), "tree_leaves": node.leaves(), "online_family_count": len(families), "history_length": history, "uses_clustered_counter_state": True}

        return run

    def plain(f: Callable[[DataFrame], DataFrame], **cost):
        return lambda df: (f(df), cost)

    return {
        "baseline_last_state": plain(models.last_state),
        "majority_phase": plain(models.majority, table_entries=3),
        "state_conditioned_majority": plain(models.state_majority, table_entries=9),
        "markov_phase_predictor": plain(models.markov, requires_oracle_current_phase=True),
        "rle_markov_phase_predictor": plain(models.run_length_markov, bucket_count=5, requires_oracle_current_phase=True),
        "hsmm_duration_phase_predictor": plain(models.duration_model, bucket_count=5, requires_oracle_current_phase=True),
        "history_lookup": plain(lambda df: models.history_lookup(df, length=history), table_entries=3**history),
        "online_current_tree": tree(flat[-len(families) :]),
        "online_history_tree": tree(flat),
    }


def examples(states: DataFrame, history: int, columns: Sequence[str], state: str = "state") -> DataFrame:
    """Full histories with run length and the next state, flat columns oldest first."""
    rows = sequences.run_lengths(states, state)
    out = sequences.histories(rows, history, columns, state)
    width = len(columns)
    return out.select("*", *[F.col("history")[i // width][i % width].alias(f"h{i}") for i in range(history * width)])


def stacked(rows: DataFrame, named: dict[str, Callable[[DataFrame], DataFrame]], prefer: Sequence[str] | None = metrics.REPORT) -> DataFrame:
    """Predictions of all models on one frame, a row per model and row; with ``prefer`` those of the preferred split alone.

    The frame is computed once; each model adds small joins to it.
    """
    rows = cut(rows)
    out = None
    for name, predict in named.items():
        said = predict(rows)
        one = (said if prefer is None else metrics.mask_rows(said, prefer)).select(*rows.columns, "prediction").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


COST_FIELDS = ["parameter_count", "table_entries", "feature_count", "tree_internal_nodes", "tree_leaves", "bucket_count", "kernel_count", "online_family_count", "history_length"]


def report(rows: DataFrame, named: dict[str, Callable], prefer: Sequence[str] = metrics.REPORT) -> dict[str, DataFrame]:
    """Tables over all models: ``predictions``, ``summary`` (scores, change detection, gains, cost), ``confusion`` and ``groups``.

    Each model adds expressions and small joins to the same examples; the tables
    are grouped passes over the union of predictions.
    """
    spark = rows.sparkSession
    rows = cut(rows)  # every model reads them
    together, costs = None, []
    for name, run in named.items():
        said, cost = run(rows)
        kept = said.select(*[c for c in rows.columns if not c.startswith("h")], "prediction").withColumn("model", F.lit(name))
        together = kept if together is None else together.unionByName(kept)
        costs.append((name, *[int(cost.get(f, 0)) for f in COST_FIELDS], bool(cost.get("uses_clustered_counter_state")), bool(cost.get("requires_oracle_current_phase"))))
    together = cut(together)  # every table reads them
    schema = "model string, " + ", ".join(f"{f} int" for f in COST_FIELDS) + ", uses_clustered_counter_state boolean, requires_oracle_current_phase boolean"
    priced = spark.createDataFrame(costs, schema)
    stored = F.when(F.col("tree_leaves") > 0, policy.tree_bytes(F.col("tree_internal_nodes"), F.col("tree_leaves"), F.col("feature_count"))).otherwise(0.0)
    priced = policy.deployment_cost(priced.withColumn("estimated_storage_bytes", stored))
    test = metrics.usable(metrics.mask_rows(together, prefer))
    scores = metrics.classification_scores(metrics.confusion(test, ["model"]), ["model"])
    change = metrics.transition_scores(test, ["model"])
    moving = test.groupBy("model").agg(metrics.transition_accuracy().alias("transition_accuracy"), metrics.stable_accuracy().alias("stable_accuracy"))
    summary = metrics.gains(scores, [b for b in ("baseline_last_state", "majority_phase") if b in named])
    cost = priced.select("model", "memory_bytes", "approx_operations", "operator_type", "complexity", "recommendation")
    dimensions = [c for c in ("workload", "cpu_or_core_id", "threads") if c in test.columns]
    groups = None
    for d in dimensions:
        one = test.groupBy("model", F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.count("*").alias("rows"), F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("accuracy"))
        groups = one if groups is None else groups.unionByName(one)
    return {"predictions": together, "summary": summary.join(change, "model").join(moving, "model").join(cost, "model"), "confusion": metrics.dense_confusion(test, ["model"]), "groups": groups}


def detector_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The twelve tables of a detector out of :func:`report`: what it gives, and accuracy and behaviour by each dimension.

    Accuracy counts usable rows of the reported split, behaviour the rows of one model
    there (the states are the same for all).  A dimension that the rows lack has an
    empty table.
    """
    rows = tables["predictions"]
    test = cut(metrics.usable(metrics.mask_rows(rows)))
    both = [c for c in ("threads", "process_count") if c in test.columns]
    if len(both) == 2:
        test = test.withColumn("thread_process", thread_process_group(F.col("threads"), F.col("process_count")))
    first = test.select(F.min("model")).first()[0]
    one = test.where(F.col("model") == first)
    out = {"predictions": rows, "summary": tables["summary"], "confusion_matrices": tables["confusion"]}
    names = {"workload": "workload", "cpu_or_core_id": "core", "threads": "thread", "process_count": "process_count", "thread_process": "thread_process"}
    for column, name in names.items():
        there = test if column in test.columns else test.withColumn(column, F.lit(None).cast("string")).limit(0)
        out[f"per_{name}_accuracy"] = there.groupBy("model", column).agg(F.count("*").alias("rows"), F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("accuracy"))
    for column in ("threads", "process_count", "thread_process"):
        there = one if column in one.columns else one.withColumn(column, F.lit(None).cast("string")).limit(0)
        out[f"phase_behavior_by_{names[column]}"] = metrics.behavior(there, [column])
    out["hardware_budget"] = tables["summary"].select("model", "memory_bytes", "approx_operations", "operator_type", "complexity", "recommendation")
    return out


def evaluate(student: DataFrame, teacher: DataFrame, costs: DataFrame, keys: Sequence[str], families: Sequence[str]) -> dict[str, DataFrame]:
    """Scores per (model, family) on rows for choosing, retention of the teacher's answers, tuples over families, all with cost."""
    chosen = metrics.usable(metrics.mask_rows(student, metrics.SELECT, else_all=True))
    by_family = metrics.classification_scores(metrics.confusion(chosen, ["model", "family"]), ["model", "family"])
    kept = metrics.retention(student, teacher, ["family", *keys], ["model", "family"]).withColumnRenamed("rows", "retention_rows")
    wide = metrics.family_tuples(student, ["model", *keys], families)
    wrong = sum(((F.col(f"target__{f}") != F.col(f"prediction__{f}")).cast("int") for f in families), F.lit(0))
    per_model = wide.groupBy("model").agg(F.count("*").alias("rows"), F.avg((wrong == 0).cast("double")).alias("exact_tuple_accuracy"), F.avg(wrong / len(families)).alias("hamming_distance"))
    priced = policy.deployment_cost(costs).select("model", "memory_bytes", "complexity")
    return {"families": by_family.join(kept, ["model", "family"], "left").join(priced, "model", "left"), "tuples": per_model.join(priced, "model", "left")}


def summary_rows(summary: DataFrame, experiment: str, scope: str | None = None, family: str | None = None) -> DataFrame:
    """Rows of one experiment out of the summaries of all, of one scope and family if named; the conditions reach the scan."""
    rows = summary.where(F.col("experiment") == experiment)
    for column, value in (("scope", scope), ("family", family)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows
