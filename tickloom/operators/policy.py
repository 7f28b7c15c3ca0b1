"""Control policy from predicted states, and the cost of deploying a predictor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import BEYOND, BEYOND_ADVICE, COMPLEXITY, MODE_POWER, ORACLE_ADVICE, OTHER_ADVICE, PARAMETER_MODELS, TABLE_MODELS
from ..functions.scalars import clamp_state
from .sequences import ORDER, STREAM, stream, with_confirmed


def control_summary(df: DataFrame, truth: str = "target", prediction: str = "prediction", by: Sequence[str] = (), power: Sequence[float] = MODE_POWER, keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    """Savings of following predictions at once, after confirmation, and of knowing the truth; and where power fell short.

    The mode changes only when the same prediction comes twice in a row; each
    stream starts in the middle mode.
    """
    modes = F.array(*[F.lit(p) for p in power])
    keyed = [*by, *[k for k in keys if k not in by]]
    rows = df.withColumns({"actual": clamp_state(F.col(truth)), "desired": clamp_state(F.col(prediction))})
    acted = with_confirmed(rows, "desired", "action", 1, keyed, order)
    acted = acted.withColumn("changed", (F.col("action") != F.coalesce(F.lag("action").over(stream(keyed, order)), F.lit(1))).cast("int"))

    def percent(c: Column) -> Column:
        return 100.0 * F.avg(c.cast("double"))

    def saving(state: str) -> Column:
        return 100.0 * (1.0 - F.avg(F.element_at(modes, F.col(state) + 1)))

    out = acted.groupBy(*by).agg(
        F.count("*").alias("rows"),
        percent(F.col("desired") == F.col("actual")).alias("prediction_accuracy_pct"),
        saving("desired").alias("raw_saving_pct"),
        saving("action").alias("guarded_saving_pct"),
        saving("actual").alias("oracle_saving_pct"),
        percent(F.col("action") == 0).alias("low_power_pct"),
        percent(F.col("action") < F.col("actual")).alias("underprovision_pct"),
        percent((F.col("action") == 0) & (F.col("actual") == 2)).alias("severe_underprovision_pct"),
        (1000.0 * F.avg("changed")).alias("changes_per_1k"),
    )
    return out.withColumn("oracle_captured_pct", F.when(F.col("oracle_saving_pct") > 0, 100.0 * F.col("guarded_saving_pct") / F.col("oracle_saving_pct")).otherwise(0.0))


def tree_bytes(internal: Column, leaves: Column, features: Column) -> Column:
    """A cut names a feature, a 16-bit threshold and two children; a leaf is two bits."""
    nodes = internal + leaves

    def bits(x: Column) -> Column:
        return F.ceil(F.log2(F.greatest(x, F.lit(2)).cast("double")))

    return (internal * (bits(features) + 16 + 2 * bits(nodes)) + 2 * leaves) / 8.0


def deployment_cost(models: DataFrame) -> DataFrame:
    """Adds bytes, operations, kind of operation, complexity and advice for each model row.

    Columns read (0 where absent): model, parameter_count, table_entries,
    feature_count, tree_internal_nodes, tree_leaves, estimated_storage_bytes,
    bucket_count, kernel_count, online_family_count, history_length,
    uses_clustered_counter_state, requires_oracle_current_phase.
    """

    def given(name: str, kind: str = "double") -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)) if name in models.columns else F.lit(0).cast(kind)

    model = F.col("model")
    params, table, feats = given("parameter_count"), given("table_entries"), given("feature_count")
    internal, leaves, stored = given("tree_internal_nodes"), given("tree_leaves"), given("estimated_storage_bytes")
    buckets, per_kernel = F.greatest(F.lit(1.0), given("bucket_count")), F.greatest(F.lit(1.0), feats)
    is_tree = model.startswith("online_") & model.contains("tree")
    is_kernel = model.startswith(next(iter(PARAMETER_MODELS)))
    # entries and parameters are at least what the model's form needs
    entries = F.when(is_tree, F.greatest(table, internal + leaves)).otherwise(table)
    for name, (_, _, _, fixed, per_bucket) in TABLE_MODELS.items():
        entries = F.when(model == name, F.greatest(table, fixed + per_bucket * buckets)).otherwise(entries)
    rows = models.withColumns({"__entries": entries, "__params": F.when(is_kernel, F.greatest(params, given("kernel_count") * per_kernel)).otherwise(params)})
    e, p = F.col("__entries"), F.col("__params")
    # a model of no known name is one of parameters, or a table, or nothing
    kind = F.when((p <= 0) & (e > 0), "table_lookup").otherwise("integer_arithmetic")
    ops = F.when(p > 0, F.greatest(F.lit(8.0), p)).when(e > 0, F.greatest(F.lit(4.0), e)).otherwise(0.0)
    memory = F.when(p > 0, p * 4).otherwise(e * 2)
    for name, (what, least, each) in PARAMETER_MODELS.items():
        mine = model.startswith(name)
        work = given("kernel_count") * per_kernel if name.startswith("rocket") else p
        kind, ops, memory = F.when(mine, what).otherwise(kind), F.when(mine, F.greatest(F.lit(least), work * each)).otherwise(ops), F.when(mine, p * 4).otherwise(memory)
    kind, ops, memory = F.when(is_tree, "comparisons").otherwise(kind), F.when(is_tree, F.greatest(F.lit(1.0), internal * 2)).otherwise(ops), F.when(is_tree, stored).otherwise(memory)
    for name, (what, steps, size, _, _) in TABLE_MODELS.items():
        mine = model == name
        bytes_ = F.lit(1.0) if what == "register" else e * size
        kind, ops, memory = F.when(mine, what).otherwise(kind), F.when(mine, steps).otherwise(ops), F.when(mine, bytes_).otherwise(memory)
    families = given("online_family_count")
    clustered = given("uses_clustered_counter_state", "boolean") & (families > 0)
    history = F.when(clustered, F.ceil(families * F.greatest(F.lit(1.0), given("history_length")) * 2 / 8).cast("double")).otherwise(0.0)
    cuts = F.when(clustered, families * 4).otherwise(0.0)
    rows = rows.withColumns({"model_storage_bytes": memory, "approx_operations": ops, "operator_type": kind, "history_storage_bytes": history, "discretizer_storage_bytes": cuts})
    rows = rows.withColumn("memory_bytes", F.col("model_storage_bytes") + F.col("history_storage_bytes") + F.col("discretizer_storage_bytes"))
    m, o, t = F.col("memory_bytes"), F.col("approx_operations"), F.col("operator_type")
    level, advice = F.lit(BEYOND), F.lit(OTHER_ADVICE)
    for what, text in BEYOND_ADVICE.items():
        advice = F.when(t == what, text).otherwise(advice)
    for kinds, most_bytes, most_ops, name, text in reversed(COMPLEXITY):
        fits = t.isin(kinds) & (m <= most_bytes) & (o <= most_ops)
        level, advice = F.when(fits, name).otherwise(level), F.when(fits, text).otherwise(advice)
    return rows.withColumns(
        {
            "complexity": level,
            "recommendation": F.when(given("requires_oracle_current_phase", "boolean"), ORACLE_ADVICE).otherwise(advice),
            "stored_parameters_or_entries": F.greatest(p, e).cast("long"),
        }
    ).drop("__entries", "__params")


def streams_of(predictions: DataFrame, model: str, family: str, split: str = "test", units: Sequence[str] | None = None) -> DataFrame:
    """Rows of one model and family on one split, of some units if named; the conditions reach the scan."""
    rows = predictions.where((F.col("model") == model) & (F.col("family") == family) & (F.col("split") == split))
    return rows if units is None else rows.where(F.col("cpu_or_core_id").isin(*units))
