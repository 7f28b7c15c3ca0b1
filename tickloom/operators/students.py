"""Small models that learn from a teacher's answers, and from true states alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest, metrics, models, sequences
from .lineage import cut

KEYS = ("run_id", "cpu_or_core_id")


def teacher_answers(stored: DataFrame, horizon: int, classes: int = 3) -> DataFrame:
    """family, row_index, step, hard, soft: the teacher's class and, where all of them are given, its probabilities.

    ``stored``: family, row_index, y_pred_future_state_k and p_future_state_k_class_c as
    text or numbers; a blank class counts as 0, one blank probability makes ``soft`` NULL.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in stored.columns else F.lit(None).cast("string")
    steps = []
    for k in range(1, horizon + 1):
        shares = [blank(f"p_future_state_{k}_class_{c}").cast("double") for c in range(classes)]
        whole = shares[0].isNotNull()
        for s in shares[1:]:
            whole = whole & s.isNotNull()
        hard = F.coalesce(blank(f"y_pred_future_state_{k}").cast("int"), F.lit(0))
        steps.append(F.struct(F.lit(k).alias("step"), hard.alias("hard"), F.when(whole, F.array(*shares)).alias("soft")))
    rows = stored.select("family", F.coalesce(F.col("row_index").cast("long"), F.lit(0)).alias("row_index"), F.explode(F.array(*steps)).alias("s"))
    return rows.select("family", "row_index", "s.step", "s.hard", "s.soft")


def context_modes(stored: DataFrame, position: str = "position") -> DataFrame:
    """family, context_mode: the first that is not blank."""
    return stored.where((F.coalesce("family", F.lit("")) != "") & (F.coalesce("context_mode", F.lit("")) != "")).groupBy("family").agg(F.min_by("context_mode", position).alias("context_mode"))


def teacher_targets(rows: DataFrame, answers: DataFrame, family: str, step: int = 1) -> DataFrame:
    """``rows`` with ``teacher`` (-1 where there is no answer), ``soft`` and ``valid``.

    Answers may be as many as rows, whatever few bytes their files take, so they are never broadcast.
    """
    mine = answers.where((F.col("family") == family) & (F.col("step") == step) & (F.col("hard") >= 0)).select("row_index", F.col("hard").alias("teacher"), "soft")
    return rows.join(mine.hint("merge"), "row_index", "left").withColumns({"valid": F.col("teacher").isNotNull(), "teacher": F.coalesce("teacher", F.lit(-1))})


def _fit_on(rows: DataFrame, condition) -> DataFrame:
    """Training rows that fulfil the condition; all that do, if none trains."""
    good = rows.where(condition)
    return metrics.mask_rows(good.withColumn("__side", F.when(F.col("is_train"), "fit").otherwise("train")), ("fit",), "__side", else_all=True).drop("__side")


def run_length_students(rows: DataFrame, answers: DataFrame, family: str, blend: float = 0.5, max_depth: int = 5, min_leaf: int = 8) -> DataFrame:
    """Predictions of a tree and of a backoff lookup on state, previous state, run length and context: rows x model.

    ``rows``: row_index, state, previous, run_length, context, target, is_train, split.
    Both learn the blend of the teacher's probabilities and the true target, the true
    one where the teacher is silent.
    """
    taught = teacher_targets(rows, answers, family)
    soft = F.coalesce("soft", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(c == F.col("teacher"), F.lit(0.9)).otherwise(F.lit(0.05))))
    pseudo = F.when(F.col("valid"), models.blended_target(soft, F.col("target"), blend)).otherwise(F.col("target"))
    frame = cut(taught.withColumns({"pseudo": pseudo, "log_run": F.log1p(F.col("run_length").cast("double"))}))
    fit = _fit_on(frame, F.col("target") >= 0)
    tree = models.fit_tree(fit, ["state", "previous", "log_run", "context"], "pseudo", max_depth, min_leaf)
    by_tree = frame.withColumn("prediction", models.tree_expression(tree)).withColumn("model", F.lit("decision_tree_student"))
    known = frame.withColumns({"__train": F.col("is_train"), "is_train": F.col("is_train") & (F.col("target") >= 0)})
    by_lookup = models.lookup_backoff(known, target="pseudo").withColumn("is_train", F.col("__train")).withColumn("model", F.lit("lookup_rle_student"))
    out = ["row_index", "split", "state", "target", "teacher", "model", "prediction"]
    return by_tree.select(*out).unionByName(by_lookup.select(*out)).withColumn("family", F.lit(family))


def history_students(rows: DataFrame, answers: DataFrame, family: str, columns: Sequence[str], max_depth: int = 5, min_leaf: int = 8, synthetic: DataFrame | None = None) -> DataFrame:
    """Predictions from histories: a tree taught by true states, a tree and a suffix lookup taught by the teacher, and a tree that also sees made-up histories.

    ``rows``: row_index, history, target, state, split, is_train and the flat 0/1
    ``columns`` of the history.  ``synthetic``: such columns with ``teacher``, answers to
    made-up histories.  A model without rows to learn from says -1.
    """
    frame = cut(teacher_targets(rows, answers, family))
    out = ["row_index", "split", "state", "target", "teacher", "model", "prediction"]
    scratch = _fit_on(frame, F.col("target") >= 0)
    distilled = cut(_fit_on(frame, F.col("valid")).select("row_index", "teacher", "history", *columns))
    said = [(frame.withColumn("prediction", models.tree_expression(models.fit_tree(scratch, columns, "target", max_depth, min_leaf))), "decision_tree_scratch_history")]
    if distilled.isEmpty():
        said += [(frame.withColumn("prediction", F.lit(-1)), m) for m in ("decision_tree_distilled_history", "lookup_distilled_history")]
    else:
        said.append((frame.withColumn("prediction", models.tree_expression(models.fit_tree(distilled, columns, "teacher", max_depth, min_leaf))), "decision_tree_distilled_history"))
        length = frame.select(F.max(F.size("history"))).first()[0]
        both = frame.withColumn("__train", F.col("is_train")).join(distilled.select("row_index", F.lit(True).alias("__fit")), "row_index", "left").withColumn("is_train", F.coalesce("__fit", F.lit(False)))
        said.append((models.history_lookup(both, target="teacher", length=length), "lookup_distilled_history"))
        if synthetic is not None:
            # made-up rows come after the real ones
            seen = distilled.select("row_index", "teacher", *columns).unionByName(synthetic.select((F.monotonically_increasing_id() + (1 << 60)).alias("row_index"), "teacher", *columns))
            said.append((frame.withColumn("prediction", models.tree_expression(models.fit_tree(seen, columns, "teacher", max_depth, min_leaf))), "synthetic_distilled_history_tree"))
    together = None
    for predicted, name in said:
        one = predicted.withColumn("model", F.lit(name)).select(*out)
        together = one if together is None else together.unionByName(one)
    return together.withColumn("family", F.lit(family))


def student_summary(predictions: DataFrame) -> DataFrame:
    """Per family and model: scores on the rows for choosing, and how far the teacher's answers are kept (0 where it gave none)."""
    chosen = metrics.mask_rows(predictions, metrics.SELECT)
    by = ["family", "model"]
    scores = metrics.classification_scores(metrics.confusion(chosen, by), by)
    kept = chosen.where("teacher >= 0").groupBy(*by).agg(F.avg((F.col("prediction") == F.col("teacher")).cast("double")).alias("teacher_retention"))
    return scores.join(kept, by, "left").withColumn("teacher_retention", F.coalesce("teacher_retention", F.lit(0.0)))


def flat_history(df: DataFrame, length: int, horizon: int, columns: Sequence[str] = ("state",), classes: int = 3, keys: Sequence[str] = KEYS) -> tuple[DataFrame, list[str]]:
    """Rows with a full history and all targets known, with one-hot columns ``x0``, ``x1``, ... oldest first; and their names."""
    rows = sequences.target_windows(df, length, horizon, list(columns), columns[0], keys)
    names = [f"x{i}" for i in range(length * len(columns) * classes)]
    return rows.withColumn("target", F.col("targets")[0]).select("*", *[F.col("one_hot")[i].alias(n) for i, n in enumerate(names)]), names


def direct_trees(df: DataFrame, families: Sequence[str], length: int, horizon: int, max_depth: int, min_leaf: int, with_context: bool = False) -> DataFrame:
    """family, step, row_index, split, state, target, prediction: trees on the histories of true states, one per family and step.

    ``df`` has a column ``state__<family>`` for each.  With context the histories are of
    all families, the own one first.  All trees grow together (see ``fit_forest``).
    """
    together, names = None, []
    for i, family in enumerate(families):
        mine = f"state__{family}"
        columns = [mine, *[f"state__{f}" for f in families if with_context and f != family]]
        rows, names = flat_history(df, length, horizon, columns)
        one = rows.select(F.lit(i).alias("i"), "row_index", "split", "is_train", F.col(mine).alias("state"), "targets", F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
        together = one if together is None else together.unionByName(one)
    steps = F.posexplode("targets").alias("step", "target")
    long = together.select("i", "row_index", "split", "is_train", "state", "x", steps).withColumn("model", (F.col("i") * horizon + F.col("step")).cast("long"))
    long = cut(long)
    # a family without training rows learns from all that it has
    trains = long.groupBy("i").agg(F.max(F.col("is_train").cast("int")).alias("some"))
    fit = long.join(F.broadcast(trains), "i").where(F.col("is_train") | (F.col("some") == 0))
    trees = forest.fit_forest(fit.select("model", "x", F.col("target").alias("y"), F.col("row_index").alias("at")), len(names), max_depth, min_leaf)
    if not trees:
        return long.select(F.lit("").alias("family"), (F.col("step") + 1).alias("step"), "row_index", "split", "state", "target", F.lit(-1).alias("prediction")).where("false")
    family = F.element_at(F.array(*map(F.lit, families)), F.col("i") + 1)
    return forest.forest_predictions(long, trees).select(family.alias("family"), (F.col("step") + 1).alias("step"), "row_index", "split", "state", "target", "prediction")


def direct_tree_summary(predictions: DataFrame) -> DataFrame:
    """Scores of the first step per family on everything that did not train, or on all rows."""
    rows = metrics.mask_rows(predictions.where("step = 1"), (), else_all=True)
    return metrics.classification_scores(metrics.confusion(rows, ["family"]), ["family"])
