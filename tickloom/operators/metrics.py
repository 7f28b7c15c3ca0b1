"""Evaluation: masks, confusion counts and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of preference of splits: what is reported, and what choices are made on.
REPORT = ("test", "val")
SELECT = ("val", "test")


def mask_rows(df: DataFrame, prefer: Sequence[str] = REPORT, split: str = "split", else_all: bool = False) -> DataFrame:
    """Rows of the first split in ``prefer`` that has any; else all but training rows; else, if asked, all.

    One row of flags is broadcast.
    """
    flags = df.agg(*[F.coalesce(F.max((F.col(split) == s).cast("int")), F.lit(0)).alias(f"__has_{s}") for s in prefer], F.coalesce(F.max((F.col(split) != "train").cast("int")), F.lit(0)).alias("__has_other"))
    keep = F.col(split) != "train"
    if else_all:
        keep = F.when(F.col("__has_other") == 1, keep).otherwise(F.lit(True))
    for s in reversed(prefer):
        keep = F.when(F.col(f"__has_{s}") == 1, F.col(split) == s).otherwise(keep)
    return df.crossJoin(F.broadcast(flags)).where(keep).drop(*[f"__has_{s}" for s in prefer], "__has_other")


def usable(df: DataFrame, truth: str = "target", prediction: str = "prediction") -> DataFrame:
    return df.where((F.col(truth) >= 0) & (F.col(prediction) >= 0))


def confusion(df: DataFrame, by: Sequence[str] = (), truth: str = "target", prediction: str = "prediction") -> DataFrame:
    """Counts by group, truth and prediction: the only pass over the rows that the scores need."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(prediction).alias("pred")).agg(F.count("*").alias("n"))


def dense_confusion(df: DataFrame, by: Sequence[str] = (), classes: int = 3, truth: str = "target", prediction: str = "prediction") -> DataFrame:
    """The same with a row for every pair of classes, 0 where none was met."""
    counts = confusion(usable(df, truth, prediction), by, truth, prediction)
    pairs = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    grid = groups.select("*", pairs.alias("truth")).select("*", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("pred"))
    return grid.join(counts, [*by, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classification_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted F1, balanced accuracy and recall of class 2, from confusion counts.

    Macro F1 is over labels met as truth or prediction, balanced accuracy over labels
    met as truth.
    """
    ends = counts.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("e")).select(*by, "e.*")
    labels = ends.groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("predicted")), F.lit(0.0))
    recall = F.try_divide(F.col("hit"), F.col("support"))
    scored = labels.withColumns({"f1": f1, "recall": recall})
    return scored.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("support") * F.col("f1")), F.sum("support")).alias("weighted_f1"),
        F.avg("recall").alias("balanced_accuracy"),
        F.coalesce(F.max(F.when(F.col("label") == 2, F.col("recall"))), F.lit(0.0)).alias("high_recall"),
    )


def transition_scores(df: DataFrame, by: Sequence[str] = (), truth: str = "target", prediction: str = "prediction", current: str = "state") -> DataFrame:
    """Whether a change was foretold, wherever it went: counts, precision, recall, F1, false-alarm rate."""
    happened, foretold = F.col(truth) != F.col(current), F.col(prediction) != F.col(current)

    def count(c: Column) -> Column:
        return F.sum(c.cast("long"))

    counts = df.groupBy(*by).agg(count(happened & foretold).alias("tp"), count(~happened & foretold).alias("fp"), count(happened & ~foretold).alias("fn"), count(~happened & ~foretold).alias("tn"))

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"event_precision": share(tp, tp + fp), "event_recall": share(tp, tp + fn), "event_f1": share(2 * tp, 2 * tp + fp + fn), "false_alarm_rate": share(fp, fp + tn)})


def transition_accuracy(truth: str = "target", prediction: str = "prediction", current: str = "state") -> Column:
    """Accuracy over rows whose state changes; NULL if none does."""
    return F.avg(F.when(F.col(truth) != F.col(current), (F.col(truth) == F.col(prediction)).cast("double")))


def stable_accuracy(truth: str = "target", prediction: str = "prediction", current: str = "state") -> Column:
    return F.avg(F.when(F.col(truth) == F.col(current), (F.col(truth) == F.col(prediction)).cast("double")))


def group_accuracy(df: DataFrame, dimensions: Sequence[str], truth: str = "target", prediction: str = "prediction") -> DataFrame:
    """Rows and accuracy by each dimension alone; all of them in one pass over grouping sets."""
    sets = [[d] for d in dimensions]
    cols = [F.col(d) for d in dimensions]
    grouped = df.groupingSets([[F.col(d) for d in s] for s in sets], *cols).agg(F.count("*").alias("rows"), F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("accuracy"), *[F.grouping(d).alias(f"__g_{d}") for d in dimensions])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        name = F.when(F.col(f"__g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "rows", "accuracy")


def behavior(df: DataFrame, by: Sequence[str], current: str = "state", target: str = "target", run_length: str = "run_length") -> DataFrame:
    """How states move: transition and stable rate, shares of states now and next, mean run length."""
    known = df.where((F.col(current) >= 0) & (F.col(target) >= 0))
    return known.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg((F.col(current) != F.col(target)).cast("double")).alias("transition_rate"),
        F.avg((F.col(current) == F.col(target)).cast("double")).alias("stable_rate"),
        *[F.avg((F.col(current) == s).cast("double")).alias(f"now_share_{s}") for s in range(3)],
        *[F.avg((F.col(target) == s).cast("double")).alias(f"next_share_{s}") for s in range(3)],
        F.avg(run_length).alias("mean_run_length"),
    )


def tuple_scores(df: DataFrame, keys: Sequence[str], families: Sequence[str], family: str = "family", truth: str = "target", prediction: str = "prediction") -> DataFrame:
    """One row: rows, share of rows right in all families, mean share of families wrong; a missing family is -1."""
    wide = df.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col(family) == f, F.col(c))), F.lit(-1)).alias(f"{c}_{i}") for i, f in enumerate(families) for c in (truth, prediction)])
    wrong = sum(((F.col(f"{truth}_{i}") != F.col(f"{prediction}_{i}")).cast("int") for i in range(len(families))), F.lit(0))
    return wide.agg(F.count("*").alias("rows"), F.avg((wrong == 0).cast("double")).alias("exact_tuple_accuracy"), F.avg(wrong / len(families)).alias("hamming_distance"))


def gains(scores: DataFrame, baselines: Sequence[str], model: str = "model", by: Sequence[str] = (), metric: str = "accuracy") -> DataFrame:
    """Adds the difference of each model's metric to every baseline's of its group."""
    # a row per model and group: the window holds a group's models
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return scores.withColumns({f"gain_over_{b}": F.col(metric) - F.max(F.when(F.col(model) == b, F.col(metric))).over(group) for b in baselines})


def retention(student: DataFrame, teacher: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of rows where the student says what the teacher says; rows without a teacher's answer do not count."""
    both = student.join(teacher.select(*keys, F.col("prediction").alias("__teacher")), list(keys), "left").where(F.col("__teacher") >= 0)
    return both.groupBy(*by).agg(F.count("*").alias("rows"), F.avg((F.col("prediction") == F.col("__teacher")).cast("double")).alias("retention"))


def paired(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that both models predicted, side by side."""
    return first.withColumnRenamed("prediction", "first_prediction").join(second.select(*keys, F.col("prediction").alias("second_prediction")), list(keys))


def metric_matrix(scores: DataFrame, sets: Sequence[str], metric: str = "accuracy", set_col: str = "set_name", model: str = "model") -> DataFrame:
    """Mean metric per model, a column per set and one for all."""
    return scores.groupBy(model).agg(*[F.avg(F.when(F.col(set_col) == s, F.col(metric))).alias(f"set_{s}") for s in sets], F.avg(metric).alias("mean"))


def family_tuples(df: DataFrame, keys: Sequence[str], families: Sequence[str], family: str = "family", truth: str = "target", prediction: str = "prediction") -> DataFrame:
    """A row per key with truth and prediction of every family, -1 where one is missing."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col(family) == f, F.col(c))), F.lit(-1)).alias(f"{c}__{f}") for f in families for c in (truth, prediction)])


def transition_table(df: DataFrame, by: Sequence[str] = ("state",), target: str = "target", classes: int = 3, prior: int = 0) -> DataFrame:
    """Counts of each next state by group, with ``prior`` added."""
    return df.where(F.col(target) >= 0).groupBy(*by).agg(*[(F.sum((F.col(target) == s).cast("long")) + prior).alias(f"to_{s}") for s in range(classes)])


def mean_of_means(df: DataFrame, metric: str, inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """Mean per inner group, then the mean of those per outer group."""
    return df.groupBy(*inner).agg(F.avg(metric).alias("__m")).groupBy(*outer).agg(F.avg("__m").alias(metric), F.count("*").alias("groups"))


def scores_by(df: DataFrame, by: Sequence[str], truth: str = "target", prediction: str = "prediction", current: str = "state") -> DataFrame:
    """Rows, accuracy, and accuracy where the state changes and where it stays, per group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("accuracy"), transition_accuracy(truth, prediction, current).alias("transition_accuracy"), stable_accuracy(truth, prediction, current).alias("stable_accuracy"))


def stable_and_moving(df: DataFrame, by: Sequence[str], target: str = "target", current: str = "state") -> DataFrame:
    """How many rows keep their state and how many change it, per group."""
    return df.groupBy(*by).agg(F.sum((F.col(target) == F.col(current)).cast("long")).alias("stable"), F.sum((F.col(target) != F.col(current)).cast("long")).alias("moving"))


def hamming(df: DataFrame, by: Sequence[str] = (), truth: str = "target", prediction: str = "prediction") -> DataFrame:
    """Share of rows that differ, per group."""
    return df.groupBy(*by).agg(F.avg((F.col(truth) != F.col(prediction)).cast("double")).alias("hamming"))
