"""Next-state predictors: baselines, duration models, lookups, trees, random kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import RUN_LENGTH_EDGES
from ..functions.scalars import bucket_edge, bucket_number
from .forest import Node, fit_tree  # noqa: F401  (fit_tree is one of the models)

STATES = (0, 1, 2)


def _fit_rows(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col("is_train") & (F.col(target) >= 0))


def _counts(rows: DataFrame, target: str, by: Sequence[Column | str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum((F.col(target) == s).cast("long")).alias(f"n{s}") for s in STATES])


def _argmax(values: Sequence[Column]) -> Column:
    """Position of the greatest, the lowest at ties."""
    a = F.array(*values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def last_state(df: DataFrame, current: str = "state") -> DataFrame:
    return df.withColumn("prediction", F.col(current))


def majority(df: DataFrame, target: str = "target") -> DataFrame:
    """The commonest training target, the lowest at ties; of all targets if there is no training one, else 0."""
    known = df.where(F.col(target) >= 0)
    counted = known.agg(*[F.sum((F.col("is_train") & (F.col(target) == s)).cast("long")).alias(f"t{s}") for s in STATES], *[F.sum((F.col(target) == s).cast("long")).alias(f"a{s}") for s in STATES])
    total = sum((F.coalesce(F.col(f"t{s}"), F.lit(0)) for s in STATES), F.lit(0))
    best = counted.select(F.when(total > 0, _argmax([F.col(f"t{s}") for s in STATES])).otherwise(F.coalesce(_argmax([F.col(f"a{s}") for s in STATES]), F.lit(0))).alias("prediction"))
    return df.crossJoin(F.broadcast(best))


def state_majority(df: DataFrame, current: str = "state", target: str = "target") -> DataFrame:
    """The commonest training target of each current state; of all for a state that was not met."""
    rows = _fit_rows(df, target)
    per = _counts(rows, target, [F.col(current).alias("__state")]).where(F.col("__state").isin(*STATES)).select("__state", _argmax([F.col(f"n{s}") for s in STATES]).alias("__own"))
    whole = _counts(rows, target).select(F.coalesce(_argmax([F.col(f"n{s}") for s in STATES]), F.lit(0)).alias("__all"))
    joined = df.join(F.broadcast(per), F.col(current) == F.col("__state"), "left").crossJoin(F.broadcast(whole))
    return joined.withColumn("prediction", F.coalesce("__own", "__all")).drop("__state", "__own", "__all")


def _row_of(current: str) -> Column:
    """An unknown state takes the table's last row."""
    return F.when(F.col(current) < 0, STATES[-1]).otherwise(F.col(current))


def markov(df: DataFrame, current: str = "state", target: str = "target") -> DataFrame:
    """Argmax of transition counts plus one."""
    table = _counts(_fit_rows(df, target).where(F.col(current).isin(*STATES)), target, [F.col(current).alias("__state")])
    best = table.select("__state", _argmax([F.col(f"n{s}") + 1 for s in STATES]).alias("__best"))
    return df.join(F.broadcast(best), _row_of(current) == F.col("__state"), "left").withColumn("prediction", F.coalesce("__best", F.lit(0))).drop("__state", "__best")


def run_length_markov(df: DataFrame, current: str = "state", run_length: str = "run_length", target: str = "target", edges: Sequence[int] = RUN_LENGTH_EDGES) -> DataFrame:
    """The same by state and bucket of run length."""
    marked = df.withColumn("__bucket", bucket_number(F.col(run_length), edges))
    rows = _fit_rows(marked, target).where(F.col(current).isin(*STATES))
    best = _counts(rows, target, [F.col(current).alias("__state"), F.col("__bucket").alias("__b")]).select("__state", "__b", _argmax([F.col(f"n{s}") + 1 for s in STATES]).alias("__best"))
    joined = marked.join(F.broadcast(best), (_row_of(current) == F.col("__state")) & (F.col("__bucket") == F.col("__b")), "left")
    return joined.withColumn("prediction", F.coalesce("__best", F.lit(0))).drop("__state", "__b", "__best", "__bucket")


def duration_model(df: DataFrame, current: str = "state", run_length: str = "run_length", target: str = "target", edges: Sequence[int] = RUN_LENGTH_EDGES) -> DataFrame:
    """Stays while the chance to stay, by state and bucket of run length (counts plus one), is half or more; else goes to the commonest other state.

    In training an unknown state counts in the last row of the tables, and as left.
    """
    marked = df.withColumns({"__bucket": bucket_number(F.col(run_length), edges), "__row": _row_of(current)})
    rows = _fit_rows(marked, target)
    stayed = (F.col(target) == F.col(current)).cast("long")
    stay = rows.groupBy(F.col("__row").alias("__s"), F.col("__bucket").alias("__b")).agg(((F.sum(stayed) + 1) / (F.count("*") + 2)).alias("__stay"))
    # a row that stayed is no transition
    gone = _counts(rows.where(F.col(target) != F.col(current)), target, [F.col("__row").alias("__g")])
    leave = gone.select("__g", *[F.when(F.col("__g") == s, F.lit(0)).otherwise(F.col(f"n{s}") + 1).alias(f"g{s}") for s in STATES])
    joined = marked.join(F.broadcast(stay), (F.col("__row") == F.col("__s")) & (F.col("__bucket") == F.col("__b")), "left").join(F.broadcast(leave), F.col("__row") == F.col("__g"), "left")
    other = F.coalesce(_argmax([F.col(f"g{s}") for s in STATES]), F.when(F.col("__row") == 0, 1).otherwise(0))
    return joined.withColumn("prediction", F.when(F.coalesce("__stay", F.lit(0.5)) >= 0.5, F.col(current)).otherwise(other).cast("int")).drop("__bucket", "__row", "__s", "__b", "__stay", "__g", *[f"g{s}" for s in STATES])


def commonest(rows: DataFrame, keys: Sequence[str], target: str, position: str, out: str) -> DataFrame:
    """Per key the commonest target; of equals the one that came first by ``position``."""
    counted = rows.groupBy(*keys, target).agg(F.count("*").alias("__n"), F.min(position).alias("__p"))
    return counted.groupBy(*keys).agg(F.min_by(target, F.struct(-F.col("__n"), F.col("__p"))).alias(out))


def lookup_backoff(df: DataFrame, current: str = "state", previous: str = "previous", run_length: str = "run_length", context: str = "context", target: str = "target", position: str = "row_index", edges: Sequence[int] = RUN_LENGTH_EDGES) -> DataFrame:
    """Tables over ever shorter keys; the first that knows the row's key decides, at last the commonest target (1 if none)."""
    out = df.withColumn("__b", bucket_edge(F.col(run_length), edges))
    train = out.where("is_train")
    levels = [[current, previous, "__b", context], [current, "__b", context], [current, "__b"], [current]]
    for i, keys in enumerate(levels):
        out = out.join(commonest(train, keys, target, position, f"__l{i}"), keys, "left")
    whole = commonest(train, [], target, position, "__all")
    out = out.crossJoin(F.broadcast(whole))
    return out.withColumn("prediction", F.coalesce(*[f"__l{i}" for i in range(4)], "__all", F.lit(1))).drop("__b", "__all", *[f"__l{i}" for i in range(4)])


def history_lookup(df: DataFrame, history: str = "history", target: str = "target", position: str = "row_index", length: int = 4) -> DataFrame:
    """The longest suffix of the history that training has seen decides; at last the commonest target (1 if none).

    One table over all suffix lengths and one join on (length, suffix).
    """
    suffixes = F.explode(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.struct(k.alias("k"), F.slice(F.col(history), F.lit(length) - k + 1, k).alias("s"))))
    train = df.where("is_train").select(target, position, suffixes.alias("x")).select(target, position, "x.k", "x.s")
    known = commonest(train, ["k", "s"], target, position, "__best")
    rows = df.select(position, suffixes.alias("x")).select(position, "x.k", "x.s").join(known, ["k", "s"])
    found = rows.groupBy(position).agg(F.max_by("__best", "k").alias("__found"))
    whole = commonest(df.where("is_train"), [], target, position, "__all")
    return df.join(found, position, "left").crossJoin(F.broadcast(whole)).withColumn("prediction", F.coalesce("__found", "__all", F.lit(1))).drop("__found", "__all")


# -- trees (grown in forest.py) ----------------------------------------------


def tree_expression(node: Node) -> Column:
    """The tree as nested conditions."""
    if node.feature is None:
        return F.lit(node.prediction)
    return F.when(F.col(node.feature) <= node.threshold, tree_expression(node.left)).otherwise(tree_expression(node.right))


def tree_top_k(node: Node, k: int, classes: int = 3) -> Column:
    """The leaf's classes by count and then number, unseen ones after them; the first ``k``."""
    if node.feature is None:
        order = sorted(node.counts, key=lambda c: (-node.counts[c], c)) + [c for c in range(classes) if c not in node.counts]
        return F.array(*[F.lit(c) for c in (order + [-1] * k)[:k]])
    return F.when(F.col(node.feature) <= node.threshold, tree_top_k(node.left, k, classes)).otherwise(tree_top_k(node.right, k, classes))


# -- random kernels and a linear head ---------------------------------------


#: Steps that a kernel may have, before it is held to the history's length.
KERNEL_STEPS = (3, 5, 7)


def random_kernels(width: int, length: int, n: int = 32, seed: int = 17) -> list[dict]:
    """Dilated kernels of 3, 5 or 7 steps with normal weights, drawn on the driver.

    Three streams of one seed: all lengths, all dilations (uniform over those whose
    reach lies within the history), then one matrix of weights and constants from
    which each kernel takes its rows.  Equal seeds give equal kernels; they are not
    those of other programs.
    """
    lengths, reaches, values = (np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(3))
    sizes = np.minimum(length, lengths.choice(KERNEL_STEPS, size=n))
    widest = np.maximum(1, (length - 1) // np.maximum(1, sizes - 1))
    dilations = 1 + np.floor(reaches.random(n) * widest).astype(int)
    normal = values.standard_normal((n, max(KERNEL_STEPS) * width + 1))
    return [{"weights": row[: size * width].reshape(size, width), "bias": float(row[-1]), "dilation": int(step)} for row, size, step in zip(normal, sizes, dilations)]


def kernel_features(df: DataFrame, kernels: list[dict], history: str = "history", out: str = "features") -> DataFrame:
    """Adds the greatest activation and the share of positive ones for each kernel; Arrow batches, whole batches at once."""
    @F.pandas_udf("array<double>")
    def features(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        x = np.array([[np.asarray(step, dtype=float) for step in row] for row in batch])
        columns = []
        for k in kernels:
            size, dilation = k["weights"].shape[0], k["dilation"]
            reach = 1 + (size - 1) * dilation
            act = np.stack([np.einsum("nsf,sf->n", x[:, s : s + reach : dilation], k["weights"]) + k["bias"] for s in range(x.shape[1] - reach + 1)], axis=1)
            columns += [act.max(axis=1), (act > 0).mean(axis=1)]
        return pd.Series(list(np.stack(columns, axis=1)))

    return df.withColumn(out, features(F.col(history)))


def ridge_head(train: DataFrame, n_features: int, features: str = "features", target: str = "target", penalty: float = 1e-3, classes: int = 3) -> np.ndarray:
    """Least squares on one-hot targets; sums of products per partition, one small matrix of each is added up.

    The penalty covers the constant too.
    """
    width = n_features + 1

    def sums(batches):
        gram, rhs = np.zeros((width, width)), np.zeros((width, classes))
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.stack(batch[features].to_numpy()), np.ones(len(batch))])
                y = np.zeros((len(batch), classes))
                t = batch[target].to_numpy()
                ok = (t >= 0) & (t < classes)
                y[np.flatnonzero(ok), t[ok].astype(int)] = 1
                gram, rhs = gram + x.T @ x, rhs + x.T @ y
        flat = np.concatenate([gram.ravel(), rhs.ravel()])
        yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    added = train.select(features, target).mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(width * (width + classes))
    for r in added:
        flat[r["i"]] = r["v"]
    gram, rhs = flat[: width * width].reshape(width, width), flat[width * width :].reshape(width, classes)
    return np.linalg.solve(gram + penalty * np.eye(width), rhs)


def linear_prediction(weights: np.ndarray, features: str = "features") -> Column:
    scores = [sum((F.get(F.col(features), F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights[:-1, c])), F.lit(float(weights[-1, c]))) for c in range(weights.shape[1])]
    return _argmax(scores)


def blended_target(soft: Column, hard: Column, weight: float, classes: int = 3) -> Column:
    """Argmax of (1 - weight) * soft + weight * one-hot; a missing soft vector counts as 0.9 for the hard label and 0.05 for others."""
    given = F.when(soft.isNotNull(), soft).otherwise(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == hard, F.lit(0.9)).otherwise(F.lit(0.05))))
    mixed = F.transform(given, lambda p, c: p * (1 - weight) + F.when(c == hard, F.lit(weight)).otherwise(F.lit(0.0)))
    return (F.array_position(mixed, F.array_max(mixed)) - 1).cast("int")
