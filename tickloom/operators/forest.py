"""Decision trees, many at once: all trees grow a level at a time in the same grouped passes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

DECILES = [k / 10 for k in range(1, 10)]
#: Different values of a feature up to which its deciles come from a buffer of them.
BUFFERED = 100_000


@dataclass
class Node:
    """A node: what it predicts, its counts by class, and its cut if it has one (left: value <= threshold)."""

    prediction: int
    counts: dict[int, int]
    feature: str | int | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> int:
        return 1 if self.feature is None else self.left.leaves() + self.right.leaves()

    def internal(self) -> int:
        return 0 if self.feature is None else 1 + self.left.internal() + self.right.internal()

    def depth(self) -> int:
        return 0 if self.feature is None else 1 + max(self.left.depth(), self.right.depth())


def _impurity(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    share = np.divide(counts, total, out=np.zeros_like(counts, dtype=float), where=total > 0)
    return 1.0 - (share**2).sum(axis=-1)


def _grown(classes: dict[int, tuple[int, int]]) -> Node:
    """A leaf of class -> (rows, first place): the commonest class, of equals the one met first."""
    return Node(min(classes, key=lambda c: (-classes[c][0], classes[c][1])), {c: n for c, (n, _) in classes.items()})


def _best_cut(cuts: list[list[float]], cells: dict, min_leaf: int) -> tuple[int, int] | None:
    """(feature, number of its cut) of least impurity, the first of equals; cells: (feature, class) -> rows by stretch between cuts."""
    best = (math.inf, None)
    classes = sorted({c for _, c in cells})
    for f, mine in enumerate(cuts):
        if not mine:
            continue
        rows = np.array([cells[f, c] for c in classes], dtype=float)[:, : len(mine) + 1]
        left = np.cumsum(rows, axis=1)[:, : len(mine)].T
        right = rows.sum(axis=1) - left
        a, b = left.sum(axis=1), right.sum(axis=1)
        score = np.divide(a * _impurity(left) + b * _impurity(right), a + b)
        score[(a < min_leaf) | (b < min_leaf)] = math.inf
        k = int(np.argmin(score))
        if score[k] < best[0]:
            best = (float(score[k]), (f, k))
    return best[1]


def fit_forest(train: DataFrame, width: int, max_depth: int = 5, min_leaf: int = 3) -> dict[int, Node]:
    """Binary trees by Gini over the deciles of each node, one for each ``model``: model -> root, features by number.

    ``train``: model, x (an array of ``width`` numbers; NULL where a model has fewer), y
    and at (a row's place).  All trees grow together: a level takes exact deciles by
    (model, node, feature) and then rows by (model, node, feature, stretch between
    deciles, class), both combined map-side; so the number of jobs depends on the depth
    alone.  The driver gets those counts, whatever the number of rows.  Rows find their
    node by joins with the cuts made so far, a row for each (model, node).  Of equal cuts
    the first in feature order and lowest wins; a missing value goes right; a model
    without rows has no tree.  Deciles of a feature of few values (BUFFERED, by a sketch)
    come from a buffer of its values, others from ``quantiles``.
    """
    spark = train.sparkSession
    names = [f"x{i}" for i in range(width)]
    data = train.select("model", *[F.get("x", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)], F.col("y").cast("long").alias("y"), F.col("at").cast("long").alias("at")).persist()
    try:
        seen = data.groupBy("model", "y").agg(F.count("*").alias("n"), F.min("at").alias("at")).collect()
        classes: dict[tuple[int, int], dict] = {}
        for r in seen:
            classes.setdefault((r["model"], 1), {})[r["y"]] = (r["n"], r["at"])
        nodes = {key: _grown(c) for key, c in classes.items()}
        roots = {model: node for (model, _), node in nodes.items()}
        kinds = data.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
        few, many = [n for n in names if kinds[n] <= BUFFERED], [n for n in names if kinds[n] > BUFFERED]
        rows = data.withColumn("node", F.lit(1).cast("long"))
        for _ in range(max_depth):
            growing = [key for key, node in nodes.items() if len(node.counts) > 1 and sum(node.counts.values()) >= 2 * min_leaf]
            if not growing:
                break
            rows = rows.join(F.broadcast(spark.createDataFrame(growing, "model long, node long")), ["model", "node"], "left_semi")
            cuts: dict[tuple[int, int], list] = {key: [[] for _ in names] for key in growing}
            found = []
            if few:
                found += rows.groupBy("model", "node").agg(*[F.percentile(n, F.array(*map(F.lit, DECILES))).alias(f"q__{n}") for n in few]).collect()
            if many:
                found += quantiles(rows, many, DECILES, ["model", "node"], few_groups=True).collect()
            for r in found:
                for i, n in enumerate(names):
                    if f"q__{n}" in r:
                        cuts[r["model"], r["node"]][i] = sorted({v for v in r[f"q__{n}"] or [] if v is not None})
            table = spark.createDataFrame([(*key, c) for key, c in cuts.items()], "model long, node long, cuts array<array<double>>")
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("v"), F.get("cuts", F.lit(i)).alias("c")) for i, n in enumerate(names)]))
            cells = rows.join(F.broadcast(table), ["model", "node"]).select("model", "node", "y", "at", each.alias("e")).select("model", "node", "y", "at", "e.*")
            before = sum((F.coalesce((F.get("c", F.lit(j)) < F.col("v")).cast("int"), F.lit(0)) for j in range(len(DECILES))), F.lit(0))
            counted = cells.withColumn("stretch", F.when(F.col("v").isNull(), F.size("c")).otherwise(before)).groupBy("model", "node", "f", "y", "stretch").agg(F.count("*").alias("n"), F.min("at").alias("at")).collect()
            sums: dict[tuple[int, int], dict] = {key: {} for key in growing}
            firsts: dict[tuple, int] = {}
            for r in counted:
                key = (r["model"], r["node"])
                sums[key].setdefault((r["f"], r["y"]), np.zeros(len(DECILES) + 1, dtype=np.int64))[r["stretch"]] = r["n"]
                firsts[*key, r["f"], r["y"], r["stretch"]] = r["at"]
            made, nodes_next = [], {}
            for key in growing:
                model, number = key
                best = _best_cut(cuts[key], sums[key], min_leaf)
                if best is None:
                    continue
                f, k = best
                node = nodes[key]
                node.feature, node.threshold = f, cuts[key][f][k]
                made.append((model, number, f, node.threshold))
                for side, stretches in ((0, range(k + 1)), (1, range(k + 1, len(DECILES) + 1))):
                    own = {}
                    for (g, c), n in sums[key].items():
                        some = [s for s in stretches if n[s]]
                        if g == f and some:
                            own[c] = (int(n[some].sum()), min(firsts[model, number, f, c, s] for s in some))
                    child = nodes_next[model, 2 * number + side] = _grown(own)
                    setattr(node, "right" if side else "left", child)
            nodes = nodes_next
            if not made:
                break
            steps = spark.createDataFrame(made, "model long, node long, f int, t double")
            value = F.get(F.array(*names), F.col("f"))
            right = F.when(value <= F.col("t"), 0).otherwise(1)
            rows = rows.join(F.broadcast(steps), ["model", "node"]).withColumn("node", F.col("node") * 2 + right).drop("f", "t")
        return roots
    finally:
        data.unpersist()


def fit_tree(train: DataFrame, features: Sequence[str], target: str, max_depth: int = 5, min_leaf: int = 3, position: str = "row_index") -> Node:
    """One tree of :func:`fit_forest` on named columns; without rows, a leaf of class 0."""
    rows = train.select(F.lit(0).cast("long").alias("model"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(target).alias("y"), F.col(position).alias("at"))

    def named(node: Node) -> Node:
        return node if node.feature is None else replace(node, feature=features[node.feature], left=named(node.left), right=named(node.right))

    roots = fit_forest(rows, len(features), max_depth, min_leaf)
    return named(roots[0]) if roots else Node(0, {})


def forest_table(spark, trees: dict[int, Node]) -> DataFrame:
    """A row for each tree: model, and by number of node, the root first: feature (-1: a leaf), threshold, left, right, prediction."""
    out = []
    for model, root in trees.items():
        order = [root]
        for node in order:  # grows as it is read
            if node.feature is not None:
                order += [node.left, node.right]
        number = {id(n): i for i, n in enumerate(order)}
        out.append((int(model), *map(list, zip(*[(-1, 0.0, -1, -1, n.prediction) if n.feature is None else (n.feature, float(n.threshold), number[id(n.left)], number[id(n.right)], n.prediction) for n in order]))))
    return spark.createDataFrame(out, "model long, feature array<int>, threshold array<double>, `left` array<int>, `right` array<int>, leaf array<int>")


def forest_predictions(rows: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """``rows`` (with model and x) of models that have a tree, with ``prediction``: one join with a row for each tree."""
    deepest = max([1, *[t.depth() for t in trees.values()]])

    def step(node: Column, _: Column) -> Column:
        f = F.get("feature", node)
        return F.when(f < 0, node).when(F.get("x", f) <= F.get("threshold", node), F.get("left", node)).otherwise(F.get("right", node))

    met = rows.join(F.broadcast(forest_table(rows.sparkSession, trees)), "model")
    return met.withColumn("prediction", F.get("leaf", F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.lit(0), step))).drop("feature", "threshold", "left", "right", "leaf")
