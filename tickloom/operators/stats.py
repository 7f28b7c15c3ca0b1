"""Uncertainty, agreement and redundancy statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hashed_digits, hashed_uniform
from .features import fill_and_scale, log_counters
from .lineage import SMALL_BYTES, cut
from .phases import Clustering, many_kmeans, nearest_centroid
from .sequences import with_running_total


def group_counts(df: DataFrame, group: str, truth: str = "target", prediction: str = "prediction", current: str = "state", classes: int = 3) -> DataFrame:
    """Per group its confusion counts and transitions: all that a cluster bootstrap needs of the rows."""
    cell = [F.sum(((F.col(truth) == t) & (F.col(prediction) == p)).cast("long")).alias(f"c{t}{p}") for t in range(classes) for p in range(classes)]
    ok = F.col(truth).between(0, classes - 1) & F.col(prediction).between(0, classes - 1)
    moved = F.col(truth) != F.col(current)
    return df.where(ok).groupBy(group).agg(*cell, F.sum(moved.cast("long")).alias("moved"), F.sum((moved & (F.col(truth) == F.col(prediction))).cast("long")).alias("moved_right"))


def drawn_sums(counts: DataFrame, group: str, resamples: int, seed: int, scheme: str = "multinomial", most_bytes: int = SMALL_BYTES) -> DataFrame:
    """``resample``, 0..resamples-1, and the sums of all other columns over groups drawn with replacement.

    Draws are hashed (see ``hashed_uniform``), so no task holds a state and none of the
    groups comes to the driver.  ``multinomial``: each resample draws as many groups as
    there are; draw i of resample r takes the group at floor(u n) in order of the
    groups' names, u hashed from (seed, r, i).  Where the groups' counts, a known number
    of rows of numbers, are within ``most_bytes`` they are broadcast and only sums are
    shuffled; else they and the draws are.  Draws are never broadcast.  ``poisson``: each group
    counts 0, 1, 2, ... times by one hash of (seed, r, group), so nothing but sums is
    shuffled for any number of groups; the drawn number of groups varies.
    """
    names = [c for c in counts.columns if c != group]
    spark = counts.sparkSession
    turns = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")
    if scheme == "multinomial":
        text = counts.select(F.col(group).cast("string").alias("__name"), *names)
        numbered = cut(with_running_total(text.withColumn("__one", F.lit(1).cast("long")), ["__name"], "__one", "__place").drop("__name", "__one"))
        n = numbered.count()
        draws = spark.range(n).select("id", turns).select("resample", F.floor(hashed_uniform(seed, F.col("resample"), F.col("id")) * n).alias("__place"))
        # the optimizer's estimates do not serve here: too large for the counts after their joins, and for the draws that of the range, before it is exploded
        broadcast = n * 8 * (len(names) + 3) <= most_bytes
        weighted = draws.hint("merge").join(F.broadcast(numbered) if broadcast else numbered, "__place").withColumn("__times", F.lit(1))
    elif scheme == "poisson":
        chance, below = math.exp(-1), []
        for k in range(1, 20):
            below.append((below[-1] if below else 0.0) + chance)
            chance /= k
        # each group and resample is hashed once and its digits compared as text: a number above each bound counts once more
        bounds = [f"{n:013x}" for n in (math.ceil(b * (1 << 52)) for b in below) if n < 1 << 52]
        drawn = counts.select("*", turns).withColumn("__digits", hashed_digits(seed, F.col("resample"), F.col(group))).where(F.col("__digits") >= bounds[0])
        weighted = drawn.withColumn("__times", sum(((F.col("__digits") >= b).cast("int") for b in bounds), F.lit(0)))
    else:
        raise ValueError(f"no such scheme: {scheme}")
    return weighted.groupBy("resample").agg(*[F.sum(F.col(c) * F.col("__times")).alias(c) for c in names])


def _intervals(values: DataFrame, names: Sequence[str]) -> list[Column]:
    """Both ends of each column's 95 % interval, 0 where it has no value."""
    out = []
    for name in names:
        ends = F.percentile(name, F.array(F.lit(0.025), F.lit(0.975)))
        out += [F.coalesce(ends[i], F.lit(0.0)).alias(f"{name}_{end}") for i, end in enumerate(("low", "high"))]
    return out


SCORES = ("accuracy", "macro_f1", "balanced_accuracy", "transition_accuracy")


def bootstrap_scores(df: DataFrame, group: str, truth: str = "target", prediction: str = "prediction", current: str = "state", resamples: int = 1000, seed: int = 17, classes: int = 3, scheme: str = "multinomial") -> DataFrame:
    """``resample`` and its accuracy, macro F1, balanced and transition accuracy (NULL where nothing moved), drawing whole groups."""
    drawn = drawn_sums(group_counts(df, group, truth, prediction, current, classes), group, resamples, seed, scheme)
    cell = lambda t, p: F.col(f"c{t}{p}")
    hit = [cell(t, t) for t in range(classes)]
    support = [sum((cell(t, p) for p in range(classes)), F.lit(0)) for t in range(classes)]
    said = [sum((cell(t, p) for t in range(classes)), F.lit(0)) for p in range(classes)]
    add = lambda columns: sum(columns, F.lit(0))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = add(share(2 * h, s + p) for h, s, p in zip(hit, support, said))
    met = add((s + p > 0).cast("int") for s, p in zip(support, said))
    balanced = add(share(h, s) for h, s in zip(hit, support))
    seen = add((s > 0).cast("int") for s in support)
    return drawn.select("resample", share(add(hit), add(support)).alias("accuracy"), share(f1, met).alias("macro_f1"), share(balanced, seen).alias("balanced_accuracy"), F.try_divide("moved_right", "moved").alias("transition_accuracy"))


def bootstrap_intervals(df: DataFrame, group: str, truth: str = "target", prediction: str = "prediction", current: str = "state", resamples: int = 1000, seed: int = 17, classes: int = 3, scheme: str = "multinomial") -> dict[str, float]:
    """95 % intervals of the scores (see ``bootstrap_scores``); one row comes to the driver, whatever the number of groups.

    Without groups there are no resamples and all ends are 0.
    """
    groups = df.where(F.col(truth).between(0, classes - 1) & F.col(prediction).between(0, classes - 1)).select(group).distinct().count()
    values = bootstrap_scores(df, group, truth, prediction, current, resamples, seed, classes, scheme)
    row = values.agg(*_intervals(values, SCORES)).first().asDict()
    return {"groups": groups, "resamples": resamples if groups else 0, **{k: float(v) for k, v in row.items()}}


def bootstrap_gaps(df: DataFrame, group: str, truth: str = "target", first: str = "first_prediction", second: str = "second_prediction", current: str = "state", resamples: int = 5000, seed: int = 29, scheme: str = "multinomial") -> DataFrame:
    """``resample`` and the differences of accuracy and transition accuracy, first minus second (the latter NULL where nothing moved)."""
    known = df.where((F.col(truth) >= 0) & (F.col(first) >= 0) & (F.col(second) >= 0))
    moved = F.col(truth) != F.col(current)
    a, b = F.col(first) == F.col(truth), F.col(second) == F.col(truth)
    count = lambda c: F.sum(c.cast("long"))
    counts = known.groupBy(group).agg(F.count("*").alias("n"), (count(a) - count(b)).alias("gap"), count(moved).alias("moved"), (count(moved & a) - count(moved & b)).alias("moved_gap"))
    drawn = drawn_sums(counts, group, resamples, seed, scheme)
    return drawn.select("resample", F.coalesce(F.try_divide("gap", "n"), F.lit(0.0)).alias("accuracy_difference"), F.try_divide("moved_gap", "moved").alias("transition_accuracy_difference"))


def bootstrap_difference(df: DataFrame, group: str, truth: str = "target", first: str = "first_prediction", second: str = "second_prediction", current: str = "state", resamples: int = 5000, seed: int = 29, scheme: str = "multinomial") -> dict[str, float]:
    """Mean, 95 % interval and chance above zero of the differences (see ``bootstrap_gaps``); only the counts without groups."""
    groups = df.where((F.col(truth) >= 0) & (F.col(first) >= 0) & (F.col(second) >= 0)).select(group).distinct().count()
    out: dict[str, float] = {"groups": groups, "resamples": resamples if groups else 0}
    if not groups:
        return out
    values = bootstrap_gaps(df, group, truth, first, second, current, resamples, seed, scheme)
    names = ("accuracy_difference", "transition_accuracy_difference")
    parts = [c for n in names for c in (F.coalesce(F.avg(n), F.lit(0.0)).alias(n), F.coalesce(F.avg((F.col(n) > 0).cast("double")), F.lit(0.0)).alias(f"{n}_above_zero"))]
    return out | {k: float(v) for k, v in values.agg(*parts, *_intervals(values, names)).first().asDict().items()}


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labellings; rows with a negative label do not count; 1 for fewer than two rows."""
    cells = df.where((F.col(a) >= 0) & (F.col(b) >= 0)).groupBy(a, b).agg(F.count("*").alias("n"))

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    joint = cells.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("joint"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("rows"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("cols"))
    expected = F.try_divide(F.col("rows") * F.col("cols"), pairs(F.col("total")))
    value = F.try_divide(F.col("joint") - expected, (F.col("rows") + F.col("cols")) / 2 - expected)
    return joint.crossJoin(rows).crossJoin(cols).select(F.when(F.col("total") < 2, 1.0).otherwise(F.coalesce(value, F.lit(1.0))).alias("adjusted_rand"))


#: Values of columns in all up to which their ranks are broadcast.
FEW_VALUES = 200_000


def ranked(df: DataFrame, columns: Sequence[str], few_values: int = FEW_VALUES) -> DataFrame:
    """Average ranks (ties share their mean) of numbers as ``rank__<column>``, NULL for NULL.

    Counts of (column, value) of all columns at once are dealt by range and summed up,
    so equal values are one row there.  Ranks go back by value: those of the columns of
    fewest values, ``FEW_VALUES`` in all, are broadcast, so that no task gets all rows of
    a common value; for each other column the rows are shuffled by it.
    """
    rows = cut(df)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    counts = rows.select(cells.alias("x")).select("x.c", "x.v").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    ranks = cut(with_running_total(counts, ["v"], "n", "before", ["c"]).select("c", "v", (F.col("before") + (F.col("n") + 1) / 2).alias("rank")))
    values = {r["c"]: r["k"] for r in ranks.groupBy("c").agg(F.count("*").alias("k")).collect()}
    total, few = 0, []
    for i in sorted(range(len(columns)), key=lambda i: values.get(i, 0)):
        total += values.get(i, 0)
        few += [i] if total <= few_values else []
    # one table of all of them, an array by column, so that every join reads the same broadcast
    table = F.broadcast(ranks.where(F.col("c").isin(few)).groupBy(F.col("v").alias("__value")).agg(F.array(*[F.max(F.when(F.col("c") == i, F.col("rank"))) for i in range(len(columns))]).alias("__ranks")))
    out = rows
    for i, c in enumerate(columns):
        mine = table if i in few else ranks.where(F.col("c") == i).select(F.col("v").alias("__value"), F.col("rank").alias("__rank"))
        met = out.join(mine, F.col(c).cast("double") == F.col("__value"), "left")
        out = met.withColumn(f"rank__{c}", F.get("__ranks", F.lit(i)) if i in few else F.col("__rank")).drop("__value", "__ranks", "__rank")
    return out


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson coefficient of every pair of columns, (a, b) in the order given, from one pass."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    row = df.agg(*[F.corr(x, y).alias(f"r{k}") for k, (x, y) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{k}").alias("r")) for k, (x, y) in enumerate(pairs)])).alias("p")).select("p.*")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of average ranks, over rows that have all columns."""
    whole = df.select(*columns).dropna()
    ranks = ranked(whole, columns)
    out = correlations(ranks, [f"rank__{c}" for c in columns])
    return out.select(F.substring("a", 7, 200).alias("a"), F.substring("b", 7, 200).alias("b"), "r")


#: Cells that one task of Kendall's coefficient looks through, about.
CELLS = 1 << 17


def balance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum of n_a n_b over concordant pairs less that over discordant ones; pairs equal in x or y do not count.

    Merge counting: at each level the right half of a stretch (in order of x) meets the
    left half in order of y, all stretches at once.
    """
    cell, which = np.unique(np.stack([x, y], axis=1), axis=0, return_inverse=True)  # in order of x and then y
    n = np.bincount(which.ravel(), weights=n)
    xs, ys = np.unique(cell[:, 0], return_inverse=True)[1], np.unique(cell[:, 1], return_inverse=True)[1]
    at, total, size = np.arange(len(n)), 0.0, 1
    order = at
    while size < len(n):
        stretch = at // (2 * size)
        order = np.lexsort((ys, stretch))
        s, v, w, right = stretch[order], ys[order], n[order], (order // size) % 2 == 1
        left = np.concatenate(([0.0], np.cumsum(np.where(right, 0.0, w))))

        def ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """First place of each one's run, and the first after it."""
            first = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            return first[run], np.append(first[1:], len(new))[run]

        new = np.concatenate(([True], s[1:] != s[:-1]))
        begin, end = ends(new)
        equal, after = ends(new | np.concatenate(([True], v[1:] != v[:-1])))
        total += float((w * ((left[equal] - left[begin]) - (left[end] - left[after])))[right].sum())
        size *= 2
    # pairs of one x stand in order of y, so they were counted as concordant
    whole = np.bincount(xs, weights=n)
    return total - float((whole**2).sum() - (n**2).sum()) / 2


def _balances(df: DataFrame, by: str, x: str, y: str) -> float:
    """``balance`` of each group of ``by``, summed."""
    def run(rows: pa.Table) -> pa.Table:
        return pa.table({"s": [balance(*[np.asarray(rows.column(c)) for c in (x, y, "n")])]})

    return df.select(by, x, y, "n").groupBy(by).applyInArrow(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]


def kendall(df: DataFrame, x: str, y: str, cells: int = CELLS) -> DataFrame:
    """Tau-b of two columns of any number of distinct values; NULL if one of them is constant.

    Distinct pairs of values with their counts are cut into ranges of x and of y, of
    about ``cells`` pairs; a value with more has a range of its own.  Pairs of one range of x
    are counted there by merging (none, if it is one value), those of different ranges
    of x but one of y there, and all others are those of the coarse table of ranges,
    which is the same task, a quarter as large at most.  No pair is joined with another
    and no task has more than two ranges' worth.
    """
    base = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")))
    rest, found = base, 0.0
    while True:
        size = rest.count()
        width = max(cells, 4 * math.isqrt(size) + 4)
        placed = rest
        for c in ("x", "y"):
            values = with_running_total(rest.groupBy(c).agg(F.count("*").alias("k")), [c], "k", f"{c}_place")
            hot = F.col("k") >= width
            # a value's place stands for it; a hot one comes after those before it in its stretch
            placed = placed.join(values.select(c, f"{c}_place", (F.floor(F.col(f"{c}_place") / width) * 2 + hot.cast("int")).alias(f"{c}_range"), hot.alias(f"{c}_hot")), c)
        placed = cut(placed.select("x_place", "y_place", "x_range", "y_range", "x_hot", "y_hot", "n")) if size > width else placed
        found += _balances(placed.where("not x_hot"), "x_range", "x_place", "y_place")
        if size <= width:
            break
        found += _balances(placed.where("not y_hot"), "y_range", "x_range", "y_place")
        rest = cut(placed.groupBy(F.col("x_range").alias("x"), F.col("y_range").alias("y")).agg(F.sum("n").alias("n")))
    pairs = lambda n: n * (n - 1) / 2
    count = lambda c: base.groupBy(c).agg(F.sum("n").cast("double").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias(f"t{c}"))
    whole = base.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))
    root = F.sqrt((pairs(F.col("n")) - F.col("tx")) * (pairs(F.col("n")) - F.col("ty")))
    return whole.crossJoin(count("x")).crossJoin(count("y")).select(F.try_divide(F.lit(found), root).alias("tau"))


def top_correlations(pairs: DataFrame, n: int) -> DataFrame:
    """The strongest pairs by absolute coefficient."""
    return pairs.withColumn("strength", F.abs("r")).orderBy(F.col("strength").desc(), "a", "b").limit(n)


def correlation_groups(pairs: DataFrame, threshold: float) -> list[list[str]]:
    """Groups of columns tied by coefficients of ``threshold`` or more; a pair of column names per row, so it is small."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in pairs.where(F.abs("r") >= threshold).collect():
        lo, hi = sorted((find(r["a"]), find(r["b"])))
        parent[hi] = lo
    groups: dict[str, list[str]] = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Diagonal of the inverse correlation matrix, greatest first; a row per pair of columns comes to the driver."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in correlations(df.select(*columns).dropna(), columns).collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["r"] if r["r"] is not None else 0.0
    vif = np.diag(np.linalg.pinv(m))
    return sorted(zip(columns, map(float, vif)), key=lambda p: (-p[1], p[0]))


def _rand(cells: dict[tuple[int, int], int]) -> float:
    """Adjusted Rand index of a table of counts; 1 for fewer than two rows or where it is not defined."""
    pairs = lambda n: n * (n - 1) / 2
    total = sum(cells.values())
    if total < 2:
        return 1.0
    rows, columns = Counter(), Counter()
    for (a, b), n in cells.items():
        rows[a] += n
        columns[b] += n
    joint, x, y = (sum(map(pairs, c.values())) for c in (cells, rows, columns))
    expected = x * y / pairs(total)
    return (joint - expected) / ((x + y) / 2 - expected) if (x + y) / 2 != expected else 1.0


def stability(df: DataFrame, counters: Sequence[str], ks: Sequence[int], seeds: Sequence[int], starts: dict[int, list] | None = None, most_rounds: int = 100) -> list[dict]:
    """For each k: mean and least pairwise Rand index over seeds (or given starts), mean of the least cluster share.

    All clusterings are fitted together (see ``many_kmeans``), and one pass counts how
    often rows have two labels for every pair of them; those counts come to the driver.
    """
    scaled = cut(fill_and_scale(log_counters(df, counters), counters))
    wanted = [(k, i) for k in ks for i in range(len(seeds))]
    found = many_kmeans(scaled.where("is_train"), counters, [Clustering(None, k, seeds[i], starts[k][i] if starts else None) for k, i in wanted], None, most_rounds)
    labels = scaled.select(F.array(*[nearest_centroid(counters, c) for c in found]).alias("l"))
    both = [(a, b) for a in range(len(wanted)) for b in range(a, len(wanted)) if wanted[a][0] == wanted[b][0]]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.get("l", F.lit(a)).alias("a"), F.get("l", F.lit(b)).alias("b")) for p, (a, b) in enumerate(both)]))
    cells: list[dict] = [{} for _ in both]
    for r in labels.select(each.alias("e")).where("e.a >= 0 and e.b >= 0").groupBy("e.p", "e.a", "e.b").agg(F.count("*").alias("n")).collect():
        cells[r["p"]][r["a"], r["b"]] = r["n"]
    out = []
    for k in ks:
        mine = [(a, b, cells[p]) for p, (a, b) in enumerate(both) if wanted[a][0] == k]
        rand = [_rand(c) for a, b, c in mine if a != b]
        shares = [min(c.get((j, j), 0) for j in range(k)) / max(1, sum(c.values())) for a, b, c in mine if a == b]
        out.append({"k": k, "seeds": len(seeds), "ari_mean": float(np.mean(rand)) if rand else 1.0, "ari_min": min(rand, default=1.0), "least_share_mean": float(np.mean(shares))})
    return out
