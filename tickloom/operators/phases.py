"""Discretising: tertile states and train-only k-means phases."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import pressure_counters
from ..functions.scalars import state_of
from .features import fill_and_scale, log_counters
from .lineage import cut
from .quantiles import with_quantiles
from .sequences import with_row_index


def tertile_states(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "state") -> DataFrame:
    """States 0, 1, 2 by the thirds of training values (``is_train``), over all rows or each group; -1 where missing.

    Exact linear quantiles.
    """
    cuts = F.col(f"q__{value}")
    return with_quantiles(df, [value], [1.0 / 3, 2.0 / 3], df.where("is_train"), by).withColumn(out, state_of(F.col(value), cuts[0], cuts[1])).drop(f"q__{value}")


def distances(columns: Sequence[str], centroids: np.ndarray) -> list[Column]:
    """Squared distance of a row to each centroid, as expressions."""
    return [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, row)), F.lit(0.0)) for row in centroids]


def nearest_centroid(columns: Sequence[str], centroids: np.ndarray) -> Column:
    """Number of the nearest centroid, the lowest at ties; -1 if there is none."""
    if not len(centroids):
        return F.lit(-1)
    return _nearest(distances(columns, centroids))


def _nearest(apart: Sequence[Column]) -> Column:
    d = F.array(*apart)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def _nearest_of(columns: Sequence[str], table: str, k: int) -> Column:
    """The same with the centroids in a column, an array of up to ``k``; NULL if it is NULL or empty."""
    def apart(j: int) -> Column:
        return sum(((F.col(c) - F.get(F.get(table, F.lit(j)), F.lit(i))) * (F.col(c) - F.get(F.get(table, F.lit(j)), F.lit(i))) for i, c in enumerate(columns)), F.lit(0.0))

    return _nearest([apart(j) for j in range(k)])


@dataclass
class Clustering:
    """One k-means among many: the group whose rows it takes (None: all), how many clusters, what it is drawn with, or its first centroids."""

    group: str | None
    k: int
    seed: int
    start: Sequence[Sequence[float]] | None = None


def _first_centroids(rows: DataFrame, columns: Sequence[str], wanted: Sequence[Clustering]) -> list[np.ndarray]:
    """For each clustering ``k`` distinct rows of its group: those at the positions drawn by NumPy among the distinct rows in order.

    Only the groups' numbers of distinct rows and the drawn rows come to the driver.
    """
    unique = with_row_index(rows.select("__group", *columns).distinct(), ["__group", *columns])
    sizes = {r["__group"]: (r["first"], r["n"]) for r in unique.groupBy("__group").agg(F.min("row_index").alias("first"), F.count("*").alias("n")).collect()}
    drawn = []
    for c in wanted:
        first, n = sizes.get(c.group or "", (0, 0))
        drawn.append([first + i for i in np.random.default_rng(c.seed).choice(n, size=min(max(1, c.k), n), replace=False).tolist()] if n else [])
    places = sorted({i for d in drawn for i in d})
    if not places:
        return [np.empty((0, len(columns))) for _ in wanted]
    picked = unique.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in places], "row_index long")), "row_index")
    found = {r["row_index"]: [float(r[c]) for c in columns] for r in picked.collect()}
    return [np.array([found[i] for i in d]).reshape(-1, len(columns)) for d in drawn]


def many_kmeans(train: DataFrame, columns: Sequence[str], wanted: Sequence[Clustering], group: str | None = None, most_rounds: int = 100) -> list[np.ndarray]:
    """Lloyd's centroids of many clusterings, over all rows or over those of one ``group`` each.

    Equal rows are one row with a count.  A round is one job for all of them: rows meet
    the centroids of their group, a row
    for each clustering, and give one grouped mean by (clustering, cluster).  A clustering
    that has settled leaves the next rounds: no row changes its cluster and the centroids
    stay.  An empty cluster keeps its centroid.
    """
    spark = train.sparkSession
    named = F.col(group).cast("string") if group else F.lit("")
    data = train.select(named.alias("__group"), *columns).where("__group IS NOT NULL").groupBy("__group", *columns).agg(F.count("*").alias("__n")).persist()
    try:
        to_draw = [c for c in wanted if c.start is None]
        drawn = iter(_first_centroids(data, columns, to_draw) if to_draw else [])
        now = [next(drawn) if c.start is None else np.array(c.start, dtype=float).reshape(-1, len(columns)) for c in wanted]
        last = [np.zeros_like(x) for x in now]
        active = [i for i, x in enumerate(now) if len(x)]
        widest = max((len(x) for x in now), default=0)
        for turn in range(most_rounds):
            if not active:
                break
            table = spark.createDataFrame([(i, wanted[i].group or "", now[i].tolist(), last[i].tolist()) for i in active], "clustering int, __group string, now array<array<double>>, last array<array<double>>")
            met = data.join(F.broadcast(table), "__group")
            old = _nearest_of(columns, "last", widest) if turn else F.lit(0)
            labelled = met.withColumns({"cluster": _nearest_of(columns, "now", widest), "__old": old})
            mean = lambda c: F.sum(F.col(c) * F.col("__n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("__n")))
            rows = labelled.groupBy("clustering", "cluster").agg(F.sum((F.col("cluster") != F.col("__old")).cast("long")).alias("moved"), *[mean(c).alias(c) for c in columns]).collect()
            moved = dict.fromkeys(active, 0)
            new = {i: now[i].copy() for i in active}
            for r in rows:
                new[r["clustering"]][r["cluster"]] = [r[c] for c in columns]
                moved[r["clustering"]] += r["moved"]
            settled = {i for i in active if not moved[i] and np.allclose(new[i], now[i])}
            for i in active:
                last[i], now[i] = now[i], new[i]
            active = [i for i in active if i not in settled]
        return now
    finally:
        data.unpersist()


def kmeans(train: DataFrame, columns: Sequence[str], k: int, seed: int, most_rounds: int = 100, start: Sequence[Sequence[float]] | None = None) -> np.ndarray:
    """Lloyd's centroids of one clustering (see ``many_kmeans``)."""
    return many_kmeans(train, columns, [Clustering(None, k, seed, start)], None, most_rounds)[0]


def phase_states(df: DataFrame, counters: Sequence[str], k: int = 3, seed: int = 17, out: str = "state", start: Sequence[Sequence[float]] | None = None, most_rounds: int = 100) -> tuple[DataFrame, dict]:
    """Phases 0..k-1 by rising pressure over all rows (see ``grouped_phases``), and what was learned."""
    states, learned = grouped_phases(df, counters, None, k, seed, out, start, most_rounds)
    return states, learned[0]


def grouped_phases(df: DataFrame, counters: Sequence[str], group: str | None = None, k: int = 3, seed: int = 17, out: str = "state", start: Sequence[Sequence[float]] | None = None, most_rounds: int = 100) -> tuple[DataFrame, list[dict]]:
    """Phases 0..k-1 by rising pressure, learned from training rows, over all rows or those of each ``group`` by itself; and what was learned, by group.

    Signed log, median fill and scaling by training rows, k-means on them; all rows
    go to the nearest centroid; clusters are ranked by their mean training pressure
    (sum of scaled pressure counters, or the norm if there is none), an empty one
    last.  Centroids are given in the order of the states.  A row without a group, or
    of one that nothing trained, has the state -1.  The number of jobs does not
    depend on that of groups.
    """
    spark = df.sparkSession
    scaled = cut(fill_and_scale(log_counters(df, counters), counters, [group] if group else []))  # read in every round, and by the states
    train = scaled.where("is_train")
    names = sorted(str(r[0]) for r in scaled.select(group).where(F.col(group).isNotNull()).distinct().collect()) if group else [""]
    wanted = [Clustering(n, k, seed, start) for n in names]
    found = dict(zip(names, many_kmeans(train, counters, wanted, group, most_rounds)))
    widest = max((len(x) for x in found.values()), default=0)
    pressing = pressure_counters(list(counters))
    pressure = sum((F.col(c) for c in pressing), F.lit(0.0)) if pressing else F.sqrt(sum((F.col(c) * F.col(c) for c in counters), F.lit(0.0)))
    named = F.col(group).cast("string") if group else F.lit("")
    some = [(n, x.tolist()) for n, x in found.items() if len(x)]
    centroids = F.broadcast(spark.createDataFrame(some, "__group string, __now array<array<double>>"))
    raw = _nearest_of(counters, "__now", widest)
    met = train.withColumn("__group", named).join(centroids, "__group") if some else None
    means = {(r["__group"], r["cluster"]): r["p"] for r in met.groupBy("__group", raw.alias("cluster")).agg(F.avg(pressure).alias("p")).collect()} if some else {}
    learned, ranks = [], []
    for n in names:
        order = sorted(range(len(found[n])), key=lambda c: means.get((n, c), math.inf))
        ordered = found[n][order] if order else found[n]
        if order:
            # ties go to the lowest raw cluster, so the raw number is found first and then ranked
            ranks.append((n, found[n].tolist(), [order.index(c) for c in range(len(order))]))
        learned.append({"group": n, "centroids": ordered.tolist(), "pressure": [means.get((n, c), math.inf) for c in order], "pressure_counters": pressing, "clusters": len(found[n])})
    if not ranks:
        return scaled.withColumn(out, F.lit(-1)), learned
    table = F.broadcast(spark.createDataFrame(ranks, "__group string, __now array<array<double>>, __rank array<int>"))
    states = scaled.withColumn("__group", named).join(table, "__group", "left").withColumn(out, F.coalesce(F.get("__rank", raw), F.lit(-1)).cast("int"))
    return states.drop("__group", "__now", "__rank"), learned


def phase_summary(states: DataFrame, counters: Sequence[str], learned: dict, state: str = "state") -> DataFrame:
    """Per state: rows, training rows, mean distance of training rows to their centroid."""
    own = F.element_at(F.array(*distances(counters, np.array(learned["centroids"]))), F.col(state) + 1)
    return states.where(F.col(state) >= 0).groupBy(state).agg(F.count("*").alias("rows"), F.sum(F.col("is_train").cast("long")).alias("train_rows"), F.avg(F.when(F.col("is_train"), F.sqrt(own))).alias("mean_train_distance"))


def one_dimensional_states(df: DataFrame, value: str, k: int = 3, seed: int = 17, out: str = "state", start: Sequence[float] | None = None, most_rounds: int = 100) -> tuple[DataFrame, list[float]]:
    """K-means on one signed-log column, states by rising centroid; as midpoints between sorted centroids."""
    logged = cut(fill_and_scale(log_counters(df, [value]), [value]))
    centroids = np.sort(kmeans(logged.where("is_train"), [value], k, seed, most_rounds, None if start is None else [[x] for x in start]).ravel())
    cuts = ((centroids[1:] + centroids[:-1]) / 2).tolist()
    state = sum(((F.col(value) > cut).cast("int") for cut in cuts), F.lit(0))
    return logged.withColumn(out, state.cast("int")), cuts
