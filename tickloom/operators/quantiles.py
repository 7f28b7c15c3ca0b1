"""Exact quantiles of columns of any size, without a buffer of all distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketches that bracket a quantile is one part in so many.
ACCURACY = 10_000


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), few_groups: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group of ``by`` (one in all, without): ``q__<column>``, the exact linear quantiles at ``probs`` of the values that are not NULL.

    Two passes.  Sketches, combined map-side, give two values about each quantile.
    Then rows below them are counted, and the next values outside them found, also
    map-side; only values between them, about 4 / ``accuracy`` of all, are shuffled
    by value with their counts and looked through in order.  A group without values
    has NULL.
    ``few_groups``: the groups are known to be few, so their brackets are broadcast.
    """
    gap = 2.0 / accuracy
    wanted = [(c, i, p) for c in columns for i, p in enumerate(probs)]
    ends = []
    for c in columns:
        inner = [x for p in probs for x in (p - gap, p + gap) if 0 < x < 1]
        sketch = F.percentile_approx(F.col(c), F.array(*map(F.lit, inner)), F.lit(accuracy)) if inner else None
        ends += [F.min(c).alias(f"__min_{c}"), F.max(c).alias(f"__max_{c}"), *([sketch.alias(f"__in_{c}")] if inner else [])]
    brackets = df.groupBy(*by).agg(*ends)

    def end(c: str, p: float) -> Column:
        if p <= 0:
            return F.col(f"__min_{c}")
        if p >= 1:
            return F.col(f"__max_{c}")
        inner = [x for q in probs for x in (q - gap, q + gap) if 0 < x < 1]
        return F.col(f"__in_{c}")[inner.index(p)]

    narrow = df.select(*by, *columns)
    if by:
        met = narrow.join(F.broadcast(brackets) if few_groups else brackets, list(by))
    else:
        met = narrow.crossJoin(F.broadcast(brackets))  # one row
    # a first element for the row itself, and one for each bracket that its value falls into
    none = F.struct(F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("v"))
    inside = [F.when((F.col(c) >= end(c, p - gap)) & (F.col(c) <= end(c, p + gap)), F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v"))) for k, (c, _, p) in enumerate(wanted)]
    first = F.col("e.k").isNull()
    below = [F.sum((first & (F.col(c) < end(c, p - gap))).cast("long")).alias(f"b{k}") for k, (c, _, p) in enumerate(wanted)]
    # the next value on either side: of few values both ends of a bracket may be one value
    below += [F.max(F.when(first & (F.col(c) < end(c, p - gap)), F.col(c).cast("double"))).alias(f"d{k}") for k, (c, _, p) in enumerate(wanted)]
    below += [F.min(F.when(first & (F.col(c) > end(c, p + gap)), F.col(c).cast("double"))).alias(f"u{k}") for k, (c, _, p) in enumerate(wanted)]
    totals = [F.sum((first & F.col(c).isNotNull()).cast("long")).alias(f"n{j}") for j, c in enumerate(columns)]
    counted = met.withColumn("e", F.explode(F.concat(F.array(none), F.array_compact(F.array(*inside))))).groupBy(*by, F.col("e.k").alias("k"), F.col("e.v").alias("v")).agg(F.count("*").alias("n"), *below, *totals)
    # the group's own row becomes one per bracket, before all values of it
    def entry(k: int, v: Column, n: Column, below: Column, total: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), v.cast("double").alias("v"), n.cast("long").alias("n"), below.cast("long").alias("below"), total.cast("long").alias("total"))

    null = F.lit(None)
    own = []
    for k, (c, _, _) in enumerate(wanted):
        low_one, high_one = F.col(f"d{k}"), F.col(f"u{k}")
        own += [entry(k, null, F.lit(0), F.col(f"b{k}") - low_one.isNotNull().cast("int"), F.col(f"n{list(columns).index(c)}")), F.when(low_one.isNotNull(), entry(k, low_one, F.lit(1), null, null)), F.when(high_one.isNotNull(), entry(k, high_one, F.lit(1), null, null))]
    own = F.array_compact(F.array(*own))
    value = F.array(F.struct("k", "v", "n", F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("total")))
    rows = counted.select(*by, F.explode(F.when(F.col("k").isNull(), own).otherwise(value)).alias("x")).select(*by, "x.*")
    order = Window.partitionBy(*by, "k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({"end": F.max("below").over(order) + F.sum("n").over(order), "total": F.max("total").over(order)})
    prob = F.element_at(F.array(*[F.lit(float(p)) for _, _, p in wanted]), F.col("k") + 1)
    placed = ranked.withColumn("place", (F.col("total") - 1) * prob)
    low, high = F.floor("place"), F.ceil("place")
    has = lambda rank: (F.col("v").isNotNull()) & (F.col("end") - F.col("n") <= rank) & (rank < F.col("end"))
    found = placed.groupBy(*by, "k").agg(F.max(F.when(has(low), F.col("v"))).alias("lo"), F.max(F.when(has(high), F.col("v"))).alias("hi"), F.max("place").alias("place"), F.max("total").alias("total"))
    mixed = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil("place") - F.col("place")) * F.col("lo") + (F.col("place") - F.floor("place")) * F.col("hi"))
    missed = (F.col("total") > 0) & (F.col("lo").isNull() | F.col("hi").isNull())
    exact = F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket; raise accuracy")).cast("double")).otherwise(mixed)
    picked = found.withColumn("q", exact)
    at = {(c, i): k for k, (c, i, _) in enumerate(wanted)}
    return picked.groupBy(*by).agg(*[F.array(*[F.max(F.when(F.col("k") == at[c, i], F.col("q"))) for i in range(len(probs))]).alias(f"q__{c}") for c in columns])


def with_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], of: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the quantiles of ``of`` (itself, if not given) beside each row: one row broadcast, or a left join by group."""
    found = quantiles(df if of is None else of, columns, probs, by)
    return df.join(found, list(by), "left") if by else df.crossJoin(F.broadcast(found))
