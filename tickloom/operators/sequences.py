"""Ordered-stream operators: futures, run lengths, histories, spans, confirmation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hashed_uniform
from .lineage import cut

STREAM = ("run_id", "cpu_or_core_id")
ORDER = ("timestamp_ms", "row_index")


def stream(keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


def with_row_index(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``row_index`` 0, 1, ... in a global order without gathering rows in one task.

    Rows are dealt by range; counts of the ranges give their offsets.  The ranges
    are cut in the shared folder first so that they stay the same.
    """
    return with_running_total(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", "row_index").drop("__one")


def with_running_total(df: DataFrame, order: Sequence[str], value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows before in a global order, or in that of each group of ``by``.

    Rows are dealt by range of (``by``, ``order``), so a group of any size is spread;
    sums of the ranges, a row for each range and group that meet, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(F.broadcast(before), [*by, "__part"]).withColumn(out, F.col("__before") + F.col("__own")).select(*df.columns, out)


def futures(df: DataFrame, horizon: int, state: str = "state", value: str | None = None, w=None) -> DataFrame:
    """Adds ``future_state_k`` (-1 past the end), and ``future_value_k`` (NULL past the end), k = 1..horizon.

    Also whether and after how many steps the state first differs from a known
    current one; -1 if it does not.
    """
    w = w or stream()
    new = {f"future_state_{k}": F.coalesce(F.lead(state, k).over(w), F.lit(-1)) for k in range(1, horizon + 1)}
    if value:
        new |= {f"future_value_{k}": F.lead(value, k).over(w) for k in range(1, horizon + 1)}
    out = df.withColumns(new)
    differs = [F.when((F.col(state) >= 0) & (F.col(f"future_state_{k}") >= 0) & (F.col(f"future_state_{k}") != F.col(state)), F.lit(k)) for k in range(1, horizon + 1)]
    out = out.withColumn("time_to_change", F.coalesce(*differs, F.lit(-1)))
    return out.withColumn("will_change", (F.col("time_to_change") > 0).cast("int"))


def run_lengths(df: DataFrame, state: str = "state", keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ``run_number`` and ``run_length``: how many rows in a row, to here, have the state."""
    w = stream(keys, order)
    changed = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    numbered = df.withColumn("__changed", changed).withColumn("run_number", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("run_length", F.row_number().over(Window.partitionBy(*keys, "run_number").orderBy(*order))).drop("__changed")


def histories(df: DataFrame, length: int, columns: Sequence[str], target: str = "state", keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows with ``history`` (the last ``length`` rows' columns, oldest first) and ``target``, the next row's state.

    Rows before a full history and the last row of a stream are left out.
    """
    w = stream(keys, order)
    out = df.withColumns(
        {
            "history": F.collect_list(F.array(*[F.col(c) for c in columns])).over(w.rowsBetween(-length + 1, 0)),
            "__have": F.row_number().over(w),
            "target": F.lead(target).over(w),
        }
    )
    return out.where((F.col("__have") >= length) & F.col("target").isNotNull()).drop("__have")


def temporal_features(df: DataFrame, state: str = "state", context: Sequence[str] = (), keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds previous state (-1 at the start), run length, and a code of the other states (base 4, so none collide)."""
    code = F.lit(0)
    for c in context:
        code = code * 4 + F.col(c) + 1
    return run_lengths(df, state, keys, order).withColumns({"previous": F.coalesce(F.lag(state).over(stream(keys, order)), F.lit(-1)), "context": code})


def spans(df: DataFrame, state: str = "state", time: str = "timestamp_ms", keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per run of equal states: first and last time, number of rows."""
    return run_lengths(df, state, keys, order).groupBy(*keys, "run_number", state).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count("*").alias("n_rows"))


def confirmed(desired: Column, w, start: int = 1, before: Column | None = None) -> Column:
    """State that follows ``desired`` only once it was asked for twice in a row.

    The latest value that equals the one before it, or ``start``.  If two requests
    agree, the state is that value already or becomes it with the second; if they
    differ, nothing changes.  ``before`` is lag(desired) over ``w``, made beforehand.
    """
    return F.coalesce(F.last(F.when(desired == before, desired), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(start))


def with_confirmed(df: DataFrame, desired: str, out: str = "action", start: int = 1, keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    w = stream(keys, order)
    return df.withColumn("__before", F.lag(desired).over(w)).withColumn(out, confirmed(F.col(desired), w, start, F.col("__before"))).drop("__before")


def first_rows(df: DataFrame, n: int, keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(stream(keys, order))).where(F.col("__k") <= n).drop("__k")


def one_hot_history(history: Column, classes: int = 3) -> Column:
    """Flattened one-hot of a history of state vectors; a state outside the classes gives zeros."""
    return F.flatten(F.transform(history, lambda row: F.flatten(F.transform(row, lambda s: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == s).cast("int"))))))


def target_windows(df: DataFrame, length: int, horizon: int, columns: Sequence[str], state: str = "state", keys: Sequence[str] = STREAM, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows with a full history (one-hot, flattened) and all ``horizon`` states to come known."""
    w = stream(keys, order)
    out = df.withColumns(
        {
            "history": F.collect_list(F.array(*[F.col(c) for c in columns])).over(w.rowsBetween(-length + 1, 0)),
            "targets": F.array(*[F.coalesce(F.lead(state, k).over(w), F.lit(-1)) for k in range(1, horizon + 1)]),
        }
    )
    full = out.where((F.size("history") == length) & ~F.exists("targets", lambda t: t < 0))
    return full.withColumn("one_hot", one_hot_history(F.col("history")))


def drawn_rows(df: DataFrame, n: int, seed: int, order: Sequence[str]) -> DataFrame:
    """``n`` rows drawn with replacement, with ``draw`` 0..n-1: draw i takes the row at floor(u N) in the given order, u hashed from (seed, i)."""
    one = F.lit(1).cast("long")
    placed = with_running_total(df.withColumn("__one", one), order, "__one", "__place").drop("__one")
    placed = cut(placed)
    total = placed.count()
    draws = df.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), F.floor(hashed_uniform(seed, F.col("id")) * total).alias("__place"))
    return draws.join(placed, "__place").select("draw", *df.columns)


def synthetic_histories(df: DataFrame, n: int, rate: float, seed: int, history: str = "history", classes: int = 3, order: Sequence[str] = ("row_index",)) -> DataFrame:
    """``n`` windows drawn with replacement (see ``drawn_rows``), each step's states replaced at ``rate`` by one drawn from the classes.

    Step j of draw i changes if u < rate, u hashed from (seed, i, j), and then takes the
    state floor(u classes / rate).  Without windows there are none.
    """
    drawn = drawn_rows(df, n, seed, order)
    noise = F.transform(F.sequence(F.lit(0), F.size(history) - 1), lambda j: hashed_uniform(seed, F.col("draw"), j))
    changed = F.zip_with(history, "__noise", lambda s, u: F.when(u < rate, F.transform(s, lambda x: F.floor(u / rate * classes).cast("int"))).otherwise(s))
    return drawn.withColumn("__noise", noise).withColumn(history, changed).drop("__noise")


def known_states(df: DataFrame, horizon: int, state: str = "family_state", split: str = "split") -> DataFrame:
    """Text columns of a stored sequence as numbers: blank states are -1, a blank split trains."""
    blank = [f"future_state_{k}" for k in range(1, horizon + 1)]
    numbers = {c: F.coalesce(F.trim(F.col(c)).try_cast("int"), F.lit(-1)) for c in [state, *blank]}
    return df.withColumns({**numbers, split: F.coalesce(F.nullif(F.trim(F.col(split)), F.lit("")), F.lit("train"))})
