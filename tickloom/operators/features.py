"""Derived features, family scores, imputing and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import DERIVED, FAMILY_COUNTERS, derived_of
from ..functions.scalars import ratio, row_mean, signed_log1p
from .quantiles import with_quantiles


def _counter(df: DataFrame, name: str) -> Column:
    return F.col(f"counter__{name}") if f"counter__{name}" in df.columns else F.lit(None).cast("double")


def derived_features(wide: DataFrame) -> DataFrame:
    """Adds the rates that do not depend on time or frequency; NULL where a part is missing or a denominator is zero."""
    read, write = _counter(wide, "memory_read_bandwidth"), _counter(wide, "memory_write_bandwidth")
    either = F.when(read.isNotNull() | write.isNotNull(), F.coalesce(read, F.lit(0.0)) + F.coalesce(write, F.lit(0.0)))
    special = {"memory_total": F.coalesce(_counter(wide, "total_memory_bandwidth"), either)}

    def part(name: str) -> Column:
        return special[name] if name in special else _counter(wide, name)

    return wide.withColumns({name: part(top) if bottom is None else ratio(part(top), part(bottom), scale) for name, (_, top, bottom, scale) in DERIVED.items()})


def family_scores(wide: DataFrame, selected: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``score__<family>``: mean of its derived features, or of log1p of chosen counters (negative ones left out)."""
    rows = derived_features(wide)
    out = {}
    for family in FAMILY_COUNTERS:
        chosen = (selected or {}).get(family, [])
        if chosen:
            there = [c for c in chosen if f"counter__{c}" in wide.columns]
            out[f"score__{family}"] = row_mean([F.when(_counter(wide, c) >= 0, F.log1p(_counter(wide, c))) for c in there]) if there else F.lit(None).cast("double")
        else:
            out[f"score__{family}"] = row_mean([F.col(c) for c in derived_of(family)])
    return rows.withColumns(out)


def train_flag(df: DataFrame, split: str = "split") -> DataFrame:
    """Adds ``is_train``; with no training row at all every row counts as one."""
    some = df.agg(F.coalesce(F.max((F.col(split) == "train").cast("int")), F.lit(0)).alias("__some"))
    return df.crossJoin(F.broadcast(some)).withColumn("is_train", (F.col("__some") == 0) | (F.coalesce(F.col(split), F.lit("train")) == "train")).drop("__some")


def fill_train_median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing values get the median of training rows, 0 where there is none; exact."""
    joined = with_quantiles(df, columns, [0.5], df.where("is_train"), by)
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"q__{c}")[0], F.lit(0.0)) for c in columns}).drop(*[f"q__{c}" for c in columns])


def fill_and_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median fill, then (x - mean) / population deviation, both of filled training rows, of all or of each group; a deviation of 0 counts as 1."""
    filled = fill_train_median(df, columns, by)
    stats = filled.where("is_train").groupBy(*by).agg(*[F.avg(c).alias(f"__a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.coalesce(F.col(f"__a_{c}"), F.lit(0.0))) / F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    beside = filled.join(stats, list(by), "left") if by else filled.crossJoin(F.broadcast(stats))
    return beside.withColumns(scaled).drop(*[f"__{k}_{c}" for c in columns for k in "as"])


def log_counters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: signed_log1p(F.col(c)) for c in columns})


def positive_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every column is above zero."""
    return df.where(" and ".join(f"coalesce(`{c}` > 0, false)" for c in columns))


def drop_reasons(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, rows that stay, and how many each column alone would drop (a row can count for several)."""
    bad = {c: ~F.coalesce(F.col(c) > 0, F.lit(False)) for c in columns}
    any_bad = None
    for b in bad.values():
        any_bad = b if any_bad is None else any_bad | b
    return df.agg(F.count("*").alias("rows"), F.sum((~any_bad).cast("long")).alias("rows_kept"), *[F.sum(b.cast("long")).alias(f"dropped_{c}") for c, b in bad.items()])


def missing_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("double").alias("missing")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy(F.col("p.column").alias("column")).agg(F.avg("p.missing").alias("missing_fraction"))


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values beyond the quantiles are set to them (1st and 99th by choice)."""
    cuts = with_quantiles(df, columns, [low, high])
    return cuts.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"q__{c}")[1]), F.col(f"q__{c}")[0])) for c in columns}).drop(*[f"q__{c}" for c in columns])


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold two different values; one row comes to the driver."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def indicators(df: DataFrame, cycles: str, instructions: str, events: dict[str, str], duration: str | None = None) -> DataFrame:
    """Adds cycles per instruction and its inverse, and each event per thousand instructions; with ``duration`` also ``<name>_per_ms``."""
    new = {"cpi": ratio(F.col(cycles), F.col(instructions)), "ipc": ratio(F.col(instructions), F.col(cycles))}
    new |= {name: ratio(F.col(c), F.col(instructions), 1000.0) for name, c in events.items()}
    if duration:
        new |= {f"{name}_per_ms": ratio(F.col(c), F.col(duration)) for name, c in events.items()}
    return df.withColumns(new)


def median_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values get the median of the column, 0 where it has no value."""
    return with_quantiles(df, columns, [0.5]).withColumns({c: F.coalesce(F.col(c), F.col(f"q__{c}")[0], F.lit(0.0)) for c in columns}).drop(*[f"q__{c}" for c in columns])


def counter_values(df: DataFrame, counter: str, out: str = "value") -> DataFrame:
    """Adds one counter's values as numbers: NULL where it is missing, not finite, or the table lacks it."""
    given = _counter(df, counter).try_cast("double")
    return df.withColumn(out, F.when(~F.isnan(given) & (F.abs(given) != float("inf")), given))
