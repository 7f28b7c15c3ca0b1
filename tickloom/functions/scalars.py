"""Column functions.  Missing is NULL throughout; NaN and infinities become NULL on the way in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_float(text: Column) -> Column:
    """A number out of text: commas dropped; blank, ``<not counted>``, ``<not supported>`` and bad text are NULL."""
    return finite(F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double"))


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


def normal_event(name: Column) -> Column:
    """Event name in lower case, without :u and :k modifiers, runs of blanks as one."""
    plain = F.lower(F.trim(name))
    plain = F.replace(F.replace(plain, F.lit(":u"), F.lit("")), F.lit(":k"), F.lit(""))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def clean_event(name: Column) -> Column:
    """Without a trailing annotation in brackets."""
    return F.regexp_replace(F.trim(name), r"\s+\[[^\[]*\]$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def split_list(text: Column, by: str = ",") -> Column:
    """Trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text, by), lambda x: F.trim(x)), lambda x: x != "")


def keyed_pairs(text: Column) -> Column:
    """``k:v;k:v`` as a map; items without a key, value or colon are left out, a later key wins."""
    items = F.transform(F.split(text, ";"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.when(F.instr(x, ":") > 0, F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))).alias("value")))
    good = F.filter(items, lambda p: (p["key"] != "") & p["value"].isNotNull() & (p["value"] != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """NULL if either is missing or the denominator is zero."""
    return F.try_divide(top, bottom) * F.lit(scale)


def signed_log1p(x: Column) -> Column:
    return F.when(x >= 0, F.log1p(x)).otherwise(x)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of what is there; NULL if nothing is."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, count)


def state_of(x: Column, low: Column, high: Column) -> Column:
    """0 below ``low``, 2 from ``high`` on, 1 between; -1 where anything is missing."""
    return F.when(x.isNull() | low.isNull() | high.isNull(), -1).when(x < low, 0).when(x < high, 1).otherwise(2).cast("int")


def bucket_number(x: Column, edges: Sequence[int]) -> Column:
    """Number of the first bucket whose edge is not below x; one more beyond the last."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[i], i).otherwise(out)
    return out.cast("int")


def bucket_edge(x: Column, edges: Sequence[int]) -> Column:
    """The first edge that is not below x; the last edge beyond it."""
    ordered = sorted(set(edges))
    out = F.lit(ordered[-1] if ordered else 15)
    for edge in reversed(ordered):
        out = F.when(x <= edge, edge).otherwise(out)
    return out.cast("int")


def one_hot(state: Column, classes: int = 3) -> Column:
    """All zeros for a state outside the classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == state).cast("int"))


def clamp_state(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(2))


def rounded(x: Column, digits: int = 6) -> Column:
    """For results that are compared: sums of doubles depend on the order of rows in the last places."""
    return F.round(x, digits)


def range_list(text: Column) -> Column:
    """``0-3,8`` as an array of integers."""
    spans = F.transform(split_list(text), lambda s: F.sequence(F.split_part(s, F.lit("-"), F.lit(1)).cast("int"), F.when(F.instr(s, "-") > 0, F.split_part(s, F.lit("-"), F.lit(2))).otherwise(s).cast("int")))
    return F.flatten(spans)


def thread_process_group(threads: Column, processes: Column) -> Column:
    """"threads=..|processes=..", with unknown for what is blank."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("threads="), known(threads), F.lit("|processes="), known(processes))


def hashed_digits(*keys: Column | int | str) -> Column:
    """The 13 hexadecimal digits that ``hashed_uniform`` is made of; in order of text they are in order of number."""
    texts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13)


def hashed_uniform(*keys: Column | int | str) -> Column:
    """A number from 0 to below 1 out of the keys alone: 52 bits of the MD5 of their texts joined by colons.

    Stateless, so any task draws the same again, and other engines can.
    """
    return F.conv(hashed_digits(*keys), 16, 10).cast("long") / float(1 << 52)
