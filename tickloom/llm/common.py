"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, dropped, fresh_path, kept, settled, shared_dir  # noqa: F401  (taken from here by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, so that no other name can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


_MEMOS: dict[str, list[weakref.ref]] = {}


def owned(owner: str, memo) -> None:
    """Notes that ``memo`` (with a length and ``clear``) is the owner's, for :func:`claim`."""
    _MEMOS.setdefault(owner, []).append(weakref.ref(memo))


class Memo(dict):
    """Bounded memo of a pure function of the key; emptied when full, and when another owner claims the process."""

    def __init__(self, fn, limit: int, owner: str):
        super().__init__()
        self.fn, self.limit = fn, limit
        owned(owner, self)

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.fn(key)
        return value


class WordTable:
    """Values of distinct words, as arrays: ``learn(list of words)`` gives an array of values for each of its columns.

    Finding words is left to Arrow; only those that are new are Python strings.
    Holds ``limit`` words between calls; beyond it, the half met most often stays.
    """

    def __init__(self, learn, limit: int, owner: str):
        self.learn, self.limit = learn, limit
        self.clear()
        owned(owner, self)

    def clear(self) -> None:
        self.keys, self.met, self.columns = pa.array([], pa.string()), np.empty(0, np.int64), None

    def __len__(self) -> int:
        return len(self.keys)

    def values(self, words: pa.Array) -> list[np.ndarray]:
        """The values of each of ``words``."""
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys)
        new = coded.dictionary.filter(pc.is_null(at))
        place = np.array(pc.fill_null(at, -1), dtype=np.int64)
        place[place < 0] = len(self) + np.arange(len(new))
        if len(new) or self.columns is None:
            learned = self.learn(new.to_pylist())
            self.columns = learned if self.columns is None else [np.concatenate(x) for x in zip(self.columns, learned)]
            self.keys = pa.concat_arrays([self.keys, new])
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int64)))
        which = np.asarray(coded.indices)
        self.met[place] += np.bincount(which, minlength=len(place))
        out = [c[place][which] for c in self.columns]
        if len(self) > self.limit:
            stays = np.sort(np.argpartition(-self.met, self.limit // 2)[: self.limit // 2])
            self.keys, self.met, self.columns = self.keys.take(pa.array(stays)), self.met[stays] // 2, [c[stays] for c in self.columns]
        return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts one after another, and the bounds of each text; a null text has none."""
    cut_up = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, bounds = cut_up.flatten(), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(cut_up)), dtype=np.int64)))
    some = np.asarray(pc.binary_length(words)) > 0
    if some.all():
        return words, bounds
    return words.filter(pa.array(some)), np.concatenate(([0], np.cumsum(some)))[bounds]


_LIBC = ctypes.CDLL(None)
#: glibc's numbers for mallopt: from how many bytes on a block is mapped by itself, and how many arenas there are.
_MMAP_THRESHOLD, _ARENA_MAX = -3, -8


def return_blocks() -> None:
    """From now on blocks of 1 MB or more go back to the system as soon as they are free, where the C library can."""
    if hasattr(_LIBC, "mallopt"):  # glibc alone has it
        _LIBC.mallopt(_MMAP_THRESHOLD, 1 << 20)
        _LIBC.mallopt(_ARENA_MAX, 2)
    pa.set_memory_pool(pa.system_memory_pool())


def give_back(collect: bool = True) -> None:
    """Return freed memory to the system, where the C library can."""
    if collect:
        gc.collect()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim:
        trim(0)


def claim(owner: str) -> None:
    """Called where a task begins: worker processes are used again by other operators, whose memos are emptied; what is free is given back."""
    return_blocks()
    emptied = False
    for other, memos in _MEMOS.items():
        if other != owner:
            for ref in memos:
                memo = ref()
                if memo:
                    memo.clear()
                    emptied = True
        _MEMOS[other] = [ref for ref in memos if ref() is not None]
    give_back(emptied)


def pieces_of(batch, rows: int = 256):
    """A record batch in short stretches, so that few of its values are Python objects at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def stretches(batch, column: int, most: int = 1 << 21):
    """A record batch in runs of rows whose texts hold ``most`` bytes together, or one row if it is longer."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


#: Pairs up to which the least neighbours of all nodes are broadcast in a round; beyond it they are joined by a shuffle.
BROADCAST_PAIRS = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the least node of its component.

    Alternating large-star and small-star rounds: each is a grouped minimum
    (combined map-side) and an equi-join on the node, so neither a hub nor a long
    chain is gathered in one place.  Pairs are counted each round; up to
    ``broadcast_pairs`` the minima are broadcast, and the pairs stay where they lie.
    Every round is written to the shared folder and the one before it deleted.
    No row comes to the driver but a count and a checksum.
    """
    spark, path = edges.sparkSession, ""

    def written(pairs: DataFrame) -> DataFrame:
        nonlocal path
        last, path = path, fresh_path(spark, "pairs")
        pairs.write.parquet(path)
        if last:
            dropped(spark, last)
        return spark.read.schema(pairs.schema).parquet(path)

    def round_of(pairs: DataFrame, few: bool) -> DataFrame:
        """Large-star, then small-star, of pairs whose ``u`` is the greater."""
        near = F.broadcast if few else lambda least: least
        either = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.u", "p.v")
        least = either.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = pairs.join(near(least), "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        return large.join(near(least), "u").select(F.explode(both).alias("p")).select("p.u", "p.v").where("u <> v").distinct()

    def checksum(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = checksum(now)
    for _ in range(most_rounds if before[0] else 0):
        now = written(round_of(now, before[0] <= broadcast_pairs))
        after = checksum(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle; raise most_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
