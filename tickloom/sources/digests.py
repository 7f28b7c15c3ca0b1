"""SHA-256 of files of any size: a chain that is carried from task to task, a stretch of each file at a time."""

from __future__ import annotations

import ctypes
import ctypes.util
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this size are read whole by one task.
WHOLE_BYTES = 64 << 20
BOM = b"\xef\xbb\xbf"
#: Bytes that OpenSSL's SHA256_CTX takes; it is a plain struct that may be copied.
_STATE = 112


class Chain:
    """SHA-256 whose state between two updates is bytes, so that another task can go on with it; hashlib gives none out."""

    def __init__(self, state: bytes | None = None):
        self.lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        self.held = ctypes.create_string_buffer(state, _STATE) if state else ctypes.create_string_buffer(_STATE)
        if not state:
            self.lib.SHA256_Init(self.held)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.held, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self.held.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.held.raw, _STATE))
        return out.raw.hex()


def _runs(batches):
    """(file, start of the split, lines) for each run of rows of one split, in the order of the file."""
    for batch in batches:
        files, starts = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
        which = np.asarray(files.indices)
        cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(starts) != 0)) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if lo < hi:
                yield files.dictionary[which[lo]].as_py(), int(starts[lo]), batch.column(2).slice(lo, hi - lo)


def _measured(batches):
    """For each split the partition that reads it, and the bytes of its lines with their ends."""
    held: dict[tuple[str, int], int] = {}
    for file, start, lines in _runs(batches):
        held[file, start] = held.get((file, start), 0) + pc.sum(pc.binary_length(lines)).as_py() + len(lines)
    rows = [(TaskContext.get().partitionId(), f, s, n) for (f, s), n in held.items()]
    columns = list(zip(*rows)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.string(), pa.int64(), pa.int64()])], names=["partition", "file", "start", "n"])


def _carried(states: dict[tuple[str, int], tuple[bytes, bool]]):
    """The state after each of the splits in ``states``, given the one before it and whether a line was before."""

    def run(batches):
        chains: dict[tuple[str, int], Chain] = {}
        for file, start, lines in _runs(batches):
            if (file, start) not in states:
                continue
            if (file, start) not in chains:
                state, later = states[file, start]
                chains[file, start] = Chain(state)
            else:
                later = True
            chains[file, start].update(b"\n" * later + b"\n".join(lines.to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in chains], pa.string()), pa.array([c.state for c in chains.values()], pa.binary())], names=["file", "state"])

    return run


def _whole(spark: SparkSession, path: str, pattern: str, nested: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", nested).load(path)
    return files.select("path", "length", F.col("_metadata.file_path").alias("file"), "content")


def large_file_digests(spark: SparkSession, path: str, pattern: str, nested: bool, sizes: dict[str, int]) -> dict[str, str]:
    """Digest of each file of ``sizes`` (path to length), all of them longer than any other that is wanted.

    Spark's line reader cuts files into splits wherever they lie; no bytes are changed
    on the way, and lines are put together again with their ends.  One pass measures
    splits; then a job a turn carries the states of all files over one split of each,
    so no task reads more than a partition, and only states of 112 bytes pass the driver.
    A file whose lines do not make up its length (the reader unpacks compressed ones)
    is left out.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", nested).option("lineSep", "\n")
    lines = reader.text(path).where(F.col("_metadata.file_size") >= min(sizes.values()))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    splits: dict[str, list[tuple[int, int, int]]] = {f: [] for f in sizes}
    for r in lines.mapInArrow(_measured, "partition int, file string, start long, n long").collect():
        splits[r["file"]].append((r["start"], r["partition"], r["n"]))
    states, ends = {}, {}
    for file, size in sizes.items():
        splits[file].sort()
        missing = size - sum(n for *_, n in splits[file])  # -1: no line feed at the end; 3 more: a byte order mark, left out by the reader
        if missing in (-1, 0, 2, 3):
            chain = Chain()
            chain.update(BOM if missing > 0 else b"")
            states[file], ends[file] = chain.state, missing in (0, 3)
    for turn in range(max((len(splits[f]) for f in states), default=0)):
        now = {f: splits[f][turn] for f in states if turn < len(splits[f])}
        given = {(f, start): (states[f], turn > 0) for f, (start, _, _) in now.items()}
        carried = lines.mapInArrow(_carried(given), "file string, state binary").rdd
        for r in spark.sparkContext.runJob(carried, list, sorted({p for _, p, _ in now.values()})):
            states[r["file"]] = bytes(r["state"])
    out = {}
    for file, state in states.items():
        chain = Chain(state)
        chain.update(b"\n" * ends[file])
        out[file] = chain.hexdigest()
    return out


def file_digests(spark: SparkSession, path: str, pattern: str = "*", nested: bool = False) -> DataFrame:
    """SHA-256 of each file; ``nested``: of folders below too.

    Files over ``WHOLE_BYTES`` are digested a split at a time, but for compressed ones; others are read whole.
    An empty file gives no row, as Spark's readers pass it over.
    """
    most = min(WHOLE_BYTES, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    files = _whole(spark, path, pattern, nested)
    large = {r["file"]: r for r in files.where(F.col("length") > most).select("path", "length", "file").collect()}
    found = large_file_digests(spark, path, pattern, nested, {f: r["length"] for f, r in large.items()}) if large else {}
    digest = F.sha2("content", 256).alias("sha256")
    out = files.where(F.col("length") <= most).select("path", "length", digest)
    if found:
        rows = [(large[f]["path"], large[f]["length"], sha) for f, sha in found.items()]
        out = out.unionAll(spark.createDataFrame(rows, "path string, length long, sha256 string"))
    if len(found) < len(large):
        out = out.unionAll(files.where((F.col("length") > most) & ~F.col("file").isin(list(found))).select("path", "length", digest))
    return out
