"""Cutting lineage, and other work in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a table is broadcast.
SMALL_BYTES = 64 << 20

#: By application and base: the session's folder, then those of the scopes that are open.
_FOLDERS: dict[tuple[str, str], list[str]] = {}
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one of a local session, and an error on a cluster."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and sc.applicationId not in _LOCAL:
        given = sc.getCheckpointDir()
        if given is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _LOCAL[sc.applicationId] = given or tempfile.mkdtemp(prefix="tickloom-")
    return (base or _LOCAL[sc.applicationId]).rstrip("/")


def _files(spark: SparkSession, folder: str):
    """A folder's path and file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _scopes(spark: SparkSession) -> list[str]:
    base = shared_dir(spark)
    key = (spark.sparkContext.applicationId, base)
    if key not in _FOLDERS:
        folder = f"{base}/tickloom-{uuid.uuid4().hex}"
        path, files = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[key] = [folder]
    return _FOLDERS[key]


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new name in the innermost open scope, or in the session's folder under the shared one; that is deleted when the session's JVM ends."""
    return f"{_scopes(spark)[-1]}/{what}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession):
    """Intermediates made inside are deleted at the end: checkpoints and written tables alike.

    What is wanted later must have been written elsewhere, or collected, by then.
    """
    folders = _scopes(spark)
    folders.append(fresh_path(spark, "scope"))
    try:
        yield
    finally:
        dropped(spark, folders.pop())


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that :func:`fresh_path` named, once nothing reads it any more."""
    path, files = _files(spark, folder)
    files.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder: later reads do not compute it again, and a lost executor costs nothing."""
    folder = _scopes(df.sparkSession)[-1]
    sc = df.sparkSession.sparkContext
    # Spark's cleaner looks for a checkpoint that is no longer used in the folder of the time, so that stays as it is
    if f"/{folder.rsplit('/', 1)[1]}/cuts/" not in (sc.getCheckpointDir() or ""):
        sc.setCheckpointDir(f"{folder}/cuts")
    return df.checkpoint(eager=True)


def kept(df: DataFrame, what: str) -> DataFrame:
    """The same as a written table: columns of few values take little room there, unlike in a checkpoint."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make, what: str) -> DataFrame:
    """The table that ``make()`` plans, written; the intermediates that it made on the way go."""
    path = fresh_path(spark, what)
    with scope(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """Marked for broadcast if the optimizer's estimate of its size is within the bound; else as it is, and the join may shuffle."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most_bytes else df
