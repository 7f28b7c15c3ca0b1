"""A corpus from raw documents to token ids: toxicity, line dedup, near-dedup, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontam, line_dedup, near_dedup, toxicity
from tickloom.llm.common import table
from tickloom.operators.lineage import dropped, fresh_path, scope


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go; so does a document of which no word is left."""
    return line_dedup.drop_repeated_lines(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingle sets, that of the lowest id stays."""
    return near_dedup.keep_one_of_each(docs)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, its slots changed or not, go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of what is left."""
    # workers have held other stages' tables before: a smaller memo
    return bpe.round_trip(docs, memo=400_000)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_near_copy),
    ("decontamination", reject_leaks),
    ("bpe", encode),
]

#: Stages learn, tokenise and compare in ways SQL cannot; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again by the next.

    A stage's own intermediates, and the rows that it read, go once its rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
