"""Balanced contiguous shards from a global prefix sum of sizes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_text, table


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put rows in ``n_shards`` contiguous ranges of ``doc_id`` of near equal bytes.

    Only id, size and checksum are shuffled.  Rows are dealt by range of id; the
    range's number is kept with the row (and cut, so that it cannot change when a
    task runs again); totals of the ranges, a few rows, give each range its
    offset; a running sum within the range does the rest.  A row goes to the
    shard that holds the middle of its bytes, so each shard is off its target by
    less than half of the largest row at either end.  Shards are contiguous in id:
    rows of equal texts and other ids may lie in different shards, as this law has
    no groups.

    Nulls: a null text has size 1 and the checksum of no bytes; a null id sorts
    first.  Repeated ids are ordered by size and checksum; equal rows are
    interchangeable.  An empty table gives no rows.  Law ``bytes``, so
    ``grown_shard`` is null.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = id_text(docs, id_col, text_col).select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "size", "text_crc32"]
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("range_no", F.spark_partition_id()))
    totals = dealt.groupBy("range_no").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # one row for each shuffle partition: bounded by the setting, not by the data
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range_no",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.join(F.broadcast(offsets), "range_no")
        .withColumn("start", F.sum("size").over(within) - F.col("size") + F.col("bytes_before"))
        .withColumn("position", F.count("*").over(within) - 1 + F.col("rows_before"))
        .withColumn("shard", F.least(F.lit(n_shards - 1).cast("long"), F.expr(f"((2 * start + size) * {n_shards}) div (2 * total)")).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("shard_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("shard_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start",
    )


def op7_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op7_byte_prefix_shards": op7_byte_prefix_shards}
#: DuckDB has no crc32, so the checksum's table is made by its rule and folded over the bytes.
ORACLES = {
    "op7_byte_prefix_shards": """
WITH RECURSIVE t0(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
tb AS (SELECT list(c ORDER BY i) AS t FROM t0 WHERE k = 8),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, length(h) // 2 AS n, list_transform(range(0, length(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bs FROM h),
d AS (SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tb),
s AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) - size AS start, row_number() OVER w - 1 AS position, CAST(sum(size) OVER () AS BIGINT) AS total FROM d WINDOW w AS (ORDER BY doc_id, size, text_crc32)),
x AS (SELECT *, CAST(least(15, ((2 * start + size) * 16) // (2 * total)) AS INT) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, position - min(position) OVER (PARTITION BY shard) AS slot, CAST(NULL AS DOUBLE) AS grown_shard, start FROM x"""
}
