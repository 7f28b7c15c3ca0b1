"""Near-duplicate documents: fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, connected_components, cut, id_text, kept, settled, stretches, table
from .shingles import mix, shingle_sets

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def fast_sketch(items: np.ndarray, t: int = 128) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit items: ``t`` coordinates, all filled.

    Round i < t hashes each item to a bin and a value; a bin keeps the least
    (round, value).  Rounds t to 2t - 1 send every item to bin i - t, so nothing
    stays empty.  Rounds end once all bins are full, about t log t hashes in all.
    Two sets agree in a coordinate with probability their Jaccard similarity, with
    concentration as if the coordinates were independent.  ``t`` is a power of two,
    512 at most: a round's number has nine bits.
    """
    if t > 512 or t & (t - 1):
        raise ValueError("t must be a power of two, 512 at most")
    n = len(items)
    bits = t.bit_length() - 1
    out = np.zeros(t, dtype=np.uint64)
    full = np.zeros(t, dtype=bool)
    low = np.uint64(64 - bits)
    i = 0
    while i < 2 * t:
        # as many rounds at once as are likely to be needed
        rounds = min(max(1, -(-int(t * (np.log(t) + 2)) // n)), (t if i < t else 2 * t) - i)
        number = np.arange(i, i + rounds, dtype=np.uint64)
        h = mix(items[None, :] + (number[:, None] + np.uint64(1)) * _GOLD)
        bins = (h >> low) if i < t else np.broadcast_to((number - np.uint64(t))[:, None], h.shape)
        # bin, round within this batch, value: the order of one sort decides
        key = ((bins << low) | ((number - np.uint64(i))[:, None] << (low - np.uint64(9))) | ((h << np.uint64(bits)) >> np.uint64(bits + 9))).ravel()
        key.sort()
        which = (key >> low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        spots = which[first]
        new = ~full[spots]
        spots, won = spots[new], key[first[new]]
        within = (won >> (low - np.uint64(9))) & np.uint64(511)
        out[spots] = mix(won & np.uint64((1 << int(low - np.uint64(9))) - 1)) + (within + np.uint64(i)) * _GOLD
        full[spots] = True
        if full.all():
            break
        i += rounds
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; the band's number goes into it."""
    parts = sketch.reshape(-1, rows)
    keys = np.arange(1, len(parts) + 1, dtype=np.uint64) * _GOLD
    for k in range(rows):
        keys = mix(keys ^ (parts[:, k] + np.uint64(k)))
    return keys


def _signatures(size: int, t: int, rows: int):
    def run(batches):
        claim("shingles")
        for batch in batches:
            for part in stretches(batch, 2):
                counts, sets, bands = [], [], []
                for items in shingle_sets(part.column(2), size):
                    counts.append(len(items))
                    sets.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    bands.append(band_keys(fast_sketch(items, t), rows).view(np.int64) if len(items) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "version", "n_shingles", "set_id", "bands"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify_pairs(size: int, percent: int):
    """Rows come sorted by group with the group's centre first; gives the links found."""

    def run(batches):
        claim("shingles")
        group, centre = None, None
        for batch in (part for whole in batches for part in stretches(whole, 4)):
            left, right = [], []
            for hub, part, is_hub, member, items in zip(*(batch.column(i).to_pylist() for i in range(4)), shingle_sets(batch.column(4), size)):
                if is_hub:
                    if group != (hub, part):
                        group, centre = (hub, part), items
                elif group == (hub, part) and _linked(centre, items, percent):
                    left.append(hub)
                    right.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return run


#: Members that one task compares with a copy of their hub.
HUB_SHARE = 64
#: Classes of a block, and shingles of all of them, in the comparison of what stars leave open.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def _verify_blocks(percent: int):
    """One task's blocks: open members against members of other components, as a product of incidence matrices."""

    def run(key, frame):
        import pandas as pd

        left, right = frame[frame.side == 0], frame[frame.side == 1]
        sets_l = [np.frombuffer(x, dtype=np.uint64) for x in left["items"]]
        sets_r = [np.frombuffer(x, dtype=np.uint64) for x in right["items"]]
        if not sets_l or not sets_r:
            return pd.DataFrame({"a": [], "b": []})
        flat_l, flat_r = np.concatenate(sets_l), np.concatenate(sets_r)
        shared = np.intersect1d(flat_l, flat_r)
        size_l, size_r = np.array([len(x) for x in sets_l]), np.array([len(x) for x in sets_r])
        both = np.zeros((len(sets_l), len(sets_r)), dtype=np.float32)
        row_l, row_r = np.repeat(np.arange(len(sets_l)), size_l), np.repeat(np.arange(len(sets_r)), size_r)
        for lo in range(0, len(shared), 2048):  # bounded memory however many shingles there are
            part = shared[lo : lo + 2048]
            mats = []
            for flat, row, n in ((flat_l, row_l, len(sets_l)), (flat_r, row_r, len(sets_r))):
                at = np.searchsorted(part, flat)
                at[at == len(part)] = 0
                hit = part[at] == flat
                m = np.zeros((n, len(part)), dtype=np.float32)
                m[row[hit], at[hit]] = 1
                mats.append(m)
            both += mats[0] @ mats[1].T
        union = size_l[:, None] + size_r[None, :] - both
        other = left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
        i, j = np.nonzero((100 * both >= percent * union) & other)
        return pd.DataFrame({"a": left["set_id"].to_numpy()[i], "b": right["set_id"].to_numpy()[j]})

    return run


def _stars(members: DataFrame, texts: DataFrame, size: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Links of pairs (hub, member): the hub's text meets its members' in shares of HUB_SHARE."""
    degree = members.groupBy("hub").agg(F.count("*").alias("n"))
    shares = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) / HUB_SHARE)).cast("int")
    # only hubs of more than one share matter to the members: few, so a crowd is not dealt out by its hub
    heavy = kept(degree.where(F.col("n") > HUB_SHARE), "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= broadcast_rows else heavy
    dealt = members.join(heavy, "hub", "left").select("hub", F.pmod(F.xxhash64("member"), shares).cast("int").alias("part"), F.lit(False).alias("is_hub"), "member")
    hubs = degree.select("hub", F.explode(F.sequence(F.lit(0), shares - 1)).alias("part"), F.lit(True).alias("is_hub"), F.col("hub").alias("member"))
    rows = dealt.unionByName(hubs).join(texts, F.col("member") == F.col("set_id")).select("hub", "part", "is_hub", "member", "text")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "hub", "part").sortWithinPartitions("hub", "part", F.col("is_hub").desc()).mapInArrow(_verify_pairs(size, percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, t: int = 128, rows: int = 4, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, version, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents of equal sets are one class; only classes are compared.  Classes
    that agree in all coordinates of a band share a bucket: at similarity s a pair
    is missed with probability about (1 - s**rows)**(t / rows), 5e-6 at 0.75 with
    the defaults.  Links are confirmed on whole sets, in two steps that together
    test every pair of a bucket that could join two components:

    1. Each bucket elects as hub the member whose buckets hold most members over
       all (the least mutated one of a group of variants), and members are tested
       with their hub, a share of them per task.  That connects nearly everything.
    2. Where a bucket still spans several components, members outside its largest
       component are tested with all of the bucket, in blocks; pairs within one
       component are not looked at, since they cannot change the result.

    No list of a bucket's pairs is ever made, no bucket is capped.  Null or empty
    texts have no set and are alone; a null id stays alone unless its class has
    another one; rows of one id and other texts are separate (``version`` is a hash
    of the text); an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    signed = cut(texts.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(_signatures(size, t, rows), "doc_id long, version long, n_shingles long, set_id binary, bands array<long>"))
    classes = signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("weight"), F.first("bands").alias("bands"))
    banded = classes.select("set_id", "weight", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = kept(banded.join(crowded, "bucket"), "shared")  # only members of buckets with company: few of all
    score = shared.groupBy("set_id").agg(F.sum("n").alias("score"))
    ranked = shared.join(score, "set_id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("score", "set_id")).alias("top")).select("bucket", F.col("top.set_id").alias("hub"))
    pairs = kept(shared.join(hubs, "bucket").where("hub <> set_id").select("hub", F.col("set_id").alias("member")).distinct(), "stars")

    # texts of members only, one for each class
    needed = kept(shared.select("set_id").distinct().join(classes.select("set_id", "rep"), "set_id"), "needed")
    few = needed.count() <= broadcast_rows
    wanted = needed.select(F.col("rep").alias("doc_id"), "set_id")
    wanted = F.broadcast(wanted) if few else wanted
    # rows of the id with another text are told apart by their set when read
    kept_texts = kept(_by_set(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select("set_id", "text"), size), "texts")

    links = kept(_stars(pairs, kept_texts, size, percent, broadcast_rows), "links")
    roots = connected_components(links)
    state = shared.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("bucket", "set_id", "weight", F.coalesce("root", "set_id").alias("root"))
    by_root = state.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("weight").alias("w"))
    spread = by_root.groupBy("bucket").agg(F.count("*").alias("n_roots"), F.sum("m").alias("n"), F.sum("w").alias("weight_all"), F.max(F.struct("m", "root")).alias("top"))
    # a bucket of two was settled by its star; so was one whose other members are each alone with the hub
    unsettled = kept(spread.where("n_roots > 1 and n > 2").select("bucket", "n", "weight_all", F.col("top.root").alias("main")), "unsettled")
    if unsettled.isEmpty():
        final = roots
    else:
        rest = state.join(unsettled, "bucket")
        final = connected_components(links.unionByName(_blocks(rest, kept_texts, size, percent)))
    rooted = classes.select("set_id", "rep").join(final.withColumnRenamed("node", "set_id"), "set_id")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    linked = rooted.join(least, "root").select("set_id", "component")
    whole = classes.select("set_id", "rep").join(linked, "set_id", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    return (
        signed.join(whole, "set_id", "left")
        .select("doc_id", "version", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _by_set(rows: DataFrame, size: int) -> DataFrame:
    """One text for each class: rows whose text is not of the class (an id met twice) are left out."""

    def run(batches):
        claim("shingles")
        for batch in (part for whole in batches for part in stretches(whole, 1)):
            good = [xxhash.xxh3_128_digest(x.tobytes()) == s for s, x in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "set_id binary, text string").dropDuplicates(["set_id"])


def _blocks(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members outside a bucket's main component and the rest of the bucket."""
    # blocks follow from a hash, so nothing is numbered within a bucket
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight_all") / BLOCK_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("set_id"), count).cast("int")
    rows = rest.withColumn("count", count).withColumn("block", block)
    left = rows.where("root <> main").select("bucket", "set_id", "root", F.lit(0).alias("side"), F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("y"))
    lefts = left.select("bucket", "x").distinct()
    right = rows.select("bucket", "set_id", "root", F.lit(1).alias("side"), F.col("block").alias("y")).join(lefts, "bucket").select("bucket", "set_id", "root", "side", "x", "y")

    def items(batches):
        claim("shingles")
        for batch in (part for whole in batches for part in stretches(whole, 1)):
            packed = [x.tobytes() for x in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["set_id", "items"])

    sets = texts.join(rows.select("set_id").distinct(), "set_id").select("set_id", "text").mapInArrow(items, "set_id binary, items binary")
    both = left.unionByName(right).join(sets, "set_id")
    return both.groupBy("bucket", "x", "y").applyInPandas(_verify_blocks(percent), "a binary, b binary")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose component has one of a lower id; all columns as they are.

    Rows that repeat an id and a text go or stay together; texts without words stay.
    """
    gone = settled(docs.sparkSession, lambda: near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct(), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__version"))
    return docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, same, "left_anti")


def op6_fast_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("version")


QUERIES = {"op6_fast_sketch_near_dedup": op6_fast_sketch_near_dedup}
ORACLES = {
    "op6_fast_sketch_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(k.c, d.doc_id), d.doc_id) AS component_id, least(coalesce(k.c, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
}
