"""Benchmark decontamination by template windows with slot consistency."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordTable, claim, id_text, kept, settled, stretches, table, words_of
from .shingles import windows

#: Words of a window, and the share of an item's windows that a document must have.
WINDOW, SHARE = 5, 0.75
#: Share of slot values that must go over to one value each.
CONSISTENT = 0.75
#: Benchmark windows up to which their hashes go to every task (8 bytes each); beyond it all windows are shuffled.
BROADCAST_WINDOWS = 4_000_000
#: Documents found up to which they are broadcast when they are dropped (16 bytes each); beyond it the join shuffles.
BROADCAST_FOUND = 1_000_000

#: Words after a number that are its unit (fixed values).
UNITS = set(
    "% ° mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "kb mb gb tb hz khz mhz ghz w kw kwh v a j kj cal kcal pa bar psi k c f mph kmh usd eur gbp dollar dollars cent cents euro euros pound pounds percent inch inches foot feet "
    "mile miles meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*([a-z%°]{0,3})$")
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\0number", b"\0name", b"\0unit"))
#: Tells windows of plain words from those of templates.
_PLAIN = np.uint64(xxhash.xxh3_64_intdigest(b"\0plain"))
#: Bits of a word's nature.
EMPTY, NUMBER, UNIT, CAPITAL = 1, 2, 4, 8


def _nature(words: list[str]) -> list[np.ndarray]:
    """Hash of each word's core without case, and the bits of its nature."""
    cores, natures = [], []
    for word in words:
        core, bits = word, 0
        if not core.isalpha():
            lo, hi = 0, len(word)
            while lo < hi and not word[lo].isalnum():
                lo += 1
            while hi > lo and not (word[hi - 1].isalnum() or word[hi - 1] in "%°"):
                hi -= 1
            core = word[lo:hi]
        low = core.lower()
        if not core:
            bits = EMPTY
        elif not core.isalpha() and _NUMBER.match(low):
            bits = NUMBER
        else:
            if low in UNITS:
                bits = UNIT
            if low != core and core[0].isupper() and len(core) > 1 and core[1:].islower():
                bits |= CAPITAL
        cores.append(low.encode() if core.isascii() else core.casefold().encode())
        natures.append(bits)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, cores), dtype=np.uint64, count=len(cores))
    return [hashes, np.array(natures, dtype=np.uint8)]


#: Distinct words that a worker process remembers.
_WORDS = WordTable(_nature, 400_000, "decontam")


def templates(texts: pa.Array):
    """For each text (template hashes, plain hashes, is a slot, is a literal) of the words that have a letter or digit.

    Numbers become one placeholder, units right after a number another, and
    capitalised words a third: those that open a sentence too, as it may be with a
    name ("Alice buys 3 apples. Alice then ..."); one that is no name has the same
    value on both sides.
    """
    words, bounds = words_of(texts)
    plain, bits = _WORDS.values(words)
    before = np.concatenate(([np.uint8(0)], bits[:-1])) if len(bits) else bits
    first = bounds[:-1][bounds[:-1] < len(bits)]
    before[first] = 0
    number = (bits & NUMBER) > 0
    unit = ((bits & UNIT) > 0) & ((before & NUMBER) > 0)
    name = ((bits & CAPITAL) > 0) & ~unit
    slot = number | unit | name
    out = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, plain)))
    keep = (bits & EMPTY) == 0
    at = np.concatenate(([0], np.cumsum(keep)))[bounds]
    out, plain, slot = out[keep], plain[keep], slot[keep]
    for lo, hi in zip(at[:-1], at[1:]):
        yield out[lo:hi], plain[lo:hi], slot[lo:hi], ~slot[lo:hi]


def _windows(template, size: int, short=(), plainly: bool = True):
    """For the width ``size`` (or the whole text, if shorter) and each width of ``short`` that the text has: (width, template window hashes, literal words in each, plain window hashes, slot flags, plain hashes)."""
    hashes, plain, slot, literal = template
    run = np.concatenate(([0], np.cumsum(literal)))
    for width in sorted({min(size, len(hashes)), *[w for w in short if w < len(hashes)]}):
        if width:
            yield width, windows(hashes, width), run[width:] - run[:-width], windows(plain, width) ^ _PLAIN if plainly else None, slot, plain


_SCHEMA = "doc_id long, version long, pos int, h long, slots array<long>, width int, plain boolean"


def _scan(size: int, known, short=(), plainly: bool = True):
    """Template windows with at least two literal words (all, if the window is shorter) and plain windows; ``known``: sorted hashes to keep, or None for all."""

    def run(batches):
        claim("decontam")
        wanted = None if known is None else known.value
        if wanted is not None:
            # a bitmap first: nearly every window falls out at one look-up
            bits = max(16, int(len(wanted) * 16 + 1).bit_length())
            shift = np.uint64(64 - bits)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[wanted >> shift] = True

        def kept(found, good):
            if wanted is None or not len(found):
                return np.flatnonzero(good)
            at = np.flatnonzero(good & seen[found >> shift])
            if len(at) and len(wanted):
                near = np.searchsorted(wanted, found[at])
                near[near == len(wanted)] = 0
                at = at[wanted[near] == found[at]]
            return at

        for batch in (part for whole in batches for part in stretches(whole, 2)):
            keys, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], [], [], []]

            def put(key, version, at, found, slots, width, is_plain):
                out[0].extend([key] * len(at))
                out[1].extend([version] * len(at))
                out[2].extend(at.tolist())
                out[3].extend(found[at].view(np.int64).tolist())
                out[4].extend(slots)
                out[5].extend([width] * len(at))
                out[6].extend([is_plain] * len(at))

            for key, version, template in zip(keys, versions, templates(batch.column(2))):
                for width, found, literal, whole, slot, plain in _windows(template, size, short, plainly):
                    at = kept(found, literal >= min(2, width))
                    if len(at):
                        signed = plain.view(np.int64)
                        put(key, version, at, found, [signed[i : i + width][slot[i : i + width]].tolist() for i in at.tolist()], width, False)
                    if whole is not None:
                        at = kept(whole, np.ones(len(whole), dtype=bool))
                        if len(at):
                            put(key, version, at, whole, [[]] * len(at), width, True)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "version", "pos", "h", "slots", "width", "plain"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE, consistent: float = CONSISTENT, broadcast_windows: int = BROADCAST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", inside: bool = False) -> DataFrame:
    """A row for each (document, benchmark item) where the item leaked.

    ``doc_id, version, item_id, n_windows, n_matched, containment, n_slots,
    slot_consistency, verbatim``.  Texts become templates (see ``templates``,
    case and outer punctuation do not count); an item leaked if the document has
    ``share`` of its distinct windows and its slot values go over consistently.
    Aligned slots (at one place of a window that both have) should follow a map that
    is one-to-one: ``slot_consistency`` is the share of aligned slots in which each
    value is the other's most frequent partner, taken over the whole document or
    over one offset that has ``share`` of the windows by itself (so two copies with
    their own values do not spoil each other); the better counts.  ``verbatim``: all
    slots have the item's own values.

    Benchmark windows are counted first.  Up to ``broadcast_windows`` their hashes
    go to the tasks as a sorted array, and only hits are shuffled; beyond, windows
    of the corpus are shuffled to a hash join.  A document that has ``share`` of an
    item's windows has one of any n - ceil(share n) + 1 of them: pairs are made by
    that many of the item's windows, those met in fewest documents, so a window
    that everything has makes no pairs.  Windows with fewer than two literal
    words say nothing and are left out.  Names are known by their case, so an item is
    also met, at the same ``share``, by windows of its words as they are but for case;
    such a pair has no slots and is ``verbatim``.  An item of fewer words than ``size``
    is one window; it is met in texts of as many words, with ``inside`` in longer ones
    too.  Items and documents without words (null,
    empty) are in no pair.  Rows that repeat an id and a text count once;
    rows of one id and other texts are told apart by ``version``; empty tables
    give no rows.
    """
    spark = docs.sparkSession

    def rows(df, key, text, **kw):
        plain = id_text(df, key, text).withColumn("version", F.xxhash64("text")).select("doc_id", "version", "text")
        return plain.mapInArrow(_scan(size, **kw), _SCHEMA)

    # an id may be null, so keys are told apart by a hash beside it
    def key(name: str):
        return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")), F.col(name).isNull())

    items = rows(benchmark, item_col, item_text_col, known=None).select(F.col("doc_id").alias("item_id"), F.col("version").alias("item_version"), F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots"), "width", "plain").distinct()
    items = kept(items.withColumn("item", F.xxhash64(key("item_id"), "item_version", "plain")), "items")
    seen = items.select("width", "plain").distinct().collect()
    short = sorted({r["width"] for r in seen if r["width"] < size}) if inside else []
    distinct = items.select("h").distinct()
    known = None
    if distinct.count() <= broadcast_windows:
        known = spark.sparkContext.broadcast(np.sort(np.asarray(distinct.toArrow().column("h"), dtype=np.int64).view(np.uint64)))
    # the corpus is read once: counts and slots need the hits, which are few
    hits = kept(rows(docs, id_col, text_col, known=known, short=short, plainly=any(r["plain"] for r in seen)).drop("width", "plain").distinct().withColumn("doc", F.xxhash64(key("doc_id"), "version")), "hits")
    met = hits.groupBy("h").agg(F.countDistinct("doc").alias("n_docs"))
    whole = Window.partitionBy("item")
    ranked = items.select("item", "h").distinct().join(met, "h", "left").withColumn("n_windows", F.count("*").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.coalesce("n_docs", F.lit(0)), "h")))
    probes = ranked.where(F.col("place") <= F.col("n_windows") - F.ceil(F.col("n_windows") * F.lit(share)) + 1).select("item", "h", "n_windows")
    pairs = hits.select("doc", "h").distinct().join(probes, "h").select("doc", "item", "n_windows").distinct()
    # (document, item) by all of the item's windows
    aligned = kept(pairs.join(items, "item").join(hits.select("doc", "doc_id", "version", "pos", "slots", "h"), ["doc", "h"]).withColumn("offset", F.col("pos") - F.col("item_pos")), "aligned")
    counted = aligned.groupBy("doc", "item").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("version").alias("version"), F.any_value("item_id").alias("item_id"), F.any_value("item_version").alias("item_version"), F.any_value("plain").alias("plain"), F.any_value("n_windows").alias("n_windows"), F.countDistinct("h").alias("n_matched"))
    enough = kept(counted.where(F.col("n_matched") >= F.col("n_windows") * F.lit(share)), "enough")
    mine = aligned.where("not plain").join(enough.select("doc", "item"), ["doc", "item"], "left_semi")
    alone = mine.groupBy("doc", "item", "offset").agg(F.countDistinct("h").alias("n"), F.any_value("n_windows").alias("n_windows")).where(F.col("n") >= F.col("n_windows") * F.lit(share)).select("doc", "item", "offset")
    values = mine.where("size(slots) > 0").select("doc", "item", "offset", F.explode(F.arrays_zip(F.col("item_slots").alias("ours"), F.col("slots").alias("theirs"))).alias("z")).groupBy("doc", "item", "offset", F.col("z.ours").alias("ours"), F.col("z.theirs").alias("theirs")).agg(F.count("*").alias("n"))
    # each way of looking at a pair: all offsets together, and an offset that has enough by itself
    views = values.groupBy("doc", "item", F.lit(None).cast("int").alias("offset"), "ours", "theirs").agg(F.sum("n").alias("n")).unionByName(values.join(alone, ["doc", "item", "offset"], "left_semi"))
    view = ["doc", "item", "offset"]
    best = views.withColumn("a", F.row_number().over(Window.partitionBy(*view, "ours").orderBy(F.col("n").desc(), "theirs"))).withColumn("b", F.row_number().over(Window.partitionBy(*view, "theirs").orderBy(F.col("n").desc(), "ours")))
    scored = best.groupBy(*view).agg(F.countDistinct("ours").alias("n_slots"), F.avg(((F.col("a") == 1) & (F.col("b") == 1)).cast("double")).alias("consistency"), F.min((F.col("ours") == F.col("theirs")).cast("int")).alias("same"))
    slots = scored.groupBy("doc", "item").agg(F.max(F.struct("consistency", "same", "n_slots")).alias("s"))
    out = enough.join(slots, ["doc", "item"], "left").select(
        "doc_id", "version", "item_id", "item_version", "plain", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("containment"),
        F.coalesce("s.n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("s.consistency", F.lit(1.0)).alias("slot_consistency"), (F.coalesce("s.same", F.lit(1)) == 1).alias("verbatim"),
    )
    # a pair that is met both ways counts once, as a template
    good = out.where(F.col("slot_consistency") >= consistent)
    pair = ["doc_id", "version", "item_id", "item_version"]
    once = good.groupBy(*pair).agg(F.min_by(F.struct(*[c for c in good.columns if c not in (*pair, "plain")]), F.col("plain")).alias("r"))
    return once.select("doc_id", "version", "item_id", "r.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns as they are.

    Rows of one id and other texts are told apart; null and empty texts stay.
    """
    found = settled(docs.sparkSession, lambda: leaks(docs, benchmark, inside=True).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct(), "found")
    clean = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__version"))
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_FOUND else found, clean, "left_anti")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), inside=True)
    return found.drop("version")


QUERIES = {"op1_template_decontamination": op1_template_decontamination}
ORACLES: dict[str, str] = {}  # word natures need Unicode case rules; tests compare with a brute-force version
