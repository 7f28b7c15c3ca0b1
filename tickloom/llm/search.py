"""Ranked lexical search: an index of compressed posting blocks, and Block-Max WAND over it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, cut, id_text, kept, stretches, table, words_of

#: Postings in a block; words of documents in a segment of the index, at least before it ends.
BLOCK, SEGMENT_WORDS = 128, 1 << 21
#: Results for each item; bytes of items' texts that are looked up in one pass over the index, about.
TOP, PASS_BYTES = 50, 8 << 20
#: Weight of a document's length in percent.
LENGTH_SHARE = 50

_INDEX = "segment long, term string, docs long, words long, df long, first binary, last binary, gap_bits binary, tf_bits binary, starts binary, data binary, impact_at binary, impact_tf binary, impact_len binary"


# bytes of terms are kept, A-Z lower-cased; all others are blanks
_BYTES = np.full(256, 0x20, dtype=np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _BYTES[_first : _last + 1] = np.arange(_first, _last + 1)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts one after another, and the bounds of each text: runs of digits, letters and all beyond ASCII; a null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    mapped = _BYTES[np.frombuffer(data, dtype=np.uint8)] if data is not None else np.empty(0, np.uint8)
    return words_of(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(mapped)], offset=texts.offset))


# -- blocks --------------------------------------------------------------------


def _bits(most: np.ndarray) -> np.ndarray:
    """Bits that hold each number (0 for 0)."""
    return np.where(most > 0, np.floor(np.log2(np.maximum(most, 1))).astype(np.int64) + 1, 0)


def _packed(values: np.ndarray, block: np.ndarray, place: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all blocks one after another, each value in its block's number of bits; and the bytes of each block."""
    length = (sizes * bits + 7) // 8
    starts = np.concatenate(([0], np.cumsum(length)))
    flat = np.zeros(starts[-1] * 8, dtype=np.uint8)
    width_of = bits[block]
    for w in np.unique(bits[bits > 0]):
        mine = np.flatnonzero(width_of == w)
        first = starts[block[mine]] * 8 + place[mine] * w
        for b in range(w):
            flat[first + b] = (values[mine] >> (w - 1 - b)) & 1
    return np.packbits(flat), length


def _unpacked(data: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """A row of BLOCK values for each block that begins at ``starts`` and has ``bits`` bits a value; what lies beyond a short block is not looked at."""
    if not bits:
        return np.zeros((len(starts), BLOCK), dtype=np.int64)
    width = BLOCK * bits // 8
    at = starts[:, None] + np.arange(width)
    raw = np.where(at < len(data), data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return np.unpackbits(raw, axis=1).reshape(len(starts), BLOCK, bits).astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Byte strings: ``data`` cut at ``starts`` (in bytes, one more than there are strings)."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _segment(number: int, terms: pa.Array, term: np.ndarray, slot: np.ndarray, doc_ids: np.ndarray, unnamed: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """Rows of one segment: one with its documents (term NULL), one for each term; term and slot of every word, documents in slot order."""
    n_docs, n_terms = len(lengths), len(terms)
    code, tf = np.unique(term * n_docs + slot, return_counts=True)
    t, d = code // n_docs, code % n_docs
    df = np.bincount(t, minlength=n_terms)
    first = np.concatenate(([0], np.cumsum(df)))  # of each term's postings
    blocks = (df + BLOCK - 1) // BLOCK
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    within = np.arange(len(t)) - first[t]
    block, place = first_block[t] + within // BLOCK, within % BLOCK
    sizes = np.bincount(block, minlength=first_block[-1])
    ends = np.cumsum(sizes)
    # gaps run on from the last document of the block before
    gap = np.where(within == 0, d, d - np.concatenate(([0], d[:-1])) - 1)
    gap_bits, tf_bits = _bits(np.maximum.reduceat(gap, ends - sizes)), _bits(np.maximum.reduceat(tf - 1, ends - sizes))
    gaps, gap_len = _packed(gap, block, place, gap_bits, sizes)
    tfs, tf_len = _packed(tf - 1, block, place, tf_bits, sizes)
    # a block's gaps and then its counts
    total = gap_len + tf_len
    starts = np.concatenate(([0], np.cumsum(total)))
    data = np.empty(starts[-1], dtype=np.uint8)
    for part, length, before in ((gaps, gap_len, 0), (tfs, tf_len, gap_len)):
        at = np.repeat(starts[:-1] + before, length) + np.arange(len(part)) - np.repeat(np.cumsum(length) - length, length)
        data[at] = part
    # impacts: the pairs (count, length) of a block that no other one beats in both
    order = np.lexsort((-tf, lengths[d], block))
    rising = block[order] * (1 << 32) + tf[order]
    best = np.maximum.accumulate(rising)
    keep = order[np.concatenate(([True], rising[1:] > best[:-1]))]
    impacts = np.bincount(block[keep], minlength=first_block[-1])
    impact_ends = np.cumsum(impacts)
    term_of = np.repeat(np.arange(n_terms), blocks)
    own = lambda ends, starts_of_term: ends - starts_of_term[term_of]  # noqa: E731  (counted from the term's first)
    bytes_at = starts[first_block]
    impacts_at = np.concatenate(([0], impact_ends))[first_block]

    def column(values: np.ndarray, kind, bounds: np.ndarray, documents: np.ndarray) -> pa.Array:
        """The documents' own value, then one for each term."""
        values = values.astype(kind)
        own_bytes = documents.view(np.uint8)
        return _binary(np.concatenate((own_bytes, values.view(np.uint8))), np.concatenate(([0], len(own_bytes) + bounds * values.itemsize)))

    none = np.empty(0, np.uint8)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n_terms + 1, number)), pa.concat_arrays([pa.array([None], pa.string()), terms.cast(pa.string())]), pa.array([n_docs] + [None] * n_terms, pa.int64()), pa.array([int(lengths.sum())] + [None] * n_terms, pa.int64()), pa.array(np.concatenate(([0], df))),
        column(d[ends - sizes], np.int32, first_block, none), column(d[ends - 1], np.int32, first_block, none), column(gap_bits, np.uint8, first_block, unnamed.astype(np.uint8)), column(tf_bits, np.uint8, first_block, none), column(own(starts[:-1], bytes_at), np.int32, first_block, none),
        column(data, np.uint8, bytes_at, doc_ids.astype(np.int64)), column(own(impact_ends, impacts_at), np.int32, first_block, none), column(tf[keep], np.int32, impacts_at, none), column(lengths[d[keep]], np.int32, impacts_at, lengths.astype(np.int32)),
    ], names=[c.split()[0] for c in _INDEX.split(", ")])


def _segments(segment_words: int):
    """For ``mapInArrow``: segments of (doc_id, text) rows; a segment's words are a few arrays of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("search")
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]] = []
        words = 0

        def flush():
            nonlocal held, words, made
            if words:
                number = (task << 31) + made
                made += 1
                coded = pa.chunked_array([h[0] for h in held]).unify_dictionaries()
                terms = coded.chunk(0).dictionary
                term = np.concatenate([np.asarray(c.indices) for c in coded.chunks]).astype(np.int64)
                lengths = np.concatenate([h[1] for h in held])
                ids = pa.concat_arrays([h[2] for h in held])
                some = lengths > 0
                unnamed, named = np.asarray(pc.is_null(ids)), np.asarray(pc.fill_null(ids, 0)).astype(np.int64)
                # slots go by id, those without one last, documents without terms have none
                order = np.lexsort((named, unnamed))
                order = order[some[order]]
                slot_of = np.full(len(lengths), -1)
                slot_of[order] = np.arange(len(order))
                yield _segment(number, terms, term, np.repeat(slot_of, lengths), named[order], unnamed[order], lengths[order])
            held, words = [], 0

        for batch in batches:
            for part in stretches(batch, 1):
                found, bounds = terms_of(part.column(1))
                held.append((found.dictionary_encode(), np.diff(bounds), part.column(0)))
                words += len(found)
                if words >= segment_words:
                    yield from flush()
        yield from flush()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """An index of all documents: a row for each segment (its documents, ``term`` NULL) and for each term of a segment.

    A segment holds the documents of one task until they have ``segment_words`` words,
    so a task holds one at a time and nothing is shuffled.  A term's postings lie in
    blocks of BLOCK: gaps of document slots and counts, in as many bits as the block
    needs.  Beside them, readable without decompression, stand each block's first and
    last slot and its impacts, those pairs of count and document length that no other pair of
    the block beats in both; they give the block's greatest score under any statistics
    of the corpus, so segments can be added.  Documents without a term are left out.
    """
    return kept(id_text(docs, id_col, text_col).mapInArrow(_segments(segment_words), _INDEX), "index")


# -- search --------------------------------------------------------------------


class Postings:
    """A term's postings in one segment; blocks are decompressed when first needed."""

    def __init__(self, row: dict):
        number = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.df = row["df"]
        self.first, self.last = number("first", np.int32).astype(np.int64), number("last", np.int32).astype(np.int64)
        self.gap_bits, self.tf_bits = number("gap_bits", np.uint8).astype(np.int64), number("tf_bits", np.uint8).astype(np.int64)
        self.starts, self.data = number("starts", np.int32).astype(np.int64), number("data", np.uint8)
        self.impact_at, self.impact_tf, self.impact_len = number("impact_at", np.int32), number("impact_tf", np.int32).astype(np.int64), number("impact_len", np.int32).astype(np.int64)
        self.sizes = np.full(len(self.last), BLOCK)
        self.sizes[-1] = self.df - BLOCK * (len(self.last) - 1)
        self.slots = np.empty((len(self.last), BLOCK), dtype=np.int32)
        self.tfs = np.empty((len(self.last), BLOCK), dtype=np.int32)
        self.open = np.zeros(len(self.last), dtype=bool)

    def greatest(self, weight: int, length_cost: np.ndarray) -> np.ndarray:
        """Each block's greatest score, from its impacts alone."""
        score = weight * ((1_000_000_000 * self.impact_tf) // (1000 * self.impact_tf + 20 * length_cost))
        return np.maximum.reduceat(score, np.concatenate(([0], self.impact_at[:-1])))

    def decompress(self, blocks: np.ndarray) -> None:
        wanted = blocks[~self.open[blocks]]
        if not len(wanted):
            return
        before = np.where(wanted > 0, self.last[wanted - 1], -1)
        counts_at = self.starts[wanted] + (self.sizes[wanted] * self.gap_bits[wanted] + 7) // 8
        for bits, at, into in ((self.gap_bits, self.starts[wanted], self.slots), (self.tf_bits, counts_at, self.tfs)):
            for w in np.unique(bits[wanted]):
                mine = bits[wanted] == w
                into[wanted[mine]] = _unpacked(self.data, at[mine], int(w))
        self.slots[wanted] = before[:, None] + np.cumsum(self.slots[wanted] + 1, axis=1)
        self.tfs[wanted] += 1
        self.open[wanted] = True


def length_cost(lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """A document's m: what its length costs, against the mean."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // n_words


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_slots(lists: list[Postings], weights: list[int], tops: list[np.ndarray], cost: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and scores of the ``top`` best documents of a segment, highest first, of equals the lowest slot.

    Block-Max WAND: between two ends of blocks each list stands in one block or in none,
    so the sum of those blocks' greatest scores bounds every document there.  The shallow
    pointers of all lists are moved over all such stretches at once; stretches are
    taken from the highest bound down, in steps that double, until the next bound is
    below the score of the ``top``-th document.  Only blocks of stretches that are
    taken are decompressed.
    """
    ends = np.unique(np.concatenate([x for p in lists for x in (p.first - 1, p.last)]))
    starts = np.concatenate(([-1], ends[:-1])) + 1
    # shallow pointers: the block of each list in which a stretch lies, -1 where it lies in none
    at = []
    bound = np.zeros(len(ends), dtype=np.int64)
    for p, t in zip(lists, tops):
        b = np.searchsorted(p.last, starts)
        b[b == len(p.last)] = -1
        b[p.first[b] > ends] = -1
        at.append(b)
        bound[b >= 0] += t[b[b >= 0]]
    order = np.argsort(-bound, kind="stable")
    found_slots, found_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    threshold, lo, step = 1, 0, 16
    while lo < len(order) and bound[order[lo]] >= threshold:
        some = order[lo : lo + step]
        some = np.sort(some[bound[some] >= threshold])
        lo, step = lo + step, step * 2
        # documents of these stretches, numbered one after another
        spans = ends[some] - starts[some] + 1
        base = np.concatenate(([0], np.cumsum(spans)))
        scores = np.zeros(base[-1], dtype=np.int64)
        for p, b, w in zip(lists, at, weights):
            mine = b[some]
            blocks = np.unique(mine[mine >= 0])
            if not len(blocks):
                continue
            p.decompress(blocks)
            slots, tfs = p.slots[blocks].ravel(), p.tfs[blocks].ravel()
            whole = (np.arange(BLOCK) < p.sizes[blocks][:, None]).ravel()
            which = np.searchsorted(ends[some], slots)
            which[which == len(some)] = 0
            good = whole & (slots >= starts[some][which]) & (slots <= ends[some][which])
            slots, tfs, which = slots[good].astype(np.int64), tfs[good].astype(np.int64), which[good]
            # a list has a slot once
            scores[base[which] + slots - starts[some][which]] += w * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * cost[slots]))
        hit = np.flatnonzero(scores >= threshold)
        which = np.searchsorted(base, hit, side="right") - 1
        found_slots = np.concatenate((found_slots, starts[some][which] + hit - base[which]))
        found_scores = np.concatenate((found_scores, scores[hit]))
        best = np.lexsort((found_slots, -found_scores))[:top]
        found_slots, found_scores = found_slots[best], found_scores[best]
        if len(best) == top:
            threshold = max(threshold, int(found_scores[-1]))
    return found_slots, found_scores


def _searcher(items: list[tuple[int, list[str]]], dfs: dict[str, int], n_docs: int, n_words: int, top: int):
    """For ``applyInArrow`` by segment: (place of the item, doc_id, score) of each item's best documents of the segment."""
    weights = {t: weight(df, n_docs) for t, df in dfs.items()}

    def run(rows: pa.Table) -> pa.Table:
        claim("search")
        out = [[], [], []]
        lists, documents = {}, None
        for row in rows.to_pylist():
            if row["term"] is None:
                documents = row
            else:
                lists[row["term"]] = Postings(row)
        lengths = np.frombuffer(documents["impact_len"], dtype=np.int32).astype(np.int64)
        ids, unnamed = np.frombuffer(documents["data"], dtype=np.int64), np.frombuffer(documents["gap_bits"], dtype=np.uint8) > 0
        cost = length_cost(lengths, n_docs, n_words)
        tops = {t: p.greatest(weights[t], length_cost(p.impact_len, n_docs, n_words)) for t, p in lists.items()}
        for place, terms in items:
            mine = [t for t in terms if t in lists and weights[t] > 0]
            if mine:
                slots, scores = best_slots([lists[t] for t in mine], [weights[t] for t in mine], [tops[t] for t in mine], cost, top)
                out[0].append(np.full(len(slots), place))
                out[1].append(pa.array(ids[slots], mask=unnamed[slots]))
                out[2].append(scores)
        return pa.table({
            "place": pa.array(np.concatenate(out[0]) if out[0] else [], pa.int64()), "doc_id": pa.chunked_array(out[1], pa.int64()), "score": pa.array(np.concatenate(out[2]) if out[2] else [], pa.int64()),
        })

    return run


def search(index: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents of an index (see ``build_index``).

    A document's score sums, over the item's distinct terms, the term's weight times
    what its count and the document's length make of it (see ``weight``,
    ``length_cost``, ``best_slots``), in whole numbers; documents of score 0 are left
    out, equal scores go by ascending ``doc_id``, a null one last.  Items are the query
    set, taken in passes of about ``pass_bytes`` of distinct texts: a pass's terms go to
    the tasks, each of which searches one segment, and the tasks' best meet in a ranking
    that keeps ``top`` a task before the shuffle.  Only rows of terms that are asked for are read
    and shuffled.  Repeated items each give their ranks; items without terms (null,
    empty), an empty index and no items give no rows.
    """
    spark = items.sparkSession
    out = "item_id long, rank int, doc_id long, score long"
    totals = index.where("term is null").agg(F.sum("docs"), F.sum("words")).first()
    asked = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).where("text is not null")
    size = asked.select("text").distinct().agg(F.sum(F.octet_length("text"))).first()[0]
    if not totals[0] or not size:
        return spark.createDataFrame([], out)
    blocks = -(-size // pass_bytes)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    ranked = None
    for b in range(blocks):
        texts = asked.where(F.col("block") == b).select("text").distinct().toArrow().column("text").combine_chunks()
        words, bounds = terms_of(texts)
        words = words.to_pylist()
        terms = [sorted(set(words[lo:hi])) for lo, hi in zip(bounds[:-1], bounds[1:])]
        distinct = sorted({t for ts in terms for t in ts})
        if not distinct:
            continue
        names = spark.createDataFrame([(t,) for t in distinct], "term string")  # of a pass, so within its bytes
        # postings of the terms that are asked for, and the documents' rows of all segments
        met = index.join(F.broadcast(names), "term", "left_semi")
        dfs = {r["term"]: r["df"] for r in met.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        run = _searcher(list(enumerate(terms)), dfs, int(totals[0]), int(totals[1]), top)
        found = met.unionByName(index.where("term is null")).groupBy("segment").applyInArrow(run, "place long, doc_id long, score long")
        order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        numbers = spark.createDataFrame(list(enumerate(texts.to_pylist())), "place long, text string")
        one = asked.join(F.broadcast(numbers), "text").select("item_id", "place").join(best, "place").select("item_id", "rank", "doc_id", "score")
        one = cut(one) if blocks > 1 else one
        ranked = one if ranked is None else ranked.unionAll(one)
    return spark.createDataFrame([], out) if ranked is None else ranked


def op13_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of the whole table for each benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT row_id, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM n),
q AS (SELECT DISTINCT item_row, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item_row, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
s AS (SELECT q.item_row, q.item_id, n.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * n.n * n_docs) // n_words)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (row_id), total GROUP BY q.item_row, q.item_id, n.row_id, n.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""

QUERIES = {"op13_block_max_wand": op13_block_max_wand}
ORACLES = {"op13_block_max_wand": _ORACLE}
