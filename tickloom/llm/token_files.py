"""Token-id files: Simple-8b words in blocks of whole documents."""

from __future__ import annotations

import bisect
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import claim, fresh_path, id_text, pieces_of, stretches, table
from .pieces import PieceCoder

#: One row of a file: a block of whole documents.  start_in_part: ids before it in its part; words: Simple-8b words, little-endian;
#: offsets: first word of each document, and the number of words; counts: ids of each document.
BLOCK_SCHEMA = "part int, block int, start_in_part long, n_ids long, doc_ids array<long>, counts array<long>, offsets array<long>, words binary"
#: A block is closed once it holds so many ids; a document is never split.
BLOCK_IDS = 1 << 18
#: Random keys that the ranges of ids are drawn from, for each part.
PART_SAMPLE = 40

_CODERS: dict[str, PieceCoder] = {}


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else the next from 256 on."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shows)]
    return {b: b for b in shows} | {b: 256 + i for i, b in enumerate(hidden)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coder(path: str) -> PieceCoder:
    """The tokenizer of ``path`` in this process, ids as little-endian 32-bit."""
    if path not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # a text with the string of an added token is encoded whole, as the library takes it
        added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

        model, shown = tokenizer.model, byte_letters()

        def token(piece: str) -> bytes:
            """One pre-token by the library's model, in the letters that stand for bytes."""
            if piece.isascii() and piece[1:].isalpha():
                piece = "\u0120" + piece[1:] if piece[0] == " " else piece
            else:
                piece = piece.encode().decode("latin-1").translate(shown)
            return array("I", [x.id for x in model.tokenize(piece)]).tobytes()

        def text(whole: str) -> bytes:
            return array("I", tokenizer.encode(whole, add_special_tokens=False).ids).tobytes()

        _CODERS[path] = PieceCoder(token, text, "token_files", whole=added)
    return _CODERS[path]


_CODED = "part int, doc_id long, h long, row long, n_ids long, words binary"


def _encode(path: str, end_id: int, bounds: list[tuple]):
    """Each text's ids as Simple-8b words where the text lies, and the part that its place in the order falls into."""

    def run(batches):
        claim("token_files")
        encode = coder(path).encode_column
        for batch in (part for whole in batches for part in stretches(whole, 3)):
            keys, hashes, rows = (batch.column(i).to_pylist() for i in range(3))
            ids, at = encode(batch.column(3))
            counts = np.diff(at) + 1
            words, offsets = simple8b.encode_streams(np.insert(ids, at[1:], end_id), np.concatenate(([0], np.cumsum(counts))))
            raw, cuts = words.astype("<u8", copy=False).tobytes(), (8 * offsets).tolist()
            parts = [bisect.bisect_right(bounds, _key(k, h, r)) for k, h, r in zip(keys, hashes, rows)]
            columns = [parts, keys, hashes, rows, counts.tolist(), [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "doc_id", "h", "row", "n_ids", "words"])

    return run


def _key(doc_id, h, row) -> tuple:
    """Order of documents: null ids first, rows of one id by hash of their text, equal rows by their place in the input."""
    return (doc_id is not None, doc_id or 0, h, row)


def _blocks(batches):
    """Blocks of whole documents from coded rows in order; a part's rows are in one partition."""
    block, done, held, doc_ids, counts, words = 0, 0, 0, [], [], []

    def flush(part):
        offsets = np.concatenate(([0], np.cumsum([len(w) // 8 for w in words])))
        columns = [[part], [block], [done], [held], [doc_ids], [counts], [offsets.tolist()], [b"".join(words)]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["part", "block", "start_in_part", "n_ids", "doc_ids", "counts", "offsets", "words"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    part = None
    for batch in (some for whole in batches for some in pieces_of(whole)):
        for part, key, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
            doc_ids.append(key)
            counts.append(n)
            words.append(packed)
            held += n
            if held >= BLOCK_IDS:
                yield flush(part)
                block, done, held, doc_ids, counts, words = block + 1, done + held, 0, [], [], []
    if doc_ids:
        yield flush(part)


def _bounds(keyed: DataFrame, parts: int) -> list[tuple]:
    """``parts`` - 1 keys that cut the order into near equal counts, from about PART_SAMPLE random rows a part."""
    share = min(1.0, PART_SAMPLE * parts / max(1, keyed.count()))
    sample = sorted(_key(r["doc_id"], r["h"], r["row"]) for r in keyed.select("doc_id", "h", "row").sample(share, seed=7).collect())
    return [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write blocks under ``out`` in ascending id order.

    Texts are encoded and packed where they lie; only packed words are shuffled, by
    range of id, and sorted within a range, so files in order of ``part`` and rows
    in order of ``block`` give all documents in order.  The ranges come from a
    bounded sample of keys, and rows of one id, equal ones too, may be dealt over
    several ranges.  Files go through Spark's writer (any store, committed once
    whatever tasks are run again).  A null text is empty, so only the end id is
    written; null ids come first; documents of one id follow each other in order of
    a hash of their text; an empty table gives no blocks.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    coded = keyed.mapInArrow(_encode(tokenizer or default_tokenizer(), end_id, _bounds(keyed, parts)), _CODED)
    dealt = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "h", "row").select("part", "doc_id", "n_ids", "words")
    dealt.mapInArrow(_blocks, BLOCK_SCHEMA).write.parquet(out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _digest(batches):
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        rows = {n: columns[n].to_pylist() for n in ("block_start", "doc_ids", "counts", "offsets", "words")}
        out: list[list] = [[], [], [], [], []]
        for begin, ids, counts, offsets, words in zip(*(rows[n] for n in ("block_start", "doc_ids", "counts", "offsets", "words"))):
            counts = np.array(counts, dtype=np.int64)
            values = simple8b.decode_streams(np.frombuffer(words, dtype="<u8"), np.array(offsets, dtype=np.int64), counts).astype("<u4")
            ends = np.cumsum(counts)
            raw = memoryview(values.tobytes())
            out[0] += ids
            out[1] += (begin + ends - counts).tolist()
            out[2] += counts.tolist()
            out[3] += [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
            out[4] += np.diff(np.array(offsets)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_words64"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: place among all ids, count, checksum, words used.

    A block knows its place in its part; a running sum over the parts' totals, a
    row per file, gives the rest.
    """
    from pyspark.sql import Window

    blocks = read_blocks(spark, path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per file: bounded by the number of partitions
    parts = totals.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_before"))
    placed = blocks.join(F.broadcast(parts), "part").withColumn("block_start", F.col("part_before") + F.col("start_in_part"))
    return placed.select("block_start", "doc_ids", "counts", "offsets", "words").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long, n_words64 long")


def op3_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)


QUERIES = {"op3_simple8b_token_files": op3_simple8b_token_files}
ORACLES: dict[str, str] = {}  # a tokenizer is not SQL; tests compare with the library and an exact round trip
