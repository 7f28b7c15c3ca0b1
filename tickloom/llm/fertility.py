"""Quality rules from tokeniser fertility, with rejection bands for each language."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from .common import WordTable, claim, cut, stretches, table, words_of
from .pieces import gather
from .shingles import windows

SYMBOLS = b"#*$%&|<>"
#: Continuation bytes of UTF-8 and white space, which are not counted as characters of words.
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"
#: Half-width of a band in robust standard deviations (interquartile range / 1.349).
WIDTH = 5.0
#: Documents that a language (or a size class of it) needs for bands of its own.
LEAST_DOCUMENTS = 50
#: Distinct words that a worker process remembers.
WORDS_KEPT = 400_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Vocabularies:
    """A piece vocabulary with byte fallback, and a byte-level one for many languages; words are encoded one by one."""

    def __init__(self, piece_path: str, byte_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        byte_level = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        self.encode, self.count_other = pieces.encode, lambda word: len(byte_level.encode_ordinary(" " + word))
        self.words = WordTable(self._learn, WORDS_KEPT, "fertility")
        self.pieces = np.empty(0, np.uint32)

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        """Of each word: hash, byte-level tokens, place and number of its pieces in ``pieces``."""
        ids = self.encode(words) if words else []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.pieces) + np.cumsum(size) - size
        self.pieces = np.concatenate((self.pieces, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
        return [hashes, np.fromiter(map(self.count_other, words), np.int64, len(words)), start, size]

    def measure(self, words: list[str]) -> tuple[np.ndarray, tuple[int, int, int, float]]:
        return next(self.measures(pa.array(words, pa.string()), np.array([0, len(words)])))

    def measures(self, words: pa.Array, bounds: np.ndarray):
        """For each text, whose words lie within ``bounds``: hashes of its words, and (pieces, byte-fallback pieces, byte-level tokens, entropy of pieces in bits)."""
        if len(self.pieces) > 8 * WORDS_KEPT:  # pieces of words that were let go
            self.words.clear()
            self.pieces = np.empty(0, np.uint32)
        hashes, other, start, size = self.words.values(words)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo == hi:
                yield np.empty(0, np.uint64), (0, 0, 0, 0.0)
                continue
            ids, ends = gather(self.pieces, start, size, slice(lo, hi))
            n = len(ids)
            share = np.bincount(ids)
            share = share[share > 0] / n
            yield hashes[lo:hi], (n, int(self.is_byte[ids].sum()), int(other[lo:hi].sum()), float(-(share * np.log2(share)).sum()))


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(piece_path: str, byte_path: str) -> Vocabularies:
    key = (piece_path, byte_path)
    if key not in _LOADED:
        _LOADED[key] = Vocabularies(*key)
    return _LOADED[key]


def repeated_words(hashes: np.ndarray, size: int = 3) -> int:
    """Words within windows of ``size`` words that the text has twice or more, the first included."""
    if len(hashes) < size + 1:
        return 0
    found = windows(hashes, size)
    order = np.argsort(found, kind="stable")
    equal = found[order][1:] == found[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(found), dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int32)
    edge[:-1][: len(found)] += twice
    edge[size:][: len(found)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_rules(raw: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text and the hashes of its words."""
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\x0b\x0c\r"):
            if line in seen:
                dup += 1
            seen.add(line)
    return len(hashes), len(raw.translate(None, _NOT_COUNTED)), len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(hashes)


_FIELDS = ["doc_id long", "lang string", "n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "n_pieces long", "n_fallback long", "n_byte_tokens long", "entropy double"]


def _measure(piece_path: str, byte_path: str):
    def run(batches):
        claim("fertility")
        tool = vocabularies(piece_path, byte_path)
        for batch in (part for whole in batches for part in stretches(whole, 2)):
            rows = []
            for text, (hashes, measures) in zip(batch.column(2).to_pylist(), tool.measures(*words_of(batch.column(2)))):
                raw = (text or "").encode()
                rows.append((*base_rules(raw, hashes), *measures))
            columns = list(zip(*rows)) if rows else [[]] * 9
            arrays = [pa.array(c, pa.float64() if i == 8 else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[f.split()[0] for f in _FIELDS])

    return run


def fertility_verdicts(docs: DataFrame, piece_path: str | None = None, byte_path: str | None = None, width: float = WIDTH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, measures and verdict of every document.

    Measures: characters per piece and per byte-level token, share of
    byte-fallback pieces, entropy of pieces.  Bands are median +- ``width`` robust
    standard deviations over all documents that pass the base rules, of a language
    and size class (words to the power of two); of the language, or of all, where
    there are fewer than LEAST_DOCUMENTS.  Entropy only has a lower bound, fallback
    only an upper one.  Quartiles are exact (linear), from two passes over the measures,
    and no group is gathered; measures are cut once and not taken twice.

    A null or empty text has no words and fails the base rules.  A null language
    is one of its own.  Rows each give a row; an empty table none.
    """
    paths = default_paths()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    measured = cut(rows.mapInArrow(_measure(piece_path or paths[0], byte_path or paths[1]), ", ".join(_FIELDS)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    values = {
        "chars_per_piece": F.try_divide("word_chars", "n_pieces"),
        "chars_per_byte_token": F.try_divide("word_chars", "n_byte_tokens"),
        "fallback_share": F.try_divide("n_fallback", "n_pieces"),
        "entropy": F.col("entropy"),
    }
    judged = measured.withColumns({**values, "base_failed": failed, "size_class": F.when(F.col("n_words") > 0, F.floor(F.log2("n_words"))).cast("int")})
    quarters = [0.25, 0.5, 0.75]
    names = [f"q__{v}" for v in values]
    # a null language is one of its own
    judged = judged.withColumn("g", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    passing = judged.where(~F.col("base_failed")).select("g", "size_class", *[F.col(v).cast("double").alias(v) for v in values])

    def bands(by: list[str], tag: str) -> DataFrame:
        """Quartiles of the groups that are large enough, exact whatever the number of documents."""
        some = passing.groupBy(*by).agg(F.count("*").alias("n")).where(f"n >= {LEAST_DOCUMENTS}").drop("n")
        return quantiles(passing, list(values), quarters, by).join(some, by).select(*by, *[F.col(q).alias(f"{tag}{q}") for q in names])

    whole = quantiles(passing, list(values), quarters).select(*[F.col(q).alias(f"w{q}") for q in names])
    joined = judged.join(bands(["g", "size_class"], "f"), ["g", "size_class"], "left").join(bands(["g"], "b"), "g", "left").crossJoin(F.broadcast(whole))  # one row
    joined = joined.select(*[c for c in judged.columns if c != "g"], *[F.coalesce(f"f{q}", f"b{q}", f"w{q}").alias(q) for q in names])

    def inside(v: str, low: bool, high: bool, slack: float):
        q = F.col(f"q__{v}")
        reach = (q[2] - q[0]) / 1.349 * width + slack
        ok = F.lit(True)
        if low:
            ok = ok & (F.col(v) >= q[1] - reach)
        if high:
            ok = ok & (F.col(v) <= q[1] + reach)
        return F.coalesce(ok, F.lit(True))

    good = inside("chars_per_piece", True, True, 0.02) & inside("chars_per_byte_token", True, True, 0.02) & inside("fallback_share", False, True, 0.02) & inside("entropy", True, False, 0.1)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & good).alias("kept"), "n_pieces", "n_byte_tokens", *values,
    )


def op2_fertility_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_verdicts(table(spark, sf_dir, "documents"))


def base_rules_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op2_fertility_bands`` alone, which SQL can restate."""
    return op2_fertility_bands(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op2_fertility_bands": op2_fertility_bands, "base_rules_of_documents": base_rules_of_documents}
#: Tokenizers are not SQL: tests restate the measures and bands.
ORACLES = {
    "base_rules_of_documents": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
s AS (SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g FROM g),
m AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, range(3) o(k) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f"""
}
