"""Token files (3), BPE (8) and fertility (2)."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tickloom.llm import bpe, fertility, pieces, simple8b, token_files
from tickloom.llm.common import fresh_path

PARTS = ["a", "é", "Z", "the", "1", "22", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "!", "***", "　", "\xa0", "ß", "中", "\x1c", "<|endoftext|>", "'ll", "_", "-", "\r\n", "²", "𝒳", "🙂", "\x00"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    out = ["", " ", "\n", "plain words here", " leading", "trailing ", "a" * 3000]
    for k in range(1500):
        pool = PARTS if k % 2 else [p for p in PARTS if not p.isspace()]
        glue = "" if k % 2 else rng.choice([" ", "\n"])
        out.append(glue.join(rng.choice(pool) for _ in range(rng.randrange(14))))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        counts = rng.integers(0, 200, rng.integers(1, 8))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        values = rng.integers(0, 2**63, bounds[-1], dtype=np.uint64) >> rng.integers(0, 63, bounds[-1]).astype(np.uint64)
        if len(values):
            values[rng.integers(0, len(values))] = 2**64 - 1
        packed, offsets = simple8b.encode_streams(values, bounds)
        assert (simple8b.decode_streams(packed, offsets, counts) == values).all()
        # any stream is decoded alone
        k = int(rng.integers(0, len(counts)))
        alone = simple8b.decode_streams(packed[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), counts[k : k + 1])
        assert (alone == values[bounds[k] : bounds[k + 1]]).all()


def test_simple8b_density():
    assert len(simple8b.encode(np.zeros(600, np.uint64))) == 10
    assert len(simple8b.encode(np.full(6, 1023, np.uint64))) == 1
    assert len(simple8b.encode(np.array([2**60], np.uint64))) == 2
    assert len(simple8b.encode(np.empty(0, np.uint64))) == 0


def test_added_tokens_as_the_library_takes_them():
    coder = token_files.coder(token_files.default_tokenizer())
    assert list(memoryview(coder.encode("a <|endoftext|> b")).cast("I")) == [64, 220, 50256, 275]


def test_piecewise_equals_library(texts):
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    coder = token_files.coder(token_files.default_tokenizer())
    for text in texts:
        assert list(memoryview(coder.encode(text)).cast("I")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.fixture(scope="module")
def reference():
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_two_tiers_equal_library(texts, reference):
    tool = bpe.bpe()
    for text in texts:
        ids = list(tool.encode(text))
        assert ids == reference.encode_ordinary(text), repr(text)
        assert tool.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == list(range(3000))
    assert all(keys[table.slots[table.slot(k)]] == k for k in keys)


def test_merge_of_a_long_pretoken():
    assert bpe.bpe().decode(bpe.bpe().merge(b"ab" * 20_000)) == b"ab" * 20_000


def test_round_trip_rows(odd, clashing, empty, same_rows, reference):
    got = same_rows(bpe.round_trip, odd, clashing, empty)
    want = []
    for r in odd.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(odd).count() == odd.count()


def test_token_files(spark, odd, clashing, empty, same_rows):
    def run(df):
        path = fresh_path(spark, "test")
        token_files.write_token_files(df, path)
        return token_files.read_digests(spark, path)

    got = same_rows(run, odd, clashing, empty)
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    by_id = {}
    for r in odd.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        by_id.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted((g[2], g[3]) for g in got if g[0] == k) for k in by_id}
    at = 0
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == at
        at += g[2]
    order = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_base_rules(odd):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tool = fertility.vocabularies(*fertility.default_paths())
    for r in odd.collect():
        raw = (r.text or "").encode()
        text = r.text or ""
        w = word.findall(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        assert fertility.base_rules(raw, tool.measure([x.decode() for x in raw.split()])[0]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_fertility_rows(odd, clashing, empty, same_rows):
    got = same_rows(fertility.fertility_verdicts, odd, clashing, empty, "doc_id", "n_words", "base_failed", "kept")
    assert len(got) == odd.count()
    assert all(failed and not kept for _, n, failed, kept in got if n < 50)


def test_fertility_keeps_clean_and_rejects_symbols(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = fertility.fertility_verdicts(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() >= 0.98
    assert got[got.quality == 0].kept.mean() <= 0.6


def test_entropy_of_pieces():
    tool = fertility.vocabularies(*fertility.default_paths())
    assert tool.measure(["the"] * 8)[1][3] == 0.0
    n, fallback, _, entropy = tool.measure(["𝒳"])[1]
    assert fallback > 0 and n >= fallback and entropy > 0


def test_bands_against_a_restatement(spark):
    """Pieces, entropy, bands and verdicts of all documents, word by word with the libraries."""
    import sentencepiece

    piece_path, byte_path = fertility.default_paths()
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    with open(byte_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    level = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = {}
    docs = {}
    names = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in table.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        met, other = Counter(), 0
        for w in words:
            if w not in known:
                known[w] = (pieces.encode(w), len(level.encode_ordinary(" " + w)))
            met.update(known[w][0])
            other += known[w][1]
        n = sum(met.values())
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        share = np.array(list(met.values())) / n if n else np.empty(0)
        chars = sum(map(len, words))
        values = dict(zip(names, (chars / n, chars / other, sum(c for i, c in met.items() if pieces.is_byte(i)) / n, float(-(share * np.log2(share)).sum())) if n else (None, None, None, 0.0)))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        docs[r.doc_id] = (r.lang, int(np.log2(len(words))) if words else None, failed, values, n, other)
    passing = [d for d in docs.values() if not d[2]]

    def quarters(some, v):
        return np.quantile([d[3][v] for d in some], (0.25, 0.5, 0.75))

    def kept(d):
        fine = [x for x in passing if x[:2] == d[:2]]
        broad = [x for x in passing if x[0] == d[0]]
        some = fine if len(fine) >= fertility.LEAST_DOCUMENTS else broad if len(broad) >= fertility.LEAST_DOCUMENTS else passing
        for v, low, high, slack in (("chars_per_piece", True, True, 0.02), ("chars_per_byte_token", True, True, 0.02), ("fallback_share", False, True, 0.02), ("entropy", True, False, 0.1)):
            a, m, b = quarters(some, v)
            reach = (b - a) / 1.349 * fertility.WIDTH + slack
            if (low and d[3][v] < m - reach) or (high and d[3][v] > m + reach):
                return False
        return not d[2]

    got = {r.doc_id: r for r in fertility.fertility_verdicts(table).collect()}
    assert got.keys() == docs.keys()
    for k, d in docs.items():
        assert (got[k].n_pieces, got[k].n_byte_tokens, got[k].base_failed) == (d[4], d[5], d[2])
        assert d[2] or all(got[k][v] == pytest.approx(d[3][v]) for v in names)
    assert {k: r.kept for k, r in got.items()} == {k: not d[2] and kept(d) for k, d in docs.items()}


def test_known_pieces_are_found_without_a_table_of_all(monkeypatch):
    """Looking a column up may not build a table of all that is known each time: so no index_in; keys of one hash are told apart."""
    monkeypatch.setattr(pieces.pc, "index_in", None)
    rng = random.Random(3)
    words = ["".join(rng.choice("aé\n.") for _ in range(rng.randrange(0, 9))) for _ in range(3000)] + ["x" * 5000, "y" * 5000]
    for same in (False, True):
        if same:
            monkeypatch.setattr(pieces, "hashes", lambda strings: np.zeros(len(strings), np.uint64))
        known = pieces.Known(400, "test")
        seen: dict[str, int] = {}
        for _ in range(20):
            column = pa.array([""] + rng.sample(words, 150), pa.string())[1:].unique()
            at = known.find(column)
            for word, place in zip(column.to_pylist(), at.tolist()):
                assert place < 0 or known.keys[place].as_py() == word
                assert same or (place >= 0) == (word in seen)
            new = column.filter(pa.array(at < 0))
            known.add(new, np.arange(len(new), dtype=np.uint32), np.ones(len(new), np.int64))
            known.met += 1
            known.trim()
            seen = {word: i for i, word in enumerate(known.keys.to_pylist())}
            assert sorted(known.order.tolist()) == list(range(len(known))) and (np.diff(known.sorted.astype(object)) >= 0).all()
