"""Byte-level BPE from a rank file: minimal perfect hash first, heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import claim, id_text, stretches, table
from .pieces import PieceCoder, gather


#: Pieces whose ids a worker process remembers.
MEMO = 800_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings (hash and displace).

    Keys fall into buckets by one hash; from the fullest bucket on, the least seed
    that sends all of a bucket's keys to free slots is kept.  There are as many
    slots as keys, and a slot's key is compared, so strangers are told apart.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // per_bucket))
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.seeds = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        free = [True] * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            members = groups[b]
            if not members:
                break
            seed = 1
            while True:
                spots = [self._spot(hashes[i], seed) for i in members]
                if len(set(spots)) == len(spots) and all(free[s] for s in spots):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(members, spots):
                free[s], self.slots[s] = False, i

    def _spot(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        return self._spot(h, self.seeds[h % self.buckets])


class Bpe:
    """Two-tier encoder and table decoder for a file of ranks."""

    def __init__(self, ranks_path: str, pattern: str, memo: int = MEMO):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.key_at = [keys[i] for i in self.hash.slots]
        self.id_at = [self.ranks[k] for k in self.key_at]
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for k, i in self.ranks.items():
            self.bytes_of[i] = k
        #: all tokens' bytes one after another, where each begins and how long it is
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        #: decimal digits of each id and a space, filled up with zeros
        self.decimal = np.array([f"{i} ".encode() for i in range(size)]).view(np.uint8).reshape(size, -1)
        self.digits = (self.decimal > 0).sum(axis=1)
        self.coder = PieceCoder(self.token_bytes, self.text_bytes, "bpe", limit=memo)

    def pretoken(self, token: bytes) -> list[int]:
        slot = self.hash.slot(token)
        if self.key_at[slot] == token:
            return [self.id_at[slot]]
        return self.merge(token)

    def merge(self, token: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until none has a rank.

        Bytes are a doubly linked list of spans; a heap holds (rank, start) of
        pairs.  An entry is stale if its pair is gone or has another rank by now.  O(n log n) for any length.
        """
        ranks, n = self.ranks, len(token)
        rank_of = ranks.get
        end = list(range(1, n + 1))  # end[i]: where the span that starts at i ends; 0 if none does
        before = list(range(-1, n))
        pair = [rank_of(token[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        bits = n.bit_length()  # rank and start in one integer: ranks first, then the leftmost
        mask = (1 << bits) - 1
        heap = [(r << bits) | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & mask
            if pair[i] != top >> bits:
                continue
            j = end[i]
            k = end[i] = end[j]
            pair[j] = -1
            before[k] = i
            if k < n:
                pair[i] = r = rank_of(token[i : end[k]], -1)
                if r >= 0:
                    heappush(heap, (r << bits) | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = r = rank_of(token[h:k], -1)
                if r >= 0:
                    heappush(heap, (r << bits) | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out

    def token_bytes(self, token: str) -> bytes:
        return array("I", self.pretoken(token.encode())).tobytes()

    def text_bytes(self, text: str) -> bytes:
        return b"".join(map(self.token_bytes, self.find(text)))

    def encode(self, text: str) -> memoryview:
        """The ids of a whole text."""
        return memoryview(self.coder.encode(text)).cast("I")

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.asarray(ids, dtype=np.int64))[0].tobytes()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's end."""
        return gather(self.flat, self.start, self.size, ids)

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in decimal, a space after each, and where each ends."""
        rows = self.decimal[ids]
        return rows[rows > 0], np.cumsum(self.digits[ids])


_BPES: dict[tuple[str, str, int], Bpe] = {}


def bpe(ranks_path: str | None = None, pattern: str | None = None, memo: int = MEMO) -> Bpe:
    key = (ranks_path or default_ranks(), pattern or default_pattern(), memo)
    if key not in _BPES:
        _BPES[key] = Bpe(*key)
    return _BPES[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every whole text; a null text is empty and has no ids."""

    def run(batches):
        claim("bpe")
        tool = bpe(ranks_path, pattern)
        for batch in batches:
            for part in stretches(batch, 1):
                ids, at = tool.coder.encode_column(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def _digests(data: np.ndarray, ends: np.ndarray, tail: int, at: np.ndarray) -> list[str]:
    """Digest of each text's stretch of ``data``, without ``tail`` bytes at its end; ``ends``: of each id, ``at``: bounds of texts in ids."""
    view, cuts = memoryview(data), np.concatenate(([0], ends))[at].tolist()
    return [hashlib.sha256(view[lo : max(lo, hi - tail)]).hexdigest() for lo, hi in zip(cuts, cuts[1:])]


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, memo: int = MEMO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and give both digests.

    One row per input row, without a shuffle.  A null text is empty: no ids, and
    the digest of no bytes.  Repeated rows each give a row; an empty table none.
    Texts of any length: the memo is bounded (``memo`` pieces, about 250 bytes each,
    in every worker process) and merging is O(n log n).
    """

    def run(batches):
        claim("bpe")
        tool = bpe(ranks_path, pattern, memo)
        for batch in batches:
            for part in stretches(batch, 1):
                ids, at = tool.coder.encode_column(part.column(1))
                shas = _digests(*tool.decimals(ids), 1, at)
                decoded = _digests(*tool.decode_all(ids), 0, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op8_bpe_round_trip": op8_bpe_round_trip}
ORACLES: dict[str, str] = {}  # a tokenizer is not SQL; tests compare with the library
