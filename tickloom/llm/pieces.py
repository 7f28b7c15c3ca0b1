"""Cutting text at places where byte-level BPE pre-tokenisation always cuts.

In the usual pattern a single space opens the next pre-token and a single line
feed is one by itself, unless more white space is next to it.  A text whose only
white space is single spaces and line feeds between other characters can thus be
cut before each of them, and each piece be encoded by itself with the same
result.  Pieces repeat, so their encodings are remembered.  Any other text is
encoded as a whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo, owned

#: White space other than a single space or line feed between characters.
ODD = r"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Opens the first piece of a text; it is odd white space, so no piece has it.
FIRST = "\x1c"

#: A letter followed by these is always a cut, whatever comes after them.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def surface(piece: str) -> str:
    """The stretch of text for a piece: a space that opened it was left out, a line feed not, and the first one is marked."""
    head = piece[:1]
    return piece[1:] if head == FIRST else piece if head == "\n" else " " + piece


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one after another, and where each ends."""
    sizes = size[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[which] - ends + sizes, sizes) + np.arange(total)], ends


#: Factors of a string's bytes by place, for its hash; places further on use them again.
_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, 1 << 12, dtype=np.uint64)


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: its length and the sum of its bytes by factors of their places."""
    cuts = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    raw = np.frombuffer(strings.buffers()[2], np.uint8, int(cuts[-1] - cuts[0]), int(cuts[0])) if cuts[-1] > cuts[0] else np.empty(0, np.uint8)
    place = np.arange(len(raw)) - np.repeat(cuts[:-1] - cuts[0], sizes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * _FACTORS[place % len(_FACTORS)], dtype=np.uint64)))[cuts - cuts[0]]
    return np.diff(sums) + sizes.astype(np.uint64)


class Known:
    """Pieces met and their ids, as arrays: ``keys`` and, for each, where its ids stand in ``flat`` and how many.

    ``sorted`` holds the hashes of the keys in order and ``order`` whose they are, so what
    is looked up costs by its own number, not by that of the keys.  Holds ``limit``
    pieces between columns; beyond it, the half met most often stays.
    """

    def __init__(self, limit: int, owner: str):
        self.limit = limit
        self.clear()
        owned(owner, self)

    def clear(self) -> None:
        self.keys = pa.array([], pa.string())
        self.flat, self.size, self.met = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.sorted, self.order = np.empty(0, np.uint64), np.empty(0, np.int64)

    def find(self, strings: pa.Array) -> np.ndarray:
        """Where each string stands among the keys, or -1; of two keys of one hash the later may not be found."""
        out = np.full(len(strings), -1, dtype=np.int64)
        if len(self):
            sought = hashes(strings)
            way = np.argsort(sought)  # in order, neighbours are looked for in the same places
            at = np.minimum(np.searchsorted(self.sorted, sought[way]), len(self) - 1)
            same_hash = self.sorted[at] == sought[way]
            hit, keys = way[same_hash], self.order[at[same_hash]]
            same = np.asarray(pc.equal(self.keys.take(pa.array(keys)), strings.take(pa.array(hit))))
            out[hit[same]] = keys[same]
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, keys: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        found = hashes(keys)
        way = np.argsort(found)
        at = np.searchsorted(self.sorted, found[way])
        self.sorted, self.order = np.insert(self.sorted, at, found[way]), np.insert(self.order, at, len(self) + way)
        self.keys = pa.concat_arrays([self.keys, keys])
        self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
        self.met = np.concatenate((self.met, np.zeros(len(keys), np.int64)))

    def trim(self) -> None:
        if len(self) > self.limit:
            stays = np.sort(np.argpartition(-self.met, self.limit // 2)[: self.limit // 2])
            flat, _ = gather(self.flat, np.cumsum(self.size) - self.size, self.size, stays)
            self.keys, self.flat, self.size, self.met = self.keys.take(pa.array(stays)), flat, self.size[stays], self.met[stays] // 2
            new = np.searchsorted(stays, self.order)
            still = stays[np.minimum(new, len(stays) - 1)] == self.order
            self.sorted, self.order = self.sorted[still], new[still]


class PieceCoder:
    """Encodes columns of texts by pieces.

    ``token(str) -> bytes`` encodes one pre-token, ``text(str) -> bytes`` any text;
    both give ids as little-endian 32-bit.  A piece that is letters and then
    punctuation is one pre-token or two; any other is encoded as a text, and so is a
    text that holds one of the strings ``whole``.  ``limit`` pieces are remembered
    between columns, so memory is bounded whatever the corpus.
    """

    def __init__(self, token, text, owner: str, limit: int = 800_000, whole: tuple[str, ...] = ()):
        self.token, self.text = token, text
        self.odd = "|".join([ODD, *map(re.escape, whole)])
        self.known = Known(limit, owner)
        self.words, self.tails = Memo(token, max(1, limit // 4), owner), Memo(token, 10_000, owner)

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.words[" " + piece]
        if piece[:1] == "\n":
            return self.tails["\n"] + (self._chunk(piece[1:]) if len(piece) > 1 else b"")
        return self._chunk(surface(piece))

    def _chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(TAIL)
        if not (core[1:] if core[:1] == " " else core).isalpha():
            return self.text(chunk) if chunk else b""
        if len(core) == len(chunk):
            return self.words[core]
        # the word is a pre-token of its own, and met with other punctuation too
        return self.words[core] + self.tails[chunk[len(core) :]]

    def encode(self, text: str) -> bytes:
        ids, _ = self.encode_column(pa.array([text], pa.string()))
        return ids.tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text; a null text has none.

        Cutting and finding known pieces is left to Arrow; only distinct pieces that
        are not known are Python strings.
        """
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd)) | (np.asarray(pc.binary_length(texts)) == 0)
        plain = texts.filter(pa.array(~odd))
        cut = pc.split_pattern(pc.binary_join_element_wise(FIRST, pc.replace_substring(plain, "\n", " \n"), ""), " ")
        pieces, known = cut.flatten(), self.known
        coded = pieces.dictionary_encode()
        place = known.find(coded.dictionary)
        new = coded.dictionary.filter(pa.array(place < 0))
        place[place < 0] = len(known) + np.arange(len(new))
        values = list(map(self._piece, new.to_pylist()))
        known.add(new, np.frombuffer(b"".join(values), dtype="<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4)
        found = np.asarray(coded.indices)
        known.met[place] += np.bincount(found, minlength=len(place))
        found = place[found]
        whole = [self.text(t) if t else b"" for t in texts.filter(pa.array(odd)).to_pylist()]
        units = np.ones(len(texts), dtype=np.int64)  # pieces of each text; an odd one is a piece by itself
        units[~odd] = np.asarray(pc.list_value_length(cut))
        which = np.empty(int(units.sum()), dtype=np.int64)
        mine = np.repeat(odd, units)
        which[~mine] = found
        which[mine] = len(known) + np.arange(len(whole))
        size = np.concatenate((known.size, np.fromiter(map(len, whole), np.int64, len(whole)) // 4))
        flat = np.concatenate((known.flat, np.frombuffer(b"".join(whole), dtype="<u4"))) if whole else known.flat
        ids, ends = gather(flat, np.cumsum(size) - size, size, which)
        known.trim()
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(units)))]
