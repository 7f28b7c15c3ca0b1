"""Personal data: listed patterns, and a skip-chain conditional random field for what they leave out."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

#: Kinds in the order in which spans of one start are listed; the last has a pattern of its own beside the base ones.
KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["none", *KINDS]
#: Documents that the field is trained on, at most, and the length above which one is not used for that.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: Features that are kept, at most (those met oftenest); steps of training; posterior from which a token is labelled.
MOST_FEATURES, STEPS, SURE = 20_000, 200, 0.8
#: Share of words whose own features training hides, so that ties have to speak for them, and ridge on all weights.
HIDDEN, RIDGE = 0.3, 1e-3
#: Rounds of message passing and the share of the old message that is kept.
ROUNDS, DAMPING = 12, 0.3
#: Words are tied by likeness (one edit, digits alone) if they have so many characters; equal words of LEAST_KEY or more are always tied.
LIKE_CHARS, LEAST_KEY = range(8, 41), 5
#: Numbers are tied by so many last digits: the rest may be a country's or a town's.
LAST_DIGITS = 7
#: Kinds of ties: neighbours in the text, far words that are equal, far words that are alike.
CHAIN, EQUAL, ALIKE = range(3)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, so possessive runs change nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""[=:][\x20\x09]*(["'])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])([A-Za-z0-9]{16,}+)\1""")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind; in code points."""
    out = []
    # an address holds one @, so each @ is looked at once: leftwards to the run's start, rightwards by pattern
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _ANY.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def listed_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans, and secrets by their pattern: 16 or more letters and digits, both met, in quotes after = or a colon."""
    base = base_spans(text)
    found = [(m.start(2), m.end(2), "secret") for m in _SECRET.finditer(text)] if "=" in text or ":" in text else []
    return sorted([*base, *[s for s in found if not any(s[0] < e and b < s[1] for b, e, _ in base)]], key=lambda x: (x[0], KINDS.index(x[2])))


class Token:
    __slots__ = ("core", "end", "features", "index", "keys", "label", "likes", "start")


def shape(word: str) -> str:
    """Runs of digits and of letters as one sign each, other characters as they are; so many signs at most."""
    word = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 4 else "99", word)[:24]


def one_edit(a: str, b: str) -> bool:
    """Whether a letter changed, added or left out makes one of the other (or they are equal)."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :] if k < len(b) else True


def tokens(text: str, listed: list[tuple[int, int, str]]) -> list[Token]:
    """Nodes of the field: words with a digit or @, and words like the local part of an address found.

    ``label`` is that of the listed span that the word lies in, if any.  ``keys`` are
    what far words share to count as equal: the word without outer punctuation.
    ``likes`` are what they share to be looked at for likeness: its digits without
    separators if there are LAST_DIGITS or more (those of the whole number, if it is part
    of a listed one) and the last ones of them, the part before an @, and the word
    with any one character left out.
    """
    locals_ = {text[s:e].split("@")[0].lower() for s, e, k in listed if k == "email"}
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    out = []
    spans = iter(listed)
    open_spans: list[tuple[int, int, str]] = []
    nxt = next(spans, None)
    for i, (start, end, word) in enumerate(words):
        lo, hi = 0, len(word)
        while lo < hi and not (word[lo].isalnum() or word[lo] == "+"):
            lo += 1
        while hi > lo and not word[hi - 1].isalnum():
            hi -= 1
        core = word[lo:hi]
        low = core.lower()
        if not (_ANY.search(core) or low in locals_):
            continue
        t = Token()
        t.index, t.start, t.end, t.core, t.label = i, start + lo, start + hi, core, 0
        while nxt and nxt[0] < t.end:
            open_spans.append(nxt)
            nxt = next(spans, None)
        open_spans = [s for s in open_spans if s[1] > t.start]
        number = digits = re.sub(r"[^0-9]", "", core)
        for s in open_spans:
            if s[0] < t.end and t.start < s[1]:
                t.label = LABELS.index(s[2])
                if s[2] in ("card", "phone"):  # a word of a number stands for all of it
                    number = re.sub(r"[^0-9]", "", text[s[0] : s[1]])
                break
        # a number or two are too common to tie words by
        t.keys = {low} if len(low) >= LEAST_KEY else set()
        t.likes = {"#" + number.lstrip("0"), "#~" + number[-LAST_DIGITS:]} if len(number) >= LAST_DIGITS else set()
        if "@" in low and len(low.split("@")[0]) >= LEAST_KEY:
            t.likes.add("@" + low.split("@")[0])
        if low in locals_:
            t.likes.add("@" + low)
        if len(low) in LIKE_CHARS:
            t.likes |= {low, *[low[:k] + low[k + 1 :] for k in range(len(low))]}
        before, after = words[i - 1][2] if i else "", words[i + 1][2] if i + 1 < len(words) else ""
        quoted = "q" if lo and word[lo - 1] in "\"'" else ""
        count = min(len(digits), 20)
        parts = core.split(".")
        t.features = (
            "bias", "s:" + shape(core), f"n:{count}", f"l:{min(len(core), 40) // 4}", "@" if "@" in core else "no@", "plus" if core[:1] == "+" else "noplus",
            "p:" + shape(before), "f:" + shape(after), "pq:" + quoted, f"dots:{min(core.count('.'), 4)}", f"dash:{min(core.count('-'), 4)}", "mix" if digits and len(digits) < len(core) else "pure",
            f"luhn:{luhn(digits)}" if 14 <= count <= 19 else "short", f"parts:{len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)}",
        )
        out.append(t)
    return out


def alike(a: Token, b: Token) -> bool:
    """Whether words that share one of ``likes`` are: equal digits, a local part, or one edit."""
    shared = a.likes & b.likes
    return any(k[:1] in "#@" for k in shared) or one_edit(a.core.lower(), b.core.lower())


def ties(nodes: list[Token]) -> list[tuple[int, int, int]]:
    """(node, later node, kind of tie): neighbours in the text, far words that are equal, far words that are alike.

    Of several words with one key each is tied to the next, so ties grow with the
    nodes.
    """
    out: dict[tuple[int, int], int] = {(a, a + 1): CHAIN for a in range(len(nodes) - 1) if nodes[a + 1].index == nodes[a].index + 1}
    last: dict[str, int] = {}
    near: dict[str, int] = {}
    for j, t in enumerate(nodes):
        for key in t.keys:
            if key in last:
                out.setdefault((last[key], j), EQUAL)
            last[key] = j
        for key in t.likes:
            i = near.get(key)
            if i is not None and (i, j) not in out and alike(nodes[i], t):
                out[i, j] = ALIKE
            near[key] = j
    return [(a, b, kind) for (a, b), kind in sorted(out.items())]


class Field:
    """Weights of the field and its inference: features of words, and a table of labels for each kind of tie."""

    def __init__(self, weights: dict[str, list[float]], tables: list[list[list[float]]]):
        self.weights = {k: np.array(v) for k, v in weights.items()}
        self.tables = np.array(tables)

    def unary(self, t: Token) -> np.ndarray:
        return sum((self.weights[f] for f in t.features if f in self.weights), np.zeros(len(LABELS)))

    def posteriors(self, nodes: list[Token], masked: frozenset[int] = frozenset()) -> np.ndarray:
        """Beliefs by loopy sum-product in log space, damped; words of listed spans are held.

        Words of ``masked`` are not held and only their bias and their ties speak.
        """
        own = np.array([self.weights.get("bias", np.zeros(len(LABELS))) if i in masked else self.unary(t) for i, t in enumerate(nodes)])
        for i, t in enumerate(nodes):
            if t.label and i not in masked:
                own[i] = -40.0
                own[i, t.label] = 0.0
        edges = ties(nodes)
        if not edges:
            return _softmax(own)
        source = np.array([x for a, b, _ in edges for x in (a, b)])
        target = np.array([x for a, b, _ in edges for x in (b, a)])
        tables = np.array([x for _, _, kind in edges for x in (self.tables[kind], self.tables[kind].T)])
        back = np.arange(len(source)) ^ 1
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            into = belief[source] - message[back]
            new = _logsumexp(into[:, :, None] + tables)
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if moved < 1e-4:
                break
        belief = own.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)

    def added(self, text: str, listed: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Spans of words that the patterns left out and the field is sure of; next to each other they are one."""
        nodes = tokens(text, listed)
        if not nodes:
            return []
        p = self.posteriors(nodes)
        best = p.argmax(axis=1)
        out: list[list] = []
        for i, t in enumerate(nodes):
            k = int(best[i])
            if not k or p[i, k] < SURE or any(s < t.end and t.start < e for s, e, _ in listed):
                continue
            if out and out[-1][2] == k and out[-1][3] == t.index - 1 and LABELS[k] in ("phone", "card"):
                out[-1][1], out[-1][3] = t.end, t.index
            else:
                out.append([t.start, t.end, k, t.index])
        return [(s, e, LABELS[k]) for s, e, k, _ in out]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def retold(text: str, listed: list[tuple[int, int, str]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its labelled mentions told again after it, in another form, and its other words as they are.

    An address by its local part, a phone number by its last word, a card in fours
    joined by hyphens or dots, a secret without quotes; half of all a second time with a
    digit changed.  All spans are given.  Beside each stands a stranger of the same form,
    with digits of its own, that is no mention: so the form alone does not tell.
    """
    again = []
    for s, e, kind in listed:
        raw = text[s:e]
        if kind == "card":
            digits = re.sub("[^0-9]", "", raw)
            raw = "-."[int(rng.integers(2))].join(digits[k : k + 4] for k in range(0, len(digits), 4))
        again.append((raw.split("@")[0] if kind == "email" else raw.split()[-1] if kind == "phone" else raw, kind))
    strangers = [("".join(str(rng.integers(10)) if "0" <= c <= "9" else c for c in raw), None) for raw, _ in again if any("0" <= c <= "9" for c in raw)]
    again += [(t.core, None) for t in tokens(text, listed) if not t.label and t.keys]
    for raw, kind in again[:]:
        places = [i for i, c in enumerate(raw) if "0" <= c <= "9"]
        if places and rng.random() < 0.5:
            i = places[int(rng.integers(len(places)))]
            again.append((f"{raw[:i]}{(int(raw[i]) + 1 + int(rng.integers(9))) % 10}{raw[i + 1 :]}", kind))
    again += strangers
    spans, parts, at = list(listed), [text], len(text)
    for raw, kind in again:
        parts.append(" und " + raw)
        at += 5 + len(raw)
        if kind:
            spans.append((at - len(raw), at, kind))
    return "".join(parts), spans


def fit(texts: list[str], seed: int = 9) -> Field:
    """All weights together, from texts that the listed patterns label.

    Ascent on the pseudo-likelihood: each word's label given its features and the
    labels of the words tied to it, so features and tables of ties share what they
    explain.  Patterns are known by their shape, so ties would have nothing to say:
    in every step HIDDEN of the words are without their features, and mentions are
    also ``retold``, so that ties of far words are met whatever the sample holds.
    A word with a digit that is tied to a listed mention, but not listed itself, may be one
    that the patterns miss: it is no example of either, and neither are its ties.
    """
    n = len(LABELS)
    rng = np.random.default_rng(seed)
    nodes: list[Token] = []
    edges: list[tuple[int, int, int]] = []
    known: list[bool] = []
    for text in texts:
        mine = tokens(*retold(text, listed_spans(text), rng))
        tied = ties(mine)
        open_to = {x for a, b, kind in tied if kind != CHAIN for x, y in ((a, b), (b, a)) if not mine[x].label and mine[y].label and any("0" <= c <= "9" for c in mine[x].core)}
        edges += [(a + len(nodes), b + len(nodes), kind) for a, b, kind in tied if a not in open_to and b not in open_to]
        known += [i not in open_to for i in range(len(mine))]
        nodes += mine
    if not nodes:
        return Field({}, np.zeros((3, n, n)).tolist())
    label = np.array([t.label for t in nodes])
    common = Counter(f for t in nodes for f in t.features)
    number = {f: k for k, (f, c) in enumerate(common.most_common(MOST_FEATURES)) if c >= 2 or f == "bias"}
    width = max(len(t.features) for t in nodes)
    which = np.full((len(nodes), width), len(number))
    for i, t in enumerate(nodes):
        held = [number[f] for f in t.features if f in number]
        which[i, : len(held)] = held
    a, b, kind = (np.array(x) for x in zip(*edges)) if edges else (np.empty(0, int),) * 3
    truth, taught = np.eye(n)[label], np.array(known, dtype=float)[:, None]
    weights, tables = np.zeros((len(number) + 1, n)), np.zeros((3, n, n))
    square_w, square_t = np.full_like(weights, 1e-6), np.full_like(tables, 1e-6)
    for _ in range(STEPS):
        seen = np.where((rng.random(len(label)) < HIDDEN)[:, None] & (which != number["bias"]), len(number), which)
        score = weights[seen].sum(axis=1)
        np.add.at(score, a, tables[kind, :, label[b]])
        np.add.at(score, b, tables[kind, label[a], :])
        gap = (truth - _softmax(score)) * taught
        step_w = np.zeros_like(weights)
        np.add.at(step_w, seen.ravel(), np.repeat(gap, width, axis=0))
        step_t = np.zeros_like(tables)
        np.add.at(step_t, (kind, slice(None), label[b]), gap[a])
        np.add.at(step_t, (kind, label[a]), gap[b])
        step_t[1:] += step_t[1:].transpose(0, 2, 1)  # far ties have no direction
        step_w -= RIDGE * len(label) * weights / STEPS
        step_t -= RIDGE * len(label) * tables / STEPS
        step_w[-1] = 0
        square_w, square_t = square_w + step_w**2, square_t + step_t**2
        weights += 0.5 * step_w / np.sqrt(square_w)
        tables += 0.5 * step_t / np.sqrt(square_t)
    return Field({f: weights[k].round(6).tolist() for f, k in number.items()}, tables.round(6).tolist())


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on the ``sample_rows`` documents of least hash that have a digit or @ (and are not very long): a fixed bound."""
    rows = id_text(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= SAMPLE_CHARS))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()
    found = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text").collect()
    return fit([r["text"] for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long, n_spans long"


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def find_personal_data(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base patterns, and all spans with the field's.

    ``n_secret`` counts spans of the listed pattern, ``n_added`` those that the field
    adds, ``n_spans`` all.  No shuffle; the model (bounded by MOST_FEATURES) goes with
    the tasks.  A text without digit and @ is passed over.  A null or empty text has
    no spans and the digest of nothing.  Nodes and ties grow with a text's words,
    each text is looked at alone.  Repeated rows each give a row; an empty table
    none.
    """
    packed = ({k: v.tolist() for k, v in model.weights.items()}, model.tables.tolist())
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        field = Field(*sent.value)
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not _ANY.search(text):
                    rows.append((key, 0, 0, 0, 0, nothing, "", 0, 0, 0))
                    continue
                listed = listed_spans(text)
                base = [x for x in listed if x[2] != "secret"]
                count = Counter(k for _, _, k in listed)
                more = field.added(text, listed)
                rows.append((key, *(count[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(listed + more), count["secret"], len(more), len(listed) + len(more)))
            columns = list(zip(*rows)) if rows else [[]] * 10
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def op9_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, train(docs))


QUERIES = {"op9_skip_chain_pii": op9_skip_chain_pii}
ORACLES: dict[str, str] = {}  # a trained model; tests compare the fixed patterns with the expressions as given
