"""Toxicity by misspelling-tolerant lexicon search with context windows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, WordTable, claim, give_back, id_text, return_blocks, stretches, table, words_of

#: General insults that are always in the lexicon (fixed values); more are learned from labels.
SEED_TERMS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown"]
#: Words near a match that mark it as reported speech (fixed values).
REPORTING = ["said", "says", "called", "quoted", "quote", "wrote", "term", "word", "sagte", "nannte", "zitat", "wort", "dit", "appelé", "mot", "dijo", "llamó", "palabra"]
#: Words near a match that mark it as aimed at somebody (fixed values).
ADDRESSING = ["you", "your", "you're", "u", "ur", "du", "dich", "ihr", "tu", "toi", "vous", "tú", "usted", "eres"]
QUOTES = "\"“”„«»‘’"
#: Words on either side of a match that count as its context.
WINDOW = 5
#: Labelled documents that the lexicon and weights are learned from, at most.
SAMPLE_ROWS = 4000
#: Terms that are learned, at most.
LEARNED_TERMS = 2000
SHORTEST, LONGEST = 4, 12
#: Terms with so many letters, fixed or learned, are met with one error too, and with two.
FUZZY_FROM, TWICE_FROM = 5, 9
#: (node, errors) pairs that an automaton's states may hold together.
HELD = 2_000_000
THRESHOLD = 0.7

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def allowed(term: str) -> int:
    """Errors with which a term is still met."""
    return (len(term) >= FUZZY_FROM) + (len(term) >= TWICE_FROM)


def normal(word: str) -> str:
    """Case-folded, without what is not a letter at either end; look-alikes within become letters."""
    word = word.casefold()
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalnum():
        lo += 1
    while hi > lo and not word[hi - 1].isalnum():
        hi -= 1
    word = word[lo:hi]
    return word if word.isalpha() or word.isdigit() else word.translate(_LEET)


#: The same, remembered while a model is learned.
_NORMAL = Memo(normal, 200_000, "toxicity")


class FuzzyTrie:
    """Lexicon trie intersected with Levenshtein automata, made deterministic as it is used.

    A state is the set of (trie node, errors so far) that the automata of all
    terms reach on the word's letters; a letter may be matched, replaced, added or
    left out.  States and steps are remembered, so a word costs a look-up per
    letter, and most die after a few.  A term marked as a stem is met by any word
    that begins with it, other terms by the whole word; either with as many errors
    as ``allowed`` says if it is among ``fuzzy``.
    """

    def __init__(self, terms: dict[str, bool], fuzzy: set[str]):
        self.fuzzy = {t: allowed(t) for t in fuzzy}
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[bool] = [False]
        self.errors: list[int] = [0]  # allowed below this node: the most that any term in its subtree has
        for term, is_stem in sorted(terms.items()):
            node = 0
            most = self.fuzzy.get(term, 0)
            self.errors[0] = max(self.errors[0], most)
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.term)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(False)
                    self.errors.append(0)
                node = nxt
                self.errors[node] = max(self.errors[node], most)
            self.term[node], self.stem[node] = term, is_stem
        self._names: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._steps: list[dict[str, int]] = []
        self._found: list[tuple[int, str] | None] = []
        self._stems: list[tuple[int, str] | None] = []
        self._held = 0
        self.dead = self._name(frozenset())
        self.start = self._name(self._close({(0, 0)}))

    def _close(self, items: set[tuple[int, int]]) -> frozenset:
        """Adds what leaving letters of a term out reaches; keeps the least errors of each node."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values() if e + 1 <= self.errors[child]]
        return frozenset(best.items())

    def _name(self, items: frozenset) -> int:
        if items not in self._names:
            self._names[items] = len(self._sets)
            self._sets.append(items)
            self._steps.append({})
            self._held += len(items)
            ends = [(e, self.term[n], self.stem[n]) for n, e in items if self.term[n] and e <= self.fuzzy.get(self.term[n], 0)]
            self._found.append(min(((e, t) for e, t, _ in ends), default=None))
            self._stems.append(min(((e, t) for e, t, is_stem in ends if is_stem), default=None))
        return self._names[items]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self._sets[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e))
                elif e + 1 <= self.errors[child]:
                    out.add((child, e + 1))
            if e + 1 <= self.errors[node]:
                out.add((node, e + 1))
        nxt = self._steps[state][c] = self._name(self._close(out))
        return nxt

    def find(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the best term the word meets, or None."""
        if len(self._sets) > 200_000 or self._held > HELD:  # bounded whatever the words are
            self.__init__({t: s for t, s in zip(self.term, self.stem) if t}, set(self.fuzzy))
        state, steps, stems = self.start, self._steps, self._stems
        stem = None
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == self.dead:
                return stem
            if stems[state] and (stem is None or stems[state][0] <= stem[0]):
                stem = stems[state]
        found = self._found[state]
        return stem if found is None or (stem and stem[0] < found[0]) else found


#: Classes of words, by number.
KINDS = [None, "strong", "weak", "fuzzy", "faint", "report", "address", "quote"]
FEATURES = ["bias", "log_strong", "share_strong", "log_weak", "share_weak", "log_fuzzy", "share_fuzzy", "log_faint", "share_faint", "any_strong"]


class Scorer:
    """Features and score of a text; ``strong`` terms are seldom or never met in clean text.

    Words of ``known`` are words of their own that clean text has, so they are no
    misspelling of a term.  Without ``errors`` terms are met as they are written.
    """

    def __init__(self, terms: dict[str, tuple[bool, bool]], weights: list[float], known: frozenset[str] = frozenset(), errors: bool = True):
        self.terms, self.weights, self.known = terms, np.array(weights), known
        trie = FuzzyTrie({t: stem for t, (stem, _) in terms.items()}, set(terms) if errors else set())
        reporting, addressing = set(REPORTING), set(ADDRESSING)

        self._reporting, self._addressing, self._find = reporting, addressing, trie.find
        self.table, self._known_kinds = WordTable(self._kinds, 300_000, "toxicity"), Memo(self.kind, 100_000, "toxicity")

    def kind(self, word: str) -> tuple[str | None, bool]:
        """(class of a word or None, whether it is quoted by itself)."""
        plain = normal(word)
        if plain in self._reporting:
            return "report", False
        if plain in self._addressing:
            return "address", False
        hit = self._find(plain) if plain else None
        if hit is None or (hit[0] and plain in self.known):
            return ("quote", False) if word[0] in QUOTES or word[-1] in QUOTES else (None, False)
        errors, term = hit
        group = ("fuzzy" if errors else "strong") if self.terms[term][1] else "faint" if errors else "weak"
        return group, word[0] in QUOTES and word.rstrip(".,;:!?")[-1] in QUOTES

    def _kinds(self, words: list[str]) -> list[np.ndarray]:
        found = list(map(self.kind, words))
        return [np.array([KINDS.index(k) for k, _ in found], dtype=np.uint8), np.array([q for _, q in found], dtype=bool)]

    def _kinds_of(self, texts: pa.Array):
        """For each text the classes of its words, as numbers, and whether each is quoted by itself."""
        words, bounds = words_of(texts)
        kinds, quoted = self.table.values(words)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield kinds[lo:hi], quoted[lo:hi]

    @staticmethod
    def _matches(kinds: np.ndarray, quoted: np.ndarray) -> list[tuple[int, str, float]]:
        at = np.flatnonzero(kinds)
        marks = [(i, KINDS[kinds[i]]) for i in at.tolist()]
        out = []
        for n, (i, group) in enumerate(marks):
            if group in ("report", "address", "quote"):
                continue
            before, after = set(), set()
            k = n - 1
            while k >= 0 and marks[k][0] >= i - WINDOW:
                before.add(marks[k][1])
                k -= 1
            k = n + 1
            while k < len(marks) and marks[k][0] <= i + WINDOW:
                after.add(marks[k][1])
                k += 1
            near = before | after
            weight = 0.25 if quoted[i] or ("quote" in before and "quote" in after) or "report" in near else 1.5 if "address" in near else 1.0
            out.append((i, group, weight))
        return out

    def matches(self, text: str) -> tuple[int, list[tuple[int, str, float]]]:
        """Number of words, and (word, class, weight of context) of each match.

        A match alone weighs 1; next to reporting words or within quotation marks
        0.25; next to words that address somebody 1.5.
        """
        kinds, quoted = next(self._kinds_of(pa.array([text], pa.string())))
        return len(kinds), self._matches(kinds, quoted)

    def misspelled(self, text: str) -> str | None:
        """The text with a letter left out of each word that meets a term exactly and may meet it with an error; None if there is none."""
        words, changed = text.split(), False
        for i, word in enumerate(words):
            plain = _NORMAL[word]
            if len(plain) >= FUZZY_FROM and self._known_kinds[word][0] in ("strong", "weak"):
                words[i], changed = word.casefold().replace(plain, plain[:2] + plain[3:]), True
        return " ".join(words) if changed else None

    @staticmethod
    def _features(n: int, found: list[tuple[int, str, float]]) -> list[float]:
        total = {"strong": 0.0, "weak": 0.0, "fuzzy": 0.0, "faint": 0.0}
        for _, group, weight in found:
            total[group] += weight
        out = [1.0]
        for group in total:
            out += [math.log1p(total[group]), 100 * total[group] / (n + 20)]
        return [*out, float(total["strong"] >= 0.5)]

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row of features for each text; a null text is empty."""
        return np.array([self._features(len(kinds), self._matches(kinds, quoted)) for kinds, quoted in self._kinds_of(texts)]).reshape(-1, len(FEATURES))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def learn_terms(texts: list[str], labels: list[int]) -> dict[str, tuple[bool, bool]]:
    """Words and word beginnings that toxic documents have far oftener: term -> (is a stem, is strong).

    Counted once a document and group of equal texts.  Of beginnings that nest, the
    longest with nearly the same documents stays if it is met as a whole word;
    otherwise the shortest that tells well.
    """
    toxic, clean = Counter(), Counter()
    whole_toxic: Counter = Counter()
    marked = {t: y for t, y in zip(texts, labels)}

    def words_in(text: str) -> set[str]:
        return {w for w in (_NORMAL[x] for x in text.split()) if len(w) >= SHORTEST and w.isalpha()}

    n_toxic = sum(1 for y in marked.values() if y)
    n_clean = len(marked) - n_toxic
    if not n_toxic or not n_clean:
        return {}
    for text in (t for t, y in marked.items() if y):
        words = words_in(text)
        toxic.update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)})
        whole_toxic.update(words)
    least = max(4, 0.02 * n_toxic)
    # only beginnings that enough toxic documents have are counted in clean ones; what begins them is among them too
    toxic = Counter({p: c for p, c in toxic.items() if c >= least})
    for text in (t for t, y in marked.items() if not y):
        heads = set()
        for w in words_in(text):
            for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                if w[:k] not in toxic:
                    break
                heads.add(w[:k])
        clean.update(heads)

    def ratio(p: str) -> float:
        return (toxic[p] / n_toxic) / ((clean[p] + 0.5) / n_clean)

    good = {p: ratio(p) for p in toxic if ratio(p) >= 4}
    out: dict[str, tuple[bool, bool]] = {}
    for p in sorted(good, key=len):
        if any(p[:k] in out for k in range(SHORTEST, len(p))) and good[p] < 4 * max(good.get(p[:k], 0) for k in range(SHORTEST, len(p)) if p[:k] in out):
            continue
        # a longer one with as many documents says the same more exactly
        if any(toxic[q] >= 0.95 * toxic[p] for q in good if len(q) == len(p) + 1 and q.startswith(p)):
            continue
        is_whole = whole_toxic[p] >= 0.8 * toxic[p]
        out[p] = (not is_whole, clean[p] <= 0.002 * n_clean)
    keep = sorted(out, key=lambda p: (-toxic[p] * math.log(good[p]), p))[:LEARNED_TERMS]
    return {p: out[p] for p in keep}


def known_words(texts: list[str], labels: list[int], terms: dict[str, tuple[bool, bool]]) -> frozenset[str]:
    """Words of clean documents that are an error away from a term."""
    trie = FuzzyTrie({t: stem for t, (stem, _) in terms.items()}, set(terms))
    near = Memo(lambda w: _NORMAL[w] if _NORMAL[w] and (trie.find(_NORMAL[w]) or (0,))[0] else None, 200_000, "toxicity")
    return frozenset(w for t, y in zip(texts, labels) if not y for w in map(near.__getitem__, t.split()) if w)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge on all weights but the first, none of which is below zero.

    A match never speaks for a text: the lowest weight is set to zero and the rest
    fitted again until none is negative.
    """
    held = list(range(x.shape[1]))
    while True:
        some, w = x[:, held], np.zeros(len(held))
        penalty = np.diag([1e-6] + [ridge] * (len(held) - 1))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            gradient = some.T @ (p - y) + penalty @ w
            hessian = (some * (p * (1 - p))[:, None]).T @ some + penalty + 1e-9 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        low = 1 + int(np.argmin(w[1:])) if len(w) > 1 else 0
        if not low or w[low] >= 0:
            out = np.zeros(x.shape[1])
            out[held] = w
            return out
        del held[low]


#: Weights where there is nothing to learn from: strong matches decide.
PLAIN_WEIGHTS = [-3.0, 4.0, 0.5, 1.0, 0.1, 1.0, 0.1, 0.0, 0.0, 2.0]


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Learn terms and weights from labelled rows that are not held out.

    The sample is the ``sample_rows`` labelled ids of least hash: a bound on what
    comes to the driver, whatever the corpus.  Weights are fitted with each half of
    the sample scored by terms learned from the other, so terms that only fit their
    own documents get no credit.

    Null ids and null labels are left out; a document labelled twice is toxic if one
    label says so; without both kinds of labels the fixed terms and plain weights
    are used.
    """
    return_blocks()
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = marked.where("crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = id_text(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = sorted({(r["doc_id"], r["text"] or "", r["toxic"]) for r in rows})
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=float)
    seeds = {t: (False, True) for t in SEED_TERMS}
    if not rows or y.min() == y.max():
        return Scorer(seeds, PLAIN_WEIGHTS)

    def learned(some: list[str], marks: list[int], weights: list[float]) -> Scorer:
        terms = seeds | learn_terms(some, marks)
        return Scorer(terms, weights, known_words(some, marks, terms))

    half = np.array([zlib.crc32(t.encode()) % 2 for t in texts])
    x = np.zeros((len(rows), len(FEATURES)))
    more, more_y = [], []
    for side in (0, 1):
        mine, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        scorer = learned([texts[i] for i in other], [int(y[i]) for i in other], PLAIN_WEIGHTS)
        copies = {i: scorer.misspelled(texts[i]) for i in mine}
        copies = {i: c for i, c in copies.items() if c is not None}
        for some, out in ((list(mine), x), (list(copies), None)):
            whole = [texts[i] for i in some] if out is not None else [copies[i] for i in some]
            for lo in range(0, len(some), 256):  # few texts are words at a time
                rows = scorer.features(pa.array(whole[lo : lo + 256], pa.string()))
                if out is not None:
                    out[some[lo : lo + 256]] = rows
                else:
                    more.append(rows)
                    more_y += [y[i] for i in some[lo : lo + 256]]
    x, fit_y = np.vstack([x, *more]), np.concatenate([y, more_y])
    model = learned(texts, [int(v) for v in y], fit_weights(x, fit_y).tolist())
    del rows, texts, scorer
    _NORMAL.clear()
    give_back()
    return model


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(terms: dict, weights: list[float], known: frozenset[str]) -> Scorer:
    key = (tuple(sorted(terms.items())), tuple(weights), known)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(terms, weights, known)
    return _SCORERS[key]


def score_documents(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    No shuffle; the model (a bounded list of terms and ten weights) goes with the
    tasks.  Null and empty texts have no match and the score of that.  Repeated rows
    each give a row; an empty table none.
    """
    terms, weights, known = model.terms, model.weights.tolist(), model.known

    def run(batches):
        claim("toxicity")
        tool = _scorer(terms, weights, known)
        for batch in (part for whole in batches for part in stretches(whole, 1)):
            keys, scores = batch.column(0).to_pylist(), tool.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([held_out(k) for k in keys], pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Scorer) -> DataFrame:
    """``docs`` without the rows scored THRESHOLD or more; all columns as they are.

    Null texts stay; repeated rows go or stay together; an empty table stays empty.
    """
    terms, weights, known = model.terms, model.weights.tolist(), model.known

    def run(batches):
        claim("toxicity")
        tool = _scorer(terms, weights, known)
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in stretches(whole, at):
                texts = batch.column(at)
                yield batch.filter(pa.array(np.asarray(texts.is_null()) | (tool.scores(texts) < THRESHOLD)))

    return docs.mapInArrow(run, docs.schema)


def op5_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_levenshtein_toxicity": op5_levenshtein_toxicity}
ORACLES: dict[str, str] = {}  # learned; tests measure held-out accuracy
