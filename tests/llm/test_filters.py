"""Decontamination (1), toxicity (5), sharding (7), personal data (9), URL rules (10), the pipeline and the entry point."""

import base64
import hashlib
import itertools
import os
import random
import re
import shutil
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from tickloom.llm import bpe, decontam, pii, registry, sharding, toxicity, url_rules

from .conftest import words
from .test_dedup import brute_lines, brute_near

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# -- 1 -------------------------------------------------------------------------

ITEM = "Alice has 3 apples and Bob has 12 kg of pears while Alice gives Bob 3 plums today. How many fruits are left in the big basket?"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(9, ITEM), (10, "short item"), (11, None), (12, ""), (13, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")


def leaked(spark, bench, *texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, bench, **kw).collect()}


def test_templates(spark, bench):
    rng = random.Random(1)
    noise = words(rng, 40)
    moved = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "7").replace("12", "40.5")
    mixed = "Carol has 7 apples and Dave has 40 kg of pears while Erin gives Frank 9 plums today. How many fruits are left in the big basket?"
    half = ITEM[: len(ITEM) // 2]
    got = leaked(spark, bench, f"{noise} {ITEM} {noise}", f"{noise}. {moved}", f"{noise}. {mixed}", noise, half, ITEM.upper(), "a short item here", "9 8 7 6 5 4 3 2 1 0")
    assert set(got) == {(0, 9), (1, 9), (5, 9)} or set(got) == {(0, 9), (1, 9)}
    assert got[0, 9].verbatim and not got[1, 9].verbatim and got[1, 9].slot_consistency == 1.0


def test_measured_cases(spark):
    """One name for six is no copy; a name that opens sentences may change; a short item is met inside."""
    six = "Anna met Bruno and Carla and Dieter near the old mill while Elena saw Fritz"
    opens = "Alice buys 12 apples at the market today. Alice then gives 4 of them away to a friend. Alice wants to know how many are left."
    items = spark.createDataFrame([(1, six), (2, opens), (3, "prime numbers below twenty")], "item_id long, text string")
    one = re.sub("Anna|Bruno|Carla|Dieter|Elena|Fritz", "Gustav", six)
    renamed = six.replace("Anna", "Gina").replace("Bruno", "Hugo").replace("Carla", "Ines").replace("Dieter", "Jens").replace("Elena", "Kira").replace("Fritz", "Lars")
    moved = opens.replace("Alice", "Zora").replace("12", "31").replace("4", "9")
    twice = f"{moved} And so on, it was said. {opens.replace('Alice', 'Yara').replace('12', '55').replace('4', '8')}"
    got = leaked(spark, items, one, renamed, f"well, {moved} done", twice, "the prime numbers below twenty are known", inside=True)
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 3)}
    assert not got[2, 2].verbatim and got[4, 3].verbatim


def brute_template(text):
    """(template word, plain word, is a slot) of each word with a letter or digit."""
    out, number_before = [], False
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        core = re.sub(r"^[\W_]+", "", word)
        core = re.sub(r"(?![%°])[\W_]+$", "", core) if not re.search(r"[%°][\W_]*$", core) else re.sub(r"([%°])[^\w%°]*$", r"\1", core)
        number = bool(re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*([a-z%°]{0,3})", core.lower()))
        if core:
            unit = core.lower() in decontam.UNITS and number_before
            name = not unit and core[0].isupper() and len(core) > 1 and core[1:].islower()
            out.append(("<n>" if number else "<u>" if unit else "<a>" if name else core.casefold(), core.casefold(), number or unit or name))
        number_before = number
    return out


def brute_leaks(docs, items, size=5, share=0.75, consistent=0.75):
    def grams(words, width, part):
        return [tuple(w[part] for w in words[i : i + width]) for i in range(len(words) - width + 1)] if width else []

    def consistency(pairs):
        n = Counter(pairs)
        if not n:
            return 1.0
        mine = {a: min((-c, decontam_hash(y), y) for (x, y), c in n.items() if x == a)[2] for a, _ in n}
        theirs = {b: min((-c, decontam_hash(x), x) for (x, y), c in n.items() if y == b)[2] for _, b in n}
        return sum(mine[a] == b and theirs[b] == a for a, b in n) / len(n)

    found = set()
    for k, text in items.items():
        item = brute_template(text)
        width = min(size, len(item))
        if not width:
            continue
        mine = [g if sum(not w[2] for w in item[i : i + width]) >= min(2, width) else None for i, g in enumerate(grams(item, width, 0))]
        for d, other in docs.items():
            doc = brute_template(other)
            plain = set(grams(item, width, 1))
            if len(plain & set(grams(doc, width, 1))) >= share * len(plain):
                found.add((d, k))
            there = grams(doc, width, 0)
            wanted = {g for g in mine if g}
            if not wanted or len(wanted & set(there)) < share * len(wanted):
                continue
            met = [(i, j) for i, g in enumerate(mine) if g for j, h in enumerate(there) if g == h]
            views = [met] + [[m for m in met if m[1] - m[0] == o] for o in {j - i for i, j in met}]
            views = [v for n, v in enumerate(views) if not n or len({mine[i] for i, _ in v}) >= share * len(wanted)]
            pairs = [[(item[i + s][1], doc[j + s][1]) for i, j in v for s in range(width) if item[i + s][2]] for v in views]
            if max(map(consistency, pairs)) >= consistent:
                found.add((d, k))
    return found


def decontam_hash(word):
    import xxhash

    h = xxhash.xxh3_64_intdigest(word.encode())
    return h - (1 << 64) if h >> 63 else h


def test_against_brute_force(spark):
    rng = random.Random(6)
    names, plain = ["Ann", "Ben", "Cleo", "Dora", "Emil", "Fay"], ["red", "fox", "ran", "to", "the", "sea", "and", "cat", "sat", "on"]
    word = lambda: rng.choice(names) if rng.random() < 0.2 else str(rng.randrange(30)) + rng.choice(["", " kg", " km,", "."]) if rng.random() < 0.25 else rng.choice(plain) + rng.choice(["", "", ".", ","])
    items = {k: " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 9, 14, 20]))) for k in range(40)}
    docs = {}
    for d in range(260):
        text = items[rng.randrange(40)].split()
        rename = {a: rng.choice(names) for a in names} if rng.random() < 0.5 else {}
        text = [rename.get(w, w) if rng.random() < 0.95 else word() for w in text]
        text = [str(rng.randrange(30)) if w.isdigit() and rng.random() < 0.3 else w for w in text if rng.random() < 0.97]
        docs[d] = " ".join([*[word() for _ in range(rng.randrange(9))], *text, *[word() for _ in range(rng.randrange(9))]])
        docs[d] = docs[d].upper() if rng.random() < 0.1 else docs[d]
    want = brute_leaks(docs, items)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for limit in (decontam.BROADCAST_WINDOWS, 0):
        got = leaked(spark, bench, *[docs[d] for d in range(260)], inside=True, broadcast_windows=limit)
        assert set(got) == want and 60 < len(want) < 10_000


def test_both_joins_agree(spark, bench):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    a = sorted(map(tuple, decontam.leaks(docs, benchmark).collect()))
    assert a == sorted(map(tuple, decontam.leaks(docs, benchmark, broadcast_windows=0).collect()))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in benchmark.collect() if " ".join(b.text.lower().split()) in " ".join(d.text.lower().split())}
    assert want <= {(r[0], r[2]) for r in a}


def test_short_and_slot_only_items(spark, bench):
    more = [(20, "Quite different"), (21, "one two three four"), (22, "Oslo 12 km Rome 40 km Bern 7 kg Paris 9 kg"), (23, "3 kg")]
    items = bench.unionByName(spark.createDataFrame(more, "item_id long, text string"))
    texts = ["this is Quite different from it", "a b one two three four c d e", "one two three four", "one two four three and more", "so far: oslo 12 km Rome 40 km Bern 7 kg Paris 9 kg and so on", "Oslo 40 km Rome 12 km Bern 9 kg Paris 7 kg", "it has 3 kg or so of it", "it has 4 kg or so of it", "x 1 2 3 4 5 6 7 8 9 y"]
    want = {(0, 20), (1, 21), (2, 21), (4, 22), (6, 23), (8, 13)}
    for limit in (decontam.BROADCAST_WINDOWS, 0):
        got = leaked(spark, items, *texts, inside=True, broadcast_windows=limit)
        assert set(got) == want and all(r.verbatim for r in got.values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in decontam.drop_leaks(docs, items).collect()} == {3, 5, 7}


def test_case_does_not_count(spark):
    item = "Anna Berg met Carl Dorn in Oslo where Emil Frost sold Greta Holm 3 old maps of Kiel and Lund for 40 euros"
    items = spark.createDataFrame([(1, item), (2, "Straße nach Kiel")], "item_id long, text string")
    texts = [f"so {case(item)} it" for case in (str, str.upper, str.lower, str.title)] + ["ab STRASSE NACH KIEL hin", "straße nach kiel"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (decontam.BROADCAST_WINDOWS, 0):
        got = decontam.leaks(docs, items, inside=True, broadcast_windows=limit).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]
        assert all(r.verbatim for r in got)


def test_leaks_of_odd_rows(odd, clashing, empty, bench):
    assert decontam.leaks(odd, bench).count() == decontam.leaks(clashing, bench).count() == decontam.leaks(empty, bench).count() == 0
    assert decontam.leaks(odd, bench.where("false")).count() == 0
    assert decontam.drop_leaks(clashing, bench).columns == clashing.columns
    assert decontam.drop_leaks(odd, bench).count() == odd.count()


# -- 5 -------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {"idiot": False, "moron": False, "worthless": False, "abc": False, "stem": True}
    trie = toxicity.FuzzyTrie(terms, {"idiot", "moron", "worthless", "abc"})
    rng = random.Random(2)
    for _ in range(4000):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "o", "t"])
        word = "".join(word)
        cost = {t: min(edits(word[:k], t) for k in range(len(word) + 1)) if stem else edits(word, t) for t, stem in terms.items()}
        near = {t: e for t, e in cost.items() if e <= (toxicity.allowed(t) if t in trie.fuzzy else 0)}
        got = trie.find(word)
        assert (got is None) == (not near)
        assert got is None or got[0] == min(near.values()) == near[got[1]]


def test_context_separates_quotation():
    tool = toxicity.Scorer({"idiot": (False, True)}, toxicity.PLAIN_WEIGHTS)
    weight = lambda text: [w for _, _, w in tool.matches(text)[1]]
    assert weight("this idiot again") == [1.0]
    assert weight("he said idiot once") == [0.25]
    assert weight('the word "idiot" is rude') == [0.25]
    assert weight("you are an idiot") == [1.5]
    assert weight("an idi0t and an idoit") == [1.0]
    assert tool.score("you are an idiot, idiot!") > tool.score('he wrote "idiot"') > 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted[got.toxic == 0] == 1).mean() < 0.01
    assert got.predicted[got.toxic == 1].mean() > 0.85
    assert got.score.between(0, 1).all()


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = [r for r in docs.join(labels, "doc_id").collect() if toxicity.held_out(r.doc_id) and r.text]
    return toxicity.train(docs, labels), rows


def test_verdicts_rest_on_the_automaton(trained):
    """Held-out toxic texts with each insult misspelt: found with errors allowed, lost without; clean ones stay clean."""
    model, rows = trained
    exact = toxicity.Scorer(model.terms, model.weights.tolist(), model.known, errors=False)
    assert (model.weights[1:] >= 0).all()
    copies = [(model.misspelled(r.text), r.toxic) for r in rows]
    toxic = [t for t, y in copies if t and y]
    assert len(toxic) > 80
    assert sum(model.score(t) >= toxicity.THRESHOLD for t in toxic) > 0.75 * len(toxic)
    assert sum(exact.score(t) >= toxicity.THRESHOLD for t in toxic) < 0.25 * len(toxic)
    clean = [r.text for r in rows if not r.toxic]
    assert sum(model.score(t) >= toxicity.THRESHOLD for t in clean) < 0.01 * len(clean)


def test_verdicts_rest_on_context(trained):
    """The same terms reported and quoted, and thrown at somebody, in one clean text: only the second is toxic."""
    model, rows = trained
    plain = [r.text.split() for r in rows if not r.toxic and 60 < len(r.text.split()) < 200 and not model.matches(r.text)[1]]
    assert len(plain) > 5
    for words in plain[:20]:
        text = lambda more: " ".join(words[:20] + more.split() + words[20:])
        assert model.score(text('he said "stupid idiot" once')) < toxicity.THRESHOLD <= model.score(text("you stupid idiot you"))


def test_score_against_brute_force(trained):
    """Matches by edit distance to every term, contexts by their definition, and the logistic score of both."""
    model, rows = trained
    errors = {}

    def best(word):
        if word not in errors:
            found = []
            for t, (stem, _) in model.terms.items():
                near = range(max(0, len(t) - 2), min(len(word), len(t) + 2) + 1) if stem else [len(word)]
                cost = min((edits(word[:k], t) for k in near if abs(k - len(t)) <= 2), default=9)
                if cost <= toxicity.allowed(t):
                    found.append((cost, t))
            least = min(found, default=(9, None))[0]
            errors[word] = {t for e, t in found if e == least}, least
        return errors[word]

    short = [r.text for r in rows if len(r.text.split()) < 150]
    for text in [r.text for r in rows if r.toxic and len(r.text.split()) < 150][:12] + short[:12]:
        words = text.split()
        n, found = model.matches(text)
        assert n == len(words)
        at = {i: (group, weight) for i, group, weight in found}
        for i, w in enumerate(words):
            plain = toxicity.normal(w)
            terms, e = best(plain) if plain and plain not in toxicity.REPORTING + toxicity.ADDRESSING else (set(), 9)
            if e and plain in model.known:
                terms = set()
            assert (i in at) == bool(terms), w
            if terms:
                assert at[i][0] in {("fuzzy" if e else "strong") if model.terms[t][1] else "faint" if e else "weak" for t in terms}
        total = {g: sum(w for _, k, w in found if k == g) for g in ("strong", "weak", "fuzzy", "faint")}
        x = [1.0] + [v for g in total for v in (np.log1p(total[g]), 100 * total[g] / (n + 20))] + [float(total["strong"] >= 0.5)]
        assert abs(1 / (1 + np.exp(-np.dot(x, model.weights))) - model.score(text)) < 1e-9


def test_toxicity_odd_rows(spark, odd, clashing, empty, same_rows):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (5, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    got = same_rows(lambda d: toxicity.score_documents(d, model), odd, clashing, empty)
    assert all(held == (zlib.crc32(str(d).encode()) % 3 == 1) and p == int(s >= 0.7) for d, held, s, p in got)
    assert toxicity.reject_toxic(clashing, model).columns == clashing.columns
    assert toxicity.train(empty, labels.where("false")).score("") < 0.5


def test_stems_are_met_with_an_error():
    terms = {"réeuxa": True, "bomente": True, "idiot": False, "abcd": True}
    trie = toxicity.FuzzyTrie(terms, set(terms))
    rng = random.Random(3)
    for _ in range(4000):
        word = list(rng.choice(list(terms)) + "".join(rng.choice("aeno") for _ in range(rng.randrange(4))))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "o", "t"])
        word = "".join(word)
        cost = {t: min(edits(word[:k], t) for k in range(len(word) + 1)) if stem else edits(word, t) for t, stem in terms.items()}
        near = {t: e for t, e in cost.items() if e <= toxicity.allowed(t)}
        got = trie.find(word)
        assert (got is None) == (not near)
        assert got is None or got[0] == min(near.values()) == near[got[1]]


def test_misspelled_learned_terms_count(spark):
    """A word and a stem that only labels tell of, in any language, are met with an error too; a known clean word is none."""
    rng = random.Random(6)

    def plain(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 8))) for _ in range(n))

    toxic = [f"{plain(30)} {rng.choice(['blorfig', 'zwackel' + rng.choice(['en', 'st', 'te'])])} {plain(9)}" for _ in range(200)]
    clean = [f"{plain(38)} zwacken" for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(toxic + clean))], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "blorfig" in model.terms and "zwacken" in model.known
    noise = plain(30)
    for word in ("blorfig", "blorfg", "blorxig", "bloorfig", "zwakkelst", "zwackelst"):
        assert model.score(f"{noise} {word}") >= toxicity.THRESHOLD, word
    for word in ("", "zwacken", "blxrfxg"):
        assert model.score(f"{noise} {word}") < toxicity.THRESHOLD, word


# -- 7 -------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards(odd, clashing, empty, same_rows, n):
    got = same_rows(lambda d: sharding.shard_by_bytes(d, n), odd, clashing, empty)
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, at, slots = sum(r[1] for r in want), 0, {}
    placed = []
    for doc, size, crc in want:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        placed.append((doc, size, crc, "bytes", shard, slots.setdefault(shard, 0), None, at))
        slots[shard] += 1
        at += size
    assert got == sorted(placed, key=str)


def test_shards_are_balanced(spark):
    got = sharding.op7_byte_prefix_shards(spark, "/root/testdata/sf0.01").toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and (sizes - sizes.mean()).abs().max() <= got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


# -- 9 -------------------------------------------------------------------------

GIVEN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def as_given(text):
    out = []
    for kind, pattern in GIVEN:
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns_as_given():
    rng = random.Random(0)
    parts = ["1", "22", ".", "@", "a", "+", " ", "-", "(", "555", "b.c", "4111111111111111", "@x.y", "é", "256", "0", "_", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        assert pii.base_spans(text) == as_given(text), repr(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_far_words_share_labels(field):
    text = "write to bob.smith7@mail.example.com today. Later bob.smith7 answered; call +1 (017) 555-7713 or, at night, 555-7713 please. Version 2.0 of 12 parts."
    base = pii.base_spans(text)
    found = {text[s:e]: k for s, e, k in field.added(text, base)}
    assert found.get("bob.smith7") == "email" and found.get("555-7713") == "phone"
    assert not any("2.0" in t or t == "12" for t in found)
    assert not any(s < b and a < e for s, e, _ in field.added(text, base) for a, b, _ in base)


def test_messages_equal_enumeration(field):
    """On a tree of ties, loopy passing gives the exact marginals."""
    text = "aa11aa11 then 5551234567 and aa11aa11"
    nodes = pii.tokens(text, [])
    edges = pii.ties(nodes)
    assert 0 < len(edges) < len(nodes)
    own = [field.unary(t) for t in nodes]
    n = len(pii.LABELS)
    total = np.zeros((len(nodes), n))
    for labels in itertools.product(range(n), repeat=len(nodes)):
        score = sum(own[i][k] for i, k in enumerate(labels)) + sum(field.tables[kind][labels[a], labels[b]] for a, b, kind in edges)
        for i, k in enumerate(labels):
            total[i, k] += np.exp(score)
    assert np.allclose(field.posteriors(nodes), total / total.sum(axis=1, keepdims=True), atol=2e-3)


def test_ties_recover_a_masked_mention(spark, field):
    """Of two mentions one is masked: the field finds its kind by the tie, and seldom without."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]' and length(text) <= 20000").collect()
    alone = pii.Field({k: v.tolist() for k, v in field.weights.items()}, (field.tables * np.array([1, 0, 0])[:, None, None]).tolist())
    met = right = right_alone = 0
    for r in rows:
        nodes = pii.tokens(r.text, pii.listed_spans(r.text))
        for _, b, kind in pii.ties(nodes):
            if kind != pii.CHAIN and nodes[b].label:
                met += 1
                right += field.posteriors(nodes, frozenset([b]))[b].argmax() == nodes[b].label
                right_alone += alone.posteriors(nodes, frozenset([b]))[b].argmax() == nodes[b].label
    assert met >= 20 and right >= 0.9 * met and right_alone <= 0.5 * met


def test_ties_of_far_words():
    nodes = pii.tokens("4845168114407329 x 4845-1681-1440-7329 y 4845168114407320 z 4845168114 w und.34@a.example v und.34 u 99999", [(61, 75, "email")])
    words = [t.core for t in nodes]
    kinds = {(words[a], words[b]): kind for a, b, kind in pii.ties(nodes)}
    assert kinds["4845168114407329", "4845-1681-1440-7329"] == pii.ALIKE
    assert any({a, b} == {"4845168114407329", "4845168114407320"} or {a, b} == {"4845-1681-1440-7329", "4845168114407320"} for a, b in kinds)
    assert not any("4845168114" in pair for pair in kinds)
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab1") for _ in range(rng.randrange(6))) for _ in range(2))
        near = a == b or any(a[:k] + a[k + 1 :] == b for k in range(len(a))) or any(b[:k] + b[k + 1 :] == a for k in range(len(b))) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
        assert pii.one_edit(a, b) == near, (a, b)


def test_repeats_are_found_by_their_ties(spark, tmp_path):
    """The registered query on documents in which mentions come again in another form, and strangers of the same form in others."""
    rng = random.Random(3)
    source = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows, planted = [], {}
    for r in source.collect():
        text, base = r.text, pii.base_spans(r.text or "")
        if base:
            start, end, kind = rng.choice(base)
            raw, digits = text[start:end], re.sub("[^0-9]", "", text[start:end])
            again = {"email": raw.split("@")[0], "card": ".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), "phone": raw.split()[-1]}.get(kind, "")
            repeat = rng.random() < 0.5
            if len(again) >= 5:
                if not repeat:
                    again = re.sub("[0-9]", lambda _: rng.choice("0123456789"), again)
                words_ = text.split(" ")
                at = rng.randrange(len(words_) // 2, len(words_)) + 1
                place = len(" ".join(words_[:at])) + 1
                text = " ".join([*words_[:at], again, *words_[at:]])
                planted[r.doc_id] = (repeat, kind, place, place + len(again))
        rows.append((r.doc_id, text))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def shares(found):
        got = {r.doc_id: [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)] for r in found.collect()}
        hit = {i: any(k == kind and s < end and start < e for k, s, e in got[i]) for i, (_, kind, start, end) in planted.items()}
        return [np.mean([hit[i] for i, p in planted.items() if p[0] == side]) for side in (True, False)]

    repeats, strangers = shares(registry.QUERIES["op9_skip_chain_pii"](spark, str(tmp_path)))
    assert len(planted) > 250 and repeats >= 0.9 and strangers <= 0.08, (repeats, strangers)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    alone = pii.train(docs)
    alone.tables[1:] = 0
    assert shares(pii.find_personal_data(docs, alone))[0] <= 0.3


def test_field_is_learned():
    """Without a mention met twice in the sample, far ties still pull labels together; without texts there is nothing."""
    field = pii.fit(["write to ann.7@mail.example.com now", "call +1 (017) 555-7713 or 12 of 30", 'key = "abc123def456abc123" and 7 more', "see 2.0000000 and 10.1.22.33 of 4111111111111111 and 4111111111111112"] * 20)
    for kind in (pii.EQUAL, pii.ALIKE):
        table = field.tables[kind]
        assert (table == table.T).all() and all(table[k, k] >= table[k, j] for k in range(len(table)) for j in range(len(table)))


def test_repeated_secret(field):
    text = 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" was set. Much later 9233a8ecf7c5b09fe5949719b6b82bc439e9329b was used.'
    listed = pii.listed_spans(text)
    assert [k for _, _, k in listed] == ["secret"]
    assert [(text[s:e], k) for s, e, k in field.added(text, listed)] == [("9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "secret")]
    for no in ('x = "abcdefghijklmnopqrst"', 'x = "12345678901234567890"', 'x "abc123def456abc123"', 'x = "abc123"'):
        assert not pii.listed_spans(no) or pii.listed_spans(no)[0][2] != "secret"


def test_personal_data_rows(field, odd, clashing, empty, same_rows):
    got = same_rows(lambda d: pii.find_personal_data(d, field), odd, clashing, empty, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for r in odd.collect():
        base = as_given(r.text or "")
        kinds = [k for _, _, k in base]
        want.append((r.doc_id, *(kinds.count(k) for k in pii.KINDS[:4]), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pii.train(empty).weights == {}


# -- 10 ------------------------------------------------------------------------


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    blocked = any(re.search(r"(^|[.-])" + re.escape(r.name) + r"($|[.-])", host) for r in url_rules.LABEL_RULES)
    return host, path, None, "block" if blocked else "allow"


URLS = [
    None, "", "no scheme", "http://", "://", "https://A.Example.COM/en/7x?q#f", "http://com/en/", "http://xcom/en/", "http://a.com?x=/en/", "http://a.net/de/8", "http://b.example.net/de/81", "http://org/es/1", "http://spam-farm.example.org/en/1",
    "http://www.spam-farm.net/de/2", "http://x.net/spam-farm", "http://casino-winx.net/", "http://a.com/EN/1", "ftp://u:p@example.com:80/en/7", "http://example.com/en/7#://", "http://a.net/de/\n8",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string").selectExpr("*", "1 as target", "'x' as token", "'y' as rule", "'z' as host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.url_verdicts(df, url_rules.BASE_RULES + url_rules.LABEL_RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate([*URLS, URLS[5]])}
    assert url_rules.url_verdicts(df.where("false"), url_rules.BASE_RULES).count() == 0
    with pytest.raises(ValueError, match="literal"):
        url_rules.url_verdicts(df, [url_rules.Rule("x", "block", ".*", (), False, 1)])


@pytest.mark.parametrize("most", [200_000, 0])
def test_many_rules_from_a_file(spark, tmp_path, monkeypatch, most):
    """10,000 rules of a file against comparing every rule; long URLs, ties, comments and rules of hosts alone."""
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", most)
    rng = random.Random(10)
    names = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    listed = {}
    for _ in range(12_000):
        host = ".".join(rng.choice(names) for _ in range(rng.randrange(1, 4)))
        path = rng.choice(["", f"/{rng.choice(names)}/", f"/{rng.choice(names)}/{rng.randrange(50)}", "/a.b/x"])
        listed.setdefault((host, path), rng.choice(["block", "allow"]))
    assert len(listed) > 10_000
    lines = ["! a comment", "/not/a/rule", "##.banner", *[f"{'@@' if v == 'allow' else ''}||{h}{p or rng.choice(['', '^'])}" for (h, p), v in listed.items()]]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    rules = url_rules.read_rules(spark, str(tmp_path / "list.txt"))
    assert rules.count() == len(listed)
    urls = [f"http://{'.'.join(rng.choice(names) for _ in range(rng.randrange(1, 5)))}/{rng.choice(names)}/{rng.randrange(60)}" for _ in range(300)]
    urls += [f"https://X.{h.upper()}{p}tail?q" for h, p in list(listed)[:60]] + [f"http://{names[0]}.{names[1]}/" + "y" * 200_000, None, "no url", "http://" + list(listed)[0][0]]
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, url in enumerate(urls):
        host, path = (re.match(r"[^:]*://([^/?#]*)([^?#]*)", url).groups() if url and "://" in url else ("", ""))
        host = host.lower()
        ends = {".".join(host.split(".")[k:]) for k in range(host.count(".") + 1)}
        fits = [(-len(h + p), h + p, listed[h, p]) for h, p in listed if h in ends and path.startswith(p)]
        want = min(fits)[1:] if fits else (None, "allow")
        assert got[i] == want, url


# -- all -----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.execute(f"create view {table[:-8]} as select * from '{sf}/{table}'")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda f: sorted([tuple(None if v is None or v != v else v for v in r) for r in f[columns].itertuples(index=False, name=None)], key=str)
    assert plain(got) == plain(want)


def test_pipeline_runs_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    now = docs.cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf).cache()
        assert after.dtypes == docs.dtypes and 0 < after.count() <= now.count()
        now = after
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_against_brute_force(spark, sf):
    """All five stages restated one after the other over whole texts."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    left = {d: t for d, t in docs.items() if t is None or model.score(t) < toxicity.THRESHOLD}
    assert 0 < len(left) < len(docs)
    lines = dict(brute_lines([(d, 0, t) for d, t in left.items()]))
    left = {d: t for d, t in lines.items() if t == left[d] or re.search(r"[^ \t-\r]", t)}
    near = {d: (n, c) for d, n, c in brute_near(list(left.items()))}
    left = {d: t for d, t in left.items() if near[d][1] in (d, None)}
    leaking = {d for d, _ in brute_leaks({d: t or "" for d, t in left.items()}, items)}
    assert leaking
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in left.items():
        if d not in leaking:
            ids = tokens.encode_ordinary(t or "")
            want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_pipeline_catches_what_is_planted(spark, sf, tmp_path):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("labels", "benchmark"))
    item = benchmark.first().text
    clean = {1000 + i: words(rng, 90) for i in range(5)}
    near = clean[1000].split()
    near[3] = "changed"
    passage = "\n" + words(rng, 55) + "\n"
    planted = {**clean, 2000: clean[1001], 2001: " ".join(near), 2002: f"{words(rng, 60)} {item} {words(rng, 20)}", 2003: words(rng, 40) + " idiot moron scum " + words(rng, 40), 2004: words(rng, 30) + passage + words(rng, 30), 2005: words(rng, 30) + passage + words(rng, 30)}
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted.items()], docs.schema)
    docs.unionByName(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(clean) | {2004, 2005} <= set(got) and not {2000, 2001, 2002, 2003} & set(got)
    assert got[2005] < got[2004] * 0.7  # the second copy of the passage is gone


def test_rest_works_without_these(tmp_path):
    """The driver deletes the subpackage, its tests and the pipeline."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    (copy / "tickloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)}, timeout=120)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf, odd, clashing, empty, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, empty, sf).count() == 0
    whole, wide = run(spark, odd, sf), run(spark, clashing, sf)
    if stage != "bpe":
        assert whole.columns == odd.columns and wide.columns == clashing.columns
    assert whole.count() == wide.count() > 0
