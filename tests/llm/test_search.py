"""Ranked search (13): against a score of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import registry, search

from .conftest import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=50):
    """Sorted (item_id, rank, doc_id, score); docs and items are (id, text) rows."""
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(docs, items, **kw):
    segment = kw.pop("segment_words", 300)
    return sorted(map(tuple, search.search(search.build_index(docs, segment_words=segment), items, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Few words met by most documents, so lists have many blocks and many scores are equal."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "x-y", "日本", "b_c", "42"]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 66])]) for _ in range(rng.choice([0, 1, 3, 8, 40])))) for i in range(1500)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 6, 20])))) for i in range(25)]
    return docs, items + [(90, None), (91, ""), (92, "unknown word!"), (93, "W1 w1 W1")]


@pytest.mark.parametrize("segment_words", [50, 3000, 1 << 21])
def test_against_all_scores(spark, corpus, segment_words):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert found(d, q, segment_words=segment_words) == brute(docs, items)
    assert found(d, q, segment_words=segment_words, top=3, pass_bytes=100) == brute(docs, items, 3)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = sorted(con.execute(registry.ORACLES["op13_block_max_wand"]).fetchall())
    got = sorted(map(tuple, registry.QUERIES["op13_block_max_wand"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()))
    assert len(got) > 50 and got == want


def test_odd_documents(spark, odd, clashing, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "same text here one"), (1, "same text here one"), (2, "x 1 日本"), (None, "same"), (3, " ".join(words(random.Random(9), 50).split()[:20]))]
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(3)).withColumn("score", F.lit(1))
    want = brute(rows, items)
    assert found(odd, q) == found(clashing, q) == want
    assert found(empty, q) == [] and found(odd, q.limit(0)) == [] and found(odd.where("text is null"), q) == []


def test_ties_go_by_id_with_null_last(spark):
    rows = [(i, "same words") for i in [5, 3, None, 9, 3, 1]]
    docs = spark.createDataFrame(rows + [(100 + i, "other things") for i in range(20)], "doc_id long, text string").repartition(4)
    got = found(docs, spark.createDataFrame([(1, "words")], "item_id long, text string"), segment_words=2)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [1, 3, 3, 5, 9, None]


@pytest.mark.parametrize("most", [0, 1, 6, 1000, 1 << 20])
def test_blocks_come_back(most):
    """Packing and unpacking of one block of any fill."""
    rng = np.random.default_rng(most)
    for size in (1, 7, 127, 128):
        values = rng.integers(0, most + 1, size)
        bits = search._bits(np.array([values.max()]))
        data, length = search._packed(values, np.zeros(size, int), np.arange(size), bits, np.array([size]))
        assert len(data) == length[0] == (size * bits[0] + 7) // 8
        assert search._unpacked(data, np.array([0]), int(bits[0]))[0, :size].tolist() == values.tolist()


def test_blocks_below_the_threshold_stay_packed():
    """A rare term in few documents decides; most blocks of the common one are never opened."""
    rng = random.Random(1)
    texts = ["common " * rng.randrange(1, 3) + "filler " * rng.randrange(30, 60) for _ in range(20_000)]
    for i in range(7000, 7080):
        texts[i] = "common rare " * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    terms_, bounds = search.terms_of(batch.column(1))
    coded = terms_.dictionary_encode()
    lengths = np.diff(bounds)
    segment = search._segment(0, coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(texts)), lengths), np.arange(len(texts)), np.zeros(len(texts), bool), lengths)
    lists = {r["term"]: search.Postings(r) for r in segment.to_pylist() if r["term"]}
    n, total = len(texts), int(lengths.sum())
    mine = [lists["common"], lists["rare"]]
    weights = [search.weight(p.df, n) for p in mine]
    tops = [p.greatest(w, search.length_cost(p.impact_len, n, total)) for p, w in zip(mine, weights)]
    slots, scores = search.best_slots(mine, weights, tops, search.length_cost(lengths, n, total), 50)
    assert slots.tolist() == list(range(7000, 7050)) and len(set(scores.tolist())) == 1
    assert len(mine[0].open) == 157 and mine[0].open.sum() <= 20


def test_impacts_bound_every_score_of_their_block():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 60))) for _ in range(900)]
    found_terms, bounds = search.terms_of(pa.array(texts))
    coded, lengths = found_terms.dictionary_encode(), np.diff(bounds)
    segment = search._segment(0, coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(900), lengths), np.arange(900), np.zeros(900, bool), lengths)
    for row in segment.to_pylist():
        if row["term"]:
            p = search.Postings(row)
            assert p.df == sum(row["term"] in t.split() for t in texts)
            for n, total in ((900, int(lengths.sum())), (10**6, 10**9)):
                top = p.greatest(7, search.length_cost(p.impact_len, n, total))
                p.decompress(np.arange(len(p.last)))
                cost = search.length_cost(lengths, n, total)
                for b, size in enumerate(p.sizes):
                    tf, slot = p.tfs[b, :size].astype(int), p.slots[b, :size]
                    assert [texts[s].split().count(row["term"]) for s in slot] == tf.tolist()
                    assert (7 * ((10**9 * tf) // (1000 * tf + 20 * cost[slot]))).max() == top[b]


