"""Line dedup (4) and near-dedup (6)."""

import hashlib
import itertools
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import common, line_dedup, near_dedup
from tickloom.llm.common import connected_components
from tickloom.llm.shingles import shingle_set
from tickloom.operators import lineage

from .conftest import SCHEMA, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abé"))
        elif out:
            at = min(at, len(out) - 1)
            out[at : at + 1] = [] if kind == 1 else [rng.choice("abé")]
    return "".join(out)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 40)))
        pairs.append((a, edited(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("t", F.expr(line_dedup.trim_common("a", "b", "encode(a, 'UTF-32')", "encode(b, 'UTF-32')")))
    whole, trimmed = line_dedup.banded_distance("a", "b", threshold), line_dedup.banded_distance("t.x", "t.y", threshold)
    got = df.select("a", "b", F.expr(whole).alias("d"), F.expr(f"if({line_dedup.may_be_near('t.x', 't.y', threshold)}, {trimmed}, 99)").alias("e")).collect()
    for r in got:
        true = distance(r.a, r.b)
        assert (r.d == true or true > threshold) and (r.d <= threshold) == (true <= threshold)
        assert (r.e <= threshold) == (true <= threshold)


@pytest.mark.parametrize("threshold", [1, 2])
def test_edit_links_miss_nothing(spark, threshold):
    rng = random.Random(21)
    lines = set()
    for _ in range(60):
        base = words(rng, rng.randrange(4, 14))
        lines |= {base} | {edited(rng, base, rng.randrange(1, 5)) for _ in range(4)}
    lines = sorted(lines)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.unhex(F.md5("line")).alias("line_id"), "line", F.char_length("line").alias("chars"))
    links, _ = line_dedup.edit_links(df, threshold)
    name = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got = {tuple(sorted((name[bytes(r.a)], name[bytes(r.b)]))) for r in links.collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(lines, 2) if abs(len(p[0]) - len(p[1])) <= threshold and distance(*p) <= threshold}
    assert got == want and want


def within(a, b, threshold):
    """Whether two strings are so few edits apart; counts of letters tell most of them apart."""
    if abs(len(a) - len(b)) > threshold:
        return False
    x, y = Counter(a), Counter(b)
    return sum((x - y).values()) <= threshold and sum((y - x).values()) <= threshold and distance(a, b) <= threshold


def components(pairs):
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in pairs:
        group[find(a)] = find(b)
    out = {}
    for x in group:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("threshold", [1, 2])
def test_hot_segments_lose_no_link(spark, threshold, monkeypatch):
    """Every segment with two lines counts as hot: the components stay those of all links, down to lines of a few characters."""
    monkeypatch.setattr(line_dedup, "HOT", 0)
    rng = random.Random(22)
    lines = set()
    for _ in range(14):
        base = words(rng, rng.randrange(2, 9))
        lines |= {base} | {edited(rng, base, rng.randrange(1, 4)) for _ in range(12)}
    middle = "x" * 30
    lines |= {words(rng, 3) + middle + words(rng, 3) for _ in range(30)} | {"".join(rng.choice("abc") for _ in range(rng.randrange(threshold + 1, 7))) for _ in range(60)}
    lines = sorted(x for x in lines if len(x) > threshold)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.unhex(F.md5("line")).alias("line_id"), "line", F.char_length("line").alias("chars"))
    name = {hashlib.md5(x.encode()).digest(): x for x in lines}
    got = {tuple(sorted((name[bytes(r.a)], name[bytes(r.b)]))) for r in line_dedup.edit_links(df, threshold)[0].collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(lines, 2) if abs(len(p[0]) - len(p[1])) <= threshold and distance(*p) <= threshold}
    assert got <= want and components(got) == components(want)


def test_a_common_middle_makes_no_pairs(spark):
    rng = random.Random(23)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(30)) + "common middle of them all, as long as" + "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), F.char_length("line").alias("chars"), "line", F.expr(line_dedup.counts("line")).alias("c"))
    places = line_dedup.look_ups(2)
    filed = line_dedup.segment_rows(df, [p for p in places if p[0] == 0 and p[2] == 0], 2).select("key", F.col("h").alias("hb")).join(df.selectExpr("h as hb", "c as cb"), "hb")
    looked = line_dedup.segment_rows(df, places, 2).select("key", "gap", F.col("h").alias("ha")).join(df.selectExpr("h as ha", "c as ca"), "ha")
    assert looked.join(filed, "key").where("gap = 0 and ha < hb").count() >= 2000 * 1999 // 2
    assert line_dedup._meetings(looked, filed, df, 2)[0].count() < 100


def test_numbered_lines_are_one_star(spark):
    """Lines that differ in a running number only: links grow with the lines, not with their pairs; classes as by brute force on a part."""
    made = [f"Read the full archive entry of this site under number {i:05d} today" for i in range(20_000)]
    frame = lambda lines: spark.createDataFrame([(x,) for x in lines], "line string").select(F.unhex(F.md5("line")).alias("line_id"), "line", F.char_length("line").alias("chars"))
    links = line_dedup.edit_links(frame(made), 2)[0].distinct()
    assert len(made) - 1 <= links.count() <= 12 * len(made)
    some = connected_components(links, "a", "b")
    assert some.count() == len(made) and some.select("root").distinct().count() == 1
    # sparse numbers make several classes
    rng = random.Random(8)
    sparse = [f"Read the full archive entry of this site under number {i:07d} today" for i in rng.sample(range(10**7), 150)] + [f"Read the full archive entry of this site under number {i} today" for i in range(150)]
    name = {hashlib.md5(x.encode()).digest(): x for x in sparse}
    got = {tuple(sorted((name[bytes(r.a)], name[bytes(r.b)]))) for r in line_dedup.edit_links(frame(sparse), 2)[0].collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(sparse, 2) if abs(len(p[0]) - len(p[1])) <= 2 and distance(*p) <= 2}
    assert got <= want and components(got) == components(want)


def test_sure_links_are_within_two_edits_and_tie_all_that_share_a_rest(spark):
    rng = random.Random(31)
    lines = sorted({edited(rng, base, rng.randrange(0, 3)) for base in ("aabbccddee", "a short line", "日本語のテキスト🙂") for _ in range(60)})
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), F.char_length("line").alias("chars"), "line")
    name = {r.h: r.line for r in df.collect()}
    got = {tuple(sorted((name[r.ha], name[r.hb]))) for r in line_dedup.sure_links(df).collect()}
    rests = lambda x: {x, *[x[:k] + x[k + 1 :] for k in range(len(x))]}
    share = {tuple(sorted(p)) for p in itertools.combinations(lines, 2) if rests(p[0]) & rests(p[1])}
    assert all(distance(*p) <= 2 for p in share) and got <= share and components(got) == components(share)



def brute_lines(docs, threshold=2, least=1, near_least=24):
    """doc rows -> text left, by comparing all lines."""
    def word(x):
        return re.search(r"[^ \t-\r]", x)

    occ = [((d if d is not None else -1, v, n), x) for d, v, t in docs if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= least and word(x)]
    first = {}
    for place, x in sorted(occ):
        first.setdefault(x, place)
    near = [x for x in first if len(x) >= near_least]
    group = {x: x for x in near}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(near, 2):
        if within(a, b, threshold):
            group[find(a)] = find(b)
    lead = {}
    for x in near:
        lead[find(x)] = min(lead.get(find(x), first[x]), first[x])
    out = []
    for d, v, t in docs:
        if t is None:
            out.append((d, None))
            continue
        keep = [x for n, x in enumerate(t.split("\n")) if not (len(x) >= least and word(x)) or (d if d is not None else -1, v, n) == (lead[find(x)] if x in group else first[x])]
        out.append((d, "\n".join(keep)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(6)
    shared = words(rng, 55) + "."
    base = [words(rng, 12) for _ in range(6)]
    rows = []
    for i in range(40):
        mine = [words(rng, 10) for _ in range(3)] + [edited(rng, rng.choice(base), rng.randrange(3))]
        if i % 3 == 0:
            mine.append(shared)
        rng.shuffle(mine)
        rows.append((i, "\n".join([*mine, "", "short", "  "]), "en", "s", 1))
    return spark.createDataFrame([*rows, (None, shared, "en", "s", 1), (90, None, "en", "s", 1), (91, "", "en", "s", 1), (92, shared, "en", "s", 1), (92, shared, "en", "s", 1)], SCHEMA)


@pytest.mark.parametrize("most", [500_000, -1])
def test_line_dedup_equals_brute_force(passages, most, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)  # -1: every join shuffles
    docs = [(r.doc_id, r.v, r.text) for r in passages.select("doc_id", F.xxhash64("text").alias("v"), "text").collect()]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(passages).collect()), key=str)
    assert got == brute_lines(docs)


@pytest.mark.parametrize(("least", "near_least"), [(1, 3), (10, 24), (40, 40)])
def test_line_limits(passages, least, near_least):
    """All lines, near ones from three characters on; and other limits."""
    docs = [(r.doc_id, r.v, r.text) for r in passages.select("doc_id", F.xxhash64("text").alias("v"), "text").collect()]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(passages, min_chars=least, near_min_chars=near_least).collect()), key=str)
    assert got == brute_lines(docs, least=least, near_least=near_least)


def test_line_dedup_stage(passages):
    left = line_dedup.drop_repeated_lines(passages)
    assert left.columns == passages.columns
    ids = [r.doc_id for r in left.collect()]
    assert 92 not in ids and {90, 91} <= set(ids)  # nothing is left of 92; 90 and 91 had no word before


def test_line_dedup_odd_rows(odd, clashing, empty, same_rows):
    got = same_rows(line_dedup.dedup_lines, odd, clashing, empty, "doc_id", "n_lines", "n_exact", "n_near")
    assert len(got) == odd.count()
    assert line_dedup.drop_repeated_lines(clashing).columns == clashing.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(200, 200), (50, 51), (51, 50)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{x: 100 for x in range(100, 140)}, 50: 50, 51: 50}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_shuffled_or_broadcast(spark):
    """Minima that are joined by a shuffle give the same roots; small tables of pairs are not read in as many parts as were shuffled."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(180)], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = common.connected_components(edges)
        few = sorted(map(tuple, out.collect()))
        assert few == sorted(map(tuple, common.connected_components(edges, broadcast_pairs=0).collect()))
        assert out.where("node > root").rdd.getNumPartitions() < 64 + 32
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stages_leave_only_their_own_table(spark, odd):
    """What a stage has made on the way is gone when it is planned, whoever calls it."""
    folder = Path(lineage.fresh_path(spark, "x")).parent
    for stage in (line_dedup.drop_repeated_lines, near_dedup.keep_one_of_each):
        cuts = lambda: {p for p in folder.glob("cuts/*/rdd-*")}
        was, made = set(folder.iterdir()), cuts()
        left = stage(odd)
        assert len(set(folder.iterdir()) - was) == 1 and not cuts() - made
        assert left.count() > 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 20, 500, 5000):
        items = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert len(set(near_dedup.fast_sketch(items).tolist())) > 100
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for share in (0.3, 0.75):
        k = int(1000 * 2 * share / (1 + share))
        agree = []
        for t in range(30):
            b = np.concatenate([a[:k], rng.integers(0, 2**63, 1000 - k, dtype=np.uint64)])
            agree.append((near_dedup.fast_sketch(a) == near_dedup.fast_sketch(b)).mean())
            a = rng.permutation(a) if t % 2 else rng.integers(0, 2**63, 1000, dtype=np.uint64)
        assert abs(np.mean(agree) - k / (2000 - k)) < 0.05


def test_one_shingle_set_gives_equal_sketches():
    items = shingle_set("A b c d e f g")
    assert (near_dedup.fast_sketch(items) == near_dedup.fast_sketch(items[::-1].copy())).all()


def brute_near(docs):
    sets = []
    for _, text in docs:
        raw = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", raw)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        ids = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(ids, default=None)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


@pytest.fixture(scope="module")
def variants(spark):
    """A hub and many variants that are linked through it or through each other, exact copies, chains and strangers."""
    rng = random.Random(12)
    hub = words(rng, 120).split()
    rows = []

    def change(base, k):
        out = list(base)
        for _ in range(k):
            out[rng.randrange(len(out))] = words(rng, 1)
        return out

    for _ in range(70):
        rows.append(" ".join(change(hub, rng.randrange(0, 12))))
    chain = hub
    for _ in range(8):
        chain = change(chain, 3)
        rows.append(" ".join(chain))
    rows += [" ".join(hub).upper(), " ".join(hub)] * 5
    rows += [words(rng, rng.randrange(1, 60)) for _ in range(60)]
    rows += ["one two", "One two", "one two three", "", None, " \n "]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("block", [1024, 8])
def test_near_dedup_equals_brute_force(variants, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = [(r.doc_id, r.text) for r in variants.collect()]
    got = near_dedup.near_duplicates(variants)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_near(docs)
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def test_near_dedup_without_broadcast(variants):
    a = sorted(map(tuple, near_dedup.near_duplicates(variants).collect()), key=str)
    assert a == sorted(map(tuple, near_dedup.near_duplicates(variants, broadcast_rows=0).collect()), key=str)


def test_near_dedup_odd_rows(odd, clashing, empty, same_rows):
    got = same_rows(near_dedup.near_duplicates, odd, clashing, empty, "doc_id", "n_shingles", "component_id", "kept")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted([g[:3] for g in got], key=str) == brute_near(docs)
    assert near_dedup.keep_one_of_each(clashing).columns == clashing.columns


def test_stage_keeps_one_of_each(variants):
    left = near_dedup.keep_one_of_each(variants)
    want = {d for d, _, c in brute_near([(r.doc_id, r.text) for r in variants.collect()]) if d == c}
    assert {r.doc_id for r in left.collect()} == want


def test_crowded_segments_are_joined_in_plans_of_their_own(spark):
    """The driver builds all broadcasts of a plan at a time, so those of the turns may not be in the plan of the comparison."""
    rows = [(i, f"{i:04d} one boilerplate middle that a great many of these lines have {'abcdefghij'[i % 10]}{i * 7919 % 10007:05d}") for i in range(300)]
    lines = spark.createDataFrame(rows, "line_id long, line string").withColumn("chars", F.char_length("line"))
    plan = line_dedup.edit_links(lines, 2)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 12
