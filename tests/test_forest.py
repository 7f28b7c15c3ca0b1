"""Trees and clusterings fitted together are those fitted alone, in as many jobs for many as for few."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import build, forest, phases, selection, stats


def plain_tree(rows, width, depth, least):
    """The same rules on lists: rows of (x, y, at)."""
    counts, first = {}, {}
    for _, y, at in rows:
        counts[y] = counts.get(y, 0) + 1
        first[y] = min(first.get(y, at), at)
    node = forest.Node(min(counts, key=lambda c: (-counts[c], first[c])), counts)
    if depth == 0 or len(counts) < 2 or len(rows) < 2 * least:
        return node
    best = (float("inf"), None)
    gini = lambda part: 1 - (np.array([sum(r[1] == c for r in part) / len(part) for c in sorted(counts)]) ** 2).sum()

    def quantile(values, p):
        place = (len(values) - 1) * p
        lo, hi = math.floor(place), math.ceil(place)
        return values[lo] if values[lo] == values[hi] else (hi - place) * values[lo] + (place - lo) * values[hi]

    for f in range(width):
        values = sorted(r[0][f] for r in rows if r[0][f] is not None)
        for t in sorted({quantile(values, p) for p in forest.DECILES}) if values else []:
            left = [r for r in rows if r[0][f] is not None and r[0][f] <= t]
            right = [r for r in rows if not (r[0][f] is not None and r[0][f] <= t)]
            if min(len(left), len(right)) >= least:
                score = (len(left) * gini(left) + len(right) * gini(right)) / len(rows)
                if score < best[0]:
                    best = (score, (f, t, left, right))
    if best[1]:
        node.feature, node.threshold, left, right = best[1]
        node.left, node.right = plain_tree(left, width, depth - 1, least), plain_tree(right, width, depth - 1, least)
    return node


def walk(node, x):
    while node.feature is not None:
        v = x[node.feature]
        node = node.left if v is not None and v <= node.threshold else node.right
    return node.prediction


@pytest.fixture(scope="module")
def models():
    rng = random.Random(3)
    rows = []
    for model in range(6):
        for i in range(90 + 10 * model):
            x = [round(rng.random() * 8, 2), float(rng.randrange(3)), None if rng.random() < 0.1 or model == 4 else rng.random()]
            y = -1 if rng.random() < 0.05 else int(x[0] > 3 + model / 2) + int(x[1] == 2)
            rows.append((model, x, y, i))
    rows += [(9, [1.0, 1.0, 1.0], 2, i) for i in range(20)]
    return rows


def test_many_trees_are_those_grown_alone(spark, models):
    df = spark.createDataFrame(models, "model long, x array<double>, y int, at long").repartition(3)
    got = forest.fit_forest(df, 3, 4, 3)
    assert set(got) == {0, 1, 2, 3, 4, 5, 9} and got[9].feature is None
    for model, tree in got.items():
        assert tree == plain_tree([(x, y, at) for m, x, y, at in models if m == model], 3, 4, 3)
    said = {(r.model, r.at): r.prediction for r in forest.forest_predictions(df, got).collect()}
    assert said == {(m, at): walk(got[m], x) for m, x, _, at in models}
    assert max(t.depth() for t in got.values()) == 4


def test_jobs_depend_on_the_depth_alone(spark, models):
    df = spark.createDataFrame(models, "model long, x array<double>, y int, at long").persist()
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, rows):
        spark.sparkContext.setJobGroup(name, "")
        forest.fit_forest(rows, 3, 2, 3)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs("trees-1", df.where("model = 0")) == jobs("trees-7", df) > 0
    df.unpersist()


def wide(spark, groups, n=40):
    rng = random.Random(groups)
    rows = [(f"r{i % 4}", None if i % 50 == 49 else f"w{i % groups}", "0", float(i // 4), i, "train" if i % 5 else "test", i % 5 > 0, rng.random() * 10 + (i // groups) % 3 * 9, rng.random() * 5 + (i // groups) % 3 * 20, None if i % 9 == 0 else rng.random()) for i in range(n * groups)]
    return spark.createDataFrame(rows, "run_id string, workload string, cpu_or_core_id string, timestamp_ms double, row_index long, split string, is_train boolean, counter__instructions_retired double, counter__llc_misses double, counter__l2_misses double")


COLUMNS = ["counter__instructions_retired", "counter__llc_misses", "counter__l2_misses"]


def test_each_workload_is_clustered_as_if_alone(spark):
    df = wide(spark, 3)
    states, learned = build.scoped_states(df, "per_workload", COLUMNS)
    got = {r.row_index: r.state for r in states.collect()}
    assert [x["workload"] for x in learned] == ["w0", "w1", "w2"] and len(got) == 120
    for x in learned:
        alone, own = phases.phase_states(df.where(F.col("workload") == x["workload"]), COLUMNS)
        assert {r.row_index: r.state for r in alone.collect()}.items() <= got.items()
        assert np.allclose(own["centroids"], x["centroids"])
    assert {s for i, s in got.items() if i % 50 == 49} == {-1} and set(got.values()) == {-1, 0, 1, 2}


def test_jobs_do_not_depend_on_workloads_or_seeds(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, "")
        run()
        return len(tracker.getJobIdsForGroup(name))

    few, many = wide(spark, 2).persist(), wide(spark, 60).persist()
    by_workload = [jobs(f"phases-{k}", lambda df=df: build.scoped_states(df, "per_workload", COLUMNS, most_rounds=2)[0].collect()) for k, df in enumerate((few, many))]
    by_seed = [jobs(f"seeds-{n}", lambda n=n: stats.stability(few, COLUMNS, [2, 3], list(range(n)), most_rounds=2)) for n in (2, 6)]
    assert abs(by_workload[0] - by_workload[1]) <= 2 and abs(by_seed[0] - by_seed[1]) <= 2


def test_ablation_takes_as_many_jobs_for_more_counters(spark):
    tracker = spark.sparkContext.statusTracker()
    df = wide(spark, 2, 60).withColumn("state", (F.col("row_index") % 3).cast("int")).persist()

    def jobs(name, families):
        spark.sparkContext.setJobGroup(name, "")
        rows = selection.ablation(df, families=families, max_depth=1).collect()
        return len(tracker.getJobIdsForGroup(name)), len(rows)

    one, some = jobs("ablation-1", {"LLC": ["llc_misses"]}), jobs("ablation-3", {"LLC": ["llc_misses"], "L2": ["l2_misses"], "core_fp": ["instructions_retired"]})
    # a job more or less is the adaptive planner's
    assert (one[1], some[1]) == (1, 3) and abs(one[0] - some[0]) <= 2
    df.unpersist()


def test_stability_against_the_operators_of_one_pair(spark):
    df = wide(spark, 2)
    got = {r["k"]: r for r in stats.stability(df, COLUMNS, [2, 3], [1, 2, 3])}
    for k in (2, 3):
        labels = [phases.phase_states(df, COLUMNS, k, s, f"s{s}")[0].select("row_index", f"s{s}") for s in (1, 2, 3)]
        joined = labels[0].join(labels[1], "row_index").join(labels[2], "row_index")
        rand = [stats.adjusted_rand(joined, f"s{a}", f"s{b}").first()[0] for a, b in ((1, 2), (1, 3), (2, 3))]
        assert (got[k]["ari_mean"], got[k]["ari_min"]) == pytest.approx((np.mean(rand), min(rand)))


def test_nothing_to_cluster(spark):
    df = wide(spark, 2)
    states, learned = build.scoped_states(df.withColumn("is_train", F.lit(False)), "per_workload", COLUMNS)
    assert {r.state for r in states.collect()} == {-1} and [x["clusters"] for x in learned] == [0, 0]
    states, learned = build.scoped_states(df.where("false"), "per_workload", COLUMNS)
    assert states.count() == 0 and learned == []
