"""Hashed draws, the bootstrap, ranks and Kendall's coefficient against plain restatements."""

import bisect
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.scalars import hashed_uniform
from tickloom.operators import sequences, stats

SCHEMA = "run_id string, target int, prediction int, second_prediction int, state int"


def uniform(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 2**52


@pytest.fixture(scope="module")
def answers(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{rng.integers(9)}", *map(int, rng.integers(0, 3, 4))) for _ in range(300)]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("first_prediction", F.col("prediction"))


def test_hashed_numbers(spark):
    got = spark.range(200).select("id", hashed_uniform(7, F.col("id"), "x").alias("u")).collect()
    assert all(r.u == uniform(7, r.id, "x") for r in got) and 0.4 < np.mean([r.u for r in got]) < 0.6


def test_bootstrap_against_plain_resampling(answers):
    """The same draws, counted row by row."""
    rows, df = answers
    names = sorted({r[0] for r in rows})
    n = len(names)

    def samples(seed):
        for r in range(40):
            drawn = [names[math.floor(uniform(seed, r, i) * n)] for i in range(n)]
            yield [row for g in drawn for row in rows if row[0] == g]

    accuracy = [np.mean([r[1] == r[2] for r in s]) for s in samples(17)]
    moved = [np.mean([r[1] == r[2] for r in s if r[1] != r[4]]) for s in samples(17)]
    got = stats.bootstrap_intervals(df, "run_id", resamples=40)
    assert (got["groups"], got["resamples"]) == (n, 40)
    for name, values in (("accuracy", accuracy), ("transition_accuracy", moved)):
        assert (got[f"{name}_low"], got[f"{name}_high"]) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
    gaps = [np.mean([(r[1] == r[2]) - (r[1] == r[3]) for r in s]) for s in samples(29)]
    found = stats.bootstrap_difference(df, "run_id", resamples=40)
    assert found["accuracy_difference"] == pytest.approx(np.mean(gaps))
    assert found["accuracy_difference_above_zero"] == pytest.approx(np.mean([g > 0 for g in gaps]))


def test_poisson_counts(answers):
    """Each group counts as often as Poisson's distribution says of its number."""
    rows, df = answers
    names = sorted({r[0] for r in rows})

    def times(u):
        k, chance, below = 0, math.exp(-1), math.exp(-1)
        while u >= below:
            k += 1
            chance /= k
            below += chance
        return k

    got = {r.resample: r.accuracy for r in stats.bootstrap_scores(df, "run_id", resamples=30, seed=5, scheme="poisson").collect()}
    for r in range(30):
        weights = {g: times(uniform(5, r, g)) for g in names}
        assert got[r] == pytest.approx(np.average([x[1] == x[2] for x in rows], weights=[weights[x[0]] for x in rows]))
    with pytest.raises(ValueError, match="scheme"):
        stats.bootstrap_scores(df, "run_id", scheme="other")


def test_more_than_a_million_groups(spark):
    """Both schemes agree on what is known: the mean over resamples is that of the rows."""
    df = spark.range(1_200_000).select(F.col("id").alias("g"), (F.col("id") % 3).alias("target"), F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id") % 3).alias("prediction"), F.lit(0).alias("state"))
    share = df.agg(F.avg((F.col("target") == F.col("prediction")).cast("double"))).first()[0]
    for scheme, resamples in (("poisson", 4), ("multinomial", 2)):
        got = stats.bootstrap_scores(df, "g", resamples=resamples, scheme=scheme).collect()
        assert len(got) == resamples and all(r.accuracy == pytest.approx(share, abs=0.003) for r in got)


def broadcast_parts(df):
    """Text of what lies below each broadcast in the plan."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*|")) for x in lines]
    joins = []
    for i, line in enumerate(lines):
        if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line:
            sides = [j for j in range(i + 1, len(lines)) if depth[j] == depth[i] + 3 and all(d > depth[i] for d in depth[i + 1 : j + 1])]
            j = sides[0] if "BuildLeft" in line else sides[1]
            end = next((k for k in range(j + 1, len(lines)) if depth[k] <= depth[j]), len(lines))
            joins.append("\n".join(lines[j:end]))
    return joins


def test_draws_are_not_broadcast(spark):
    """A row for each resample and group would go through the driver; counts are broadcast within a known size only."""
    counts = spark.range(6000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("g"), *[(F.col("id") % (k + 2)).alias(f"n{k}") for k in range(3)])
    counts = counts.crossJoin(spark.range(1_000_000).where("id = 0")).drop("id")  # so that the estimate of their size is far too large
    found = stats.drawn_sums(counts, "g", 100, 17)
    assert not any("Generate" in part for part in broadcast_parts(found))
    assert len(broadcast_parts(found)) == 1
    shuffled = stats.drawn_sums(counts, "g", 100, 17, most_bytes=0)
    assert not broadcast_parts(shuffled)
    assert sorted(found.collect()) == sorted(shuffled.collect())


def test_no_groups(answers):
    _, df = answers
    assert stats.bootstrap_intervals(df.where("false"), "run_id") == {"groups": 0, "resamples": 0, **{f"{n}_{e}": 0.0 for n in stats.SCORES for e in ("low", "high")}}
    assert stats.bootstrap_difference(df.where("false"), "run_id") == {"groups": 0, "resamples": 0}


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(v), int(n)) for (g, v), n in zip({(g, v) for g, v in rng.integers(0, [3, 500], (900, 2))}, rng.integers(1, 9, 900))]
    df = spark.createDataFrame(rows, "g int, v int, n long").repartition(5)
    for by in ([], ["g"]):
        order = ["g", "v"] if not by else ["v"]
        got = {(r.g, r.v): r.before for r in sequences.with_running_total(df, order, "n", "before", by).collect()}
        assert got == {(g, v): sum(n for a, b, n in rows if (a, b) < (g, v) and (not by or a == g)) for g, v, _ in rows}


def test_ranks_of_many_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), float(b) if i % 7 else None, -0.0 if i % 2 else 0.0) for i, (a, b) in enumerate(rng.integers(0, [4, 60], (500, 2)))]
    got = stats.ranked(spark.createDataFrame(rows, "a int, b double, c double"), ["a", "b", "c"]).collect()
    assert len(got) == 500
    for name in "abc":
        values = sorted(r[name] for r in got if r[name] is not None)
        for r in got:
            v = r[name]
            assert r[f"rank__{name}"] == (None if v is None else (bisect.bisect_left(values, v) + bisect.bisect_right(values, v) + 1) / 2)


def test_ranking_takes_as_many_jobs_for_more_columns(spark):
    df = spark.range(300).select(*[((F.col("id") * k) % 97).alias(f"x{k}") for k in range(1, 9)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        spark.sparkContext.setJobGroup(f"rank-{n}", "")
        stats.ranked(df, [f"x{k}" for k in range(1, n + 1)]).collect()
        return len(tracker.getJobIdsForGroup(f"rank-{n}"))

    assert jobs(2) == jobs(8)


def sign_sum(x, y, n):
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    return float((s * n[:, None] * n).sum() / 2)


@pytest.mark.parametrize("size,values", [(1, 1), (2, 2), (37, 5), (400, 9), (600, 1000)])
def test_balance_is_the_sum_of_signs(size, values):
    rng = np.random.default_rng(size)
    for _ in range(5):
        x, y, n = rng.integers(0, values, size), rng.integers(0, values, size), rng.integers(1, 5, size)
        assert stats.balance(x, y, n) == sign_sum(x, y, n.astype(float))


def tau_b(x, y):
    n, pairs = len(x), lambda c: sum(k * (k - 1) / 2 for k in np.unique(c, return_counts=True)[1])
    return sign_sum(x, y, np.ones(n)) / math.sqrt((n * (n - 1) / 2 - pairs(x)) * (n * (n - 1) / 2 - pairs(y)))


def test_kendall_in_ranges(spark):
    """Values of every kind: many, few, a hot one that has more pairs than a range."""
    rng = np.random.default_rng(9)
    n = 1500
    x, y = rng.integers(0, 10**6, n).astype(float), rng.integers(0, 40, n).astype(float)
    hot_x, hot_y = np.where(np.arange(n) % 3 == 0, 5e5, x), np.where(np.arange(n) % 3 == 1, 7.0, rng.random(n) * 50)
    for a, b in ((x, x + rng.normal(0, 3e5, n)), (x, y), (hot_x, hot_y), (-x, x)):
        df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, b)] + [(None, 1.0), (1.0, None)], "x double, y double")
        want = tau_b(a, b)
        assert stats.kendall(df, "x", "y", cells=20).first().tau == pytest.approx(want, abs=1e-12)
        assert stats.kendall(df, "x", "y").first().tau == pytest.approx(want, abs=1e-12)


def test_kendall_of_a_million_pairs(spark):
    """A permutation's inversions, counted by insertion into a sorted list of blocks."""
    n = 1_000_000
    df = spark.range(n).select("id", ((F.col("id") * 611_953 + (F.col("id") % 7) * 13) % 1_000_003).alias("y"))
    y = (np.arange(n, dtype=np.int64) * 611_953 + (np.arange(n) % 7) * 13) % 1_000_003
    step, counts, less = 1000, np.zeros(1_001, np.int64), 0
    blocks = [[] for _ in range(1_001)]
    order = np.argsort(y, kind="stable")
    assert len(order) == n
    for v in y.tolist():
        b = v // step
        less += int(counts[:b].sum()) + bisect.bisect_left(blocks[b], v)
        bisect.insort(blocks[b], v)
        counts[b] += 1
    pairs = lambda c: float((c * (c - 1) / 2).sum())
    ties = pairs(np.unique(y, return_counts=True)[1])
    whole = n * (n - 1) / 2
    want = (2 * less - (whole - ties)) / math.sqrt(whole * (whole - ties))
    assert stats.kendall(df, "id", "y").first().tau == pytest.approx(want, abs=1e-12)


def test_kendall_without_values(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert stats.kendall(df, "x", "y").first().tau is None and stats.kendall(df.where("false"), "x", "y").first().tau is None


def test_poisson_draws_are_hashed_once(answers):
    """One hash to drop the groups that do not count and one to count the others, not one for each bound."""
    _, df = answers
    drawn = stats.drawn_sums(stats.group_counts(df, "run_id"), "run_id", 3, 5, "poisson")
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2 and "conv(" not in plan


def test_rows_of_a_common_value_are_not_drawn_together(spark):
    """Ranks of columns of few values are broadcast to the rows; the way by shuffles gives the same."""
    df = spark.range(400).selectExpr("id % 3 AS a", "CAST(id * 7 % 50 AS double) AS b", "IF(id % 9 = 0, NULL, id % 200) AS c")
    few, many = stats.ranked(df, ["a", "b", "c"]), stats.ranked(df, ["a", "b", "c"], few_values=10)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == plan.count("strategy=broadcast") == 3
