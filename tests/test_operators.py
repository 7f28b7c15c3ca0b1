"""Known answers and NumPy restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import domain
from tickloom.functions import scalars as fn
from tickloom.operators import features, merge, metrics, models, phases, planning, policy, selection, sequences, splits, stats
from tickloom.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbers_out_of_text(spark):
    texts = [None, "", " 1,234 ", "<not counted>", "<not supported>", "nan", "inf", "-2.5", "x"]
    got = [r[0] for r in frame(spark, [(t,) for t in texts], "t string").select(fn.safe_float(F.col("t"))).collect()]
    assert got == [None, None, 1234.0, None, None, None, None, -2.5, None]


def test_lists_ranges_and_one_hot(spark):
    r = spark.range(1).select(fn.split_list(F.lit(" a, ,b,")).alias("a"), fn.range_list(F.lit("0-3,8")).alias("b"), fn.one_hot(F.lit(1)).alias("c"), fn.one_hot(F.lit(-1)).alias("d"), fn.clamp_state(F.lit(7)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (["a", "b"], [0, 1, 2, 3, 8], [0, 1, 0], [0, 0, 0], 2)


def test_forbidden_counters():
    names = ["counter__cycles", "counter__l2_misses", "other"]
    assert domain.safe_counters(names) == ["counter__l2_misses"]
    with pytest.raises(ValueError, match="timing"):
        domain.safe_counters(names, strict=True)


def test_config_is_merged_at_depth():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert domain.merged_config(base, {"a": {"c": 5}}) == {"a": {"b": 1, "c": 5}, "d": 3}
    assert base["a"]["c"] == 2


def test_perf_text(spark):
    lines = [("# started",), ("1.000100,CPU2,1234,,cycles:u [x],500,80.00,1.5,GHz",), ("1.000100,<not counted>,,faults,0,0.00,,",), ("short,1",)]
    got = readers.parse_perf_lines(frame(spark, lines, "value string")).collect()
    assert [(round(r.timestamp_ms, 4), r.cpu_or_core_id, r.value, r.event_name, r.event_name_normalized, r.runtime_ns, r.enabled_pct, r.metric_value, r.status) for r in got] == [
        (1000.1, "2", 1234.0, "cycles:u", "cycles", 500.0, 80.0, 1.5, "ok"), (1000.1, "", None, "faults", "faults", 0.0, 0.0, None, "not counted"),
    ]


def test_missing_file_is_an_empty_table(spark, tmp_path):
    assert readers.read_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "log.csv").write_text("start_ms,end_ms,phase_label\n0,10,a\n5,20,b\n")
    assert readers.read_phase_log(spark, str(tmp_path / "log.csv")).count() == 2


def test_ragged_union_partitions_and_digests(spark, tmp_path):
    out = readers.union_ragged([frame(spark, [(1, "x")], "a int, k string"), frame(spark, [(2.0, "y")], "b double, k string")])
    assert sorted(out.columns) == ["a", "b", "k"] and out.count() == 2
    readers.write_partitioned(out, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).where("k = 'x'").count() == 1
    assert readers.file_digests(spark, str(tmp_path / "t" / "k=x"), "*.parquet").count() == 1


def test_pivot_keeps_rows_without_a_known_event(spark):
    samples = frame(spark, [("r", "0", 1.0, "A", 2.0, 90.0, 5.0), ("r", "0", 1.0, "a:u", 3.0, 80.0, 7.0), ("r", "0", 2.0, "zzz", 9.0, 1.0, 1.0), ("r", "0", 3.0, "a", None, 70.0, 1.0)], "run_id string, cpu_or_core_id string, timestamp_ms double, event_name string, value double, enabled_pct double, runtime_ns double")
    aliases = frame(spark, [("A", "loads", 1), ("a", "other", 0)], "event_name string, counter string, priority int")
    wide = merge.pivot_sum(merge.map_events(samples, aliases), ["loads"], quality=True).orderBy("timestamp_ms").collect()
    assert [(r.counter__loads, r.pmu_enabled_pct__loads, r.pmu_runtime_ns__loads) for r in wide] == [(5.0, 80.0, 12.0), (None, None, None), (None, 70.0, 1.0)]


def test_quality(spark):
    wide = frame(spark, [(100.0, 1.0), (80.0, 1.0), (0.0, 4.0)], "pmu_enabled_pct__a double, pmu_runtime_ns__a double")
    r = merge.collection_quality(wide, ["a"]).first()
    assert (r.samples, r.enabled_pct_mean, r.enabled_pct_min, r.runtime_ns_mean) == (3, 60.0, 0.0, 2.0)
    assert r.fraction_enabled_below_90pct == pytest.approx(2 / 3) and r.fraction_enabled_zero == pytest.approx(1 / 3) and r.enabled_pct_p05 == pytest.approx(8.0)


def test_durations(spark):
    rows = frame(spark, [("r", "0", 0.0), ("r", "0", 10.0), ("r", "0", 30.0), ("r", "1", 5.0)], "run_id string, cpu_or_core_id string, timestamp_ms double")
    got = {(r.cpu_or_core_id, r.timestamp_ms): r.interval_duration_ms for r in merge.with_durations(rows).collect()}
    assert got == {("0", 0.0): 15.0, ("0", 10.0): 10.0, ("0", 30.0): 20.0, ("1", 5.0): None}


def test_overlapping_phases_take_the_first(spark):
    rows = frame(spark, [("r", t) for t in (0.0, 9.9, 10.0, 15.0, 25.0)], "run_id string, timestamp_ms double")
    log = frame(spark, [("r", 0.0, 12.0, "a", 0), ("r", 10.0, 20.0, "b", 1), ("r", 5.0, 5.0, "none", 2)], "run_id string, start_ms double, end_ms double, phase_label string, position int")
    got = {r.timestamp_ms: r.phase_label for r in merge.label_phases(rows, log, bin_ms=4.0).collect()}
    assert got == {0.0: "a", 9.9: "a", 10.0: "a", 15.0: "b", 25.0: ""}


def test_nearest_takes_the_later_at_a_tie_and_keeps_the_limit(spark):
    core = frame(spark, [("r", t, i) for i, t in enumerate((4.0, 5.0, 10.0, 26.0, 99.0))] + [("q", 1.0, 9)], "run_id string, timestamp_ms double, k int")
    other = frame(spark, [("r", 0.0, 0.5), ("r", 10.0, 1.5), ("r", 20.0, 2.5)], "run_id string, timestamp_ms double, v double")
    got = {r.k: (r.v, r.attached) for r in merge.nearest(core, other, ["v"]).collect()}
    assert got == {0: (0.5, True), 1: (1.5, True), 2: (1.5, True), 3: (2.5, True), 4: (None, False), 9: (None, False)}


@pytest.mark.parametrize("chunk", [1.0, 7.0, 50.0, 3_600_000.0])
def test_nearest_equals_bisection(spark, chunk):
    rng = np.random.default_rng(3)
    a, b = sorted(set(rng.integers(0, 200, 60).tolist())), sorted(set(rng.integers(0, 200, 40).tolist()))
    core = frame(spark, [("r", float(t)) for t in a], "run_id string, timestamp_ms double")
    other = frame(spark, [("r", float(t), float(t)) for t in b], "run_id string, timestamp_ms double, v double")
    limit = float(np.median(np.diff(b)))
    lone = frame(spark, [("x", 5.0)], "run_id string, timestamp_ms double")
    got = merge.nearest(core.unionByName(lone), other, ["v"], chunk_ms=chunk).collect()
    assert len(got) == len(a) + 1 and [(r.v, r.attached) for r in got if r.run_id == "x"] == [(None, False)]
    for r in got:
        if r.run_id == "x":
            continue
        best = min(b, key=lambda t: (abs(t - r.timestamp_ms), -t))
        assert r.v == (best if abs(best - r.timestamp_ms) <= limit else None)


def test_units(spark):
    rows = frame(spark, [("3", "t"), ("", "t")], "cpu_or_core_id string, task string")
    topology = F.create_map(F.lit("3"), F.lit("1"))
    got = merge.unit_identity(rows, topology, "system_wide_physical_core", "task").collect()
    assert [(r.unit_id, r.physical_core_id, r.collection_scope) for r in got] == [("1", "1", "system_wide_physical_core"), ("t", "", "task_local")]


def test_derived_features(spark):
    row = {"instructions_retired": 1000.0, "llc_references": 50.0, "llc_misses": 10.0, "branch_instructions": 0.0, "branch_mispredictions": 3.0, "memory_read_bandwidth": None, "memory_write_bandwidth": 4.0}
    df = frame(spark, [tuple(row.values())], ", ".join(f"counter__{k} double" for k in row))
    r = features.derived_features(df).first()
    assert (r.llc_refs_per_ki, r.llc_misses_per_ki, r.llc_miss_rate, r.branch_miss_rate, r.memory_total_bandwidth, r.memory_write_fraction) == (50.0, 10.0, 0.2, None, 4.0, 1.0)


def test_train_only_tertiles(spark):
    df = frame(spark, [(1.0, "train"), (2.0, "train"), (50.0, "test"), (60.0, "test"), (None, "test")], "v double, split string")
    got = phases.tertile_states(features.train_flag(df), "v").collect()
    assert [r.state for r in got] == [0, 2, 2, 2, -1]


def test_all_rows_train_if_none_does(spark):
    assert features.train_flag(frame(spark, [("test",), ("val",)], "split string")).where("is_train").count() == 2


def test_constant_column_scales_to_zero(spark):
    df = frame(spark, [(5.0, None, True), (5.0, 2.0, True), (None, 4.0, False)], "a double, b double, is_train boolean")
    got = features.fill_and_scale(df, ["a", "b"]).select("a", "b").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (0.0, 0.0), (0.0, 2.0)]


def states_frame(spark, streams):
    rows = [(f"r{i}", "0", float(t), 1000 * i + t, s) for i, states in enumerate(streams) for t, s in enumerate(states)]
    return frame(spark, rows, "run_id string, cpu_or_core_id string, timestamp_ms double, row_index long, state int")


def test_run_lengths_histories_and_confirmation(spark):
    rng = np.random.default_rng(5)
    streams = [rng.integers(-1, 3, n).tolist() for n in (1, 2, 9, 40)]
    df = states_frame(spark, streams)
    lengths = {r.row_index: r.run_length for r in sequences.run_lengths(df).collect()}
    actions = {r.row_index: r.action for r in sequences.with_confirmed(df, "state").collect()}
    history = {r.row_index: ([s[0] for s in r.history], r.target) for r in sequences.histories(df, 3, ["state"]).collect()}
    for i, states in enumerate(streams):
        action, pending, count, run = 1, None, 0, 0
        for t, s in enumerate(states):
            run = run + 1 if t and states[t - 1] == s else 1
            assert lengths[1000 * i + t] == run
            if s == action:
                pending, count = None, 0
            elif s == pending:
                count += 1
            else:
                pending, count = s, 1
            if count >= 2:
                action, pending, count = s, None, 0
            assert actions[1000 * i + t] == action
            full = 2 <= t < len(states) - 1
            assert history.get(1000 * i + t) == ((states[t - 2 : t + 1], states[t + 1]) if full else None)


def test_one_hot_history(spark):
    df = frame(spark, [([[0, -1], [2, 1]],)], "h array<array<int>>")
    assert df.select(sequences.one_hot_history(F.col("h"))).first()[0] == [1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0]


def numpy_tree(x, y, depth, leaf):
    from collections import Counter

    counts = Counter(y.tolist())
    out = {"p": counts.most_common(1)[0][0]}
    if depth == 0 or len(counts) == 1 or len(y) < 2 * leaf:
        return out
    best = (np.inf,)
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, f], np.arange(1, 10) / 10)):
            l = x[:, f] <= t
            if l.sum() < leaf or (~l).sum() < leaf:
                continue
            score = sum(len(s) * (1 - sum((c / len(s)) ** 2 for c in Counter(s.tolist()).values())) for s in (y[l], y[~l])) / len(y)
            if score < best[0] - 1e-12:
                best = (score, f, t)
    if best[0] == np.inf:
        return out
    l = x[:, best[1]] <= best[2]
    return out | {"f": best[1], "t": best[2], "l": numpy_tree(x[l], y[l], depth - 1, leaf), "r": numpy_tree(x[~l], y[~l], depth - 1, leaf)}


def test_tree_equals_restatement(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=150).round(3), rng.integers(0, 3, 150).astype(float)])
    y = ((x[:, 0] > 0.2).astype(int) + (x[:, 1] == 2)).astype(int)
    y[::17] = -1
    df = frame(spark, [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "row_index long, a double, b double, y int")
    tree = models.fit_tree(df, ["a", "b"], "y", 3, 4)
    want = numpy_tree(x, y, 3, 4)

    def check(node, ref):
        assert node.prediction == ref["p"]
        assert (node.feature is None) == ("f" not in ref)
        if "f" in ref:
            assert node.feature == "ab"[ref["f"]] and node.threshold == pytest.approx(ref["t"])
            check(node.left, ref["l"])
            check(node.right, ref["r"])

    check(tree, want)
    assert tree.leaves() == tree.internal() + 1
    assert df.withColumn("p", models.tree_expression(tree)).where("p = y").count() > 100
    assert len(df.select(models.tree_top_k(tree, 2).alias("k")).first().k) == 2


def test_kmeans_equals_restatement(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.2, size=(30, 2)) for m in (0, 3, 8)]).round(4)
    df = frame(spark, [tuple(map(float, r)) for r in x], "a double, b double")
    unique = np.unique(x, axis=0)
    c = unique[np.random.default_rng(17).choice(len(unique), size=3, replace=False)]
    for _ in range(100):
        lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[lab == k].mean(0) if (lab == k).any() else c[k] for k in range(3)])
        if np.allclose(new, c):
            break
        c = new
    assert np.allclose(phases.kmeans(df, ["a", "b"], 3, 17), new)


def test_phase_states_follow_pressure(spark):
    rows = [(i, float(v), float(v * 2), True) for i, v in enumerate([1, 2, 1, 100, 110, 90, 5000, 5200, 5100])]
    df = frame(spark, rows, "row_index long, counter__llc_misses double, counter__l2_misses double, is_train boolean")
    states, learned = phases.phase_states(df, ["counter__l2_misses", "counter__llc_misses"])
    assert [r.state for r in states.orderBy("row_index").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert learned["clusters"] == 3 and learned["pressure"] == sorted(learned["pressure"])
    assert phases.phase_summary(states, ["counter__l2_misses", "counter__llc_misses"], learned).count() == 3
    one, cuts = phases.one_dimensional_states(df, "counter__l2_misses")
    assert [r.state for r in one.orderBy("row_index").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and len(cuts) == 2


def test_unknown_states_in_tables(spark):
    rows = [(0, 0, 1, 0, True), (1, 2, 1, 2, True), (2, -1, 1, 1, False), (3, 1, 1, -1, False)]
    df = frame(spark, rows, "row_index long, state int, run_length int, target int, is_train boolean")
    assert [r.prediction for r in models.markov(df).orderBy("row_index").collect()] == [0, 2, 2, 0]
    assert [r.prediction for r in models.duration_model(df).orderBy("row_index").collect()] == [0, 2, -1, 1]
    assert [r.prediction for r in models.state_majority(df).orderBy("row_index").collect()] == [0, 2, 0, 0]


def test_commonest_takes_the_first_met(spark):
    df = frame(spark, [(0, 2), (1, 1), (2, 1), (3, 2)], "row_index long, t int")
    assert models.commonest(df, [], "t", "row_index", "m").first().m == 2


def test_kernels_and_ridge(spark):
    kernels = models.random_kernels(1, 5, 4)
    x = np.random.default_rng(0).normal(size=(12, 5, 1))
    df = frame(spark, [(i, [[float(v)] for v in row[:, 0]], i % 3) for i, row in enumerate(x)], "i int, history array<array<double>>, target int")
    got = models.kernel_features(df, kernels)
    rows = {r.i: r.features for r in got.collect()}
    for i, row in enumerate(x):
        want = []
        for k in kernels:
            reach = 1 + (len(k["weights"]) - 1) * k["dilation"]
            act = [float((row[s : s + reach : k["dilation"]] * k["weights"]).sum() + k["bias"]) for s in range(5 - reach + 1)]
            want += [max(act), float(np.mean(np.array(act) > 0))]
        assert np.allclose(rows[i], want)
    m = np.column_stack([np.array([rows[i] for i in range(12)]), np.ones(12)])
    y = np.eye(3)[[i % 3 for i in range(12)]]
    assert np.allclose(models.ridge_head(got, 8), np.linalg.solve(m.T @ m + 1e-3 * np.eye(9), m.T @ y))


def test_blend(spark):
    df = frame(spark, [([0.1, 0.8, 0.1], 2), (None, 0)], "s array<double>, h int")
    assert [r[0] for r in df.select(models.blended_target(F.col("s"), F.col("h"), 0.3)).collect()] == [1, 0]


def labelled(spark, truth, pred, current, groups):
    return frame(spark, list(zip(truth, pred, current, groups)), "target int, prediction int, state int, g string")


def test_scores_and_bootstrap(spark):
    df = labelled(spark, [0, 0, 1, 1, 2, 2], [0, 0, 1, 0, 2, 1], [0, 1, 1, 2, 2, 0], ["g1"] * 3 + ["g2"] * 3)
    s = metrics.classification_scores(metrics.confusion(df)).first()
    assert s.accuracy == pytest.approx(4 / 6) and s.high_recall == 0.5 and s.balanced_accuracy == pytest.approx(2 / 3)
    b = stats.bootstrap_intervals(df, "g", resamples=200)
    assert b["groups"] == 2 and all(b[f"{m}_low"] <= b[f"{m}_high"] for m in ("accuracy", "macro_f1", "balanced_accuracy", "transition_accuracy"))
    pair = df.withColumns({"first_prediction": F.col("target"), "second_prediction": F.col("prediction")})
    assert stats.bootstrap_difference(pair, "g", resamples=200)["accuracy_difference"] > 0
    assert stats.bootstrap_intervals(df.where("false"), "g")["groups"] == 0


@pytest.mark.parametrize(("b", "want"), [("220011", 1.0), ("010101", None)])
def test_rand_index(spark, b, want):
    df = frame(spark, list(zip(map(int, "001122"), map(int, b))), "a int, b int")
    got = stats.adjusted_rand(df, "a", "b").first()[0]
    assert got == pytest.approx(want) if want else got < 1
    assert stats.adjusted_rand(df.where("a = 9"), "a", "b").first()[0] == 1.0


def test_splits_keep_groups_together(spark):
    rows = [(f"run{i}{p}", f"g{i}", f"w{i % 3}", 1 + i % 2) for i in range(12) for p in "ab"]
    df = frame(spark, rows, "run_id string, concurrent_group_id string, workload string, threads int")
    for table in (splits.run_grouped(df, seed=7), splits.config_grouped(df), splits.per_scenario(df)):
        joined = df.join(table, "run_id").groupBy("concurrent_group_id").agg(F.countDistinct("split").alias("n"))
        assert joined.where("n <> 1").count() == 0 and table.count() == 24
    out = splits.leave_one_out(df, "w1")
    assert {r.run_id for r in out.where("split = 'test'").collect()} >= {r[0] for r in rows if r[2] == "w1"}
    assert splits.split_items([], 0.7, 0.1, 1) == {} and set(splits.split_items(["x"], 0.7, 0.1, 1).values()) == {"train"}
    assert set(splits.split_items(list("ab"), 0.9, 0.1, 1).values()) == {"train", "test"}


def test_plans(spark):
    w = frame(spark, [(x,) for x in "abcd"], "workload string")
    assert planning.workload_pairs(w).count() == 6
    chunks = planning.chunked_groups(w, 2).orderBy("chunk", "member").collect()
    assert [r.workload for r in chunks] == list("abcd")
    assert [r.workload for r in planning.chunked_groups(w.where("workload < 'd'"), 2).orderBy("chunk", "member").collect()] == ["a", "b", "c", "a"]
    plan = planning.task_plan(w, [1, 16], 3)
    assert planning.plan_summary(plan).first().tasks == 24
    with pytest.raises(ValueError, match="missing"):
        planning.require_complete(plan, plan.where("threads = 1"), ["workload", "threads"], "run")
    with pytest.raises(ValueError, match="no state"):
        planning.require_states(frame(spark, [(3,)], "state int"))
    listing = frame(spark, [("cache-misses OR llc-miss   [Hardware event]",), ("cycles",)], "value string")
    names = planning.event_aliases(listing)
    assert {r.normal for r in names.collect()} == {"cache-misses", "llc-miss", "cycles"}
    cands = frame(spark, [("f", "zzz", 0), ("f", "LLC-miss", 1), ("g", "none", 0)], "family string, event_name string, priority int")
    assert {(r.family, r.event_name) for r in planning.resolve_aliases(cands, names).collect()} == {("f", "LLC-miss"), ("g", None)}
    assert planning.device_events(spark, {"r": "cas_rd"}, [0, 1]).count() == 2


def test_choices(spark):
    results = [
        ("e", "s", "L1", "singleton", "a", "", 0.9, 0, 0), ("e", "s", "L1", "singleton", "b", "", 0.9, 1, 1), ("e", "s", "L1", "singleton", "a,b", "", 9.0, 1, 2),
        ("e", "s", "L1", "singleton", "c", "", float("nan"), 1, 3), ("e", "s", "__global__", "one_per_family_exhaustive", "x", "L1:x;L2:y", 0.5, 0, 4),
    ]
    df = frame(spark, results, "experiment string, scope string, family string, candidate_type string, counter_set string, family_counter_map string, validation_score double, selected int, position int")
    one, whole = selection.singleton_choice(df), selection.global_choice(df)
    assert [r.counter for r in one.collect()] == ["b"]
    assert {(r.family, r.counter) for r in whole.collect()} == {("L1", "x"), ("L2", "y")}
    assert {r.counter for r in selection.prefer(whole, one, ["experiment", "scope"]).collect()} == {"x", "y"}


def test_costs(spark):
    rows = [("baseline_last_state", 0, 0, 0, 0, 0.0), ("online_history_tree", 0, 0, 3, 4, 12.0), ("own", 0, 0, 0, 0, 0.0)]
    df = frame(spark, rows, "model string, parameter_count int, table_entries int, tree_internal_nodes int, tree_leaves int, estimated_storage_bytes double")
    got = {r.model: (r.memory_bytes, r.approx_operations, r.operator_type, r.complexity) for r in policy.deployment_cost(df).collect()}
    assert got["baseline_last_state"] == (1.0, 1.0, "register", "Very Low")
    assert got["online_history_tree"] == (12.0, 6.0, "comparisons", "Low")
    assert spark.range(1).select(policy.tree_bytes(F.lit(3), F.lit(4), F.lit(20))).first()[0] == (3 * (5 + 16 + 6) + 8) / 8


def test_row_numbers(spark):
    df = frame(spark, [(float(x),) for x in np.random.default_rng(0).permutation(500)], "x double")
    assert all(r.x == r.row_index for r in sequences.with_row_index(df, ["x"]).collect())


def test_ordered_sums_do_not_depend_on_how_rows_are_dealt(spark):
    """Three values whose sum has other last bits in another order: always added in order."""
    rows = [(n, "u", "x" if n < 90 else "y", float(v)) for n, v in enumerate([0.1, 0.2, 0.3, 1e16, 1.0, -1e16] * 20)]
    df = spark.createDataFrame(rows, "n long, unit string, counter string, value double")
    want = {c: 0.0 for c in "xy"}
    for _, _, c, v in rows:
        want[c] += v
    for dealt in (df.coalesce(1), df.repartition(7), df.orderBy(F.col("n").desc()).coalesce(1)):
        (got,) = merge.pivot_sum(dealt, ["x", "y", "z"], ["unit"], order=["n"]).collect()
        assert (got.counter__x, got.counter__y, got.counter__z) == (want["x"], want["y"], None)


def test_equal_rows_meet_the_centroids_once(spark, monkeypatch):
    """K-means over copies looks through distinct rows with their counts, and gives the centroids of all rows."""
    seen, first = [], phases._first_centroids
    monkeypatch.setattr(phases, "_first_centroids", lambda rows, *more: seen.append(rows.count()) or first(rows, *more))
    points = [(float(x), float(x % 3)) for x in (0, 1, 2, 20, 21, 22) for _ in range(x % 5 + 1)] * 4
    got = phases.kmeans(spark.createDataFrame(points, "a double, b double"), ["a", "b"], 2, 17)
    assert seen == [6]
    data = np.array(points)
    sides = [data[data[:, 0] < 10].mean(axis=0), data[data[:, 0] > 10].mean(axis=0)]
    assert np.allclose(got[np.argsort(got[:, 0])], sides)
