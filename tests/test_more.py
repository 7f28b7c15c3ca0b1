"""Quantiles, stored sequences, teachers and students, collections, sinks and statistics against restatements."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import domain
from tickloom.operators import build, collection, evaluation, events, features, forest, lineage, models, planning, selection, sequences, splits, stats, students
from tickloom.operators.quantiles import quantiles
from tickloom.sources import writers

from .test_operators import frame, numpy_tree

PROBS = [0, 0.01, 0.05, 1 / 3, 0.5, 2 / 3, 0.9, 0.99, 1]


@pytest.mark.parametrize("accuracy", [20, 10_000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles_are_exact(spark, by, accuracy):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([None, rng.random() * 100, float(rng.randrange(5))]), rng.gauss(0, 1) if rng.random() < 0.9 else None) for _ in range(4000)]
    rows += [("d", None, None), ("e", 1.0, 2.0), ("f", 1.0, None), ("f", 2.0, 3.0)]
    df = frame(spark, rows, "g string, x double, y double")
    got = {tuple(r[c] for c in by): r for r in quantiles(df, ["x", "y"], PROBS, by, accuracy=accuracy).collect()}
    for key in {tuple(r[0] for _ in by) for r in rows}:
        for i, c in ((1, "x"), (2, "y")):
            mine = [r[i] for r in rows if r[i] is not None and (not by or r[0] == key[0])]
            assert got[key][f"q__{c}"] == (pytest.approx(np.quantile(mine, PROBS)) if mine else [None] * len(PROBS))


def test_quantiles_of_nothing(spark):
    empty = frame(spark, [], "g string, x double")
    assert quantiles(empty, ["x"], [0.5]).collect()[0]["q__x"] == [None]
    assert quantiles(empty, ["x"], [0.5], ["g"]).count() == 0


def test_deciles_of_many_values_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200).round(4)
    df = frame(spark, [(i, float(a), int(a > 0.3) + int(a > 1)) for i, a in enumerate(x)], "row_index long, a double, y int")
    one = models.fit_tree(df, ["a"], "y", 2, 3)
    monkeypatch.setattr(forest, "BUFFERED", 0)
    assert models.fit_tree(df, ["a"], "y", 2, 3) == one


def test_split_sizes():
    assert [splits.split_sizes(n, 0.7, 0.15) for n in (1, 2, 3, 10, 20)] == [(1, 0), (1, 0), (2, 0), (7, 2), (14, 3)]
    assert splits.split_sizes(5, 1.0, 0.0) == (4, 0) and splits.split_items([], 0.7, 0.15, 1) == {}
    named = splits.split_items(list("abcdefghij"), 0.7, 0.15, 3)
    assert Counter(named.values()) == {"train": 7, "val": 2, "test": 1} and named == splits.split_items(list("abcdefghij"), 0.7, 0.15, 3)


def test_kernels_lie_within_the_history():
    kernels = models.random_kernels(2, 9, 200, 5)
    assert all((len(k["weights"]) - 1) * k["dilation"] < 9 and k["weights"].shape[1] == 2 for k in kernels)
    assert {len(k["weights"]) for k in kernels} == {3, 5, 7} and max(k["dilation"] for k in kernels) == 4
    again = models.random_kernels(2, 9, 200, 5)
    assert all((a["weights"] == b["weights"]).all() for a, b in zip(kernels, again))
    assert {len(k["weights"]) for k in models.random_kernels(1, 3, 50)} == {3}


def test_kernel_classifier_against_numpy(spark):
    """Features and ridge head restated: the same weights and the same classes."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (60, 7, 1)).astype(float)
    y = (x[:, -1, 0] > 1).astype(int) + (x[:, -2, 0] > 1).astype(int)
    df = frame(spark, [(i, a.tolist(), int(t)) for i, (a, t) in enumerate(zip(x, y))], "row_index long, history array<array<double>>, target int")
    kernels = models.random_kernels(1, 7, 6)
    rows = models.kernel_features(df, kernels)
    weights = models.ridge_head(rows, 12)
    want = []
    for a in x:
        out = []
        for k in kernels:
            n, step = len(k["weights"]), k["dilation"]
            act = [sum((a[s + i * step] * k["weights"][i]).sum() for i in range(n)) + k["bias"] for s in range(7 - (n - 1) * step)]
            out += [max(act), np.mean([v > 0 for v in act])]
        want.append([*out, 1.0])
    z = np.array(want)
    solved = np.linalg.solve(z.T @ z + 1e-3 * np.eye(13), z.T @ np.eye(3)[y])
    assert np.allclose(weights, solved, atol=1e-6)
    got = {r.row_index: r.p for r in rows.withColumn("p", models.linear_prediction(weights)).collect()}
    assert [got[i] for i in range(60)] == (z @ solved).argmax(axis=1).tolist()


def streams(n=4, length=30, seed=5):
    rng = random.Random(seed)
    rows, at = [], 0
    for s in range(n):
        state = 0
        for t in range(length):
            state = rng.choice([0, 1, 2]) if rng.random() < 0.3 else state
            rows.append((f"r{s}", "0", float(t), at, state, "train" if s < n - 2 else "val" if s == n - 2 else "test", s < n - 2))
            at += 1
    return rows


SCHEMA = "run_id string, cpu_or_core_id string, timestamp_ms double, row_index long, state int, split string, is_train boolean"


def windows_of(rows, length):
    """(row_index, one-hot, target, state, split) of rows with a full history and a known next state."""
    out = []
    for run in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == run]
        for i in range(length - 1, len(mine) - 1):
            hot = [int(mine[i - length + 1 + k][4] == c) for k in range(length) for c in range(3)]
            out.append((mine[i][3], hot, mine[i + 1][4], mine[i][4], mine[i][5]))
    return sorted(out)


def said_by(tree, x):
    while "f" in tree:
        tree = tree["l"] if x[tree["f"]] <= tree["t"] else tree["r"]
    return tree["p"]


def test_history_students_against_a_restatement(spark):
    rows = streams()
    df = frame(spark, rows, SCHEMA)
    teacher = {r[3]: (r[4] + 1) % 3 for r in rows if r[3] % 4}
    answers = frame(spark, [("f", k, 1, v, None) for k, v in teacher.items()], "family string, row_index long, step int, hard int, soft array<double>")
    flat, names = students.flat_history(df, 3, 1)
    got = students.history_students(flat, answers, "f", names, 3, 4)
    w = windows_of(rows, 3)
    x, y = np.array([h for _, h, *_ in w], dtype=float), np.array([t for _, _, t, *_ in w])
    train = np.array([s == "train" for *_, s in w])
    taught = np.array([i in teacher for i, *_ in w])
    scratch = numpy_tree(x[train], y[train], 3, 4)
    distilled = numpy_tree(x[train & taught], np.array([teacher.get(i, -1) for i, *_ in w])[train & taught], 3, 4)
    lookup = {}
    for (i, h, *_), t in zip(w, train & taught):
        for n in range(1, 4) if t else ():
            lookup.setdefault((n, tuple(h[-3 * n :])), []).append(teacher[i])

    def looked(h):
        for n in (3, 2, 1):
            if (n, tuple(h[-3 * n :])) in lookup:
                return Counter(lookup[n, tuple(h[-3 * n :])]).most_common(1)[0][0]
        return Counter(teacher[i] for (i, *_), t in zip(w, train & taught) if t).most_common(1)[0][0]

    want = {}
    for i, h, *_ in w:
        want |= {("decision_tree_scratch_history", i): said_by(scratch, h), ("decision_tree_distilled_history", i): said_by(distilled, h), ("lookup_distilled_history", i): looked(h)}
    assert {(r.model, r.row_index): r.prediction for r in got.collect()} == want
    summary = {r.model: r for r in students.student_summary(got).collect()}
    val = [(i, t) for i, _, t, _, s in w if s == "val"]
    for model in summary:
        assert summary[model].accuracy == pytest.approx(np.mean([want[model, i] == t for i, t in val]))
        assert summary[model].teacher_retention == pytest.approx(np.mean([want[model, i] == teacher[i] for i, _ in val if i in teacher]))


def test_students_without_a_teacher_and_with_made_up_histories(spark):
    df = frame(spark, streams(), SCHEMA)
    flat, names = students.flat_history(df, 2, 1)
    none = frame(spark, [], "family string, row_index long, step int, hard int, soft array<double>")
    silent = students.history_students(flat, none, "f", names, 2, 4)
    assert {r.prediction for r in silent.where("model like '%distilled%'").collect()} == {-1}
    answers = flat.select(F.lit("f").alias("family"), "row_index", F.lit(1).alias("step"), F.col("state").alias("hard"), F.lit(None).cast("array<double>").alias("soft"))
    made = sequences.synthetic_histories(flat, 40, 0.2, 3)
    made_rows = made.select(F.col("state").alias("teacher"), *[F.col("history")[i // 3][0].eqNullSafe(i % 3).cast("int").alias(n) for i, n in enumerate(names)])
    got = students.history_students(flat, answers, "f", names, 2, 4, made_rows)
    assert got.select("model").distinct().count() == 4


def test_direct_trees_with_context(spark):
    df = frame(spark, streams(), SCHEMA).withColumnRenamed("state", "state__a").withColumn("state__b", (F.col("row_index") % 3).cast("int"))
    got = students.direct_trees(df, ["a", "b"], 2, 2, 2, 4, with_context=True)
    assert {(r.family, r.step) for r in got.select("family", "step").distinct().collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert {r.family: r.accuracy for r in students.direct_tree_summary(got).collect()}["b"] == 1.0


def test_synthetic_histories_are_near_real_ones(spark):
    df = frame(spark, streams(), SCHEMA)
    h = sequences.histories(df, 4, ["state"])
    real = {tuple(x[0] for x in r.history) for r in h.collect()}
    drawn = [tuple(x[0] for x in r.history) for r in sequences.synthetic_histories(h, 400, 0.0, 3).collect()]
    assert len(drawn) == 400 and set(drawn) <= real
    noisy = [tuple(x[0] for x in r.history) for r in sequences.synthetic_histories(h, 400, 0.5, 3).collect()]
    assert set(noisy) - real and all(set(x) <= {0, 1, 2} for x in noisy)


def wide(spark):
    rng = random.Random(7)
    rows = [(f"r{i % 4}", f"w{i % 2}", "0", float(i // 4), i, "train" if i % 4 < 3 else "test", i % 4 < 3, rng.random() * 10, rng.random() * 5 + (i % 3) * 20, None if i % 9 == 0 else rng.random()) for i in range(120)]
    return frame(spark, rows, "run_id string, workload string, cpu_or_core_id string, timestamp_ms double, row_index long, split string, is_train boolean, counter__instructions_retired double, counter__llc_misses double, counter__cycles double")


def test_sequences_are_stored_and_replaced(spark, tmp_path):
    df, path = wide(spark), str(tmp_path / "s")
    tables = build.build_sequences(df, "e1", 2, ("global", "per_workload"), selected={"global": {"LLC": "llc_misses"}}, seed=3)
    build.write_sequences(tables, path)
    first = build.counter_sequences(spark, path, "e1", "per_workload", ["llc_misses"])
    assert first.count() == 120 and {r.family_state for r in first.collect()} <= {0, 1, 2}
    build.write_sequences(build.build_sequences(df.where("run_id <> 'r0'"), "e1", 2, selected={"global": {"LLC": "llc_misses"}}, seed=3), path)
    build.write_sequences(build.build_sequences(df, "e2", 2, seed=3), path)
    assert build.family_sequences(spark, path, "e1", "global").count() == 90 and build.family_sequences(spark, path, "e2", "global").count() == 0
    assert {(r.experiment, r.scope) for r in build.experiments(spark, path).collect()} == {("e1", "global"), ("e1", "per_workload"), ("e2", "global")}
    assert build.experiments(spark, path + "-none").count() == 0
    learned = spark.read.parquet(f"{path}/clusters").where("experiment = 'e1'").first()
    assert "counter__cycles" not in learned.pressure_counters and learned.clusters == 3
    with pytest.raises(ValueError, match="scope"):
        build.scoped_states(df, "other")


def test_scoped_states_learn_from_their_workload_alone(spark):
    df = wide(spark)
    both = {r.row_index: r.state for r in build.scoped_states(df, "per_workload", seed=3)[0].collect()}
    alone = {r.row_index: r.state for r in build.scoped_states(df.where("workload = 'w1'"), "global", seed=3)[0].collect()}
    assert alone == {i: s for i, s in both.items() if i in alone} and len(both) == 120


def test_targets_must_agree(spark):
    a, b = frame(spark, [(1, 0), (2, 1)], "row_index long, target int"), frame(spark, [(1, 0), (2, 2)], "row_index long, target int")
    assert [r.row_index for r in build.different_targets({"a": a, "b": b}).collect()] == [2]
    with pytest.raises(ValueError, match="targets"):
        build.require_same_targets({"a": a, "b": b})
    with pytest.raises(ValueError, match="no state"):
        planning.require_states(frame(spark, [(5,)], "state int"))


def test_tasks_of_chunked_groups_and_their_order(spark):
    w = frame(spark, [("a",), ("b",), ("c",)], "workload string")
    tasks = collection.build_tasks(w, list(range(8)), 1, ("set2",), pairing="chunked")
    groups = {}
    for r in tasks.collect():
        groups.setdefault(r.concurrent_group_id, []).append((r.process_index, r.workload, r.affinity))
    assert {k: sorted(v) for k, v in groups.items()} == {"set2_r1_g1": [(0, "a", [0]), (1, "b", [1])], "set2_r1_g2": [(0, "c", [0]), (1, "a", [1])]}
    names = sorted(groups)
    random.Random(9).shuffle(names)
    assert [r.concurrent_group_id for r in sorted(collection.group_order(tasks, 9).collect(), key=lambda r: r.place)] == names
    with pytest.raises(ValueError, match="processors"):
        collection.processors([0, 1], [2, 1])
    assert collection.processors([], [2, 1]) == [[0, 1], [2]]
    assert [(r.workload, r.place) for r in collection.wanted_workloads(w, ["c", "x", "a"]).orderBy("place").collect()] == [("c", 0), ("a", 2)]
    assert collection.column_gaps(["run_id", "rep"]) == ["concurrent_group_id", "pairing_mode", "workload", "counter__*"]


def test_complete_collection_has_no_errors(spark):
    w = frame(spark, [("a",), ("b",), ("c",)], "workload string")
    tasks = collection.build_tasks(w, list(range(16)), 2, threads=(1, 4))
    assert {k: tasks.where(F.col("set_key") == k).count() for k in ("set1", "set2", "set3")} == {k: t for k, (t, _) in collection.expected_counts(3, 2, 2).items()}
    assert collection.collection_errors(tasks, tasks.select("set_key", F.lit(0).alias("returncode")), 3, 2, 2).count() == 0


def test_aliases_of_a_plain_machine(spark):
    names = events.candidates(spark)
    assert events.reads_memory_controllers("intel", 6, 62) and not events.reads_memory_controllers("intel", 6, 63)
    listed = frame(spark, [(v.lower(), v) for c in domain.REQUIRED_CORE + ["llc_misses"] for v in domain.EVENT_CANDIDATES[c]["intel"]], "normal string, event_name string")
    aliases = events.alias_map(names, listed, "intel")
    ready = events.readiness(aliases).first()
    assert ready.ready and ready.missing == ""
    assert not events.alias_map(names, listed, "intel").where("requires_system_wide").count()
    assert events.event_names(aliases).count() == 4 and events.event_names(aliases, "system_wide_uncore").count() == 0


def test_sinks(spark, tmp_path):
    value = {"b": [1, None], "a": {"z": 1.5, "y": "é"}}
    writers.write_json(spark, value, str(tmp_path / "j"))
    text = spark.read.text(str(tmp_path / "j"), wholetext=True).first()[0]
    assert writers.read_json(spark, str(tmp_path / "j")) == value and text.index('"a"') < text.index('"b"')
    with pytest.raises(ValueError, match="one row"):
        writers.summary_of(spark.range(2))
    rows = writers.write_tables({"x": spark.range(3), "y": spark.range(0)}, str(tmp_path / "t"), {"k": 1})
    assert rows == {"x": 3, "y": 0} and writers.read_json(spark, str(tmp_path / "t/manifest")) == {"k": 1, "rows": rows}


def test_small_tables_alone_are_broadcast(spark):
    few = spark.range(10)
    assert "broadcast" in few.join(lineage.small(few.select(F.col("id").alias("k"))), F.col("id") == F.col("k"))._jdf.queryExecution().toString().lower()
    assert lineage.small(few, 1) is few


def test_detector_tables_lack_nothing(spark):
    rows = evaluation.examples(frame(spark, streams(), SCHEMA), 2, ["state"]).select("run_id", "cpu_or_core_id", "split", "is_train", "row_index", "state", "run_length", "target", "history")
    named = {n: f for n, f in evaluation.predictors(2, ["f"]).items() if n == "baseline_last_state"}
    tables = evaluation.detector_tables(evaluation.report(rows, named))
    assert len(tables) == 12 and tables["per_process_count_accuracy"].count() == 0 and tables["per_core_accuracy"].count() == 1


def test_ablation_without_counters(spark):
    df = frame(spark, streams(), SCHEMA)
    got = selection.ablation_table(df, families={"L1": ["l1d_loads"], "L2": ["l2_misses"]})
    assert [(r.family, r.candidate_type, r.selected) for r in got.orderBy("family").collect()] == [("L1", "unavailable", 0), ("L2", "unavailable", 0)]


def test_profiles_and_indicators(spark):
    config = domain.merged_config(domain.DEFAULTS, {"runtime": {"profile": "own", "own": {}}})
    assert domain.with_profile(config)["runtime"]["profile"] == "own" and "teacher" not in domain.with_profile(config)
    assert domain.with_profile(config, full=True)["teacher"]["epochs"] == 15
    assert domain.derived_there("LLC", ["llc_miss_rate", "x"]) == ["llc_miss_rate"]
    row = features.indicators(frame(spark, [(10.0, 5.0, 2.0, 4.0)], "c double, i double, m double, d double"), "c", "i", {"mpki": "m"}, "d").first()
    assert (row.cpi, row.ipc, row.mpki, row.mpki_per_ms) == (2.0, 0.5, 400.0, 0.5)


def test_families_may_be_a_table_of_any_number(spark):
    """The plan does not grow with the number of families, and the rows are those of the list."""
    aliases = spark.range(5000).selectExpr("concat('f', id) AS family", "id % 7 <> 0 AS supported", "'task_local' AS collection_scope", "concat('e', id) AS selected_event")
    names = [f"f{k}" for k in range(0, 6000, 3)]
    table = spark.range(0, 6000, 3).selectExpr("concat('f', id) AS family", "id / 3 AS place")
    got = events.family_events(aliases, table)
    want = {(i, f, f"e{f[1:]}") for i, f in enumerate(names) if int(f[1:]) < 5000 and int(f[1:]) % 7}
    assert {tuple(r) for r in got.collect()} == want == {tuple(r) for r in events.family_events(aliases, names).collect()}
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 5000


def test_experiments_read_the_rows_a_fixed_number_of_times(spark):
    """Splits of many workloads take no pass over the rows each, and are those of the modes by themselves."""
    read = spark.sparkContext.accumulator(0)

    def count(x):
        read.add(1)
        return x

    counted = F.udf(count, "long").asNondeterministic()
    rows = spark.range(60).select(counted("id").alias("row_index")).selectExpr("concat('run_', row_index % 30) AS run_id", "concat('g', row_index % 15) AS concurrent_group_id", "concat('w', row_index % 5) AS workload", "row_index % 3 AS threads", "row_index")
    got = {(r.experiment, r.run_id): r.split for r in splits.experiment_splits(rows).collect()}
    assert read.value <= 3 * 60
    assert len(got) == 8 * 30
    alone = {"run_holdout": splits.run_grouped(rows), "config_holdout": splits.config_grouped(rows, seed=118), "scenario_holdout": splits.per_scenario(rows, seed=228), "leave_out_w3": splits.leave_one_out(rows, "w3")}
    for name, table in alone.items():
        assert {r.run_id: r.split for r in table.collect()} == {run: s for (e, run), s in got.items() if e == name}
