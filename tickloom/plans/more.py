"""Queries for the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import build, evaluation, features, merge, metrics, models, phases, planning, policy, selection, sequences, splits
from ..operators.lineage import fresh_path
from ..operators.quantiles import quantiles
from ..sources import adapter, readers
from ..streaming import online
from . import frames
from .frames import VALUE, sql, sql_uniform
from .registry import _PRED, COLS, _sql_family, _test_rows, _two_families, query, r6

# -- scalars -----------------------------------------------------------------


@query("p5_lists_and_ranges", "SELECT o_orderkey, 3 AS n, 'b' AS second, 4 + o_orderkey % 3 AS n_range FROM orders")
def p5(spark, d):
    o = adapter.table(spark, d, "orders")
    spans = F.concat(F.lit("0-"), (F.col("o_orderkey") % 3 + 2).cast("string"), F.lit(",9"))
    return o.select("o_orderkey", F.size(fn.split_list(F.lit(" a,b ,,c,"))).alias("n"), fn.split_list(F.lit(" a,b ,,c,"))[1].alias("second"), F.size(fn.range_list(spans)).cast("long").alias("n_range"))


@query("p7_ratios", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_linenumber - 1, 0) * 1000, 4) AS r FROM lineitem")
def p7(spark, d):
    return adapter.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.ratio(F.col("l_extendedprice"), F.col("l_linenumber") - 1, 1000.0), 4).alias("r"))


@query("p10_row_means", sql("wide", f"SELECT run_id, timestamp_ms, round(list_avg([{', '.join(COLS)}]), 6) AS mean FROM wide"))
def p10(spark, d):
    return frames.mean_of(frames.wide(spark, d), COLS).select("run_id", "timestamp_ms", *r6("mean"))


@query("p16_one_hot", sql("states", "SELECT row_index, CAST(state = 0 AS INT) AS s0, CAST(state = 1 AS INT) AS s1, CAST(state = 2 AS INT) AS s2, least(greatest(state, 0), 2) AS clamped FROM states"))
def p16(spark, d):
    h = fn.one_hot(F.col("state"))
    return frames.states(spark, d).select("row_index", h[0].alias("s0"), h[1].alias("s1"), h[2].alias("s2"), fn.clamp_state(F.col("state")).alias("clamped"))


@query("p17_unit_identity", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'task' ELSE CAST(user_id % 4 // 2 AS VARCHAR) END AS unit_id, CASE WHEN user_id % 5 = 0 THEN 'task_local' ELSE 'system_wide_physical_core' END AS collection_scope FROM events")
def p17(spark, d):
    e = adapter.table(spark, d, "events")
    rows = e.select("event_id", F.when(F.col("user_id") % 5 == 0, "").otherwise((F.col("user_id") % 4).cast("string")).alias("cpu_or_core_id"), F.lit("task").alias("task"))
    topology = F.create_map(*[F.lit(x) for c in range(4) for x in (str(c), str(c // 2))])
    return merge.unit_identity(rows, topology, "system_wide_physical_core", "task").select("event_id", "unit_id", "collection_scope")


@query("p19_thread_process_groups", "SELECT l_orderkey, l_linenumber, 'threads=' || l_linenumber || '|processes=' || CASE WHEN l_linenumber % 2 = 0 THEN 'unknown' ELSE '2' END AS g FROM lineitem")
def p19(spark, d):
    processes = F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise("2")
    return adapter.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.thread_process_group(F.col("l_linenumber"), processes).alias("g"))


@query("p24_weighted_scores", sql("examples", *_PRED, "SELECT workload, round(0.7 * avg(CAST(target = prediction AS DOUBLE)) + 0.3 * coalesce(avg(CASE WHEN target = 2 THEN CAST(prediction = 2 AS DOUBLE) END), 0), 6) AS score FROM test GROUP BY workload"))
def p24(spark, d):
    s = metrics.classification_scores(metrics.confusion(_test_rows(spark, d), ["workload"]), ["workload"])
    return s.select("workload", F.round(selection.weighted_score(), 6).alias("score"))


@query("p25_tree_bytes", "SELECT p_partkey, (p_size * (ceil(log2(greatest(p_size, 2))) + 16 + 2 * ceil(log2(greatest(2 * p_size + 1, 2)))) + 2 * (p_size + 1)) / 8.0 AS bytes FROM part")
def p25(spark, d):
    n = F.col("p_size")
    return adapter.table(spark, d, "part").select("p_partkey", policy.tree_bytes(n, n + 1, n).alias("bytes"))


# -- sources -----------------------------------------------------------------


@query("s8_suite_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def s8(spark, d):
    return build.only(adapter.table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey")


@query("s9_stored_sequences", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE o_orderkey % 4 END AS family_state, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 2 END AS future_state_1, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM orders")
def s9(spark, d):
    k = F.col("o_orderkey")
    stored = adapter.table(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 3, "").otherwise((k % 4).cast("string")).alias("family_state"), F.when(k % 3 == 0, " ").otherwise("2").alias("future_state_1"), F.when(k % 2 == 0, "").otherwise("test").alias("split"))
    return sequences.known_states(stored, 1).withColumn("family_state", F.col("family_state").cast("long"))


@query("k1_ragged_union", "SELECT n_nationkey AS k, n_name AS name, NULL AS extra FROM nation UNION ALL SELECT r_regionkey AS k, NULL AS name, r_name AS extra FROM region".replace("NULL AS extra", "CAST(NULL AS VARCHAR) AS extra").replace("NULL AS name", "CAST(NULL AS VARCHAR) AS name"))
def k1(spark, d):
    a = adapter.table(spark, d, "nation").selectExpr("n_nationkey as k", "n_name as name")
    b = adapter.table(spark, d, "region").selectExpr("r_regionkey as k", "r_name as extra")
    return readers.union_ragged([a, b])


@query("k12_mean_of_means", "SELECT flag, round(avg(m), 6) AS price, count(*) AS groups FROM (SELECT l_returnflag AS flag, l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY flag")
def k12(spark, d):
    rows = adapter.table(spark, d, "lineitem").selectExpr("l_returnflag as flag", "l_suppkey", "l_extendedprice as price")
    return metrics.mean_of_means(rows, "price", ["flag", "l_suppkey"], ["flag"]).select("flag", *r6("price"), "groups")


# -- joins -------------------------------------------------------------------


@query("j1_alias_collisions", "SELECT event_id, CASE event_type WHEN 'view' THEN 'late' WHEN 'click' THEN 'clicks' END AS counter FROM events")
def j1(spark, d):
    e = adapter.table(spark, d, "events").select("event_id", F.concat(F.upper("event_type"), F.lit(":u")).alias("event_name"))
    aliases = spark.createDataFrame([("view", "early", 0), ("VIEW:k", "late", 1), ("click", "clicks", 2)], "event_name string, counter string, priority int")
    return merge.map_events(e, aliases).select("event_id", "counter")


@query("j5_attach_metadata", "SELECT o_orderkey, c_name AS workload, c_mktsegment AS suite FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j5(spark, d):
    runs = adapter.table(spark, d, "customer").selectExpr("c_custkey as o_custkey", "c_name as workload", "c_mktsegment as suite")
    return merge.attach_metadata(adapter.table(spark, d, "orders"), runs, "o_custkey", ["workload", "suite", "threads"]).select("o_orderkey", "workload", "suite")


@query("j8_prefer_first", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey AS k, 'fallback' AS v FROM nation WHERE n_regionkey <> 1")
def j8(spark, d):
    n = adapter.table(spark, d, "nation")
    first = n.where("n_regionkey = 1").selectExpr("n_nationkey as k", "n_name as v")
    return selection.prefer(first, n.selectExpr("n_nationkey as k", "'fallback' as v"), ["k"])


@query("j11_family_tuples", sql("base", _sql_family(0, COLS[0]), _sql_family(1, COLS[1]), "SELECT row_index, a.target AS target__core_fp, a.prediction AS prediction__core_fp, CASE WHEN row_index % 3 = 0 THEN -1 ELSE b.target END AS target__branch_control, CASE WHEN row_index % 3 = 0 THEN -1 ELSE b.prediction END AS prediction__branch_control FROM s0 a JOIN s1 b USING (row_index)"))
def j11(spark, d):
    rows = _two_families(spark, d).where("family = 'core_fp' or row_index % 3 <> 0")
    return metrics.family_tuples(rows, ["row_index"], ["core_fp", "branch_control"])


@query("j14_listed_and_stale", "SELECT o_orderkey, o_custkey % 3 = 0 AS listed FROM orders")
def j14(spark, d):
    o = adapter.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("directory"))
    manifest = adapter.table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("directory"))
    kept, stale = readers.resolve_directories(o, manifest)
    return kept.select("o_orderkey", F.lit(True).alias("listed")).unionByName(stale.select("o_orderkey", F.lit(False).alias("listed")))


# -- evaluation --------------------------------------------------------------


@query("a18_family_scores", sql("base", _sql_family(0, COLS[0]), _sql_family(1, COLS[1]), """SELECT family, count(*) AS rows, round(avg(CAST(target = prediction AS DOUBLE)), 6) AS accuracy FROM (SELECT 'core_fp' AS family, * FROM s0 UNION ALL SELECT 'branch_control' AS family, * FROM s1)
WHERE split = (SELECT CASE WHEN max(CAST(split = 'val' AS INT)) = 1 THEN 'val' ELSE 'test' END FROM base) AND target >= 0 AND prediction >= 0 GROUP BY family"""))
def a18(spark, d):
    rows = metrics.usable(metrics.mask_rows(_two_families(spark, d), metrics.SELECT))
    return metrics.classification_scores(metrics.confusion(rows, ["family"]), ["family"]).select("family", "rows", *r6("accuracy"))


@query("a20_transition_tables", sql("examples", "SELECT state, " + ", ".join(f"1 + count(*) FILTER (target = {s}) AS to_{s}" for s in range(3)) + " FROM examples WHERE is_train AND target >= 0 GROUP BY state"))
def a20(spark, d):
    return metrics.transition_table(frames.examples(spark, d).where("is_train"), prior=1)


@query("f9_stable_and_moving", sql("examples", *_PRED, "SELECT threads, cpu_or_core_id, count(*) FILTER (target = state) AS stable, count(*) FILTER (target <> state) AS moving FROM test GROUP BY 1, 2"))
def f9(spark, d):
    return metrics.stable_and_moving(_test_rows(spark, d), ["threads", "cpu_or_core_id"])


@query("m22_blended_targets", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 3 WHEN o_custkey % 3 = 0 THEN CASE WHEN 0.7 * 0.2 + 0.3 >= 0.7 * 0.6 THEN 0 ELSE 2 END WHEN o_custkey % 3 = 1 THEN CASE WHEN 0.7 * 0.2 + 0.3 > 0.7 * 0.6 THEN 1 ELSE 2 END ELSE 2 END AS target FROM orders")
def m22(spark, d):
    soft = F.when(F.col("o_orderkey") % 5 != 0, F.array(F.lit(0.2), F.lit(0.2), F.lit(0.6)))
    return adapter.table(spark, d, "orders").select("o_orderkey", models.blended_target(soft, (F.col("o_custkey") % 3).cast("int"), 0.3).cast("long").alias("target"))


@query("w9_target_windows", sql("states", """h AS (SELECT row_index, list(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h, row_number() OVER w AS k, coalesce(lead(state, 1) OVER w, -1) AS t1, coalesce(lead(state, 2) OVER w, -1) AS t2 FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))""", "SELECT row_index, t1, t2, array_to_string(list_transform(flatten(list_transform(h, lambda s: [CAST(s = 0 AS INT), CAST(s = 1 AS INT), CAST(s = 2 AS INT)])), lambda x: CAST(x AS VARCHAR)), '') AS one_hot FROM h WHERE k >= 3 AND t1 >= 0 AND t2 >= 0"))
def w9(spark, d):
    t = sequences.target_windows(frames.states(spark, d), 3, 2, ["state"])
    return t.select("row_index", F.col("targets")[0].alias("t1"), F.col("targets")[1].alias("t2"), F.array_join(F.transform("one_hot", lambda x: x.cast("string")), "").alias("one_hot"))


@query("w10_temporal_features", sql("examples", "SELECT row_index, previous, run_length, (threads % 3 + 1) * 4 + (CAST(cpu_or_core_id AS INT) % 3 + 1) AS context FROM examples"))
def w10(spark, d):
    s = frames.states(spark, d).withColumns({"a": F.col("threads") % 3, "b": F.col("cpu_or_core_id").cast("int") % 3})
    return sequences.temporal_features(s, context=("a", "b")).select("row_index", "previous", "run_length", "context")


@query(
    "w11_synthetic_histories",
    sql(
        "states", "h AS (SELECT row_index, row_number() OVER w AS n, list(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h, lead(state) OVER w AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))",
        "p AS (SELECT row_index, h, target, row_number() OVER (ORDER BY row_index) - 1 AS place, count(*) OVER () AS n_rows FROM h WHERE n >= 4 AND target IS NOT NULL)",
        f"dr AS (SELECT i AS draw, CAST(floor({sql_uniform(5, 'i')} * (SELECT count(*) FROM p)) AS BIGINT) AS place FROM range(500) t(i))",
        f"st AS (SELECT draw, row_index, target, j, CASE WHEN {sql_uniform(5, 'draw', 'j')} < 0.1 THEN CAST(floor({sql_uniform(5, 'draw', 'j')} / 0.1 * 3) AS INT) ELSE h[j + 1] END AS s FROM dr JOIN p USING (place), range(4) t(j))",
        "SELECT draw, row_index, target, string_agg(s, ',' ORDER BY j) AS history FROM st GROUP BY ALL",
    ),
)
def w11(spark, d):
    """500 windows drawn by hash, with noise."""
    h = sequences.histories(frames.states(spark, d), 4, ["state"])
    return sequences.synthetic_histories(h, 500, 0.1, 5).select("draw", "row_index", "target", F.array_join(F.flatten("history"), ",").alias("history"))


@query("t6_states_by_mean", "WITH m AS (SELECT l_suppkey % 5 AS c, avg(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT c AS cluster, row_number() OVER (ORDER BY q, c) - 1 AS state FROM m")
def t6(spark, d):
    m = adapter.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("cluster")).agg(F.avg("l_quantity").alias("q"))
    return selection.rank_within(m.withColumn("one", F.lit(1)), ["one"], [F.col("q"), F.col("cluster")]).select("cluster", (F.col("rank") - 1).alias("state"))


@query("t8_first_supported", "SELECT 'f' || (p_partkey % 7) AS family, min(p_partkey) FILTER (p_partkey % 2 = 0) AS priority, count(*) FILTER (p_partkey % 2 = 0) > 0 AS supported FROM part GROUP BY 1")
def t8(spark, d):
    part = adapter.table(spark, d, "part")
    candidates = part.select(F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("family"), F.concat(F.lit("Event "), F.col("p_partkey").cast("string")).alias("event_name"), F.col("p_partkey").alias("priority"))
    supported = candidates.where("priority % 2 = 0").select(fn.normal_event(F.col("event_name")).alias("normal"))
    return planning.resolve_aliases(candidates, supported).select("family", "priority", "supported")


@query("e1_event_aliases", "SELECT DISTINCT lower(c_mktsegment) AS normal, c_mktsegment AS event_name FROM customer UNION SELECT DISTINCT 'n' || c_nationkey AS normal, 'N' || c_nationkey || ':u' AS event_name FROM customer")
def e1(spark, d):
    c = adapter.table(spark, d, "customer")
    lines = c.select(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" OR N"), F.col("c_nationkey").cast("string"), F.lit(":u   [Hardware event]")).alias("value"))
    return planning.event_aliases(lines)


@query("x2_group_splits")
def x2(spark, d):
    """Whole execution groups to a split; drawn by NumPy, so rows only."""
    return splits.run_grouped(frames.base(spark, d))


@query("x5_leave_one_out")
def x5(spark, d):
    """Every run to a split; the runs that are not held out are drawn by NumPy, so rows only."""
    return splits.leave_one_out(frames.base(spark, d).withColumn("concurrent_group_id", F.col("run_id")), "w3")


@query("v2_file_digests")
def v2(spark, d):
    """SHA-256 of the files of every table, in one file or a folder of parts; SQL does not read raw files."""
    return readers.file_digests(spark, d, "*.parquet", nested=True).select("length", "sha256")


@query("o9_representatives", "WITH x AS (SELECT p_brand AS grp, p_partkey AS column, p_retailprice AS score FROM part) SELECT grp, \"column\" FROM x QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, \"column\") = 1".replace("AS column", 'AS "column"'))
def o9(spark, d):
    part = adapter.table(spark, d, "part").selectExpr("p_brand as grp", "p_partkey as column", "p_retailprice as score")
    return selection.representatives(part, ["grp"], ["score"], "column").select("grp", "column")


@query("o4_indicators", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS cpi, l_quantity / nullif(l_extendedprice, 0) AS ipc, l_tax / nullif(l_quantity, 0) * 1000 AS mpki FROM lineitem")
def o4(spark, d):
    rows = features.indicators(adapter.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", {"mpki": "l_tax"})
    return rows.select("l_orderkey", "l_linenumber", "cpi", "ipc", "mpki")


@query("m5_one_dimensional_states")
def m5(spark, d):
    """States of one counter by k-means on its signed log; drawn by NumPy, so rows only."""
    return phases.one_dimensional_states(frames.base(spark, d), VALUE)[0].select("row_index", "state")


@query("m30_ablation_of_one_thread")
def m30(spark, d):
    """The choice of counters on runs of one thread."""
    return selection.ablation(frames.states(spark, d).where("threads = 1"), families={"branch_control": ["branch_instructions"], "LLC": ["llc_misses"]}, max_depth=2)


@query("m32_model_cost_rows", sql("examples", *_PRED, "SELECT 'markov_phase_predictor' AS model, count(*) AS rows, round(avg(CAST(target = prediction AS DOUBLE)), 6) AS accuracy, 18.0 AS memory_bytes, 'Very Low' AS complexity FROM test".replace("18.0 AS", "CAST(18 AS DOUBLE) AS")))
def m32(spark, d):
    scores = metrics.classification_scores(metrics.confusion(_test_rows(spark, d))).select(F.lit("markov_phase_predictor").alias("model"), "rows", *r6("accuracy"))
    return scores.join(policy.deployment_cost(scores.select("model")).select("model", "memory_bytes", "complexity"), "model")


@query("m24_direct_tree")
def m24(spark, d):
    """Accuracy of a tree on the one-hot history of true states."""
    t = sequences.target_windows(frames.states(spark, d), 3, 1, ["state"])
    rows = t.select("row_index", "split", "is_train", "state", F.col("targets")[0].alias("target"), *[F.col("one_hot")[i].alias(f"x{i}") for i in range(9)])
    tree = models.fit_tree(rows.where("is_train"), [f"x{i}" for i in range(9)], "target", 3, 8)
    return metrics.classification_scores(metrics.confusion(metrics.mask_rows(rows.withColumn("prediction", models.tree_expression(tree)), (), else_all=True)))


@query("a6_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, CAST(0.05 AS DOUBLE)), 6) AS p05, round(quantile_cont(l_extendedprice, CAST(0.5 AS DOUBLE)), 6) AS p50, round(quantile_cont(l_extendedprice, CAST(0.95 AS DOUBLE)), 6) AS p95 FROM lineitem GROUP BY l_returnflag")
def a6(spark, d):
    q = quantiles(adapter.table(spark, d, "lineitem"), ["l_extendedprice"], [0.05, 0.5, 0.95], ["l_returnflag"])
    return q.select("l_returnflag", *[F.round(F.col("q__l_extendedprice")[i], 6).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


@query("a13_hamming", sql("base", _sql_family(0, COLS[0]), "SELECT split, round(avg(CAST(target <> prediction AS DOUBLE)), 6) AS hamming FROM s0 GROUP BY split"))
def a13(spark, d):
    rows = _two_families(spark, d).where("family = 'core_fp'")
    return metrics.hamming(rows, ["split"]).select("split", *r6("hamming"))


@query("stream_windowed_sums", "SELECT 'run_' || user_id AS run_id, CAST(epoch_ms(date_trunc('day', ts)) AS DOUBLE) AS timestamp_ms, round(sum(value) FILTER (event_type = 'view'), 6) AS counter__instructions_retired FROM events GROUP BY 1, 2")
def stream(spark, d):
    """The pivot of a day's samples by a watermarked stream, run to its end over the table and a closing row."""
    where = fresh_path(spark, "stream")
    e = adapter.table(spark, d, "events").select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.lit("0").alias("cpu_or_core_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "instructions_retired").alias("counter"), "value")
    e.write.parquet(f"{where}/in")
    # a far later row of no run closes the last window
    e.agg((F.max("ts") + F.expr("interval 1 year")).alias("ts")).select(F.lit("").alias("run_id"), F.lit("0").alias("cpu_or_core_id"), "ts", F.lit("").alias("counter"), F.lit(0.0).alias("value")).write.mode("append").parquet(f"{where}/in")
    source = spark.readStream.schema(e.schema).parquet(f"{where}/in")
    sums = online.windowed_sums(source, ["instructions_retired"], late="60 days")
    run = sums.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{where}/out").where("run_id <> ''").select("run_id", "timestamp_ms", *r6("counter__instructions_retired"))


@query("merge_end_to_end", sql("wide", "SELECT run_id, timestamp_ms, round(counter__branch_mispredictions / nullif(counter__branch_instructions, 0), 6) AS branch_miss_rate, round(counter__llc_misses / nullif(counter__llc_references, 0), 6) AS llc_miss_rate FROM wide"))
def merge_end_to_end(spark, d):
    """Samples to durations to features in one plan."""
    rows = features.derived_features(merge.with_durations(frames.wide(spark, d, True)))
    return rows.select("run_id", "timestamp_ms", *r6("branch_miss_rate", "llc_miss_rate"))

@query("m18_skipped_models", "SELECT event_type AS family, m AS model, 'skipped' AS status, 'torch is not installed' AS reason FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (VALUES ('tcn_phase_classifier'), ('tiny_transformer_phase_classifier')) v(m)")
def m18(spark, d):
    """What each family's detector says of the models that it cannot fit."""
    families = adapter.table(spark, d, "events").select(F.col("event_type").alias("family")).distinct()
    return families.crossJoin(F.broadcast(evaluation.skipped(spark)))


@query("r6_detector_summary")
def r6_detector(spark, d):
    """All predictors on one frame of examples: scores, change detection, gains and cost; trees are learned, so rows only."""
    filled = features.fill_train_median(frames.base(spark, d), [VALUE])
    rows = evaluation.examples(phases.tertile_states(filled, VALUE), 4, ["state"]).select("run_id", "workload", "cpu_or_core_id", "threads", "split", "is_train", "row_index", "state", "run_length", "target", "history", "h0", "h1", "h2", "h3")
    return evaluation.report(rows, evaluation.predictors(4, ["core_fp"], 3))["summary"]


@query(
    "r5_evaluate_outputs",
    sql("base", _sql_family(0, COLS[0]), _sql_family(1, COLS[1]), """u AS (SELECT 'core_fp' AS family, * FROM s0 UNION ALL SELECT 'branch_control' AS family, * FROM s1),
sp AS (SELECT CASE WHEN max(CAST(split = 'val' AS INT)) = 1 THEN 'val' ELSE 'test' END AS s FROM base)""", """SELECT 'baseline_last_state' AS model, family, count(*) FILTER (split = s AND target >= 0 AND prediction >= 0) AS rows, round(avg(CASE WHEN split = s AND target >= 0 AND prediction >= 0 THEN CAST(target = prediction AS DOUBLE) END), 6) AS accuracy,
  round(avg(CASE WHEN target >= 0 THEN CAST(prediction = target AS DOUBLE) END), 6) AS retention, CAST(1 AS DOUBLE) AS memory_bytes, 'Very Low' AS complexity FROM u, sp GROUP BY family"""),
)
def r5(spark, d):
    student = _two_families(spark, d).withColumn("model", F.lit("baseline_last_state"))
    teacher = student.select("family", "row_index", F.col("target").alias("prediction"))
    costs = student.select("model").distinct()
    out = evaluation.evaluate(student, teacher, costs, ["row_index"], ["core_fp", "branch_control"])["families"]
    return out.select("model", "family", "rows", *r6("accuracy", "retention"), "memory_bytes", "complexity")


@query("f10_enabled_models", "SELECT event_type AS family, CASE event_type WHEN 'view' THEN 9 ELSE 3 END AS models FROM (SELECT DISTINCT event_type FROM events)")
def f10(spark, d):
    """How many models run for each family, with views as the one that global models run for."""
    names = list(evaluation.predictors(4, ["view"]))
    families = [r[0] for r in adapter.table(spark, d, "events").select("event_type").distinct().collect()]  # five types
    return spark.createDataFrame([(f, len(evaluation.enabled(names, f, "view"))) for f in families], "family string, models int")
