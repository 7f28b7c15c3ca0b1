"""Queries for stored sequences, teachers and students, ablation tables, event names, collections, sinks and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain
from ..functions import scalars as fn
from ..operators import build, collection, evaluation, events, features, merge, metrics, models, phases, planning, policy, selection, sequences, splits, stats, students
from ..operators.lineage import fresh_path
from ..operators.quantiles import quantiles
from ..sources import adapter, readers, writers
from ..streaming import online, perf, scoring
from . import frames
from .frames import COUNTERS, VALUE, sql
from .registry import _PRED, COLS, ORACLES, _first, _sql_family, _test_rows, _two_families, query, r6

# -- sources and sinks -------------------------------------------------------


@query("s1_csv_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS missing FROM orders")
def s1(spark, d):
    """A table written as CSV and read again as strings, with the empty table of a path that is not there."""
    path = fresh_path(spark, "csv")
    adapter.table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.csv(path, header=True)
    return readers.read_csv(spark, path).unionByName(readers.read_csv(spark, path + "-none", "o_orderkey string, o_orderstatus string, missing string"), allowMissingColumns=True)


@query("s2_json_records", "SELECT 'run_' || n_nationkey AS run_id, n_name AS workload, n_regionkey AS threads FROM nation")
def s2(spark, d):
    path = fresh_path(spark, "json")
    adapter.table(spark, d, "nation").selectExpr("concat('run_', n_nationkey) as run_id", "n_name as workload", "n_regionkey as threads").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_metadata(spark, path).select("run_id", "workload", F.col("threads").cast("long").alias("threads"))


@query("s7_phase_log", "SELECT CAST(n_nationkey * 10 AS DOUBLE) AS start_ms, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey * 10 + 5 AS DOUBLE) END AS end_ms, n_name AS phase_label FROM nation")
def s7(spark, d):
    """A phase log with ends that were not noted; none where there is no log."""
    path = fresh_path(spark, "log")
    log = adapter.table(spark, d, "nation").select((F.col("n_nationkey") * 10).alias("start_ms"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise((F.col("n_nationkey") * 10 + 5).cast("string")).alias("end_ms"), F.col("n_name").alias("phase_label"))
    log.write.csv(path, header=True)
    return readers.read_phase_log(spark, path).unionByName(readers.read_phase_log(spark, path + "-none")).select("start_ms", "end_ms", "phase_label")


@query("s19_key_values", "SELECT c_mktsegment AS key, 'a: ' || max(c_name) AS value FROM customer GROUP BY 1")
def s19(spark, d):
    lines = adapter.table(spark, d, "customer").orderBy("c_name").coalesce(1).select(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" :  a: "), F.col("c_name"), F.lit(" ")).alias("value"))
    return writers.key_values(lines.unionByName(lines.select(F.lit("no colon").alias("value"))))


@query("k2_json_summary", "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total, min(o_orderstatus) AS least FROM orders")
def k2(spark, d):
    path = fresh_path(spark, "summary")
    writers.write_json(spark, writers.summary_of(adapter.table(spark, d, "orders").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderstatus").alias("least"))), path)
    found = writers.read_json(spark, path)
    return spark.createDataFrame([(found["rows"], found["total"], found["least"])], "rows long, total double, least string")


_PERF_ROWS = "SELECT CAST(event_id AS DOUBLE) AS timestamp_ms, event_type AS event_name, CASE WHEN event_id % 17 <> 0 THEN value END AS value, CASE WHEN event_id % 17 = 0 THEN 'not counted' ELSE 'ok' END AS status FROM events"


@query("k3_perf_table", _PERF_ROWS)
def k3(spark, d):
    """perf_long rows through a file with the fixed header."""
    path = fresh_path(spark, "perf")
    e = adapter.table(spark, d, "events")
    gone = F.col("event_id") % 17 == 0
    writers.write_perf(e.select(F.col("event_id").alias("timestamp_ms"), F.when(~gone, F.col("value")).alias("value"), F.col("event_type").alias("event_name"), F.when(gone, "not counted").otherwise("ok").alias("status")), path)
    return writers.read_perf_table(spark, path).select("timestamp_ms", "event_name", "value", "status")


@query(
    "k4_merge_outputs",
    sql("wide", """SELECT (SELECT count(DISTINCT run_id) FROM wide) AS run_count, (SELECT count(*) FROM wide) AS interval_rows, (SELECT count(DISTINCT cpu_or_core_id) FROM wide) AS aggregate_rows, 5 AS pmu_quality_families, 3 AS manifest_run_count,
  (SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (1, 2, 3)) AS merged_run_count, (SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (1, 2, 3)) AS filtered_stale_run_count""", quality=True),
)
def k4(spark, d):
    """Summary of a merge whose three tables were written."""
    wide = frames.wide(spark, d, True)
    aggregate = merge.pivot_sum(frames.samples(spark, d), COUNTERS, ["cpu_or_core_id"])
    files = adapter.table(spark, d, "events").select(F.concat(F.lit("/runs/u"), F.col("user_id").cast("string"), F.lit("/a.csv")).alias("path"))
    manifest = spark.createDataFrame([("/runs/u1",), ("/runs/u2",), ("/runs/u3",)], "directory string")
    s = writers.write_merge(wide, aggregate, merge.collection_quality(wide, COUNTERS), fresh_path(spark, "merge"), files, manifest)
    names = ["run_count", "interval_rows", "aggregate_rows", "pmu_quality_families", "manifest_run_count", "merged_run_count", "filtered_stale_run_count"]
    return spark.createDataFrame([tuple(s[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("v2_file_digest_of_text", "SELECT sha256(n_name || chr(10)) AS sha256, n_name AS name FROM nation")
def v2t(spark, d):
    """Digests of files of one line each, one per nation."""
    path = fresh_path(spark, "digests")
    adapter.table(spark, d, "nation").select("n_name", F.col("n_name").alias("value")).write.partitionBy("n_name").text(path)
    found = readers.file_digests(spark, path, "*.txt", nested=True)
    return found.select("sha256", F.url_decode(F.regexp_replace(F.regexp_extract("path", "n_name=([^/]*)/", 1), r"\+", "%2B")).alias("name"))


# -- projections over names ---------------------------------------------------

_KINDS = ["l1d_loads", "cycles", "llc_misses", "IPC_raw", "memory_read_bandwidth", "resource_stalls", "branch_mispredictions", "runtime_ns", "elapsed"]
_SQL_NAMES = "(SELECT DISTINCT CASE WHEN p_size % 11 = 0 THEN 'other' ELSE 'counter' END || '__' || lower(replace(p_brand, '#', '_')) || '_' || [" + ", ".join(f"'{k}'" for k in _KINDS) + f"][p_size % {len(_KINDS)} + 1] AS name FROM part)"
_BAD = " OR ".join(f"lower(name) LIKE '%{p}%'" for p in ["cycle", "ipc", "cpi", "elapsed", "stall", "per\\_ms", "interval\\_duration", "runtime"]).replace("%per\\_ms%'", "%per\\_ms%' ESCAPE '\\'").replace("%interval\\_duration%'", "%interval\\_duration%' ESCAPE '\\'")


def _names(spark, d) -> list[str]:
    """Columns that a collection by the parts' brands and sizes would have: a few hundred."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_size") % len(_KINDS) + 1).cast("int"))
    name = F.concat(F.when(F.col("p_size") % 11 == 0, "other").otherwise("counter"), F.lit("__"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_"), kind)
    return [r[0] for r in adapter.table(spark, d, "part").select(name).distinct().collect()]


@query("p20_safe_counters", f"SELECT name FROM {_SQL_NAMES} WHERE name LIKE 'counter%' AND NOT ({_BAD})")
def p20(spark, d):
    return spark.createDataFrame([(c,) for c in domain.safe_counters(_names(spark, d))], "name string")


@query("p21_pressure_counters", f"SELECT name FROM {_SQL_NAMES} WHERE name LIKE '%llc_misses%' OR (name LIKE '%memory%' AND name LIKE '%bandwidth%') OR name LIKE '%branch_mispredictions%' OR name LIKE '%stall%'")
def p21(spark, d):
    return spark.createDataFrame([(c,) for c in domain.pressure_counters(_names(spark, d))], "name string")


@query("p22_counters_there", sql("wide", "cols AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{c}', {i})" for f, cs in domain.FAMILY_COUNTERS.items() for i, c in enumerate(cs)) + ") v(family, counter, place)), have AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM wide))", "SELECT family, coalesce(string_agg(counter, ',' ORDER BY place) FILTER ('counter__' || counter IN (SELECT c FROM have)), '') AS counters FROM cols GROUP BY family"))
def p22(spark, d):
    return spark.createDataFrame([(f, ",".join(c)) for f, c in domain.counters_there(frames.wide(spark, d).columns).items()], "family string, counters string")


@query("s18_runtime_profile", "SELECT machine, profile, epochs, depth FROM (SELECT p_brand AS machine, max(p_size) AS depth, min(p_size) + 2 AS quick FROM part GROUP BY p_brand) CROSS JOIN (VALUES ('quick'), ('full')) v(profile), LATERAL (SELECT CASE profile WHEN 'quick' THEN quick ELSE 15 END AS epochs)")
def s18(spark, d):
    """Both profiles of each brand's configuration, whose tree depth and quick epochs are those of its parts: 25 records."""
    own = adapter.table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("depth"), F.min("p_size").alias("least")).collect()
    rows = []
    for r in own:
        config = domain.merged_config(domain.DEFAULTS, {"detector": {"tree_max_depth": r["depth"]}, "runtime": {"quick": {"teacher_epochs": r["least"] + 2}}})
        rows += [(r["p_brand"], c["runtime"]["profile"], c["teacher"]["epochs"], c["detector"]["tree_max_depth"]) for c in (domain.with_profile(config, full) for full in (False, True))]
    return spark.createDataFrame(rows, "machine string, profile string, epochs int, depth int")


@query("r2_counter_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2, 3) THEN NULL ELSE o_totalprice END AS value, CAST(NULL AS DOUBLE) AS absent FROM orders")
def r2(spark, d):
    """A counter as numbers where its text is blank, nan or inf, and one that the table lacks."""
    k = F.col("o_orderkey") % 4
    rows = adapter.table(spark, d, "orders").select("o_orderkey", F.when(k == 1, "").when(k == 2, "nan").when(k == 3, "-inf").otherwise(F.col("o_totalprice").cast("string")).alias("counter__price"))
    return features.counter_values(features.counter_values(rows, "price"), "nothing", "absent").select("o_orderkey", "value", "absent")


@query("r12_summary_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1")
def r12(spark, d):
    rows = adapter.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("experiment"), (F.col("o_custkey") % 3).cast("string").alias("scope"))
    return evaluation.summary_rows(rows, "F", "1").select("o_orderkey")


# -- filters and checks -------------------------------------------------------


@query("f6_all_but_training", sql("base", "SELECT split, count(*) AS rows FROM base WHERE split <> 'train' GROUP BY split"))
def f6(spark, d):
    return metrics.mask_rows(frames.base(spark, d), (), else_all=True).groupBy("split").agg(F.count("*").alias("rows"))


@query("f7_train_flags", "SELECT l_returnflag AS flag, count(*) FILTER (l_returnflag = 'A') AS some, count(*) AS none FROM lineitem GROUP BY 1")
def f7(spark, d):
    """Rows that train where some are named so, and where none is."""
    rows = adapter.table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_returnflag") == "A", "train").otherwise("test").alias("split"), F.lit("test").alias("never"))
    both = features.train_flag(features.train_flag(rows).withColumnRenamed("is_train", "some"), "never")
    return both.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(F.col("some").cast("long")).alias("some"), F.sum(F.col("is_train").cast("long")).alias("none"))


@query("f11_bad_states", "SELECT o_orderkey, o_orderkey % 7 - 2 AS state FROM orders WHERE o_orderkey % 7 - 2 NOT BETWEEN -1 AND 2")
def f11(spark, d):
    rows = adapter.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 - 2).alias("state"))
    planning.require_states(rows.where("state between -1 and 2"))
    return planning.bad_states(rows)


@query("f12_different_targets", sql("base", _sql_family(0, COLS[0]), _sql_family(1, COLS[1]), "SELECT row_index, count(DISTINCT target) AS targets FROM (SELECT row_index, target FROM s0 UNION ALL SELECT row_index, target FROM s1) GROUP BY row_index HAVING count(DISTINCT target) > 1"))
def f12(spark, d):
    rows = _two_families(spark, d)
    build.require_same_targets({f: rows.where("family = 'core_fp'") for f in ("a", "b")})
    return build.different_targets({f: rows.where(F.col("family") == f) for f in ("core_fp", "branch_control")})


@query("o1_positive_rows", sql("wide", f"SELECT run_id, timestamp_ms FROM wide WHERE {COLS[0]} > 0 AND {COLS[1]} > 0"))
def o1p(spark, d):
    return features.positive_rows(frames.wide(spark, d), COLS[:2]).select("run_id", "timestamp_ms")


@query("o2_median_impute", sql("wide", "m AS (SELECT " + ", ".join(f"median({c}) AS m{i}" for i, c in enumerate(COLS)) + " FROM wide)", "SELECT run_id, timestamp_ms, " + ", ".join(f"round(coalesce({c}, m{i}), 6) AS {c}" for i, c in enumerate(COLS)) + " FROM wide, m"))
def o2m(spark, d):
    return features.median_fill(frames.wide(spark, d), COLS).select("run_id", "timestamp_ms", *r6(*COLS))


@query("o3_varying_columns", "SELECT c AS name FROM (SELECT count(DISTINCT l_tax) AS l_tax, count(DISTINCT l_linenumber * 0) AS zero, count(DISTINCT CASE WHEN l_orderkey < 0 THEN 1 END) AS never, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem) UNPIVOT (n FOR c IN (l_tax, zero, never, l_returnflag)) WHERE n > 1")
def o3v(spark, d):
    rows = adapter.table(spark, d, "lineitem").select("l_tax", (F.col("l_linenumber") * 0).alias("zero"), F.when(F.col("l_orderkey") < 0, 1).alias("never"), "l_returnflag")
    return spark.createDataFrame([(c,) for c in features.varying_columns(rows, rows.columns)], "name string")


@query("o4_normalized_views", "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_quantity, 0) * 1000 AS tax_per_ki, l_tax / nullif(l_extendedprice, 0) AS tax_per_ki_per_ms FROM lineitem")
def o4n(spark, d):
    rows = features.indicators(adapter.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", {"tax_per_ki": "l_tax"}, "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", "tax_per_ki", "tax_per_ki_per_ms")


@query("o8_variance_inflation_of_three", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), m AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'l_quantity' AS "column", round((1 - c * c) / det, 4) AS vif FROM m UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 4) FROM m UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 4) FROM m""")
def o8t(spark, d):
    vif = stats.variance_inflation(adapter.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return spark.createDataFrame(vif, "column string, vif double").select("column", F.round("vif", 4).alias("vif"))


_FEATURES = list(domain.DERIVED)
_WIDE_COUNTERS = ["instructions_retired", "l1d_loads", "l1d_stores", "l2_misses", "llc_references", "llc_misses", "offcore_demand_data_reads", "memory_read_bandwidth", "memory_write_bandwidth", "branch_instructions", "branch_mispredictions", "fp_arithmetic"]
_WIDE_SQL = {c: f"CASE WHEN (l_orderkey + {i}) % 11 <> 0 THEN l_quantity * {i + 1} + l_linenumber * (l_orderkey % {i + 2}) END" for i, c in enumerate(_WIDE_COUNTERS)}


@query(
    "p8_all_derived_features",
    "WITH w AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _WIDE_SQL.items()) + " FROM lineitem), t AS (SELECT *, CASE WHEN memory_read_bandwidth IS NULL AND memory_write_bandwidth IS NULL THEN NULL ELSE coalesce(memory_read_bandwidth, 0) + coalesce(memory_write_bandwidth, 0) END AS total FROM w) "
    "SELECT l_orderkey, l_linenumber, round(1000 * l1d_loads / nullif(instructions_retired, 0), 6) AS l1d_loads_per_ki, round(1000 * l1d_stores / nullif(instructions_retired, 0), 6) AS l1d_stores_per_ki, round(1000 * l2_misses / nullif(instructions_retired, 0), 6) AS l2_misses_per_ki, round(1000 * llc_references / nullif(instructions_retired, 0), 6) AS llc_refs_per_ki, "
    "round(1000 * llc_misses / nullif(instructions_retired, 0), 6) AS llc_misses_per_ki, round(llc_misses / nullif(llc_references, 0), 6) AS llc_miss_rate, round(1000 * offcore_demand_data_reads / nullif(instructions_retired, 0), 6) AS offcore_reads_per_ki, round(total, 6) AS memory_total_bandwidth, round(memory_write_bandwidth / nullif(total, 0), 6) AS memory_write_fraction, "
    "round(1000 * branch_instructions / nullif(instructions_retired, 0), 6) AS branch_instructions_per_ki, round(branch_mispredictions / nullif(branch_instructions, 0), 6) AS branch_miss_rate, round(1000 * fp_arithmetic / nullif(instructions_retired, 0), 6) AS fp_arithmetic_per_ki, round(instructions_retired, 6) AS instructions_per_interval FROM t",
)
def p8_all(spark, d):
    """All derived features, over line items as if their columns were counters."""
    rows = adapter.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).cast("double").alias(f"counter__{c}") for c, e in _WIDE_SQL.items()])
    return features.derived_features(rows).select("l_orderkey", "l_linenumber", *r6(*_FEATURES))


# -- joins with devices and teachers -------------------------------------------


@query("j2_device_events", "SELECT user_id AS run_id, round(value, 3) AS timestamp_ms, sum(CASE WHEN event_id % 4 = 0 THEN event_id END) AS counter__memory_read_bandwidth, sum(CASE WHEN event_id % 4 = 1 THEN event_id END) AS counter__memory_write_bandwidth, sum(event_id) AS counter__total_memory_bandwidth FROM events WHERE event_id % 4 <= 1 GROUP BY 1, 2")
def j2(spark, d):
    """Events of four devices to the families that they stand for, summed over devices; others are left out."""
    e = adapter.table(spark, d, "events")
    name = F.concat(F.lit("UNCORE_imc_"), (F.col("user_id") % 4).cast("string"), F.when(F.col("event_id") % 4 == 0, "/cas_count_read/").when(F.col("event_id") % 4 == 1, "/cas_count_write/").otherwise("/other/"))
    samples = e.select(F.col("user_id").alias("run_id"), merge.time_key(F.col("value")).alias("timestamp_ms"), name.alias("event_name"), F.col("event_id").alias("value"))
    aliases = events.alias_map(events.candidates(spark), spark.createDataFrame([], "normal string, event_name string"), "intel", [f"uncore_imc_{k}" for k in range(4)], True)
    specs = events.device_specs(aliases, [f"uncore_imc_{k}" for k in range(4)])
    sums = merge.device_totals(events.device_samples(samples, specs))
    return sums.select("run_id", "timestamp_ms", *[F.col(f"counter__{c}").cast("long").alias(f"counter__{c}") for c in ("memory_read_bandwidth", "memory_write_bandwidth", "total_memory_bandwidth")])


def _teacher(spark, d):
    """A stored table of a teacher's answers: some blank, some without probabilities."""
    o = adapter.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 2 == 0, "L1").otherwise("L2").alias("family"), k.alias("row_index"), F.when(k % 5 == 0, "").otherwise((k % 3).cast("string")).alias("y_pred_future_state_1"),
        *[F.when((k % 4 == 0) & F.lit(c == 1), "").otherwise(F.lit(["0.2", "0.5", "0.3"][c])).alias(f"p_future_state_1_class_{c}") for c in range(3)],
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("mode"), (k % 4).cast("string"))).alias("context_mode"), k.alias("position"),
    )


@query("s13_teacher_answers", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'L1' ELSE 'L2' END AS family, o_orderkey AS row_index, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 3 END AS hard, CASE WHEN o_orderkey % 4 <> 0 THEN 0.5::DOUBLE END AS middle FROM orders")
def s13(spark, d):
    return students.teacher_answers(_teacher(spark, d), 1).select("family", "row_index", F.col("hard").cast("long").alias("hard"), F.col("soft")[1].alias("middle"))


@query("s13_context_modes", "WITH x AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'L1' ELSE 'L2' END AS family, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) SELECT family, 'mode' || (min(k) % 4) AS context_mode FROM x GROUP BY family")
def s13c(spark, d):
    return students.context_modes(_teacher(spark, d))


@query("j15_teacher_targets", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_orderkey % 3 END ELSE -1 END AS teacher, l_orderkey % 2 = 0 AS valid FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) OR l_orderkey % 2 = 1")
def j15(spark, d):
    """Orders are neither broadcast nor sorted with more than about a million rows a task."""
    items = adapter.table(spark, d, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // 1_000_000))
    rows = items.select(F.col("l_orderkey").alias("row_index"), "l_linenumber").repartition(parts, "row_index")
    there = adapter.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_index")).repartition(parts, "row_index").distinct().withColumn("there", F.lit(True))
    known = rows.join(there.hint("merge"), "row_index", "left").where("there or row_index % 2 = 1").drop("there")
    found = students.teacher_targets(known, students.teacher_answers(_teacher(spark, d), 1), "L1")
    return found.select(F.col("row_index").alias("l_orderkey"), "l_linenumber", F.col("teacher").cast("long").alias("teacher"), "valid")


@query("s12_policy_streams", sql("examples", *_PRED, "SELECT row_index, run_id, prediction FROM test WHERE cpu_or_core_id = '0'"))
def s12(spark, d):
    """Test rows of one model and family out of a table of all, in streams of one unit."""
    said = _test_rows(spark, d).withColumns({"model": F.lit("markov"), "family": F.lit("core_fp")})
    every = said.unionByName(said.withColumn("model", F.lit("other"))).unionByName(said.withColumn("family", F.lit("L1"))).unionByName(said.withColumn("split", F.lit("val")))
    return policy.streams_of(every, "markov", "core_fp", units=["0"]).select("row_index", "run_id", "prediction")


# -- stored sequences ------------------------------------------------------------


def _start(k: int, n: int, shift: float = 0.0) -> list[list[float]]:
    """First centroids: the same value in all columns, from low to high."""
    return [[-1.0 + 2.0 * i / max(1, k - 1) + shift] * n for i in range(k)]


def _lloyd(tag: str, source: str, columns: list[str], start: list[list[float]], rounds: int, by: str = "''") -> tuple[list[str], str]:
    """CTEs of log, fill, scaling and Lloyd's rounds over ``source`` (row_index, is_train, columns) per value of ``by``; and the name of the one with row_index, part, is_train, x0.., k."""
    n, m, k = len(columns), f"{tag}_", len(start)
    logs = ", ".join(f"CASE WHEN {c} >= 0 THEN ln(1 + {c}) ELSE {c} END AS l{i}" for i, c in enumerate(columns))
    out = [
        f"{m}l AS (SELECT row_index, is_train, {by} AS part, {logs} FROM {source})",
        f"{m}m AS (SELECT part, " + ", ".join(f"median(l{i}) AS m{i}" for i in range(n)) + f" FROM {m}l WHERE is_train GROUP BY part)",
        f"{m}f AS (SELECT row_index, is_train, part, " + ", ".join(f"coalesce(l{i}, m{i}, 0) AS f{i}" for i in range(n)) + f" FROM {m}l LEFT JOIN {m}m USING (part))",
        f"{m}s AS (SELECT part, " + ", ".join(f"avg(f{i}) AS a{i}, stddev_pop(f{i}) AS s{i}" for i in range(n)) + f" FROM {m}f WHERE is_train GROUP BY part)",
        f"{m}x AS (SELECT row_index, is_train, part, " + ", ".join(f"(f{i} - coalesce(a{i}, 0)) / coalesce(nullif(s{i}, 0), 1) AS x{i}" for i in range(n)) + f" FROM {m}f LEFT JOIN {m}s USING (part))",
        f"{m}c0 AS (SELECT DISTINCT part, " + ", ".join(f"CAST({start[j][i]} AS DOUBLE) AS c{j}_{i}" for j in range(k) for i in range(n)) + f" FROM {m}x)",
    ]
    dist = [" + ".join(f"(x{i} - c{j}_{i}) * (x{i} - c{j}_{i})" for i in range(n)) for j in range(k)]
    label = "list_position([" + ", ".join(dist) + "], list_min([" + ", ".join(dist) + "])) - 1"
    for r in range(rounds + 1):
        out.append(f"{m}k{r} AS (SELECT x.*, {label} AS k, " + ", ".join(f"c{j}_{i}" for j in range(k) for i in range(n)) + f" FROM {m}x x JOIN {m}c{r} USING (part))")
        if r < rounds:
            out.append(f"{m}c{r + 1} AS (SELECT part, " + ", ".join(f"coalesce(avg(x{i}) FILTER (is_train AND k = {j}), max(c{j}_{i})) AS c{j}_{i}" for j in range(k) for i in range(n)) + f" FROM {m}k{r} GROUP BY part)")
    return out, f"{m}k{rounds}"


def _ranked(tag: str, labels: str, pressing: list[int], k: int, n: int = 0) -> list[str]:
    """CTE ``<tag>_r``: part, k, state by mean training pressure (the norm of ``n`` columns if none presses), clusters without training rows last."""
    pressure = " + ".join(f"x{i}" for i in pressing) or "sqrt(" + " + ".join(f"x{i} * x{i}" for i in range(n)) + ")"
    return [f"{tag}_p AS (SELECT p.part, j AS k, avg({pressure}) FILTER (x.is_train) AS p FROM (SELECT DISTINCT part FROM {labels}) p CROSS JOIN range({k}) r(j) LEFT JOIN {labels} x ON x.part = p.part AND x.k = j GROUP BY p.part, j)", f"{tag}_r AS (SELECT part, k, row_number() OVER (PARTITION BY part ORDER BY coalesce(p, 1e300), k) - 1 AS state FROM {tag}_p)"]


_PRESSING = [i for i, c in enumerate(COLS) if c in domain.pressure_counters(COLS)]
_M3, _M3_LAST = _lloyd("g", "base", COLS, _start(3, len(COLS)), 3)
_M4, _M4_LAST = _lloyd("w", "base", COLS[:2], _start(3, 2), 2, "workload")
_M5, _M5_LAST = _lloyd("o", "base", COLS[:1], _start(3, 1), 3)


@query("m3_phases_from_a_start", sql("base", *_M3, *_ranked("g", _M3_LAST, _PRESSING, 3), f"SELECT row_index, CAST(state AS INT) AS state FROM {_M3_LAST} JOIN g_r USING (part, k)"))
def m3_start(spark, d):
    """Lloyd's rounds from given centroids, clusters ranked by training pressure."""
    return phases.phase_states(frames.base(spark, d), COLS, start=_start(3, len(COLS)), most_rounds=3)[0].select("row_index", "state")


@query("a24_phase_summary", sql("base", *_M3, *_ranked("g", _M3_LAST, _PRESSING, 3), f"SELECT CAST(state AS INT) AS state, count(*) AS rows, count(*) FILTER (is_train) AS train_rows, round(avg(CASE WHEN is_train THEN sqrt(CASE k " + " ".join(f"WHEN {j} THEN " + " + ".join(f"(x{i} - c{j}_{i}) * (x{i} - c{j}_{i})" for i in range(len(COLS))) for j in range(3)) + f" END) END), 6) AS mean_train_distance FROM {_M3_LAST} JOIN g_r USING (part, k) GROUP BY 1"))
def a24_summary(spark, d):
    states, learned = phases.phase_states(frames.base(spark, d), COLS, start=_start(3, len(COLS)), most_rounds=3)
    return phases.phase_summary(states, COLS, learned).select("state", "rows", "train_rows", *r6("mean_train_distance"))


@query("m4_phases_per_workload", sql("base", *_M4, *_ranked("w", _M4_LAST, [i for i in range(2) if COLS[i] in domain.pressure_counters(COLS[:2])], 3, 2), f"SELECT row_index, CAST(state AS INT) AS state FROM {_M4_LAST} JOIN w_r USING (part, k)"))
def m4(spark, d):
    """The same within each workload by itself."""
    return build.scoped_states(frames.base(spark, d), "per_workload", COLS[:2], start=_start(3, 2), most_rounds=2)[0].select("row_index", F.col("state").cast("int").alias("state"))


@query("m5_one_dimension_from_a_start", sql("base", *_M5, f"e AS (SELECT list_sort([any_value(c0_0), any_value(c1_0), any_value(c2_0)]) AS c FROM {_M5_LAST})", f"SELECT row_index, CAST(x0 > (c[1] + c[2]) / 2 AS INT) + CAST(x0 > (c[2] + c[3]) / 2 AS INT) AS state FROM {_M5_LAST}, e"))
def m5_start(spark, d):
    return phases.one_dimensional_states(frames.base(spark, d), VALUE, start=[c[0] for c in _start(3, 1)], most_rounds=3)[0].select("row_index", "state")


_A28, _A28_LAST = _lloyd("a", "base", COLS[:2], _start(2, 2), 2)
_B28, _B28_LAST = _lloyd("b", "base", COLS[:2], _start(2, 2, 0.8), 2)


@query(
    "m28_stability_from_starts",
    sql(
        "base", *_A28, *_B28,
        f"j AS (SELECT a.k AS ka, b.k AS kb FROM {_A28_LAST} a JOIN {_B28_LAST} b USING (row_index))", "t AS (SELECT ka, kb, count(*)::DOUBLE AS n FROM j GROUP BY 1, 2)",
        "s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS j, (SELECT sum(n) FROM t) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY ka)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY kb)) AS b)",
        "SELECT 2 AS k, round((j - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari_mean, round(((SELECT least(count(*) FILTER (ka = 0), count(*) FILTER (ka = 1)) / count(*) FROM j) + (SELECT least(count(*) FILTER (kb = 0), count(*) FILTER (kb = 1)) / count(*) FROM j)) / 2, 6) AS least_share_mean FROM s",
    ),
)
def m28_starts(spark, d):
    found = stats.stability(frames.base(spark, d), COLS[:2], [2], [1, 2], {2: [_start(2, 2), _start(2, 2, 0.8)]}, most_rounds=2)
    return spark.createDataFrame([(r["k"], r["ari_mean"], r["least_share_mean"]) for r in found], "k int, ari_mean double, least_share_mean double").select("k", *r6("ari_mean", "least_share_mean"))


def _built(spark, d):
    """Sequences of two counters over given phases, written to the shared folder and read back."""
    path = fresh_path(spark, "sequences")
    tables = build.build_sequences(frames.base(spark, d), "run_holdout", 2, counters=["instructions_retired", "llc_misses"], selected={"global": {"LLC": "llc_misses", "core_fp": "instructions_retired", "L2": "l2_misses"}}, start=_start(3, len(COLS)), most_rounds=1)
    build.write_sequences(tables, path)
    return path


_B, _B_LAST = _lloyd("g", "base", sorted(COLS), _start(3, len(COLS)), 1)
_B_PRESS = [i for i, c in enumerate(sorted(COLS)) if c in domain.pressure_counters(COLS)]
_BUILT = [*_B, *_ranked("g", _B_LAST, _B_PRESS, 3), f"st AS (SELECT base.*, CAST(r.state AS INT) AS state FROM base JOIN {_B_LAST} USING (row_index) JOIN g_r r USING (part, k))", "fu AS (SELECT *, coalesce(lead(state, 1) OVER w, -1) AS f1, coalesce(lead(state, 2) OVER w, -1) AS f2, lead(counter__llc_misses, 1) OVER w AS v1 FROM st WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))"]


@query("r3_built_sequences", sql("base", *_BUILT, "SELECT row_index, workload, split, state AS family_state, f1 AS future_state_1, f2 AS future_state_2, CAST((f1 >= 0 AND f1 <> state) OR (f2 >= 0 AND f2 <> state) AS INT) AS will_change_within_horizon, CASE WHEN f1 >= 0 AND f1 <> state THEN 1 WHEN f2 >= 0 AND f2 <> state THEN 2 ELSE -1 END AS time_to_change, round(counter__llc_misses, 6) AS counter_value, round(v1, 6) AS future_counter_value_1 FROM fu"))
def r3(spark, d):
    """Rows of the LLC family as stored: partitions of its selected counter alone are read."""
    rows = build.family_sequences(spark, _built(spark, d), "run_holdout", "global").where("family = 'LLC'")
    return rows.select("row_index", "workload", "split", "family_state", "future_state_1", "future_state_2", "will_change_within_horizon", "time_to_change", *r6("counter_value", "future_counter_value_1"))


@query("k6_sequence_summary", sql("base", "q AS (SELECT quantile_cont(counter__llc_misses, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(counter__llc_misses, CAST(2 AS DOUBLE) / 3) AS b, quantile_cont(counter__instructions_retired, CAST(1 AS DOUBLE) / 3) AS c, quantile_cont(counter__instructions_retired, CAST(2 AS DOUBLE) / 3) AS e FROM base WHERE is_train), n AS (SELECT count(*) AS n FROM base)", """SELECT family, CASE family WHEN 'LLC' THEN 'ablation_selected' WHEN 'core_fp' THEN 'ablation_selected' WHEN 'L2' THEN 'selected_counter_sequence_missing' ELSE 'missing_single_ablation_selection' END AS sequence_source, CASE WHEN family IN ('LLC', 'core_fp') THEN n ELSE 0 END AS rows,
 CASE WHEN family IN ('L1', 'L2', 'memory_offcore') THEN 0 ELSE 1 END AS available, round(CASE family WHEN 'LLC' THEN a WHEN 'core_fp' THEN c END, 6) AS low, round(CASE family WHEN 'LLC' THEN b WHEN 'core_fp' THEN e END, 6) AS high FROM (VALUES ('L1'), ('L2'), ('LLC'), ('memory_offcore'), ('branch_control'), ('core_fp')) v(family), q, n"""))
def k6(spark, d):
    rows = spark.read.parquet(f"{_built(spark, d)}/summary")
    return rows.select("family", "sequence_source", "rows", "available", F.round("global_low_threshold", 6).alias("low"), F.round("global_high_threshold", 6).alias("high"))


@query("s11_stored_experiments", "SELECT 'run_holdout' AS experiment, 'global' AS scope, 2 AS counters, 2 AS families, 'llc_misses (ablation_selected)' AS llc")
def s11(spark, d):
    """What is stored: experiments and scopes, counters and families with rows, and how a family's counter is named."""
    path = _built(spark, d)
    found = build.experiments(spark, path)
    counters = build.counter_sequences(spark, path, "run_holdout", "global").agg(F.countDistinct("counter_name").cast("int").alias("counters"))
    families = build.family_sequences(spark, path, "run_holdout", "global").agg(F.countDistinct("family").cast("int").alias("families"))
    text = build.counter_text(spark.read.parquet(f"{path}/summary"), "global").where("family = 'LLC'").select(F.col("text").alias("llc"))
    return found.crossJoin(counters).crossJoin(families).crossJoin(text)


# -- trees, students, ablation ----------------------------------------------------


def _stump(tag: str, rows: str, x: str, min_leaf: int) -> list[str]:
    """CTEs of a tree of one cut on column ``x`` of ``rows`` (row_index, is_train, target): ``<tag>_p`` is row_index, prediction."""
    t = f"{tag}_"
    return [
        f"{t}n AS (SELECT target, {x} AS x, row_index FROM {rows} WHERE is_train)",
        f"{t}c AS (SELECT DISTINCT unnest(quantile_cont(x, CAST([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9] AS DOUBLE[]))) AS t FROM {t}n)",
        f"{t}y AS (SELECT t, target, count(*) FILTER (x <= t)::DOUBLE AS l, count(*) FILTER (NOT x <= t)::DOUBLE AS r FROM {t}n, {t}c GROUP BY t, target)",
        f"{t}g AS (SELECT t, sum(l) AS nl, sum(r) AS nr, (sum(l) * (1 - sum(l * l) / nullif(sum(l) * sum(l), 0)) + sum(r) * (1 - sum(r * r) / nullif(sum(r) * sum(r), 0))) / (sum(l) + sum(r)) AS s FROM {t}y GROUP BY t HAVING sum(l) >= {min_leaf} AND sum(r) >= {min_leaf})",
        f"{t}b AS (SELECT arg_min(t, round(s, 12) * 1e9 + 0) AS t FROM (SELECT * FROM {t}g ORDER BY round(s, 12), t LIMIT 1))",
        f"{t}m AS (SELECT x <= t AS side, target, count(*) AS n, min(row_index) AS f FROM {t}n, {t}b GROUP BY 1, 2)",
        f"{t}s AS (SELECT side, target AS p FROM {t}m QUALIFY row_number() OVER (PARTITION BY side ORDER BY n DESC, f) = 1)",
        f"{t}p AS (SELECT row_index, p AS prediction FROM {rows} z, {t}b JOIN {t}s ON true WHERE side = ({x} <= t))",
    ]


@query("m6_tree_of_one_cut", sql("examples", "q AS (SELECT row_index, is_train, target, coalesce(counter__branch_instructions, (SELECT median(counter__branch_instructions) FROM base WHERE is_train), 0) AS v FROM examples)", *_stump("u", "q", "v", 3), "SELECT row_index, prediction FROM u_p"))
def m6(spark, d):
    rows = features.fill_train_median(frames.examples(spark, d), ["counter__branch_instructions"])
    tree = models.fit_tree(rows.where("is_train"), ["counter__branch_instructions"], "target", 1, 3)
    return rows.select("row_index", models.tree_expression(tree).alias("prediction"))


def _ablated(counter: str, i: int) -> list[str]:
    c, r = f"counter__{counter}", f"q{i}"
    return [
        f"{r} AS (SELECT row_index, split, is_train, target, coalesce({c}, (SELECT median({c}) FROM base WHERE is_train), 0) AS v FROM examples)", *_stump(f"u{i}", r, "v", 3),
        f"e{i} AS (SELECT split, target, prediction FROM {r} JOIN u{i}_p USING (row_index) WHERE target >= 0)",
        *[f"{name}{i} AS (SELECT 0.7 * avg(CAST(target = prediction AS DOUBLE)) + 0.3 * coalesce(avg(CASE WHEN target = 2 THEN CAST(prediction = 2 AS DOUBLE) END), 0) AS s FROM e{i} WHERE split = {_first(*order)})" for name, order in (("v", ("val", "test")), ("t", ("test", "val")))],
    ]


_ABLATED = ["branch_instructions", "branch_mispredictions", "llc_references"]
_ABLATION_FAMILIES = {"branch_control": _ABLATED[:2], "LLC": _ABLATED[2:], "L2": ["l2_misses"]}
_SINGLES = " UNION ALL ".join(f"SELECT '{f}' AS family, '{c}' AS counter_set, (SELECT s FROM v{i}) AS v, (SELECT s FROM t{i}) AS t, {i} AS i" for i, (f, c) in enumerate((("branch_control", "branch_instructions"), ("branch_control", "branch_mispredictions"), ("LLC", "llc_references"))))


@query(
    "m29_ablation_table",
    sql(
        "examples", *[x for i, c in enumerate(_ABLATED) for x in _ablated(c, i)], f"si AS ({_SINGLES})",
        """SELECT family, 'singleton' AS candidate_type, counter_set, CAST(NULL AS VARCHAR) AS family_counter_map, round(v, 6) AS validation_score, round(t, 6) AS report_score, CAST(row_number() OVER (PARTITION BY family ORDER BY v DESC, i) = 1 AS INT) AS selected FROM si
  UNION ALL SELECT 'L2', 'unavailable', '', NULL, 0, 0, 0
  UNION ALL SELECT '__global__', 'one_per_family_exhaustive', a.counter_set || ',' || b.counter_set, 'LLC:' || a.counter_set || ';branch_control:' || b.counter_set, round((a.v + b.v) / 2, 6), round((a.t + b.t) / 2, 6), CAST(row_number() OVER (ORDER BY a.v + b.v DESC, b.i) = 1 AS INT) FROM si a, si b WHERE a.family = 'LLC' AND b.family = 'branch_control'""",
    ),
)
def m29t(spark, d):
    """All rows of an ablation with trees of one cut: three counters, a family without one, and both choices for all."""
    rows = selection.ablation_table(frames.states(spark, d), families=_ABLATION_FAMILIES, max_depth=1)
    return rows.select("family", "candidate_type", "counter_set", "family_counter_map", *r6("validation_score", "report_score"), "selected")


@query("k8_ablation_written", sql("examples", *[x for i, c in enumerate(_ABLATED) for x in _ablated(c, i)], f"si AS ({_SINGLES})", "SELECT family, counter_set FROM si QUALIFY row_number() OVER (PARTITION BY family ORDER BY v DESC, i) = 1"))
def k8(spark, d):
    """The chosen counters as the written results name them, by the last flagged row of each family."""
    path = fresh_path(spark, "ablation")
    writers.write_ablation(selection.ablation_table(frames.states(spark, d), families=_ABLATION_FAMILIES, max_depth=1, exhaustive=False), path, "global", 1)
    chosen = {r["family"] for r in writers.read_json(spark, f"{path}/manifest")["selected_rows"]}
    return selection.last_selected(spark.read.parquet(f"{path}/results")).where(F.col("family").isin(*chosen))


@query("m30_one_thread_ablation", sql("examples", "o1 AS (SELECT * FROM examples WHERE threads = 1)", "q0 AS (SELECT row_index, split, is_train, target, coalesce(counter__branch_instructions, (SELECT median(counter__branch_instructions) FROM o1 WHERE is_train), 0) AS v FROM o1)", *_stump("u0", "q0", "v", 3), "e0 AS (SELECT split, target, prediction FROM q0 JOIN u0_p USING (row_index) WHERE target >= 0)", f"SELECT 'branch_control' AS family, 'branch_instructions' AS counter, round(coalesce(0.7 * avg(CAST(target = prediction AS DOUBLE)), 0) + 0.3 * coalesce(avg(CASE WHEN target = 2 THEN CAST(prediction = 2 AS DOUBLE) END), 0), 6) AS score FROM e0 WHERE split = {_first('val', 'test').replace('FROM base', 'FROM o1')}"))
def m30s(spark, d):
    rows = selection.ablation(frames.states(spark, d).where("threads = 1"), families={"branch_control": ["branch_instructions"]}, max_depth=1)
    return rows.select("family", "counter", *r6("score"))


@query("t4_last_selected", "SELECT 'f' || (o_custkey % 20) AS family, arg_max('c' || o_orderkey, o_orderkey) AS counter_set FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY 1")
def t4(spark, d):
    k = F.col("o_orderkey")
    rows = adapter.table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string")).alias("family"), F.concat(F.lit("c"), k.cast("string")).alias("counter_set"), F.when(k % 3 == 0, "1").when(k % 3 == 1, "Yes").otherwise("0").alias("selected"), k.alias("position"))
    return selection.last_selected(rows)


@query("t5_top_classes", sql("examples", "q AS (SELECT row_index, is_train, target, run_length::DOUBLE AS v FROM examples WHERE target >= 0)", *_stump("u", "q", "v", 3), "k AS (SELECT side, target, n FROM u_m UNION ALL SELECT side, c, 0 FROM (SELECT DISTINCT side FROM u_m) z CROSS JOIN range(3) r(c) WHERE NOT EXISTS (SELECT 1 FROM u_m m WHERE m.side = z.side AND m.target = c))", "o AS (SELECT side, array_to_string(list(CAST(target AS INT) ORDER BY n DESC, target), ',') AS top FROM k GROUP BY side)", "SELECT row_index, top FROM q, u_b JOIN o ON true WHERE side = (v <= t)"))
def t5(spark, d):
    """Classes of each row's leaf by count, unseen ones last."""
    rows = frames.examples(spark, d).where("target >= 0").withColumn("v", F.col("run_length").cast("double"))
    tree = models.fit_tree(rows.where("is_train"), ["v"], "target", 1, 3)
    return rows.select("row_index", F.array_join(F.transform(models.tree_top_k(tree, 3), lambda c: c.cast("string")), ",").alias("top"))


_ONE_HOT = [f"x{i}" for i in range(6)]
_DIRECT = [
    "h AS (SELECT row_index, split, is_train, state, list(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS h, row_number() OVER w AS n, coalesce(lead(state, 1) OVER w, -1) AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))",
    "hx AS (SELECT row_index, split, is_train, state, target, " + ", ".join(f"CAST(h[{i // 3 + 1}] = {i % 3} AS INT) AS x{i}" for i in range(6)) + " FROM h WHERE n >= 2 AND target >= 0)",
    "cd AS (" + " UNION ALL ".join(f"SELECT {i} AS f, t, target, count(*) FILTER (x{i} <= t)::DOUBLE AS l, count(*) FILTER (NOT x{i} <= t)::DOUBLE AS r FROM hx, (SELECT DISTINCT unnest(quantile_cont(x{i}, CAST([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9] AS DOUBLE[]))) AS t FROM hx WHERE is_train) WHERE is_train GROUP BY t, target" for i in range(6)) + ")",
    "cg AS (SELECT f, t, (sum(l) * (1 - sum(l * l) / nullif(sum(l) * sum(l), 0)) + sum(r) * (1 - sum(r * r) / nullif(sum(r) * sum(r), 0))) / (sum(l) + sum(r)) AS s FROM cd GROUP BY f, t HAVING sum(l) >= 8 AND sum(r) >= 8)",
    "cb AS (SELECT f, t FROM cg ORDER BY round(s, 12), f, t LIMIT 1)",
    "sd AS (SELECT hx.*, CASE f " + " ".join(f"WHEN {i} THEN x{i} <= t" for i in range(6)) + " END AS side FROM hx, cb)",
    "sm AS (SELECT side, target AS p FROM sd WHERE is_train GROUP BY side, target QUALIFY row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, min(row_index)) = 1)",
    "dp AS (SELECT sd.*, p AS prediction FROM sd JOIN sm USING (side))",
]


@query("m24_direct_trees", sql("states", *_DIRECT, "SELECT 'core_fp' AS family, count(*) AS rows, round(avg(CAST(target = prediction AS DOUBLE)), 6) AS accuracy FROM dp WHERE split <> 'train'"))
def m24t(spark, d):
    """Trees of one cut on histories of true states, scored on all but training rows."""
    rows = frames.states(spark, d).withColumnRenamed("state", "state__core_fp")
    return students.direct_tree_summary(students.direct_trees(rows, ["core_fp"], 2, 1, 1, 8)).select("family", "rows", *r6("accuracy"))


def _taught(spark, d):
    """Examples with a teacher that says the state two rows on, or nothing for every seventh row."""
    e = frames.examples(spark, d).withColumn("context", F.col("threads"))
    answers = e.where("row_index % 7 <> 0 and state >= 0").select(F.lit("core_fp").alias("family"), "row_index", F.lit(1).alias("step"), F.greatest(F.col("state"), F.lit(0)).alias("hard"), F.lit(None).cast("array<double>").alias("soft"))
    return e, answers


@query(
    "m23_lookup_student",
    sql(
        "examples",
        "x AS (SELECT row_index, split, state, previous, target AS truth, is_train AND target >= 0 AS is_train, CASE WHEN run_length <= 1 THEN 1 WHEN run_length <= 3 THEN 3 WHEN run_length <= 7 THEN 7 ELSE 15 END AS b, threads AS context, CASE WHEN row_index % 7 <> 0 AND state >= 0 THEN state ELSE -1 END AS teacher, CASE WHEN row_index % 7 <> 0 AND state >= 0 THEN CASE WHEN target = state OR target < 0 THEN state ELSE state END ELSE target END AS target FROM examples)",
        *[f"{n} AS (SELECT {k + ', ' if k else ''}target AS {n}_t FROM x WHERE is_train GROUP BY {k + ', ' if k else ''}target QUALIFY row_number() OVER ({'PARTITION BY ' + k if k else ''} ORDER BY count(*) DESC, min(row_index)) = 1)" for n, k in (("l0", "state, previous, b, context"), ("l1", "state, b, context"), ("l2", "state, b"), ("l3", "state"), ("l4", ""))],
        "pr AS (SELECT x.*, coalesce(l0_t, l1_t, l2_t, l3_t, l4_t, 1) AS prediction FROM x LEFT JOIN l0 USING (state, previous, b, context) LEFT JOIN l1 USING (state, b, context) LEFT JOIN l2 USING (state, b) LEFT JOIN l3 USING (state) CROSS JOIN l4)",
        f"SELECT 'core_fp' AS family, 'lookup_rle_student' AS model, count(*) AS rows, round(avg(CAST(truth = prediction AS DOUBLE)), 6) AS accuracy, round(avg(CASE WHEN teacher >= 0 THEN CAST(prediction = teacher AS DOUBLE) END), 6) AS teacher_retention FROM pr WHERE split = {_first('val', 'test')}",
    ),
)
def m23(spark, d):
    """The lookup taught by a blend of which the teacher's share decides (0.9 of 0.7 against 0.3)."""
    e, answers = _taught(spark, d)
    said = students.run_length_students(e, answers, "core_fp", 0.3, 1, 8)
    return students.student_summary(said.where("model = 'lookup_rle_student'")).select("family", "model", "rows", *r6("accuracy", "teacher_retention"))


@query("m23_history_students")
def m23h(spark, d):
    """Scores of the history students: trees are grown, so SQL does not restate them; a test compares with a brute-force version."""
    e, answers = _taught(spark, d)
    rows, names = students.flat_history(e.drop("target"), 3, 1)
    return students.student_summary(students.history_students(rows, answers, "core_fp", names, 3, 8))


@query("r6_detector_baselines", sql("states", "h AS (SELECT row_index, split, is_train, state, row_number() OVER w AS n, lead(state) OVER w AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))", "e AS (SELECT * FROM h WHERE n >= 4 AND target IS NOT NULL)", "mj AS (SELECT target AS m FROM e WHERE is_train AND target >= 0 GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)", f"t AS (SELECT *, m FROM e, mj WHERE split = {_first('test', 'val')} AND target >= 0)", """SELECT 'baseline_last_state' AS model, count(*) AS rows, round(avg(CAST(target = state AS DOUBLE)), 6) AS accuracy, round(avg(CAST(target = state AS DOUBLE)) - (SELECT avg(CAST(target = m AS DOUBLE)) FROM t), 6) AS gain_over_majority_phase, CAST(1 AS DOUBLE) AS memory_bytes FROM t WHERE state >= 0
 UNION ALL SELECT 'majority_phase', count(*), round(avg(CAST(target = m AS DOUBLE)), 6), 0, 6 FROM t"""))
def r6b(spark, d):
    """The detector's summary for two baselines."""
    rows = evaluation.examples(frames.states(spark, d), 4, ["state"]).select("run_id", "workload", "cpu_or_core_id", "threads", "split", "is_train", "row_index", "state", "run_length", "target", "history")
    named = {n: f for n, f in evaluation.predictors(4, ["core_fp"]).items() if n in ("baseline_last_state", "majority_phase")}
    return evaluation.report(rows, named)["summary"].select("model", "rows", *r6("accuracy", "gain_over_majority_phase"), "memory_bytes")


@query("k7_detector_tables", sql("states", "h AS (SELECT *, row_number() OVER w AS n, lead(state) OVER w AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))", f"t AS (SELECT * FROM h WHERE n >= 4 AND target IS NOT NULL AND split = {_first('test', 'val')} AND target >= 0 AND state >= 0)", "SELECT 'per_workload_accuracy' AS name, count(DISTINCT workload) AS rows FROM t UNION ALL SELECT 'per_core_accuracy', count(DISTINCT cpu_or_core_id) FROM t UNION ALL SELECT 'per_thread_accuracy', count(DISTINCT threads) FROM t UNION ALL SELECT 'confusion_matrices', 9 UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'hardware_budget', 1 UNION ALL SELECT 'predictions', (SELECT count(*) FROM h WHERE n >= 4 AND target IS NOT NULL) UNION ALL SELECT 'phase_behavior_by_thread', (SELECT count(DISTINCT threads) FROM t) UNION ALL SELECT 'per_process_count_accuracy', 1 UNION ALL SELECT 'per_thread_process_accuracy', (SELECT count(DISTINCT threads) FROM t) UNION ALL SELECT 'phase_behavior_by_process_count', 1 UNION ALL SELECT 'phase_behavior_by_thread_process', (SELECT count(DISTINCT threads) FROM t)"))
def k7(spark, d):
    """Rows of each of the twelve tables of a detector as written, for the last-state baseline."""
    rows = evaluation.examples(frames.states(spark, d), 4, ["state"]).withColumn("process_count", F.lit(2)).select("run_id", "workload", "cpu_or_core_id", "threads", "process_count", "split", "is_train", "row_index", "state", "run_length", "target", "history")
    named = {n: f for n, f in evaluation.predictors(4, ["core_fp"]).items() if n == "baseline_last_state"}
    written = writers.write_tables(evaluation.detector_tables(evaluation.report(rows, named)), fresh_path(spark, "detector"), {"experiment": "run_holdout"})
    return spark.createDataFrame(list(written.items()), "name string, rows long")


_BY = {"workload": "workload", "core": "cpu_or_core_id", "thread": "threads"}


@query("k7_detector_contents", sql("states", "h AS (SELECT *, row_number() OVER w AS n, lead(state) OVER w AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))", f"t AS (SELECT * FROM h WHERE n >= 4 AND target IS NOT NULL AND split = {_first('test', 'val')} AND target >= 0 AND state >= 0)", " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS rows, round(avg(CAST(target = state AS DOUBLE)), 6) AS accuracy FROM t GROUP BY {c}" for n, c in _BY.items()) + " UNION ALL SELECT 'confusion', a || '>' || b, count(*) FILTER (target = a AND state = b), NULL FROM t, range(3) x(a), range(3) y(b) GROUP BY a, b"))
def k7c(spark, d):
    """What stands in a detector's written tables of accuracy and confusion, for the last-state baseline."""
    rows = evaluation.examples(frames.states(spark, d), 4, ["state"]).withColumn("process_count", F.lit(2)).select("run_id", "workload", "cpu_or_core_id", "threads", "process_count", "split", "is_train", "row_index", "state", "run_length", "target", "history")
    named = {n: f for n, f in evaluation.predictors(4, ["core_fp"]).items() if n == "baseline_last_state"}
    path = fresh_path(spark, "detector")
    writers.write_tables(evaluation.detector_tables(evaluation.report(rows, named)), path, {"experiment": "run_holdout"})
    out = spark.read.parquet(f"{path}/confusion_matrices").select(F.lit("confusion").alias("name"), F.concat(F.col("truth").cast("string"), F.lit(">"), F.col("pred").cast("string")).alias("value"), F.col("n").alias("rows"), F.lit(None).cast("double").alias("accuracy"))
    for name, column in _BY.items():
        out = out.unionByName(spark.read.parquet(f"{path}/per_{name}_accuracy").select(F.lit(name).alias("name"), F.col(column).cast("string").alias("value"), "rows", *r6("accuracy")))
    return out


@query("k10_student_outputs", sql("examples", "SELECT 'predictions' AS name, 2 * count(*) AS rows FROM examples UNION ALL SELECT 'summary', 2"))
def k10(spark, d):
    e, answers = _taught(spark, d)
    said = students.run_length_students(e, answers, "core_fp", 0.3, 1, 8)
    written = writers.write_tables({"predictions": said, "summary": students.student_summary(said)}, fresh_path(spark, "students"), {"scope": "global", "horizon": 1})
    return spark.createDataFrame(list(written.items()), "name string, rows long")


@query("k10_student_contents", ORACLES["m23_lookup_student"])
def k10c(spark, d):
    """The written summary of the lookup student, read back."""
    e, answers = _taught(spark, d)
    said = students.run_length_students(e, answers, "core_fp", 0.3, 1, 8)
    path = fresh_path(spark, "students")
    writers.write_tables({"predictions": said, "summary": students.student_summary(said)}, path, {"scope": "global", "horizon": 1})
    return spark.read.parquet(f"{path}/summary").where("model = 'lookup_rle_student'").select("family", "model", "rows", *r6("accuracy", "teacher_retention"))


@query("m33_history_dataset", sql("states", "h AS (SELECT row_index, row_number() OVER w AS n, list(state) OVER (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h, lead(state) OVER w AS target FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))", "SELECT row_index, h[1] AS h0, h[2] AS h1, h[3] AS h2, h[4] AS h3, target FROM h WHERE n >= 4 AND target IS NOT NULL"))
def m33(spark, d):
    return evaluation.examples(frames.states(spark, d), 4, ["state"]).select("row_index", "h0", "h1", "h2", "h3", "target")


@query("m25_group_counts", sql("examples", *_PRED, "SELECT run_id, " + ", ".join(f"count(*) FILTER (target = {t} AND prediction = {p}) AS c{t}{p}" for t in range(3) for p in range(3)) + ", count(*) FILTER (target <> state) AS moved, count(*) FILTER (target <> state AND target = prediction) AS moved_right FROM test GROUP BY run_id"))
def m25c(spark, d):
    """What a bootstrap over runs draws from."""
    return stats.group_counts(_test_rows(spark, d), "run_id")


@query("m18_all_or_skipped", "SELECT m AS model, 'skipped' AS status FROM (SELECT DISTINCT 'net_' || event_type AS m FROM events)")
def m18n(spark, d):
    """Models that need a library that is nowhere installed are skipped with a reason."""
    names = ["net_" + r[0] for r in adapter.table(spark, d, "events").select("event_type").distinct().collect()]  # five event types
    return evaluation.skipped(spark, names, "no_such_library").where("reason <> ''").select("model", "status")


# -- splits: what does not depend on the draw ---------------------------------------


@query("x2_split_sizes", sql("base", "g AS (SELECT count(DISTINCT concurrent_group_id) AS n FROM base), t AS (SELECT n, greatest(1, round_even(n * 0.7, 0))::BIGINT AS a FROM g), v AS (SELECT n, a, CASE WHEN n - a > 1 THEN round_even(n * 0.15, 0)::BIGINT ELSE 0 END AS b FROM t)", "SELECT 'train' AS split, a AS groups FROM v UNION ALL SELECT 'val', b FROM v UNION ALL SELECT 'test', n - a - b FROM v"))
def x2s(spark, d):
    """How many execution groups each split has; no group is in two."""
    rows = frames.base(spark, d)
    named = splits.run_grouped(rows).join(rows.select("run_id", "concurrent_group_id").distinct(), "run_id")
    return named.select("split", "concurrent_group_id").distinct().groupBy("split").agg(F.count("*").alias("groups"))


@query("x5_held_out", "SELECT 'run_' || user_id AS run_id, CASE WHEN user_id % 7 = 3 THEN 1 ELSE -1 END AS held FROM (SELECT DISTINCT user_id FROM events)")
def x5h(spark, d):
    """Every run, and whether those of the workload that is left out are tested; the others' splits are drawn."""
    rows = frames.base(spark, d).withColumn("concurrent_group_id", F.col("run_id"))
    named = splits.leave_one_out(rows, "w3").join(rows.select("run_id", "workload").distinct(), "run_id")
    return named.select("run_id", F.when(F.col("workload") == "w3", (F.col("split") == "test").cast("int")).otherwise(-1).alias("held"))


@query("x6_experiments", "SELECT e AS experiment, n AS runs FROM (SELECT count(DISTINCT user_id) AS n FROM events) CROSS JOIN (SELECT unnest(['run_holdout', 'config_holdout', 'scenario_holdout']) AS e UNION ALL SELECT DISTINCT 'leave_out_w' || (user_id % 7) FROM events)")
def x6s(spark, d):
    """Every experiment splits every run once."""
    return splits.experiment_splits(frames.base(spark, d)).groupBy("experiment").agg(F.countDistinct("run_id").alias("runs"))


# -- event names and collections ---------------------------------------------------------


def _family_name(family):
    return F.when(family == 0, "instructions_retired").when(family == 1, "memory_read_bandwidth").when(family == 2, "memory_write_bandwidth").otherwise(F.concat(F.lit("f"), family.cast("string")))


def _aliases(spark, d):
    """Aliases by parts: 20 candidates a family, even ones the vendor's, every 23rd is listed; the first family is that of instructions, the next two are read from devices."""
    k = F.col("p_partkey")
    name = _family_name(F.floor(k / 20))
    part = adapter.table(spark, d, "part")
    names = part.select(name.alias("family"), F.when(k % 2 == 0, "mine").otherwise("generic").alias("vendor"), F.concat(F.lit("Part:u "), k.cast("string")).alias("event_name"), k.alias("priority"))
    listed = part.where("p_partkey % 23 = 0").select(F.concat(F.lit("PART "), k.cast("string")).alias("value"))
    return events.alias_map(names, planning.event_aliases(listed), "mine", ["uncore_imc_0"], True)


_ALIAS_SQL = """(SELECT CASE f WHEN 0 THEN 'instructions_retired' WHEN 1 THEN 'memory_read_bandwidth' WHEN 2 THEN 'memory_write_bandwidth' ELSE 'f' || f END AS family, f,
  CASE f WHEN 1 THEN 'uncore_imc/cas_count_read/' WHEN 2 THEN 'uncore_imc/cas_count_write/' ELSE coalesce('PART ' || best % 1000000000, '') END AS selected_event,
  CASE f WHEN 1 THEN 'uncore_imc/cas_count_read/' WHEN 2 THEN 'uncore_imc/cas_count_write/' ELSE coalesce('Part:u ' || best % 1000000000, '') END AS selected_via,
  CASE WHEN f IN (1, 2) THEN 'vendor_preferred_uncore' WHEN best IS NULL THEN 'unsupported' WHEN best < 1000000000 THEN 'vendor_preferred' ELSE 'generic_fallback' END AS selection_kind, f IN (1, 2) OR coalesce(best < 1000000000, false) AS analysis_confident
  FROM (SELECT p_partkey // 20 AS f, min(CASE WHEN p_partkey % 23 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000000000 END + p_partkey END) AS best FROM part GROUP BY 1))"""


@query("e2_alias_map", f"SELECT family, selected_event, selection_kind, analysis_confident FROM {_ALIAS_SQL}")
def e2(spark, d):
    return _aliases(spark, d).select("family", "selected_event", "selection_kind", "analysis_confident")


@query("e2_aliases_from_parts", "WITH c AS (SELECT p_partkey % 50 AS f, p_partkey AS k, p_partkey % 2 = 0 AS own, p_partkey % 3 = 0 AS there FROM part), b AS (SELECT f, min(CASE WHEN there THEN CASE WHEN own THEN 0 ELSE 1000000000 END + k END) AS best, count(*) AS n FROM c GROUP BY f) SELECT 'f' || f AS family, best IS NOT NULL AS supported, coalesce('Part ' || (best % 1000000000), '') AS selected_via, CASE WHEN best IS NULL THEN 'unsupported' WHEN best < 1000000000 THEN 'vendor_preferred' ELSE 'generic_fallback' END AS selection_kind, n AS candidate_count FROM b")
def e2p(spark, d):
    """Every part a candidate: even ones are the vendor's, every third is listed."""
    k = F.col("p_partkey")
    part = adapter.table(spark, d, "part")
    names = part.select(F.concat(F.lit("f"), (k % 50).cast("string")).alias("family"), F.when(k % 2 == 0, "mine").otherwise("generic").alias("vendor"), F.concat(F.lit("Part "), k.cast("string")).alias("event_name"), k.alias("priority"))
    supported = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("part "), k.cast("string")).alias("normal"), F.concat(F.lit("PART "), k.cast("string")).alias("event_name"))
    return events.alias_map(names, supported, "mine").select("family", "supported", "selected_via", "selection_kind", "candidate_count")


@query("e3_device_specs", "SELECT f AS family, 'uncore_imc_' || n_regionkey AS device, 'uncore_imc_' || n_regionkey || '/' || e || '/' AS event_name FROM (SELECT DISTINCT n_regionkey FROM nation) CROSS JOIN (VALUES ('memory_read_bandwidth', 'cas_count_read'), ('memory_write_bandwidth', 'cas_count_write')) v(f, e)")
def e3(spark, d):
    devices = [f"uncore_imc_{r[0]}" for r in adapter.table(spark, d, "region").select("r_regionkey").collect()]  # five regions
    return events.device_specs(_aliases(spark, d), sorted(devices))


_CORE = ["instructions_retired", "f4", "f9"]


@query("e4_study_readiness", f"WITH a AS (SELECT family FROM {_ALIAS_SQL} WHERE selection_kind = 'vendor_preferred'), m AS (SELECT f, i FROM (VALUES {', '.join(f'({f!r}, {i})' for i, f in enumerate(_CORE))}) c(f, i) WHERE f NOT IN (SELECT family FROM a) UNION ALL SELECT 'one_of:f5|f6', 9 WHERE NOT EXISTS (SELECT 1 FROM a WHERE family IN ('f5', 'f6'))) SELECT (SELECT count(*) FROM m) = 0 AS ready, (SELECT coalesce(string_agg(f, ',' ORDER BY i), '') FROM m) AS missing, (SELECT string_agg(family, ',' ORDER BY family) FROM a) AS confident")
def e4(spark, d):
    """Whether three families of parts, and one of two others, are there with confidence."""
    return events.readiness(_aliases(spark, d), _CORE, ["f5", "f6"])


@query("e4_uncore_readiness", f"WITH n AS (SELECT count(*) AS n FROM {_ALIAS_SQL} WHERE selection_kind = 'vendor_preferred_uncore') SELECT event_type AS \"case\", CASE event_type WHEN 'view' THEN 'no device' WHEN 'click' THEN 'blocked by policy' WHEN 'error' THEN 'blocked by policy' ELSE CASE WHEN n = 0 THEN 'no event' WHEN event_type = 'signup' THEN 'the probe gave no counts' ELSE 'ready' END END AS reason, event_type NOT IN ('view', 'click', 'error', 'signup') AND n > 0 AS ready FROM (SELECT DISTINCT event_type FROM events), n")
def e4u(spark, d):
    """A machine for each type of event, and what its probe said."""
    specs = events.device_specs(_aliases(spark, d), ["uncore_imc_0"])
    cases = {"view": ([], False, "1"), "click": (["a"], True, "1"), "error": (["a"], False, "No permission"), "signup": (["a"], False, None)}
    out = None
    for r in adapter.table(spark, d, "events").select("event_type").distinct().collect():  # five types
        devices, blocked, output = cases.get(r[0], (["a"], False, "123,,x"))
        one = events.uncore_readiness(devices, blocked, specs, output).withColumn("case", F.lit(r[0]))
        out = one if out is None else out.unionByName(one)
    return out


@query("e5_families_by_kind", f"SELECT family, 'confident' AS kind FROM {_ALIAS_SQL} WHERE analysis_confident UNION ALL SELECT family, selection_kind FROM {_ALIAS_SQL} WHERE selection_kind IN ('generic_fallback', 'unsupported')")
def e5(spark, d):
    return events.families_by_kind(_aliases(spark, d))


@query("e5_reverse_aliases", f"SELECT normal, arg_max(family, f) AS family FROM (SELECT family, f, lower(replace(unnest([selected_event, selected_via]), ':u', '')) AS normal FROM {_ALIAS_SQL} WHERE selection_kind <> 'vendor_preferred_uncore' AND selected_event <> '') GROUP BY normal")
def e5r(spark, d):
    order = F.when(F.col("family") == "instructions_retired", 0).otherwise(F.substring("family", 2, 9).cast("int"))
    return events.reverse_aliases(_aliases(spark, d).where("selection_kind <> 'vendor_preferred_uncore'").withColumn("family_order", order))


@query("e6_family_events", f"SELECT family, selected_event AS event_name FROM {_ALIAS_SQL} WHERE f % 3 = 0 AND selected_event <> '' AND selection_kind <> 'vendor_preferred_uncore'")
def e6(spark, d):
    """Events of every third family of parts."""
    thirds = adapter.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("f")).where("f % 3 = 0").distinct()
    return events.family_events(_aliases(spark, d), thirds.select(_family_name(F.col("f")).alias("family"), (F.col("f") / 3).alias("place"))).select("family", "event_name")


@query("e6_family_readiness", f"WITH a AS (SELECT count(*) FILTER (family = 'instructions_retired') AS base, count(*) FILTER (family IN ('f3', 'f4', 'f7')) AS others FROM {_ALIAS_SQL} WHERE selection_kind = 'vendor_preferred'), r AS (SELECT CASE WHEN base = 0 THEN 'instructions are missing' WHEN others = 0 THEN 'no other counter' ELSE '' END AS reason FROM a) SELECT reason = '' AS ready, reason FROM r UNION ALL SELECT false, 'instructions are missing'")
def e6r(spark, d):
    a, chosen = _aliases(spark, d), ["instructions_retired", "f3", "f4", "f7"]
    return events.family_readiness(a, chosen).unionByName(events.family_readiness(a.where("family <> 'instructions_retired'"), chosen))


def _tasks(spark, d):
    return collection.build_tasks(adapter.perf_long(spark, d).select("workload"), list(range(32)), 2, threads=(1, 4))


_TASKS = """w AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT 'w' || (user_id % 7) AS w FROM events)),
pr AS (SELECT a.w AS a, b.w AS b, row_number() OVER (ORDER BY a.i, b.i) AS g FROM w a JOIN w b ON a.i < b.i),
tk AS (SELECT 'set1' AS set_key, rep, 'set1_r' || rep || '_' || w || '_t' || t AS concurrent_group_id, 0 AS process_index, w AS workload, t AS threads, w AS co_running_workloads, 0 AS first_cpu FROM w, range(1, 3) r(rep), (VALUES (1), (4)) v(t)
  UNION ALL SELECT k, rep, k || '_r' || rep || '_g' || g || CASE k WHEN 'set3' THEN '_t4' ELSE '' END, p, CASE p WHEN 0 THEN a ELSE b END, CASE k WHEN 'set3' THEN 4 ELSE 1 END, a || ',' || b, p * CASE k WHEN 'set3' THEN 4 ELSE 1 END FROM pr, range(1, 3) r(rep), (VALUES ('set2'), ('set3')) s(k), range(2) q(p))"""


@query("e7_tasks", f"WITH {_TASKS} SELECT set_key, CAST(rep AS INT) AS rep, concurrent_group_id, CAST(process_index AS INT) AS process_index, workload, threads, co_running_workloads, CAST(first_cpu AS INT) AS first_cpu FROM tk")
def e7(spark, d):
    return _tasks(spark, d).select("set_key", "rep", "concurrent_group_id", "process_index", "workload", "threads", "co_running_workloads", F.col("affinity")[0].alias("first_cpu"))


@query("a23_plan_by_set", f"WITH {_TASKS} SELECT set_key, count(*) AS tasks, count(DISTINCT concurrent_group_id) AS groups, count(DISTINCT workload) AS unique_workloads, array_to_string(list_sort(list_distinct(list(threads))), ',') AS thread_values FROM tk GROUP BY set_key")
def a23s(spark, d):
    return collection.plan_by_set(_tasks(spark, d))


@query("t7_group_order", f"WITH {_TASKS} SELECT concurrent_group_id, true AS placed FROM tk GROUP BY 1")
def t7(spark, d):
    """Every group has one place of 0 to n - 1; the order is drawn, so a test compares it with Python's."""
    order = collection.group_order(_tasks(spark, d), 5)
    n = order.count()
    return order.select("concurrent_group_id", (F.col("place").between(0, n - 1) & (F.count("*").over(_by("place")) == 1)).alias("placed"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


@query("v1_collection_errors", f"WITH {_TASKS}, g AS (SELECT * FROM tk WHERE concurrent_group_id <> 'set2_r1_g1') SELECT 'set2' AS set_key, 'tasks' AS problem, count(*) + 2 AS expected, count(*) AS found FROM g WHERE set_key = 'set2' UNION ALL SELECT 'set2', 'groups', count(DISTINCT concurrent_group_id) + 1, count(DISTINCT concurrent_group_id) FROM g WHERE set_key = 'set2' UNION ALL SELECT 'set2', 'results', count(*) + 2, count(*) FROM g WHERE set_key = 'set2' UNION ALL SELECT 'set3', 'failed', 0, count(*) FROM g WHERE set_key = 'set3' AND workload = 'w1' UNION ALL SELECT 'set2', 'pairs of repetition 1', count(*), count(*) - 1 FROM pr")
def v1e(spark, d):
    """A collection that lacks a group and in which a workload failed."""
    tasks = _tasks(spark, d).where("concurrent_group_id <> 'set2_r1_g1'")
    results = tasks.select("set_key", F.when((F.col("set_key") == "set3") & (F.col("workload") == "w1"), 1).otherwise(0).alias("returncode"))
    n = tasks.select("workload").distinct().count()
    return collection.collection_errors(tasks, results, n, 2, 2)


@query("v1_holdout_gaps", "SELECT 'leave_one_workload_out__w' || (user_id % 7) AS experiment, 'tree' AS model FROM events WHERE user_id % 7 IN (2, 5) GROUP BY 1")
def v1h(spark, d):
    workloads = adapter.perf_long(spark, d).select("workload").distinct()
    done = workloads.where("workload not in ('w2', 'w5')").select(F.concat(F.lit("leave_one_workload_out__"), "workload").alias("experiment")).unionByName(spark.createDataFrame([("config_group_holdout",)], "experiment string"))
    return collection.holdout_gaps(done.withColumns({"family": F.lit("__all_families__"), "model": F.lit("tree")}), workloads, ["tree"])


@query("v3_ablation_coverage", "SELECT 'e' || (n_nationkey % 4) AS experiment, 's' || n_regionkey AS scope FROM nation GROUP BY 1, 2 EXCEPT SELECT 'e' || (n_nationkey % 4), 's' || n_regionkey FROM nation WHERE n_nationkey % 3 = 0")
def v3(spark, d):
    """Experiments and scopes without a choice."""
    n = adapter.table(spark, d, "nation")
    keys = [F.concat(F.lit("e"), (F.col("n_nationkey") % 4).cast("string")).alias("experiment"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("scope")]
    return planning.incomplete(n.select(*keys), n.where("n_nationkey % 3 = 0").select(*keys), ["experiment", "scope"])


@query("k9_discovery", f"SELECT family, selected_event FROM {_ALIAS_SQL}")
def k9(spark, d):
    """Aliases as the written discovery names them."""
    path = fresh_path(spark, "discovery")
    aliases = _aliases(spark, d)
    writers.write_discovery(adapter.table(spark, d, "part").select(F.concat(F.lit("PART "), F.col("p_partkey").cast("string")).alias("value")), aliases, events.readiness(aliases), {"vendor": "intel"}, path)
    return writers.read_aliases(spark, path).select("family", "selected_event")


@query("k11_collection_records", f"WITH {_TASKS} SELECT set_key, count(*) AS tasks, count(*) AS results FROM tk GROUP BY set_key")
def k11(spark, d):
    path = fresh_path(spark, "collection")
    tasks = _tasks(spark, d)
    writers.write_collection(tasks, tasks.select("set_key", F.lit(0).alias("returncode")), path)
    read = [spark.read.parquet(f"{path}/{n}").groupBy("set_key").agg(F.count("*").alias(a)) for n, a in (("manifest", "tasks"), ("results", "results"))]
    return read[0].join(read[1], "set_key")


@query("k11_collection_contents", f"WITH {_TASKS} SELECT set_key, CAST(rep AS INT) AS rep, concurrent_group_id, CAST(process_index AS INT) AS process_index, workload, threads, co_running_workloads, CAST(first_cpu AS INT) AS first_cpu FROM tk")
def k11c(spark, d):
    """The written manifest of a collection, read back whole."""
    path, tasks = fresh_path(spark, "collection"), _tasks(spark, d)
    writers.write_collection(tasks, tasks.select("set_key", F.lit(0).alias("returncode")), path)
    return spark.read.parquet(f"{path}/manifest").select("set_key", "rep", "concurrent_group_id", "process_index", "workload", "threads", "co_running_workloads", F.col("affinity")[0].alias("first_cpu"))


_MODELS = ["baseline_last_state", "rle_markov_phase_predictor", "hsmm_duration_phase_predictor", "online_history_tree", "rocket_phase_classifier", "tiny_transformer_phase_classifier", "graph_tcn_phase_classifier", "own_parameters", "own_table"]


@query(
    "p26_all_model_forms",
    "SELECT p_partkey, model, CASE model WHEN 'baseline_last_state' THEN 1 WHEN 'rle_markov_phase_predictor' THEN 2 * greatest(p_size, 45) WHEN 'hsmm_duration_phase_predictor' THEN 2 * greatest(p_size, 39) WHEN 'online_history_tree' THEN p_size * 3 WHEN 'own_table' THEN 2 * p_size WHEN 'rocket_phase_classifier' THEN 4 * greatest(p_size * 10, 8 * p_size) ELSE 4 * p_size * 10 END AS memory_bytes, "
    "CASE model WHEN 'baseline_last_state' THEN 1 WHEN 'rle_markov_phase_predictor' THEN 6 WHEN 'hsmm_duration_phase_predictor' THEN 12 WHEN 'online_history_tree' THEN greatest(1, 2 * p_size) WHEN 'own_table' THEN greatest(4, p_size) WHEN 'rocket_phase_classifier' THEN greatest(64, 64 * p_size) WHEN 'tiny_transformer_phase_classifier' THEN greatest(256, 40 * p_size) WHEN 'graph_tcn_phase_classifier' THEN greatest(256, 30 * p_size) ELSE greatest(8, 10 * p_size) END AS approx_operations, "
    "CASE WHEN model = 'baseline_last_state' THEN 'register' WHEN model IN ('rle_markov_phase_predictor', 'own_table') THEN 'table_lookup' WHEN model IN ('hsmm_duration_phase_predictor', 'own_parameters') THEN 'integer_arithmetic' WHEN model = 'online_history_tree' THEN 'comparisons' WHEN model = 'tiny_transformer_phase_classifier' THEN 'softmax' ELSE 'MACs' END AS operator_type FROM (SELECT p_partkey, p_size, [" + ", ".join(f"'{m}'" for m in _MODELS) + "][p_partkey % 9 + 1] AS model FROM part)",
)
def p26_all(spark, d):
    """Costs of every form of model, over parts."""
    size, model = F.col("p_size"), F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    table = model.isin("rle_markov_phase_predictor", "hsmm_duration_phase_predictor", "own_table")
    params = model.isin("rocket_phase_classifier", "tiny_transformer_phase_classifier", "graph_tcn_phase_classifier", "own_parameters")
    rows = adapter.table(spark, d, "part").select(
        "p_partkey", model.alias("model"), F.when(params, size * 10).otherwise(0).alias("parameter_count"), F.when(table, size).otherwise(0).alias("table_entries"), F.when(model == "online_history_tree", size).otherwise(0).alias("tree_internal_nodes"),
        F.when(model == "online_history_tree", size * 3).otherwise(0).alias("estimated_storage_bytes"), F.when(table, 5).otherwise(0).alias("bucket_count"), F.when(model == "rocket_phase_classifier", 8).otherwise(0).alias("feature_count"), F.when(model == "rocket_phase_classifier", size).otherwise(0).alias("kernel_count"),
    )
    return policy.deployment_cost(rows).select("p_partkey", "model", "memory_bytes", "approx_operations", "operator_type")


@query("p5_lists_per_row", "SELECT o_orderkey, len(list_filter([trim(x) FOR x IN string_split(t, ',')], lambda x: x <> '')) AS n, coalesce(list_filter([trim(x) FOR x IN string_split(t, ',')], lambda x: x <> '')[1], '') AS first FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ', ,' WHEN 1 THEN ' ' || o_orderstatus || ',,' || o_orderkey ELSE 'x , ' || o_orderstatus || ' ,y' END AS t FROM orders)")
def p5_rows(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    text = F.when(k % 3 == 0, ", ,").when(k % 3 == 1, F.concat(F.lit(" "), s, F.lit(",,"), k.cast("string"))).otherwise(F.concat(F.lit("x , "), s, F.lit(" ,y")))
    items = fn.split_list(text)
    return adapter.table(spark, d, "orders").select("o_orderkey", F.size(items).cast("long").alias("n"), F.coalesce(F.get(items, F.lit(0)), F.lit("")).alias("first"))


# -- streams ----------------------------------------------------------------------


def _finished(df: DataFrame, where: str, name: str) -> DataFrame:
    """What a stream gives that is run over all that is there."""
    run = df.writeStream.outputMode("append").format("parquet").option("path", f"{where}/{name}").option("checkpointLocation", f"{where}/{name}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/{name}")


@query("stream_perf_text", "SELECT 'run=' || user_id % 3 AS run_id, CAST(user_id % 4 AS VARCHAR) AS cpu_or_core_id, CAST(event_id // 50 * 100 AS DOUBLE) AS timestamp_ms, round(sum(CASE WHEN event_id % 17 <> 0 THEN value END) FILTER (event_type = 'view'), 6) AS counter__instructions_retired, round(sum(CASE WHEN event_id % 17 <> 0 THEN value END) FILTER (event_type IN ('click', 'error')), 6) AS counter__branch_instructions, min(CAST(json_extract(props, '$.k') AS DOUBLE)) FILTER (event_type = 'view') AS pmu_enabled_pct__instructions_retired, CAST(sum(event_id * 10) FILTER (event_type = 'view') AS DOUBLE) AS pmu_runtime_ns__instructions_retired FROM events GROUP BY ALL")
def stream_perf(spark, d):
    """Counter text of three runs, landed as files: parsed, and pivoted once a time is closed."""
    where = fresh_path(spark, "stream")
    e = adapter.table(spark, d, "events")
    value = F.when(F.col("event_id") % 17 == 0, F.lit("<not counted>")).otherwise(F.col("value").cast("string"))
    line = F.concat_ws(",", F.format_string("%.3f", F.floor(F.col("event_id") / 50) / 10), F.concat(F.lit("CPU"), (F.col("user_id") % 4).cast("string")), value, F.lit("msec"), F.concat(F.upper("event_type"), F.lit(":u [annotated]")), (F.col("event_id") * 10).cast("string"), F.get_json_object("props", "$.k"), F.lit(""), F.lit(""))
    e.select(line.alias("value"), (F.col("user_id") % 3).alias("run")).write.partitionBy("run").text(f"{where}/in")
    # a far later line of another run closes all times
    spark.range(1).select(F.lit("999999999.000,CPU0,0,msec,x,0,0,,").alias("value"), F.lit("z").alias("run")).write.mode("append").partitionBy("run").text(f"{where}/in")
    rows = perf.interval_rows(perf.perf_samples(perf.perf_lines(spark, f"{where}/in"), "1000 days"), {"view": "instructions_retired", "click": "branch_instructions", "error": "branch_instructions"})
    done = _finished(rows, where, "out").where("run_id <> 'run=z'")
    return done.select("run_id", "cpu_or_core_id", F.round("timestamp_ms", 3).alias("timestamp_ms"), *r6("counter__instructions_retired", "counter__branch_instructions"), "pmu_enabled_pct__instructions_retired", "pmu_runtime_ns__instructions_retired")


@query("stream_nearest", "WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click') SELECT v.event_id, CAST(v.user_id AS VARCHAR) AS run_id, round(c.value, 6) AS value, c.ts IS NOT NULL AS attached FROM v LEFT JOIN c ON v.user_id = c.user_id AND c.ts BETWEEN v.ts - INTERVAL 3 DAYS AND v.ts + INTERVAL 3 DAYS QUALIFY row_number() OVER (PARTITION BY v.event_id ORDER BY abs(epoch_us(c.ts) - epoch_us(v.ts)), c.ts DESC, c.value) = 1")
def stream_near(spark, d):
    """Each view with the nearest click of its user within three days, both as streams."""
    where = fresh_path(spark, "stream")
    e = adapter.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    late = e.agg((F.max("ts") + F.expr("interval 9000 days")).alias("ts"))
    sides = {}
    for side, kind in (("core", "view"), ("other", "click")):
        e.where(F.col("event_type") == kind).drop("event_type").unionByName(late.select(F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("run_id"), "ts", F.lit(0.0).alias("value"))).write.parquet(f"{where}/{side}")
        sides[side] = spark.readStream.schema(e.drop("event_type").schema).parquet(f"{where}/{side}").withWatermark("ts", "1000 days")
    near = perf.nearest_on_streams(sides["core"].drop("value"), sides["other"], ["value"], "3 days", row=["event_id"])
    return _finished(near, where, "out").where("run_id <> ''").select("event_id", "run_id", *r6("value"), "attached")


@query("stream_scored_states", sql("states", "h AS (SELECT run_id, timestamp_ms, row_index, is_train, state, row_number() OVER w AS n, lead(state) OVER w AS target, state AS v FROM states WINDOW w AS (PARTITION BY run_id, cpu_or_core_id ORDER BY timestamp_ms))", "q AS (SELECT row_index, is_train, target, v::DOUBLE AS v FROM h WHERE n >= 4 AND target IS NOT NULL)", *_stump("u", "q", "v", 3), "SELECT run_id, timestamp_ms, CAST(state AS INT) AS state, p AS prediction FROM h, u_b JOIN u_s ON true WHERE n >= 4 AND side = (v <= t)"))
def stream_scored(spark, d):
    """Daily sums of a stream of events, their states and the predictions of a tree that was fitted at rest: three stateful steps and none of them waits for the clock."""
    where = fresh_path(spark, "stream")
    rest = frames.base(spark, d)
    low, high = quantiles(rest.where("is_train"), [VALUE], [1 / 3, 2 / 3]).first()[f"q__{VALUE}"]
    tree = models.fit_tree(evaluation.examples(frames.states(spark, d), 4, ["state"]).where("is_train"), ["h3"], "target", 1, 3)
    e = adapter.table(spark, d, "events").select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), (F.col("user_id") % 4).cast("string").alias("cpu_or_core_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "instructions_retired").alias("counter"), "value")
    e.write.parquet(f"{where}/in")
    e.agg((F.max("ts") + F.expr("interval 9000 days")).alias("ts")).select(F.lit("").alias("run_id"), F.lit("0").alias("cpu_or_core_id"), "ts", F.lit("").alias("counter"), F.lit(0.0).alias("value")).write.mode("append").parquet(f"{where}/in")
    sums = online.windowed_sums(spark.readStream.schema(e.schema).parquet(f"{where}/in"), ["instructions_retired"], late="1000 days")
    with scoring.state_store(spark):
        done = _finished(scoring.scored(sums, VALUE, low, high, tree, 4), where, "out")
    return done.where("run_id <> '' and prediction is not null").select("run_id", "timestamp_ms", "state", "prediction")
