"""Fixed values of the domain: counter families, derived features, defaults."""

from __future__ import annotations

#: Parts of a counter's name that keep it out of models (timing would leak the answer).
FORBIDDEN_PARTS = ["cycle", "ipc", "cpi", "elapsed", "stall", "per_ms", "interval_duration", "runtime"]

#: Family -> its counters, in order of preference.
FAMILY_COUNTERS = {
    "L1": ["l1d_loads", "l1d_stores"],
    "L2": ["l2_misses"],
    "LLC": ["llc_references", "llc_misses"],
    "memory_offcore": ["offcore_demand_data_reads", "memory_read_bandwidth", "memory_write_bandwidth", "total_memory_bandwidth"],
    "branch_control": ["branch_instructions", "branch_mispredictions"],
    "core_fp": ["instructions_retired", "fp_arithmetic"],
}
COUNTERS = [c for counters in FAMILY_COUNTERS.values() for c in counters]

#: Derived feature -> (family, numerator, denominator, scale); no denominator: the value itself.
DERIVED = {
    "l1d_loads_per_ki": ("L1", "l1d_loads", "instructions_retired", 1000.0),
    "l1d_stores_per_ki": ("L1", "l1d_stores", "instructions_retired", 1000.0),
    "l2_misses_per_ki": ("L2", "l2_misses", "instructions_retired", 1000.0),
    "llc_refs_per_ki": ("LLC", "llc_references", "instructions_retired", 1000.0),
    "llc_misses_per_ki": ("LLC", "llc_misses", "instructions_retired", 1000.0),
    "llc_miss_rate": ("LLC", "llc_misses", "llc_references", 1.0),
    "offcore_reads_per_ki": ("memory_offcore", "offcore_demand_data_reads", "instructions_retired", 1000.0),
    "memory_total_bandwidth": ("memory_offcore", "memory_total", None, 1.0),
    "memory_write_fraction": ("memory_offcore", "memory_write_bandwidth", "memory_total", 1.0),
    "branch_instructions_per_ki": ("branch_control", "branch_instructions", "instructions_retired", 1000.0),
    "branch_miss_rate": ("branch_control", "branch_mispredictions", "branch_instructions", 1.0),
    "fp_arithmetic_per_ki": ("core_fp", "fp_arithmetic", "instructions_retired", 1000.0),
    "instructions_per_interval": ("core_fp", "instructions_retired", None, 1.0),
}

#: Upper edges of run-length buckets; longer runs fall in one more.
RUN_LENGTH_EDGES = [1, 3, 7, 15]
#: Weights of accuracy and high-state recall in a counter's score.
SCORE_WEIGHTS = (0.7, 0.3)
#: Relative power of the three modes of the control policy.
MODE_POWER = [0.82, 0.94, 1.0]

# Counters that a machine must offer, and names of events that stand for them.

#: Needed with confidence on their own, and one of which is needed.
REQUIRED_CORE = ["instructions_retired", "cycles", "branch_mispredictions"]
REQUIRED_ANY = ["llc_references", "llc_misses", "offcore_demand_data_reads"]
#: Counters that a collection of families reads.
COLLECTED = ["instructions_retired", "branch_instructions", "branch_mispredictions", "l1d_loads", "l1d_stores", "l2_misses", "llc_references", "llc_misses", "offcore_demand_data_reads", "fp_arithmetic"]
#: Counters read from memory controllers where the machine has them, and vendor, family and model of such a machine.
UNCORE_EVENTS = {"memory_read_bandwidth": "cas_count_read", "memory_write_bandwidth": "cas_count_write"}
UNCORE_TOTAL = "total_memory_bandwidth"
UNCORE_MACHINE = ("intel", 6, 62)
#: Names of experiment sets.
SET_NAMES = {"set1": "set1_single_process_multithread", "set2": "set2_multi_process_single_thread", "set3": "set3_hybrid_multi_process_multithread"}
#: Counter -> vendor -> event names, in order of preference.
EVENT_CANDIDATES = {
    "instructions_retired": {"intel": ["INST_RETIRED.ANY"], "amd": ["RETIRED_INST"], "arm": ["INST_RETIRED"], "generic": ["instructions"]},
    "cycles": {"intel": ["CPU_CLK_UNHALTED.THREAD"], "amd": ["CYCLES_NOT_IN_HALT"], "arm": ["CPU_CYCLES"], "generic": ["cycles", "cpu-cycles"]},
    "branch_instructions": {"intel": ["BR_INST_RETIRED.ALL_BRANCHES"], "amd": ["RETIRED_BR_INST"], "arm": ["BR_RETIRED"], "generic": ["branches", "branch-instructions"]},
    "branch_mispredictions": {"intel": ["BR_MISP_RETIRED.ALL_BRANCHES"], "amd": ["RETIRED_BR_INST_MISP"], "arm": ["BR_MIS_PRED_RETIRED"], "generic": ["branch-misses"]},
    "l1d_loads": {"intel": ["MEM_UOPS_RETIRED.ALL_LOADS"], "amd": ["LS_DISPATCH.LOADS"], "arm": ["L1D_CACHE"], "generic": ["L1-dcache-loads", "cpu/L1-dcache-loads/"]},
    "l1d_stores": {"intel": ["MEM_UOPS_RETIRED.ALL_STORES"], "amd": ["LS_DISPATCH.STORES"], "arm": ["L1D_CACHE_WB"], "generic": ["L1-dcache-stores", "cpu/L1-dcache-stores/"]},
    "l2_misses": {"intel": ["L2_RQSTS.MISS"], "amd": ["L2 Miss"], "arm": ["L2D_CACHE_REFILL"], "generic": ["l2_rqsts.miss", "L2-dcache-load-misses", "cpu/L2-dcache-load-misses/"]},
    "llc_references": {"intel": ["LONGEST_LAT_CACHE.REFERENCE", "LLC_REFERENCES"], "amd": ["L3 Access"], "arm": ["L3D_CACHE"], "generic": ["cache-references", "LLC-loads", "cpu/LLC-loads/"]},
    "llc_misses": {"intel": ["LONGEST_LAT_CACHE.MISS", "LLC_MISSES"], "amd": ["L3 Miss"], "arm": ["L3D_CACHE_REFILL"], "generic": ["cache-misses", "LLC-load-misses", "cpu/LLC-load-misses/"]},
    "offcore_demand_data_reads": {"intel": ["OFFCORE_REQUESTS.DEMAND_DATA_RD"], "amd": ["DC Fills from Local Memory", "DC Fills from Remote Memory"], "arm": ["PMU_AXI_RD_REQ_EVENT"], "generic": []},
    "fp_arithmetic": {"intel": ["FP_ARITH_INST_RETIRED.SCALAR_DOUBLE"], "amd": ["RETIRED_SSE_AVX_FLOPS"], "arm": ["FP_RETIRED"], "generic": []},
    "resource_stalls": {"intel": ["RESOURCE_STALLS.ANY", "RESOURCE_STALLS"], "amd": ["DISPATCH_STALLS"], "arm": ["STALL_FRONTEND", "STALL_BACKEND"], "generic": ["stalled-cycles-frontend", "stalled-cycles-backend"]},
    "memory_read_bandwidth": {"intel": ["READ"], "amd": ["Local DRAM Read Data Bytes"], "arm": ["PMU_AXI_RD_REQ_EVENT"], "generic": []},
    "memory_write_bandwidth": {"intel": ["WRITE"], "amd": ["Local DRAM Write Data Bytes"], "arm": ["PMU_AXI_WR_REQ_EVENT"], "generic": []},
    "total_memory_bandwidth": {"intel": ["READ", "WRITE"], "amd": ["Total Memory Bw"], "arm": ["PMU_AXI_RD_REQ_EVENT", "PMU_AXI_WR_REQ_EVENT"], "generic": []},
}

DEFAULTS = {
    "seed": 17,
    "splits": {"train_fraction": 0.70, "val_fraction": 0.15},
    "phases": {"clusters": 3, "scope": "global"},
    "detector": {"history_length": 20, "horizon": 1, "tree_max_depth": 6, "tree_min_samples_leaf": 8},
    "ablation": {"tree_max_depth": 5, "tree_min_samples_leaf": 3, "weights": {"accuracy": 0.7, "high_usage_recall": 0.3}},
    "bootstrap": {"resamples": 1000},
    "runtime": {"profile": "quick", "quick": {"teacher_epochs": 3}, "full": {"teacher_epochs": 15}},
}


def merged_config(base: dict, override: dict) -> dict:
    """``base`` with ``override`` laid over it at every depth; neither is changed."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def with_profile(config: dict, full: bool = False) -> dict:
    """The configuration under its runtime profile (or the full one): the profile's epochs are the teacher's."""
    runtime = config.get("runtime", {})
    name = "full" if full else str(runtime.get("profile", "quick"))
    epochs = (runtime.get(name) or {}).get("teacher_epochs")
    chosen = {"runtime": {"profile": name}}
    return merged_config(config, chosen if epochs is None else {**chosen, "teacher": {"epochs": int(epochs)}})


def derived_there(family: str, columns: list[str]) -> list[str]:
    """Derived features of a family that are among the columns."""
    return [name for name in derived_of(family) if name in columns]


def counters_there(columns: list[str], prefix: str = "counter__") -> dict[str, list[str]]:
    """Family -> its counters that are among the columns."""
    return {family: [c for c in counters if f"{prefix}{c}" in columns] for family, counters in FAMILY_COUNTERS.items()}


def is_forbidden(counter: str) -> bool:
    return any(part in counter.lower() for part in FORBIDDEN_PARTS)


def safe_counters(columns: list[str], prefix: str = "counter__", strict: bool = False) -> list[str]:
    """Counter columns fit for models, sorted; with ``strict`` a forbidden one is an error."""
    found = sorted(c for c in columns if c.startswith(prefix))
    bad = [c for c in found if is_forbidden(c)]
    if strict and bad:
        raise ValueError(f"timing-derived counters are not allowed: {', '.join(bad)}")
    return [c for c in found if c not in bad]


def derived_of(family: str) -> list[str]:
    return [name for name, (owner, *_) in DERIVED.items() if owner == family]


def pressure_counters(counters: list[str]) -> list[str]:
    """Counters that rise with memory or branch pressure."""
    low = {c: c.lower() for c in counters}
    return [c for c in counters if "llc_misses" in low[c] or ("memory" in low[c] and "bandwidth" in low[c]) or "branch_mispredictions" in low[c] or "stall" in low[c]]


# Fixed values of the cost model.

#: Kinds of operation, most bytes, most operations -> complexity, advice; the first that fits holds.
COMPLEXITY = [
    (["register", "table_lookup"], 256, 16, "Very Low", "feasible in simple hardware"),
    (["table_lookup", "comparisons", "integer_arithmetic"], 2048, 128, "Low", "feasible in simple hardware"),
    (["integer_arithmetic", "comparisons", "MACs"], 8192, 1024, "Medium", "feasible in firmware/software runtime"),
    (["MACs", "softmax"], 65536, 100000, "High", "feasible in firmware/software runtime"),
]
BEYOND = "Very High"
BEYOND_ADVICE = {"softmax": "offline upper bound only"}
OTHER_ADVICE = "likely needs accelerator"
ORACLE_ADVICE = "oracle diagnostic only; requires the current offline-teacher phase"

#: Models known by their whole name: kind, operations, bytes per table entry, entries besides those per run-length bucket, entries per bucket.
TABLE_MODELS = {
    "baseline_last_state": ("register", 1.0, 1.0, 1, 0),
    "markov_phase_predictor": ("table_lookup", 3.0, 2.0, 9, 0),
    "rle_markov_phase_predictor": ("table_lookup", 6.0, 2.0, 0, 9),
    "hsmm_duration_phase_predictor": ("integer_arithmetic", 12.0, 2.0, 9, 6),
}
#: Beginnings of names of models of parameters (4 bytes each): kind, least operations, operations per parameter.
PARAMETER_MODELS = {
    "rocket_phase_classifier": ("MACs", 64.0, 8.0),
    "tcn_phase_classifier": ("MACs", 128.0, 2.0),
    "tiny_transformer_phase_classifier": ("softmax", 256.0, 4.0),
    "graph_tcn_phase_classifier": ("MACs", 256.0, 3.0),
}
