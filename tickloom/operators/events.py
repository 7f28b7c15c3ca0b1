"""Which event stands for each counter on a machine, and whether that is enough to collect by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import COLLECTED, EVENT_CANDIDATES, REQUIRED_ANY, REQUIRED_CORE, UNCORE_EVENTS, UNCORE_MACHINE, UNCORE_TOTAL
from ..functions.scalars import normal_event
from .lineage import small


def candidates(spark: SparkSession, table: dict[str, dict[str, list[str]]] = EVENT_CANDIDATES) -> DataFrame:
    """family, vendor, event_name, priority, family_order: a row per name of the table."""
    rows = [(family, vendor, name, i, order) for order, (family, vendors) in enumerate(table.items()) for vendor, names in vendors.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "family string, vendor string, event_name string, priority int, family_order int")


def reads_memory_controllers(vendor: str, cpu_family: int, cpu_model: int) -> bool:
    return (vendor, cpu_family, cpu_model) == UNCORE_MACHINE


def alias_map(names: DataFrame, supported: DataFrame, vendor: str, devices: Sequence[str] = (), uncore: bool = False) -> DataFrame:
    """A row per family: the event that stands for it, how it was chosen, and where it is counted.

    ``names``: family, vendor, event_name, priority; ``supported``: normal, event_name (see
    ``planning.event_aliases``).  The vendor's own names come before generic ones, in
    their order.  With ``uncore`` memory traffic is read from ``devices``, if there are
    any, and its total is derived.
    """
    mine = names.where(F.col("vendor").isin(vendor, "generic")).withColumn("own", F.col("vendor") == vendor)
    known = supported.groupBy("normal").agg(F.max("event_name").alias("listed"))
    met = mine.withColumn("normal", normal_event(F.col("event_name"))).join(known, "normal", "left")
    first = F.struct((~F.col("own")).alias("a"), F.col("priority").alias("b"))
    best = met.groupBy("family").agg(
        F.count("*").alias("candidate_count"),
        F.min_by(F.when(F.col("listed").isNotNull(), F.struct("listed", "event_name", "own")), F.when(F.col("listed").isNotNull(), first)).alias("hit"),
    )
    rows = names.select("family").distinct().join(best, "family", "left")
    alias = F.lit("")
    for family, event in UNCORE_EVENTS.items():
        alias = F.when(F.col("family") == family, event).otherwise(alias)
    by_device = (alias != "") & F.lit(bool(uncore and devices))
    derived = (F.col("family") == UNCORE_TOTAL) & F.lit(uncore)

    def pick(device: Column, total: Column, other: Column) -> Column:
        return F.when(by_device, device).when(derived, total).otherwise(other)

    no, own = F.col("hit").isNull(), F.col("hit.own")
    name = F.concat(F.lit("uncore_imc/"), alias, F.lit("/"))
    parts = " + ".join(f"uncore_imc/{e}/" for e in UNCORE_EVENTS.values())
    return rows.select(
        "family",
        pick(F.lit(True), F.lit(True), ~no).alias("supported"),
        pick(name, F.lit(f"derived_{UNCORE_TOTAL}"), F.coalesce("hit.listed", F.lit(""))).alias("selected_event"),
        pick(name, F.lit(parts), F.coalesce("hit.event_name", F.lit(""))).alias("selected_via"),
        pick(F.lit("vendor_preferred_uncore"), F.lit("derived_uncore_total"), F.when(no, "unsupported").when(own, "vendor_preferred").otherwise("generic_fallback")).alias("selection_kind"),
        pick(F.lit(True), F.lit(True), F.coalesce(own, F.lit(False))).alias("analysis_confident"),
        pick(F.lit("system_wide_uncore"), F.lit("derived_uncore"), F.lit("task_local")).alias("collection_scope"),
        (by_device | derived).alias("requires_system_wide"),
        F.when(by_device, alias).otherwise("").alias("event_alias"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
    )


def reverse_aliases(aliases: DataFrame, order: str = "family_order") -> DataFrame:
    """normal event name -> family, by the selected event and by the name it was found under; events of devices are left out, the last family wins."""
    rows = aliases.where((F.col("collection_scope") != "system_wide_uncore") & (F.trim("selected_event") != ""))
    names = rows.select("family", order, F.explode(F.array("selected_event", "selected_via")).alias("name"))
    return names.groupBy(normal_event(F.col("name")).alias("normal")).agg(F.max_by("family", order).alias("family"))


def device_specs(aliases: DataFrame, devices: Sequence[str]) -> DataFrame:
    """family, device, event_name of every device and family that is read from devices."""
    rows = aliases.where((F.col("collection_scope") == "system_wide_uncore") & (F.trim("event_alias") != ""))
    return rows.select("family", F.explode(F.array(*map(F.lit, devices)).cast("array<string>")).alias("device"), "event_alias").select("family", "device", F.concat("device", F.lit("/"), "event_alias", F.lit("/")).alias("event_name"))


def device_samples(samples: DataFrame, specs: DataFrame, event: str = "event_name") -> DataFrame:
    """Samples of device events with the family that their event stands for; others are left out.  Rows keep their columns, ``counter`` is new."""
    known = specs.where((F.trim("event_name") != "") & (F.trim("family") != "")).groupBy(normal_event(F.col("event_name")).alias("__name")).agg(F.max("family").alias("counter"))
    return samples.withColumn("__name", normal_event(F.col(event))).join(known, "__name").drop("__name")


def event_names(aliases: DataFrame, scope: str = "task_local") -> DataFrame:
    """Events to count in a scope."""
    return aliases.where((F.col("collection_scope") == scope) & (F.trim("selected_event") != "")).select("family", F.col("selected_event").alias("event_name"))


def families_by_kind(aliases: DataFrame) -> DataFrame:
    """family, kind: each of ``confident``, ``generic_fallback`` and ``unsupported`` that holds for a family."""
    kinds = F.array_compact(F.array(F.when(F.col("analysis_confident"), F.lit("confident")), F.when(F.col("selection_kind") == "generic_fallback", F.lit("generic_fallback")), F.when(~F.col("supported"), F.lit("unsupported"))))
    return aliases.select("family", F.explode(kinds).alias("kind"))


def readiness(aliases: DataFrame, core: Sequence[str] = REQUIRED_CORE, either: Sequence[str] = REQUIRED_ANY) -> DataFrame:
    """One row: whether the counters that a study needs are there with confidence, and what is missing (sorted)."""
    sure = F.col("analysis_confident") & (F.col("collection_scope") == "task_local")
    there = aliases.agg(F.collect_set(F.when(sure, F.col("family"))).alias("there"))
    missing = F.concat(F.array_except(F.array(*map(F.lit, core)), F.col("there")), F.when(F.arrays_overlap("there", F.array(*map(F.lit, either))), F.array().cast("array<string>")).otherwise(F.array(F.lit("one_of:" + "|".join(either)))))
    return there.select(F.array_join(F.array_sort("there"), ",").alias("confident"), missing.alias("m")).select((F.size("m") == 0).alias("ready"), F.array_join("m", ",").alias("missing"), "confident")


def uncore_readiness(devices: Sequence[str], blocked: bool, specs: DataFrame, probe_output: str | None = None) -> DataFrame:
    """One row: whether devices can be read, and why not.  The probe itself is run outside; ``probe_output`` is None if it failed."""
    refused = any(x in (probe_output or "").lower() for x in ("access to performance monitoring", "perf_event_paranoid", "permission"))
    counted = probe_output is not None and "<not supported>" not in probe_output.lower() and not refused
    reason = F.lit("no device") if not devices else F.lit("blocked by policy") if blocked or refused else F.when(F.col("n") == 0, "no event").otherwise("ready" if counted else "the probe gave no counts")
    return specs.agg(F.count("*").alias("n")).select(reason.alias("reason")).withColumn("ready", F.col("reason") == "ready")


def family_events(aliases: DataFrame, families: Sequence[str] | DataFrame = COLLECTED) -> DataFrame:
    """Supported events of the families that are collected, in the families' order.

    ``families``: a short list, or a table of any number (family, place), one row each, that is joined.
    """
    there = aliases.where(F.col("supported") & (F.col("collection_scope") == "task_local") & (F.trim("selected_event") != ""))
    if isinstance(families, DataFrame):
        placed = there.join(small(families.select("family", F.col("place").cast("int").alias("place"))), "family")
    else:
        place = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
        placed = there.where(place > 0).withColumn("place", (place - 1).cast("int"))
    return placed.select("place", "family", F.col("selected_event").alias("event_name"))


def family_readiness(aliases: DataFrame, families: Sequence[str] = COLLECTED) -> DataFrame:
    """One row: whether instructions and one more of the families are there with confidence."""
    sure = F.col("analysis_confident") & (F.col("collection_scope") == "task_local") & F.col("family").isin(*families)
    found = aliases.agg(F.coalesce(F.max((sure & (F.col("family") == "instructions_retired")).cast("int")), F.lit(0)).alias("base"), F.sum((sure & (F.col("family") != "instructions_retired")).cast("int")).alias("others"))
    reason = F.when(F.col("base") == 0, "instructions are missing").when(F.coalesce("others", F.lit(0)) == 0, "no other counter").otherwise("")
    return found.select(reason.alias("reason")).select((F.col("reason") == "").alias("ready"), "reason")
