"""Choosing one counter per family: scores, the best, all combinations, and how a choice is looked up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import FAMILY_COUNTERS, SCORE_WEIGHTS, is_forbidden
from ..functions.scalars import keyed_pairs, split_list
from .features import fill_train_median
from .forest import Node, fit_forest, forest_predictions
from .lineage import cut, small
from .metrics import REPORT, SELECT, classification_scores, confusion, mask_rows
from .sequences import stream


def weighted_score(accuracy: str = "accuracy", high_recall: str = "high_recall", weights: tuple[float, float] = SCORE_WEIGHTS) -> Column:
    return weights[0] * F.col(accuracy) + weights[1] * F.col(high_recall)


def mark_best(scores: DataFrame, by: Sequence[str], score: str = "score", order: str = "position") -> DataFrame:
    """Adds ``selected``: 1 for the greatest score of a group, the first of equals."""
    best = scores.groupBy(*by).agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("o"))).alias("__top"))
    return scores.join(best, list(by)).withColumn("selected", ((F.col(score) == F.col("__top").getField(score)) & (F.col(order) == -F.col("__top.o"))).cast("int")).drop("__top")


def combinations(scores: DataFrame, families: Sequence[str], family: str = "family", counter: str = "counter", score: str = "score") -> DataFrame:
    """A row for every choice of one counter per family, with the mean score: a product of small lists (2 x 1 x 2 x 4 x 2 x 2 here)."""
    options = scores.select(family, counter, score)
    out = None
    for i, name in enumerate(families):
        mine = options.where(F.col(family) == name).select(F.col(counter).alias(f"c{i}"), F.col(score).alias(f"s{i}"))
        out = mine if out is None else out.crossJoin(small(mine))
    mean = sum((F.col(f"s{i}") for i in range(len(families))), F.lit(0.0)) / len(families)
    pairs = F.concat_ws(";", *[F.concat(F.lit(f"{name}:"), F.col(f"c{i}")) for i, name in enumerate(families)])
    return out.select(pairs.alias("family_counter_map"), F.concat_ws(",", *[f"c{i}" for i in range(len(families))]).alias("counter_set"), mean.alias("score"))


def best_combination(scores: DataFrame, families: Sequence[str], family: str = "family", counter: str = "counter", score: str = "score", order: str = "position") -> DataFrame:
    """The best choice without the product: a mean of separate scores is greatest where each is."""
    best = mark_best(scores, [family], score, order).where("selected = 1").where(F.col(family).isin(*families))
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(family, counter))), lambda p: F.concat(p[family], F.lit(":"), p[counter])), ";").alias("family_counter_map"), F.avg(score).alias("score"))


def latest_choice(results: DataFrame, by: Sequence[str], score: str = "validation_score", order: str = "position") -> DataFrame:
    """Per group the row of the greatest (score, selected), the last of equals; a score that is no number counts as least."""
    value = F.coalesce(F.when(~F.isnan(F.col(score)) & (F.abs(F.col(score)) != float("inf")), F.col(score)), F.lit(float("-inf")))
    rank = F.struct(value.alias("a"), F.coalesce(F.col("selected").cast("int"), F.lit(0)).alias("b"), F.col(order).alias("c"))
    return results.groupBy(*by).agg(F.max_by(F.struct(*[F.col(c) for c in results.columns if c not in by]), rank).alias("r")).select(*by, "r.*")


def singleton_choice(results: DataFrame) -> DataFrame:
    """experiment, scope, family, counter of the best rows that try one counter."""
    ones = results.where((F.col("candidate_type") == "singleton") & ~F.coalesce(F.col("family"), F.lit("")).isin("", "__global__"))
    ones = ones.withColumn("__c", split_list(F.col("counter_set"))).where(F.size("__c") == 1).withColumn("counter", F.col("__c")[0]).drop("__c")
    return latest_choice(ones, ["experiment", "scope", "family"]).select("experiment", "scope", "family", "counter")


def global_choice(results: DataFrame) -> DataFrame:
    """experiment, scope, family, counter of the best rows that choose for all families at once."""
    rows = results.where((F.col("candidate_type") == "one_per_family_exhaustive") & (F.col("family") == "__global__"))
    rows = rows.withColumn("pairs", keyed_pairs(F.col("family_counter_map"))).where(F.size("pairs") > 0).drop("family")
    return latest_choice(rows, ["experiment", "scope"]).select("experiment", "scope", F.explode("pairs").alias("family", "counter"))


def resolve(wanted: DataFrame, choice: DataFrame) -> DataFrame:
    """The choice for each (experiment, scope): the exact one, that of the scope, that of the experiment, or the general one."""
    level = F.when((F.col("c.experiment") == F.col("w.experiment")) & (F.col("c.scope") == F.col("w.scope")), 0).when((F.col("c.experiment") == "") & (F.col("c.scope") == F.col("w.scope")), 1)
    level = level.when((F.col("c.experiment") == F.col("w.experiment")) & (F.col("c.scope") == ""), 2).when((F.col("c.experiment") == "") & (F.col("c.scope") == ""), 3)
    # the general rows meet all wanted ones, so the join is on the scope or none; both tables are small
    met = wanted.alias("w").join(small(choice).alias("c"), F.col("c.experiment").isin("", F.col("w.experiment")) & F.col("c.scope").isin("", F.col("w.scope")))
    ranked = met.select("w.experiment", "w.scope", level.alias("level"), "c.family", "c.counter")
    best = ranked.groupBy("experiment", "scope").agg(F.min("level").alias("level"))
    return ranked.join(best, ["experiment", "scope", "level"]).drop("level")


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def ablation(df: DataFrame, state: str = "state", families: dict[str, list[str]] | None = None, max_depth: int = 5, min_leaf: int = 3) -> DataFrame:
    """Score of each counter that is there: a tree on its value foretells the next state.

    The last row of a stream has the state -1 to come, which the tree learns like any
    other and scores leave out.  Missing values get the training median.  Choices
    are made on validation rows, reports on test rows.  The trees of all counters grow
    together (see ``fit_forest``), so the number of jobs is that of one.
    """
    rows = cut(df.withColumn("target", F.coalesce(F.lead(state).over(stream()), F.lit(-1))))
    listed = [(f, c) for f in sorted(families or FAMILY_COUNTERS) for c in (families or FAMILY_COUNTERS)[f] if f"counter__{c}" in df.columns and not is_forbidden(f"counter__{c}")]
    if not listed:
        raise ValueError("no usable counter")
    columns = list(dict.fromkeys(f"counter__{c}" for _, c in listed))
    filled = fill_train_median(rows, columns)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("model"), F.array(F.col(f"counter__{c}").cast("double")).alias("x")) for i, (_, c) in enumerate(listed)]))
    long = cut(filled.select("split", "is_train", "target", "row_index", each.alias("e")).select("split", "is_train", "target", "row_index", "e.*"))
    trees = fit_forest(long.where("is_train").select("model", "x", F.col("target").alias("y"), F.col("row_index").alias("at")), 1, max_depth, min_leaf)
    # a counter that nothing trained says 0
    said = forest_predictions(long.where("target >= 0"), {i: trees.get(i, Node(0, {})) for i in range(len(listed))})
    out = df.sparkSession.createDataFrame([(i, f, c, i) for i, (f, c) in enumerate(listed)], "model long, family string, counter string, position int")
    kinds = ("accuracy", "macro_f1", "high_recall")
    for name, order in (("selection", SELECT), ("report", REPORT)):
        scores = classification_scores(confusion(mask_rows(said, order, else_all=True), ["model"]), ["model"]).select("model", *[F.col(c).alias(f"{name}_{c}") for c in kinds])
        out = out.join(scores, "model", "left").withColumns({f"{name}_{c}": F.coalesce(f"{name}_{c}", F.lit(0.0)) for c in kinds})
    out = out.drop("model")
    scored = out.withColumns({"score": weighted_score("selection_accuracy", "selection_high_recall"), "report_score": weighted_score("report_accuracy", "report_high_recall")})
    return mark_best(scored, ["family"])


UNAVAILABLE = "unavailable"
ABLATION = ["family", "scope", "candidate_type", "counter_set", "family_counter_map", "selection_accuracy", "selection_macro_f1", "selection_high_recall", "report_accuracy", "report_macro_f1", "report_high_recall", "validation_score", "report_score", "selected", "position"]


def ablation_table(df: DataFrame, scope: str = "global", state: str = "state", families: dict[str, list[str]] | None = None, max_depth: int = 5, min_leaf: int = 3, exhaustive: bool = True) -> DataFrame:
    """All rows of an ablation: each counter alone, families without one, and every choice of one counter per family.

    ``candidate_type`` is singleton, unavailable (score 0, nothing selected) or
    one_per_family_exhaustive (family ``__global__``, mean of the counters' scores; the
    product of short lists).  ``selected`` marks the best counter of each family and the
    best choice, the first of equals.
    """
    spark = df.sparkSession
    names = families or FAMILY_COUNTERS
    there = {f: [c for c in counters if f"counter__{c}" in df.columns and not is_forbidden(c)] for f, counters in names.items()}
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    out = None
    if any(there.values()):
        single = cut(ablation(df, state, {f: c for f, c in there.items() if c}, max_depth, min_leaf))
        out = single.select("family", F.lit(scope).alias("scope"), F.lit("singleton").alias("candidate_type"), F.col("counter").alias("counter_set"), none("family_counter_map", "string"), *ABLATION[5:11], F.col("score").alias("validation_score"), "report_score", "selected", F.col("position").cast("long").alias("position"))
    empty = [(f, i) for i, f in enumerate(sorted(names)) if not there[f]]
    if empty:
        rows = spark.createDataFrame(empty, "family string, position long")
        rows = rows.select("family", F.lit(scope).alias("scope"), F.lit(UNAVAILABLE).alias("candidate_type"), F.lit("").alias("counter_set"), none("family_counter_map", "string"), *[F.lit(0.0).alias(c) for c in ABLATION[5:13]], F.lit(0).alias("selected"), (F.col("position") + (1 << 20)).alias("position"))
        out = rows if out is None else out.unionByName(rows)
    if exhaustive and any(there.values()):
        order = [f for f in sorted(names) if there[f]]
        reported = combinations(single, order, score="report_score").select("family_counter_map", F.col("score").alias("report_score"))
        joint = combinations(single, order).join(reported, "family_counter_map")
        # the first of equal choices in order of the counters' places
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.array(*[F.element_at(F.create_map(*[F.lit(x) for c in there[f] for x in (c, there[f].index(c))]), F.split("counter_set", ",")[i]) for i, f in enumerate(order)])))
        rows = mark_best(joint.withColumns({"family": F.lit("__global__"), "position": place.cast("long") + (1 << 30)}), ["family"])
        out = out.unionByName(rows.select("family", F.lit(scope).alias("scope"), F.lit("one_per_family_exhaustive").alias("candidate_type"), "counter_set", "family_counter_map", *[none(c, "double") for c in ABLATION[5:11]], F.col("score").alias("validation_score"), "report_score", "selected", "position"))
    return out.select(*ABLATION)


def last_selected(results: DataFrame, order: str = "position") -> DataFrame:
    """family, counter_set of the last row that is flagged as selected (1, true or yes)."""
    flagged = results.where(F.lower(F.col("selected").cast("string")).isin("1", "true", "yes"))
    return flagged.groupBy("family").agg(F.max_by("counter_set", order).alias("counter_set"))


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def representatives(df: DataFrame, by: Sequence[str], scores: Sequence[str], name: str) -> DataFrame:
    """Of each group the row with the greatest scores, compared in their order, then the least ``name``."""
    return rank_within(df, by, [*[F.col(s).desc_nulls_last() for s in scores], F.col(name)]).where("rank = 1").drop("rank")
