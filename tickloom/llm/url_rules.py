"""URL rules indexed by their rarest literal token (DataFrame functions only)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are words that any match has between separators."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    base: bool
    strength: int


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    name = host + path
    whole = [t for t in re.split(r"[^a-z0-9]+", host.lower()) if t]
    # a token of the path is whole only if the rule goes on after it
    whole += [t for t in re.findall(r"[/.\-_]([a-z0-9]+)(?=[/.\-_])", path)]
    return Rule(name, verdict, r"^(?:[^/?#]*\.)?" + _quote(host.lower()) + _quote(path), tuple(dict.fromkeys(whole)), True, len(name))


def pattern_rule(verdict: str, literal: str) -> Rule:
    """Fits a host with ``literal`` (words joined by -) as a whole label or the end or start of one."""
    return Rule(literal, verdict, r"^(?:[^/?#]*[.\-])?" + _quote(literal) + r"(?:[.\-][^/?#]*)?(?:/|$)", tuple(literal.split("-")), False, len(literal))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The fixed rules of the query's contract: verdict, host, path.
BASE_RULES = [
    prefix_rule("block", "com", "/en/"),
    prefix_rule("allow", "example.com", "/en/7"),
    prefix_rule("allow", "net", "/de/"),
    prefix_rule("block", "example.net", "/de/8"),
    prefix_rule("block", "org", "/es/"),
]
#: Block list of the method: host labels of advertising, spam and gambling.
LABEL_RULES = [pattern_rule("block", x) for x in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets", "click-bait", "fake-news", "buy-followers", "malware-site")]


#: Rules up to which their index is broadcast (about 200 bytes each); beyond it the join shuffles.
BROADCAST_RULES = 200_000
_FIELDS = ["rule", "verdict", "pattern", "tokens", "base", "strength"]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows; made by the JVM alone."""
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens"), F.lit(r.base).alias("base"), F.lit(r.strength).alias("strength")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of text files in the common syntax of host filters: ``||host/path`` blocks, ``@@||host/path`` allows, ``!`` opens a comment.

    A rule fits its host and all subdomains where the path starts with the rule's; a
    closing ``^`` after the host is any path.  Lines of other kinds are left out.
    """
    line = F.trim("value")
    lines = spark.read.text(path).select(line.alias("line")).where(line.rlike(r"^(@@)?\|\|[A-Za-z0-9.\-]+(/[^*^|$]*|\^)?$"))
    text = F.regexp_replace(F.regexp_replace("line", r"^(@@)?\|\|", ""), r"\^$", "")
    host = F.lower(F.regexp_extract(text, r"^([^/]+)", 1))
    rest = F.regexp_extract(text, r"^[^/]+(.*)$", 1)
    quoted = lambda c: F.regexp_replace(c, "([^A-Za-z0-9/])", r"\\$1")
    rows = lines.select(F.when(F.col("line").startswith("@@"), "allow").otherwise("block").alias("verdict"), host.alias("host"), rest.alias("rest")).distinct()
    whole = F.filter(F.split("host", "[^a-z0-9]+"), lambda t: t != "")
    inner = F.expr(r"regexp_extract_all(rest, '[/.\\-_]([a-z0-9]+)(?=[/.\\-_])', 1)")
    end = F.when(F.col("rest") == "", F.lit(r"(?:[/?#]|$)")).otherwise("")
    return rows.select(
        F.concat("host", "rest").alias("rule"), "verdict", F.concat(F.lit(r"^(?:[^/?#]*\.)?"), quoted(F.col("host")), quoted(F.col("rest")), end).alias("pattern"),
        F.array_distinct(F.concat(whole, inner)).alias("tokens"), F.lit(True).alias("base"), F.length(F.concat("host", "rest")).alias("strength"),
    )


def url_verdicts(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the longest fitting base rule and the verdict.

    ``rules``: a list, or a table of rule, verdict, pattern, tokens, base, strength
    (see ``read_rules``) of any size.  Each rule is filed under the one of its tokens
    that fewest distinct URLs of this table have (ties: the lexically least).  Distinct
    URLs are cut into tokens; only tokens that are some rule's go on, and are kept;
    they fetch rules by a join and only these run their expression.  Base rules go
    before the method's patterns; among each the longest name wins, then the
    lexically least.

    A null URL, or one without ``://``, has an empty host and path and gets the
    default; a URL may be of any length.  Repeated pages each give a row.  A rule
    without a whole token is an error, since nothing could fetch it.
    """
    spark = pages.sparkSession
    listed = (rules if isinstance(rules, DataFrame) else rule_table(spark, rules)).select(*_FIELDS)
    if not listed.where("size(tokens) = 0").isEmpty():
        raise ValueError("every rule needs a literal token between separators")
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER)
    parsed = (
        pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
        .withColumn("rest", rest)
        .select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        .withColumn("target", F.concat("host", "path"))
    )
    targets = parsed.where("target <> ''").select("target").distinct()
    by_token = listed.withColumn("token", F.explode("tokens"))
    tokens = cut(by_token.select("token").distinct())
    few = listed.count() <= BROADCAST_RULES
    words = targets.select("target", F.explode(F.array_distinct(F.split("target", "[^A-Za-z0-9]+"))).alias("token"))
    hit = cut(words.join(F.broadcast(tokens) if few else tokens, "token", "left_semi"))
    counts = hit.groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    index = by_token.join(counts, "token", "left").groupBy("rule", "verdict", "pattern", "base", "strength").agg(rarest)
    # greatest first: base, longest, then the lexically least name (as the least of a struct)
    rank = F.struct((~F.col("base")).alias("later"), (-F.col("strength")).alias("shorter"), "rule", "verdict", "base")
    best = hit.join(F.broadcast(index) if few else index, "token").where(F.expr("target rlike pattern")).groupBy("target").agg(F.min(rank).alias("best"), F.count("*").alias("n_fitting"))
    return parsed.join(best, "target", "left").select(
        "page_id", "host", "path",
        F.when(F.col("best.base"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.base"), F.col("best.rule")).alias("pattern"),
    )


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), BASE_RULES + LABEL_RULES)


def _oracle() -> str:
    values = ",\n    ".join(f"('{r.name}', '{r.verdict}', '{r.pattern}', {r.base}, {r.strength})" for r in BASE_RULES + LABEL_RULES)
    return f"""
WITH rules(rule, verdict, pattern, base, strength) AS (VALUES
    {values}),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
t AS (SELECT DISTINCT host || path AS target FROM q),
b AS (SELECT target, rule, verdict, base, row_number() OVER (PARTITION BY target ORDER BY base DESC, strength DESC, rule) AS k
      FROM t JOIN rules ON target <> '' AND regexp_matches(target, pattern))
SELECT page_id, host, path, CASE WHEN base THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict, CASE WHEN NOT base THEN rule END AS pattern
FROM q LEFT JOIN b ON b.target = host || path AND k = 1"""


QUERIES = {"op10_url_rules": op10_url_rules}
ORACLES = {"op10_url_rules": _oracle()}
