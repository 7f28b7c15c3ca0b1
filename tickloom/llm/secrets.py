"""Secret scans: listed patterns, and a battery of randomness tests with control of false discoveries (DataFrame functions only)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ["assign", "access", "hex", "random"]
# The fixed patterns of the contract.  A short run of hex digits has no longer one inside,
# so its length stands in the pattern; a short assignment may hide the start of another, so its does not.
ASSIGN, ASSIGN_LEAST = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

#: Runs that are tested have so many characters; runs of LONG_WORDS characters show what ordinary text is like.
LEAST_CHARS, LONG_WORDS = 16, (8, 15)
_CLASS = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_CLASS}])[{_CLASS}]{{{LEAST_CHARS},}}={{0,2}}"
_ORDINARY = rf"(?<![{_CLASS}])[{_CLASS}]{{{LONG_WORDS[0]},{LONG_WORDS[1]}}}(?![{_CLASS}])"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, smallest alphabet first: name, alphabet in order of value.  A run is in the first that has all its characters; digits alone are a number.
ENCODINGS = [
    ("hex", _DIGITS + "abcdef"), ("upper hex", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"), ("lower base36", _DIGITS + _LOWER), ("upper base36", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: A run that randomness would give less often than this is not random; share of false ones among those found, by band of length.
REJECTED, FALSE_SHARE = 0.001, 0.01
#: Least lengths of the bands.
BANDS = [16, 24, 32, 48, 64, 96, 128]
#: Steps of a p-value: so many to a power of ten, always rounded up.
STEPS = 20


def _placed(found: Column, gaps: Column) -> Column:
    """Start and end in code points of matches, from them and the text between them."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("out"))

    def step(acc, x):
        end = acc["at"] + x["g"] + x["m"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(lengths, begin, step, lambda acc: acc["out"])


def _spans(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds the matches of ``pattern`` in ``text`` and their spans; the text is cut a second time only where something matches."""
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    found = df.withColumn(f"{name}_text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return found.withColumn(name, F.when(F.size(f"{name}_text") > 0, _placed(F.col(f"{name}_text"), F.split("text", pattern, -1))).otherwise(none))


def _only(spans: str, good: Column) -> Column:
    """The spans whose place in ``good`` (an array of flags) is true."""
    return F.transform(F.filter(F.arrays_zip(F.col(spans).alias("s"), good.alias("good")), lambda z: z["good"]), lambda z: z["s"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id``, spans of the listed patterns, and the runs to be tested, a row for each document; written once, without the texts."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("runs", CANDIDATE)):
        rows = _spans(rows, name, pattern)
    values = F.when(F.size("assign_text") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).otherwise(F.expr("CAST(array() AS array<string>)"))
    rows = rows.withColumn("values", values)
    long_enough = F.transform("values", lambda v: F.length(v) >= ASSIGN_LEAST)
    runs = F.zip_with("runs", "runs_text", lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("text")))
    return cut(rows.select("row", "doc_id", _only("assign", long_enough).alias("assign"), "access", "hex", runs.alias("runs")))


def ordinary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``encoding, size, second, third``: for each alphabet the sums of squares and cubes of its characters' shares in the long words of all texts.

    Every character counts half a time more, so a table without text has even shares.
    """
    words = docs.select(F.array_join(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(_ORDINARY), F.lit(0)), "").alias("w")).where("w <> ''")
    met = words.select(F.explode(F.split("w", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    listed = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("encoding"), F.lit(a).alias("alphabet")) for i, (_, a) in enumerate(ENCODINGS)])))
    # some sixty characters in eleven alphabets
    signs = listed.select("encoding", F.explode(F.split("alphabet", "")).alias("c")).join(F.broadcast(met), "c", "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(0.5))
    sums = signs.groupBy("encoding").agg(F.count("*").alias("size"), F.sum("n").alias("s1"), F.sum(F.col("n") ** 2).alias("s2"), F.sum(F.col("n") ** 3).alias("s3"))
    return sums.select("encoding", "size", (F.col("s2") / F.col("s1") ** 2).alias("second"), (F.col("s3") / F.col("s1") ** 3).alias("third"))


def lower_tail(z: Column) -> Column:
    """Chance of a standard normal below ``z``; relative error about 1e-7 in the tail (Chebyshev fit of erfc)."""
    # fixed values of the published fit
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    tail = t * F.exp(-x * x + functools.reduce(lambda total, c: total * t + c, reversed(fit[:-1]), F.lit(fit[-1]))) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def _cube_root_z(x: Column, mean: Column, variance: Column) -> Column:
    """How many deviations a chi-squared-like ``x`` is from its mean, by the cube root, which is nearly normal."""
    shape = 9 * mean * mean / variance
    return (F.cbrt(x / mean) - 1 + 1 / shape) * F.sqrt(shape)


def tested(runs: DataFrame, usual: DataFrame) -> DataFrame:
    """``runs`` (with ``text``) with the battery's results.

    ``encoding`` (-1: none), ``length`` without padding, ``p_uniform, p_runs, p_serial``
    (two-sided, of chance alone), ``p_random`` (their least, times three), ``p_ordinary``
    (that ordinary text of the length is as even; 1 for a run that is not random) and ``band``.

    Uniformity: chi-squared of the alphabet, whose exact mean and variance are known for
    any shares of the characters, so for chance and for ordinary text (``ordinary``).
    Runs: those of the alphabet's lower and upper half.  Serial correlation: of the
    characters' values, the last one followed by the first.
    """
    core = F.regexp_replace("text", "=+$", "")
    fits = F.lit(-1)
    for i, (name, alphabet) in reversed(list(enumerate(ENCODINGS))):
        only = F.translate("core", alphabet, "") == ""
        # hex needs letters and digits: words of a to f are words
        fits = F.when(only & F.col("core").rlike("[0-9]") if "hex" in name else only, i).otherwise(fits)
    rows = runs.withColumn("core", core).withColumn("encoding", F.when(F.col("core").rlike("^[0-9]*$"), -1).otherwise(fits)).withColumn("length", F.length("core"))
    rows = rows.join(F.broadcast(usual), "encoding", "left")  # a row for each encoding
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    halves = F.array(*[F.lit("0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for _, a in ENCODINGS])
    at = F.greatest("encoding", F.lit(0))
    rows = rows.withColumn("alphabet", F.get(alphabets, at)).withColumns({"signs": F.split("core", ""), "bits": F.call_function("translate", F.col("core"), F.col("alphabet"), F.get(halves, at))})
    rows = rows.withColumn("v", F.transform("signs", lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double")))
    whole = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    turned = F.concat(F.slice("v", F.lit(2), F.col("length")), F.slice("v", 1, 1))
    counts = F.transform(F.array_distinct("signs"), lambda c: (F.col("length") - F.length(F.replace(F.col("core"), c, F.lit("")))).cast("double"))
    rows = rows.withColumns(
        {
            "squares": F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c),
            "ones": F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("double"),
            "changes": F.length(F.regexp_replace("bits", "0+|1+", "x")).cast("double"),
            "sum": whole(F.col("v")), "square": whole(F.transform("v", lambda x: x * x)), "cross": whole(F.zip_with("v", turned, lambda a, b: a * b)),
        }
    )
    n, k = F.col("length").cast("double"), F.col("size").cast("double")
    two_sided = lambda z: 2 * lower_tail(-F.abs(z))

    def moments(second: Column, third: Column) -> tuple[Column, Column]:
        """Mean and variance of chi-squared against even shares, if the shares' squares and cubes have these sums."""
        mean = k * ((n - 1) * second + 1) - n
        return mean, F.greatest(2 * (n - 1) * k * k / n * (second + 2 * (n - 2) * third - (2 * n - 3) * second * second), F.lit(1e-9))

    chi = k * F.col("squares") / n - n
    even = moments(1 / k, 1 / (k * k))
    usual_mean, usual_variance = moments(F.col("second"), F.col("third"))
    zeros = n - F.col("ones")
    expected = 2 * F.col("ones") * zeros / n
    runs_z = (F.col("changes") - expected - 1) / F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9)))
    serial = F.try_divide(F.col("cross") - F.col("sum") * F.col("sum") / n, F.col("square") - F.col("sum") * F.col("sum") / n)
    serial_z = (serial + 1 / (n - 1)) / F.sqrt(n * (n - 3) / ((n + 1) * (n - 1) * (n - 1)))
    rows = rows.withColumns(
        {
            "p_uniform": two_sided(_cube_root_z(chi, *even)),
            "p_runs": F.when((F.col("ones") == 0) | (zeros == 0), 0.0).otherwise(two_sided(runs_z)),
            "p_serial": F.coalesce(two_sided(serial_z), F.lit(0.0)),
            "as_even": lower_tail(_cube_root_z(chi, usual_mean, usual_variance)),
        }
    )
    rows = rows.withColumn("p_random", F.when(F.col("encoding") >= 0, F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial"))).otherwise(0.0))
    band = sum((F.when(F.col("length") >= b, 1).otherwise(0) for b in BANDS), F.lit(-1))
    return rows.withColumn("p_ordinary", F.when(F.col("p_random") >= REJECTED, F.greatest("as_even", F.lit(1e-300))).otherwise(1.0)).withColumn("band", band).select(*runs.columns, "encoding", "length", "p_uniform", "p_runs", "p_serial", "p_random", "p_ordinary", "band")


def _level(p: Column) -> Column:
    return F.floor(-F.log10(p) * STEPS).cast("int")


def discoveries(results: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """``band, level``: the least level (-log10 p in STEPS) that is a discovery, by Benjamini and Hochberg's rule over the different texts of each band.

    p-values are rounded up to a level first, so a band is a short table of counts.
    """
    distinct = results.select("band", _level(F.col("p_ordinary")).alias("level"), "text").distinct()
    counts = distinct.groupBy("band", "level").agg(F.count("*").alias("n"))
    down = Window.partitionBy("band").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"found": F.sum("n").over(down), "all": F.sum("n").over(Window.partitionBy("band"))})
    return ranked.where(F.pow(F.lit(10.0), -F.col("level") / STEPS) <= share * F.col("found") / F.col("all")).groupBy("band").agg(F.min("level").alias("level"))


def _listed(spans: Column) -> Column:
    """kind:start:end of (start, kind, end), in order, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """A row for each document: ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``.

    The listed patterns give the base spans, in code points.  The method adds spans of
    kind ``random``: runs of LEAST_CHARS or more characters of a base64 alphabet that no
    base span touches, that pass every test of randomness in the smallest encoding that
    holds them (see ``tested``), and that ordinary text of their length would so
    rarely be like that, of all different runs of their band of length, about ``share``
    of those found are false (see ``discoveries``).  So short runs, which say little, are
    found only among few others.  What ordinary text is like is counted over all texts.

    A null or empty text has no span; texts and runs may be of any length; repeated rows
    and ids each give a row; an empty table gives none.  Numbers are never random.
    """
    rows = scanned(docs, id_col, text_col)

    def of_kind(i: int) -> Column:
        return F.transform(KINDS[i], lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    base = F.concat(*map(of_kind, range(3)))
    found = rows.select("row", "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), base.alias("base"))
    runs = rows.where(F.size("runs") > 0).select("row", base.alias("base"), F.explode("runs").alias("r")).select("row", "base", "r.*")
    free = runs.where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))).drop("base")
    results = cut(tested(free, ordinary(docs, text_col)))
    least = discoveries(results, share)  # a row a band
    random = results.withColumn("own", _level(F.col("p_ordinary"))).join(F.broadcast(least), "band").where(F.col("own") >= F.col("level"))
    added = random.groupBy("row").agg(F.collect_list(F.struct(F.col("start").alias("start"), F.lit(len(KINDS) - 1).alias("kind"), F.col("end").alias("end"))).alias("added"))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    both = found.join(added, "row", "left").withColumn("added", F.coalesce("added", none))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", F.size("added").cast("long").alias("n_random"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))


def op12_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return secrets(table(spark, sf_dir, "documents"))


def base_secrets_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the query above that SQL can express."""
    return secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _oracle() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ["password", "passwd", "secret", "token", "api_?key"]))
    assign = rf"""(?:{names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, f"length(v[k]) >= {ASSIGN_LEAST}", 1), ("access", "AKIA[A-Z0-9]+", "length(f[k]) >= 20", 0), ("hex", "[0-9a-f]+", "length(f[k]) >= 24", 0)]
    spans = "\nUNION ALL ".join(
        f"SELECT row_id, {i} AS kind, '{name}' AS name, a AS start, a + length(f[k]) AS stop FROM (SELECT *, CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a"
        f" FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM (SELECT row_id, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{guard}')))) WHERE {good}"
        for i, (name, pattern, good, group) in enumerate(kinds)
        for guard in [{"access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}.get(name, names)]
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({spans}),
b AS (SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM s GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN b USING (row_id)"""


QUERIES = {"op12_randomness_secrets": op12_randomness_secrets, "base_secrets_of_documents": base_secrets_of_documents}
ORACLES = {"base_secrets_of_documents": _oracle()}
