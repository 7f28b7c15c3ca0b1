"""Exact and near-duplicate lines: segment-partition edit join (DataFrame functions only)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, id_text, kept, settled, table

#: Edits allowed between near-duplicate lines.
THRESHOLD = 2
#: Shorter lines are never touched; at 1 every line with a word is looked at.
MIN_CHARS = 1
#: Shorter lines are only compared for equality: two edits change much of a short line.  It works from threshold + 1 on.
NEAR_MIN_CHARS = 24
#: A segment that so many times as many pairs of lines share as there are lines with it is split by a second segment.
HOT = 64
#: Times that segments are split again, at most; what is hot after that is paired all the same.
SPLITS = 4
#: Lines of up to so many characters are tied by what is left of them without one character, where they meet in crowds.
TIED_CHARS = 256
#: Rows up to which a table of keys is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a word and ``min_chars`` code points.  ``version`` tells rows of one id and other texts apart."""
    return (
        docs.withColumn("version", F.xxhash64("text"))
        .select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .withColumn("chars", F.char_length("line"))
        .where((F.col("chars") >= min_chars) & (F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != ""))
        .withColumn("line_id", F.unhex(F.md5("line")))
    )


def _place() -> Column:
    return F.struct("doc_id", "version", "line_no")


def look_ups(threshold: int) -> list[tuple[int, int, int]]:
    """(gap, i, shift): where a line looks for the i-th segment of lines that are ``gap`` characters shorter.

    A line of length L is filed under its threshold + 1 even segments, (0, i, 0).  A
    line of length l looks, for each L in [l - threshold, l] and each segment, at
    the substrings that can match if edits before it and after it are counted
    (multi-match-aware selection): starts within i - 1 of the segment's start seen
    from the left, and within threshold + 1 - i of it seen from the right.
    """
    pieces = threshold + 1
    return [(gap, i, shift) for gap in range(pieces) for i in range(1, pieces + 1) for shift in range(max(1 - i, gap - (pieces - i)), min(i - 1, gap + (pieces - i)) + 1)]


def _placed(lines: DataFrame, where: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """``lines`` (chars, line, and more), a row for each place in ``where`` that lies within a line: gap, i, length, start, size, u.

    ``u`` is the line with four bytes for each code point, so a substring of it is a
    plain copy.  The places are exploded before keys are made: one small expression
    for all of them stays within what the JVM compiles.
    """
    pieces = threshold + 1
    places = F.expr(f"array({', '.join(f'struct({g} as gap, {i} as i, {s} as shift)' for g, i, s in where)})")
    at = lines.withColumn("u", F.expr("encode(line, 'UTF-32')")).select("*", F.explode(places).alias("k")).select(*lines.columns, "u", "k.gap", "k.i", "k.shift")
    for name, value in (
        ("length", "chars - gap"),
        ("short", f"cast(length div {pieces} as int)"),
        ("even", f"{pieces} - (length - {pieces} * short)"),  # so many segments are short ones
        ("size", "short + if(i > even, 1, 0)"),
        ("start", "(i - 1) * short + greatest(0, i - 1 - even) + shift"),
    ):
        at = at.withColumn(name, F.expr(value))
    return at.where("start >= 0 and start + size <= chars")


_SEGMENT = "i, length, substring(u, 4 * start + 1, 4 * size)"


def segment_rows(lines: DataFrame, where: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """``h, gap, key`` for each line (h, chars, line) and each place in ``where`` that lies within it."""
    return _placed(lines.select("h", "chars", "line"), where, threshold).select("h", "gap", F.expr(f"xxhash64({_SEGMENT})").alias("key"))


def _keyed(lines: DataFrame, threshold: int) -> DataFrame:
    """``lines`` with ``key``: once for each segment that they are filed under (``own``), and once for the line itself, whose key is the complement of ``h``."""
    own = [(0, i, 0) for i in range(1, threshold + 2)]
    filed = _placed(lines.withColumn("own", F.lit(True)), [*own, (-1, 1, 0)], threshold)
    key = F.when(F.col("gap") < 0, F.expr("~h")).otherwise(F.expr(f"xxhash64({_SEGMENT})"))
    return filed.withColumn("key", key).withColumn("own", F.col("gap") >= 0).select(*lines.columns, "key", "own")


#: Characters whose counts tell lines apart before they are compared.
COUNTED = " etnaorhisdlucmp"


def counts(line: str) -> str:
    """SQL: the counts of COUNTED in a line, four bits each (modulo 16), in one integer."""
    return " | ".join(f"shiftleft(cast(octet_length({line}) - octet_length(replace({line}, '{c}', '')) as bigint) & 15L, {4 * k})" for k, c in enumerate(COUNTED))


def counts_differ(a: str, b: str) -> str:
    """SQL: by how much two such integers differ in sum, at least; an edit makes two at most."""
    gap = "(((shiftrightunsigned({a}, {k}) & 15L) - (shiftrightunsigned({b}, {k}) & 15L)) & 15L)"
    return " + ".join("least({g}, 16L - {g})".format(g=gap.format(a=a, b=b, k=4 * k)) for k in range(len(COUNTED)))


def trim_common(a: str, b: str, ua: str, ub: str) -> str:
    """SQL: struct(x, y) of two lines without their common head and tail.

    ``ua`` and ``ub`` are the lines with four bytes for each code point; the lengths
    of head and tail are found on them by binary lifting.
    """

    def common(least: str, at_p: str, at_q: str) -> str:
        steps = f"transform(sequence(cast(ceil(log2({least} + 1)) as int), 0, -1), e -> shiftleft(1, e))"
        return f"aggregate({steps}, 0, (n, s) -> if(n + s <= {least} and {at_p} = {at_q}, n + s, n))"

    whole = f"least(octet_length({ua}), octet_length({ub})) div 4"
    head = common(whole, f"substring({ua}, 4 * n + 1, 4 * s)", f"substring({ub}, 4 * n + 1, 4 * s)")
    back = "substring({p}, octet_length({p}) - 4 * (n + s) + 1, 4 * s)"
    tail = common(f"({whole} - h)", back.format(p=ua), back.format(p=ub))
    rest = "substring({p}, h + 1, cast(octet_length({u}) div 4 as int) - h - k)"
    return f"transform(array(cast({head} as int)), h -> transform(array(cast({tail} as int)), k -> struct({rest.format(p=a, u=ua)} as x, {rest.format(p=b, u=ub)} as y))[0])[0]"


def may_be_near(x: str, y: str, threshold: int) -> str:
    """SQL: False only if the trimmed strings are more than ``threshold`` edits apart.

    Both ends differ, so one edit stands at or before the first character and
    another at or after the last, unless a single one is all.  At most threshold -
    2 are left for what lies between, so of threshold - 1 pieces of it one is whole.
    """
    tiny = f"char_length({x}) <= {max(threshold, 2)}"
    near = f"abs(char_length({x}) - char_length({y})) <= {threshold}"
    if threshold < 2:
        return f"({near} and char_length({x}) <= 1 and char_length({y}) <= 1)"
    pieces = threshold - 1
    size = f"((char_length({x}) - 2) div {pieces})"
    found = " or ".join(f"instr({y}, substring({x}, cast(2 + {k} * {size} as int), cast({size} as int))) > 0" for k in range(pieces))
    return f"({near} and ({tiny} or {found}))"


def banded_distance(x: str, y: str, threshold: int) -> str:
    """SQL: edit distance of two strings if at most ``threshold``, else something greater.

    Bit-parallel, in a band of 2 * threshold + 1 diagonals held in one 64-bit
    integer.  Bit k of column j stands for row j - threshold + k.  vp and vn tell
    where the distance rises and falls down a column; the distance itself is
    followed along the band's lower edge until it meets the last row, and then
    along that row.  A pair that can no longer get back is left alone.
    """
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    match = " + ".join(f"if(coalesce(get(m.xs, s.j - {t} + {k}), '') = c and s.j - {t} + {k} >= 0, {1 << k}L, 0L)" for k in range(width))
    d0 = f"((((p.pm & s.vp) + s.vp) ^ s.vp) | p.pm | s.vn) & {full}L"
    step = f"""transform(transform(array(struct({match} as pm)), p -> struct({d0} as d0)), q ->
        transform(array(struct((s.vn | ~(q.d0 | s.vp)) & {full}L as hp, q.d0 & s.vp as hn)), r -> struct(
            (r.hn | ~(shiftright(q.d0, 1) | r.hp)) & {full}L as vp,
            shiftright(q.d0, 1) & r.hp as vn,
            s.d + if(s.j + 1 <= m.n - {t},
                if((q.d0 & {1 << 2 * t}L) = 0, 1, 0),
                cast((shiftright(r.hp, cast(m.n - s.j - 1 + {t} as int)) & 1L) - (shiftright(r.hn, cast(m.n - s.j - 1 + {t} as int)) & 1L) as int)) as d,
            s.j + 1 as j))[0])[0]"""
    start = f"named_struct('vp', {full - ((1 << t) - 1)}L, 'vn', 0L, 'd', cast(least(m.n, {t}) as int), 'j', 0)"
    walk = f"aggregate(m.ys, {start}, (s, c) -> if(s.d > {2 * t} + size(m.ys) - m.n, s, {step}), s -> s.d)"
    chars = "if({0} = '', cast(array() as array<string>), split({0}, ''))"
    whole = f"transform(array(struct({chars.format(x)} as xs, {chars.format(y)} as ys, char_length({x}) as n)), m -> {walk})[0]"
    return f"if(abs(char_length({x}) - char_length({y})) > {t}, {t + 1}, {whole})"


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if it has few rows (``rows``, if they are counted already); else as it is, and the join shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def sure_links(lines: DataFrame) -> DataFrame:
    """``ha, hb``: links that tie together all ``lines`` (h, chars, line) that are equal but for one character, left out or changed.

    Two lines that are the same without one character of each are two edits apart at
    most, so nothing is compared: each is filed under itself and under what is left
    without each of its characters, by two hashes, and all lines of one entry are tied
    to the least of them.  So rows grow with characters, whatever the number of
    lines that are alike: a million numbered lines of one wording are one star.
    """
    at = lines.where(f"chars <= {TIED_CHARS}").withColumn("u", F.expr("encode(line, 'UTF-32')")).select("h", "u", F.explode(F.expr("sequence(0, chars)")).alias("p"))
    left = F.expr("if(p = 0, u, concat(substring(u, 1, 4 * (p - 1)), substring(u, 4 * p + 1)))")
    filed = at.select("h", left.alias("v")).select("h", F.xxhash64("v").alias("v"), F.xxhash64(F.lit(1), "v").alias("w"))
    least = filed.groupBy("v", "w").agg(F.min("h").alias("hub"), F.max("h").alias("last")).where("hub <> last").select("v", "w", "hub")
    return filed.join(least, ["v", "w"]).where("h <> hub").select(F.col("h").alias("ha"), F.col("hub").alias("hb")).distinct()


def _meetings(live: DataFrame, held: DataFrame, lines: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``ha, hb`` of lines that meet in a segment and are to be compared, without pairing all that share a common one; and links that need no comparison (None, if there are none).

    ``live`` (key, gap, ha) and ``held`` (key, hb) meet by key; ``lines`` are h, chars,
    line and c, the counts of letters.  Where far more pairs than lines would meet,
    lines are tied by ``sure_links`` first.  Of the lines of a key that are tied to each other
    already, its main body, none is paired with another: only those outside it are paired
    with all.  Where these are still too many, the lines without that segment are again
    within the threshold of each other: the rests are filed and looked up by segments of
    their own, under the key and the segment.  So a segment shared by a million lines that
    have nothing else in common makes no pairs.  Rests of no more characters than the
    threshold are all near each other: each is tied to the least one of the other side.
    Keys of all turns are hashes, so all that meets waits for one join at the end.
    """
    places = look_ups(threshold)
    filed = [p for p in places if p[0] == 0 and p[2] == 0]
    lookers: list[DataFrame] = []
    holders: list[DataFrame] = []
    tiny: list[DataFrame] = []
    mains: list[DataFrame] = []
    live, held = live.select("key", "gap", "ha"), held.select("key", "hb")
    many = f"a > 0 and b > 0 and a * b > {HOT} * (a + b)"

    def sides(l: DataFrame, r: DataFrame, *more: str) -> DataFrame:
        """Rows of both sides, 1 in ``x`` for those that look, in ``y`` for those that are met."""
        return l.select("key", *more, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(r.select("key", *more, F.lit(0), F.lit(1)))

    first = kept(sides(live, held).groupBy("key").agg(F.sum("x").alias("a"), F.sum("y").alias("b")).where(many).select("key"), "crowds")
    n = first.count()
    about, sure, roots = lines.select("h", "c"), None, None
    if n:
        first = _small(first, n)
        crowd_live, crowd_held = live.join(first, "key", "left_semi"), held.join(first, "key", "left_semi")
        if threshold >= 2:
            crowd = crowd_live.select(F.col("ha").alias("h")).unionAll(crowd_held.select(F.col("hb").alias("h"))).distinct()
            sure = kept(sure_links(lines.join(crowd, "h", "left_semi").select("h", "chars", "line")), "ties")
            roots = _small(kept(connected_components(sure, "ha", "hb").select(F.col("node").alias("h"), "root"), "roots"))

    def rooted(side: DataFrame, name: str) -> DataFrame:
        """With the root of each line, itself where it is tied to none."""
        own = F.col(name)
        return side.join(roots.withColumnRenamed("h", name), name, "left").withColumn("root", F.coalesce("root", own)) if roots is not None else side.withColumn("root", own)

    def bodies(l: DataFrame, r: DataFrame) -> DataFrame:
        """Of each crowded key the root that most of its lines have, and whether the lines outside it are too many to be paired with all."""
        by_root = sides(rooted(l, "ha"), rooted(r, "hb"), "root").groupBy("key", "root").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        whole = by_root.groupBy("key").agg(F.sum("x").alias("a"), F.sum("y").alias("b"), F.max(F.struct(F.col("x") + F.col("y"), F.col("root").alias("root"), "x", "y")).alias("m"))
        return kept(whole.where(many).select("key", F.col("m.root").alias("main"), F.expr(f"(a - m.x) * b + m.x * (b - m.y) > {HOT} * (a + b)").alias("hot")), "bodies")

    def rest(side: DataFrame, *more) -> DataFrame:
        """Without the segment that led to the key."""
        left = F.expr("concat(substring(line, 1, start), substring(line, start + size + 1))")
        return side.select("key", "id", *more, left.alias("line"), (F.col("chars") - F.col("size")).alias("chars")).distinct()

    if n:
        found = bodies(crowd_live, crowd_held)
        looking = filing = None
        for _ in range(SPLITS):
            hot = found.where("hot").select("key")
            n_hot = hot.count()
            if not n_hot:
                break
            hot = _small(hot, n_hot)
            mains.append(found.where("not hot").select("key", "main"))
            lookers.append(live.join(hot, "key", "left_anti"))
            holders.append(held.join(hot, "key", "left_anti"))
            if looking is None:
                text, key = lines.select(F.col("h").alias("id"), "chars", "line"), F.expr(f"xxhash64({_SEGMENT})")
                who = live.join(hot, "key", "left_semi").select("key", "gap", F.col("ha").alias("id")).distinct()
                looking = _placed(text.join(who.select("id").distinct(), "id"), places, threshold).withColumn("key", key).join(who, ["key", "gap", "id"], "left_semi")
                who = held.join(hot, "key", "left_semi").select("key", F.col("hb").alias("id")).distinct()
                filing = _placed(text.join(who.select("id").distinct(), "id"), filed, threshold).withColumn("key", key).join(who, ["key", "id"], "left_semi")
            else:
                looking, filing = looking.join(hot, "key", "left_semi"), filing.join(hot, "key", "left_semi")
            looking, filing = kept(rest(looking, F.col("gap").alias("by")), "looking"), kept(rest(filing), "filing")
            short = f"chars <= {threshold}"
            # tiny rests are near each other, so the least of each side ties them; one that is no longer tiny is compared
            tiny.append(looking.where(short).select("key", "id", F.lit(True).alias("looks")).unionAll(filing.where(short).select("key", "id", F.lit(False))))
            lookers.append(looking.where(f"not {short}").select("key", F.col("by").alias("gap"), F.col("id").alias("ha")))
            holders.append(filing.where(short).select("key", F.col("id").alias("hb")))
            key = F.expr(f"xxhash64(key, {_SEGMENT})")
            filing = _placed(filing.where(f"not {short}"), filed, threshold).withColumn("key", key).drop("u")
            looking = kept(_placed(looking.where(f"chars - by > {threshold}"), places, threshold).where("gap = by").withColumn("key", key).drop("u").join(filing.select("key").distinct(), "key", "left_semi"), "looking")
            live, held = looking.select("key", "gap", F.col("id").alias("ha")).distinct(), filing.select("key", F.col("id").alias("hb")).distinct()
            found = bodies(live, held)
        mains.append(found.select("key", "main"))  # what is hot still is paired all the same, but for those of one body
    lookers.append(live)
    holders.append(held)
    asking = functools.reduce(DataFrame.unionByName, lookers).join(about.toDF("ha", "ca"), "ha")
    asked = functools.reduce(DataFrame.unionByName, holders).join(about.toDF("hb", "cb"), "hb")
    on = ["key"]
    if n:
        # of a crowded key those inside its body ask in a class of their own, where those outside it alone are filed too
        main = _small(kept(functools.reduce(DataFrame.unionByName, mains), "mains"))
        inside = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
        # each written by itself: in one plan the driver would build the broadcasts of all turns at a time
        asking = kept(rooted(asking, "ha").join(main, "key", "left").withColumn("class", inside.cast("int")).drop("root", "main"), "asking")
        both = F.when(F.col("main").isNull() | inside, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        asked = kept(rooted(asked, "hb").join(main, "key", "left").withColumn("class", F.explode(both)).drop("root", "main"), "asked")
        on = ["key", "class"]
    pairs = asking.join(asked, on).where(f"{_OTHER} and {counts_differ('ca', 'cb')} <= {2 * threshold}").select("ha", "hb")
    if tiny:
        ends_of = functools.reduce(DataFrame.unionAll, tiny)
        ends = ends_of.groupBy("key").agg(F.min(F.when(F.col("looks"), F.col("id"))).alias("ha"), F.min(F.when(~F.col("looks"), F.col("id"))).alias("hb")).where("ha is not null and hb is not null")
        tied = ends_of.join(ends, "key").select(F.when(F.col("looks"), F.col("id")).otherwise(F.col("ha")).alias("ha"), F.when(F.col("looks"), F.col("hb")).otherwise(F.col("id")).alias("hb"))
        pairs = pairs.unionAll(tied.where("ha <> hb"))
    return kept(pairs.distinct(), "meetings") if n else pairs.distinct(), sure


#: Of two lines of one length it is enough that one looks for the other.
_OTHER = "ha <> hb and (gap > 0 or ha < hb)"


def edit_links(lines: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links ``a, b`` between ids of different lines within ``threshold`` edits, the lines looked at).

    ``lines``: one row for each distinct line of more than ``threshold`` characters
    (line_id, line, chars, and more).  A pair within the threshold always shares a
    segment, so none is missed; of lines that all are near each other links are
    given that tie them together.  First,
    with hashes alone, look-ups that meet another line's segment are kept: at most
    one row each, however many lines share it.  The lines that these are about, few
    of all, are then fetched; they are paired where their segments meet (see
    ``_meetings``) and their counts of letters allow it, and compared.
    """
    lines = lines.where(f"chars > {threshold}").withColumn("h", F.xxhash64("line"))
    places = look_ups(threshold)
    own = [p for p in places if p[0] == 0 and p[2] == 0]
    filed = segment_rows(lines, own, threshold).select("key", F.col("h").alias("hb"))
    looked = segment_rows(lines, places, threshold).select("key", "gap", F.col("h").alias("ha"))
    live = kept(looked.alias("x").join(filed.alias("y"), (F.col("x.key") == F.col("y.key")) & F.expr(_OTHER), "left_semi"), "live")
    keys = kept(live.select("key").distinct(), "keys")
    asks = live.select(F.col("ha").alias("h")).distinct()
    # the lines that look and those that are met, with their texts
    if keys.count() <= BROADCAST_ROWS:
        # in one pass: a line stands once for itself and once for each of its segments
        wanted = F.broadcast(keys.unionAll(asks.select(F.expr("~h").alias("key"))))
        met = kept(_keyed(lines, threshold).join(wanted, "key"), "met")
        held = met.where("own").select("key", F.col("h").alias("hb"))
        texts = kept(met.drop("key", "own").dropDuplicates(["h"]), "texts")
    else:
        held = kept(filed.join(keys, "key"), "held")
        wanted = kept(asks.unionAll(held.select(F.col("hb").alias("h"))).distinct(), "wanted")
        texts = kept(lines.join(wanted, "h"), "texts")
    known = texts.select("h", "chars", "line", F.expr(counts("line")).alias("c"))
    pairs, sure = _meetings(live, held, known, threshold)
    found = texts.select("h", "line_id", "line")
    both = pairs.join(found.toDF("ha", "a", "line_a"), "ha").join(found.toDF("hb", "b", "line_b"), "hb")
    wide = both.withColumn("ua", F.expr("encode(line_a, 'UTF-32')")).withColumn("ub", F.expr("encode(line_b, 'UTF-32')"))
    trimmed = wide.select("a", "b", F.expr(trim_common("line_a", "line_b", "ua", "ub")).alias("t")).where(may_be_near("t.x", "t.y", threshold))
    links = trimmed.where(f"{banded_distance('t.x', 't.y', threshold)} <= {threshold}").select("a", "b")
    if sure is not None:
        names = texts.select("h", "line_id")
        links = links.unionAll(sure.join(names.toDF("ha", "a"), "ha").join(names.toDF("hb", "b"), "hb").select("a", "b"))
    return links, texts


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_min_chars: int = NEAR_MIN_CHARS) -> DataFrame:
    """``doc_id, version, exact, near``: the numbers of each document's lines that go.

    A line goes if an equal one, or one of its class of near-equal lines, stands
    earlier (by id, then line).  Classes are the components of lines linked by at
    most ``threshold`` edits.
    """
    lines = _lines(docs, min_chars)
    # where each line stands, without its text: met again at the end, so it is kept
    stands = cut(lines.select("line_id", "doc_id", "version", "line_no"))
    repeated = kept(stands.groupBy("line_id").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").select("line_id", "first"), "repeated")
    near = lines.where(F.col("chars") >= near_min_chars).withColumn("place", _place())
    # rows that repeat an id and a text stand at the same place, so a line may still come twice
    few = repeated.count() <= BROADCAST_ROWS
    distinct = near.join(F.broadcast(repeated) if few else repeated, "line_id", "left").where("first is null or first = place").select("line_id", "line", "chars", "place")
    if not few:  # the lines were shuffled: once is enough
        distinct = cut(distinct)
    links, texts = edit_links(distinct, threshold)
    members = connected_components(links)
    classes = members.join(texts.select(F.col("line_id").alias("node"), "place"), "node")
    leaders = classes.groupBy("root").agg(F.min("place").alias("leader"))
    near_first = classes.join(leaders, "root").groupBy(F.col("node").alias("line_id")).agg(F.min("leader").alias("leader"))
    dups = kept(repeated.join(near_first, "line_id", "full").select("line_id", "first", F.coalesce("leader", "first").alias("leader")), "dups")
    found = stands.withColumn("place", _place()).join(_small(dups), "line_id").where("place <> leader")
    exact = F.col("first").isNotNull() & (F.col("place") != F.col("first"))
    return found.groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set(F.when(exact, F.col("line_no")))).alias("exact"),
        F.sort_array(F.collect_set(F.when(~exact, F.col("line_no")))).alias("near"),
    )


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_min_chars: int = NEAR_MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, version, n_lines, n_exact, n_near, text``: every document without its repeated lines.

    Lines are cut at line feeds.  Lines under ``min_chars`` code points, and those of
    white space alone, stay; those under ``near_min_chars`` only go as equals.  A null text stays null and has no lines; an empty
    text is one empty line; rows that repeat an id and text are treated alike;
    rows of one id and other texts are separate documents, ordered by a hash; null
    ids come first.  An empty table gives no rows.  Other columns are not looked
    at.
    """
    plain = id_text(docs, id_col, text_col)
    side = settled(docs.sparkSession, lambda: repeated_lines(plain, threshold, min_chars, near_min_chars), "gone")  # a row for many a document: never broadcast
    joined = plain.withColumn("version", F.xxhash64("text")).alias("d").join(side.alias("g"), F.expr("d.doc_id <=> g.doc_id and d.version = g.version"), "left")
    lines = F.split(F.col("d.text"), "\n", -1)
    none = F.array().cast("array<int>")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.version").alias("version"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("g.exact"), F.lit(0)).alias("n_exact"),
        F.coalesce(F.size("g.near"), F.lit(0)).alias("n_near"),
        F.when(F.col("g.exact").isNull(), F.col("d.text"))
        .otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.concat(F.coalesce("g.exact", none), F.coalesce("g.near", none)), i)), "\n"))
        .alias("text"),
    )


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_min_chars: int = NEAR_MIN_CHARS) -> DataFrame:
    """``docs`` with its own columns and the texts cut; a document of which no word is left goes.

    ``n_chars``, where there is one, follows the text.  Documents without repeated
    lines are as they were, null and empty texts too; rows that repeat an id and a
    text are treated alike.
    """
    plain = id_text(docs)
    side = settled(docs.sparkSession, lambda: repeated_lines(plain, threshold, min_chars, near_min_chars), "gone")  # a row for many a document: never broadcast
    names = ("__gone_id", "__gone_version", "__exact", "__near")
    joined = docs.join(side.toDF(*names), docs["doc_id"].cast("long").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__gone_version")), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(F.concat("__exact", "__near"), i)), "\n")
    cut_text = joined.withColumn("__cut", F.when(F.col("__exact").isNotNull(), left)).where(F.col("__cut").isNull() | F.col("__cut").rlike(r"[^ \t-\r]"))
    text = F.coalesce(F.col("__cut"), docs["text"])
    out = [text.alias(c) if c == "text" else F.char_length(text).cast(t).alias(c) if c == "n_chars" else docs[f"`{c}`"] for c, t in docs.dtypes]
    return cut_text.select(*out)


def op4_edit_join_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.char_length("text").alias("n_chars_left"), F.md5("text").alias("text_md5"))


QUERIES = {"op4_edit_join_line_dedup": op4_edit_join_line_dedup}
ORACLES: dict[str, str] = {}  # DuckDB's levenshtein counts bytes; tests compare with a brute-force version
