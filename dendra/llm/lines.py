"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

A line is split into threshold + 1 segments of even length. Lines within the threshold
of each other agree on a segment of the shorter one, which then stands in the longer
one within a few places of its own (the selection depends on both lengths). Segments
and the substrings that can meet them are hashed together with the length and the
segment's number. Keys that one line holds alone are dropped first; only lines that
share a key are looked at again.

A line needs one earlier line within the threshold, not all of them. So each is first
held against two earlier lines of its key (the first one and the one before it), and
only lines that these don't settle meet all earlier lines of their keys, unless letter
counts differ too much. Pairs are verified with a bit-parallel automaton on the band of
diagonals that the threshold allows. Lines are known by 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_names, partitions_for, text_of

#: Lines within so many edits are near-duplicates; shorter lines than MIN_CHARS are kept, except exact repeats where these are asked for.
THRESHOLD, MIN_CHARS = 2, 24
#: Lines are looked up by broadcast up to this many, and by a shuffled join beyond.
BROADCAST_LINES = 400_000
#: A key's lines are dealt into so many parts to find first witnesses, so that no key is one task's work.
PARTS = 64
#: Lines with more than one in so many of all occurrences are looked up by broadcast; there are no more than this of them.
HOT_LINES = 20_000
_LETTERS = "etaonisrhldcumfp"
_REPEATED = -1


def _segment(length: Column, number: int, count: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment; the longer ones come last."""
    base = F.floor(length / count).cast("int")
    short = count - length % count
    return base * number + F.greatest(F.lit(0), number - short), base + F.when(F.lit(number) >= short, 1).otherwise(0)


def keys(wide: Column, length: Column, threshold: int, least: int) -> list[Column]:
    """Hashes of the segments (first), then of the substrings that meet segments of lines up to ``threshold`` shorter; null where there is none.

    ``wide`` has four bytes for each character, so that a substring is found without a walk over the characters before it.
    """
    count = threshold + 1
    own, probes = [], []
    for shorter in range(threshold + 1):
        size = length - shorter
        for number in range(count):
            start, width = _segment(size, number, count)
            lo, hi = max(-number, shorter - (threshold - number)), min(number, shorter + (threshold - number))
            for shift in range(lo, hi + 1):
                fits = (size >= least) & (start + shift >= 0) & (start + shift + width <= length)
                key = F.when(fits, F.xxhash64(size, F.lit(number), F.substring(wide, 4 * (start + shift) + 1, 4 * width)))
                (own if shorter == 0 and shift == 0 else probes).append(key)
    return [*own, *probes]


def letter_counts(line: str) -> Column:
    """Counts of sixteen letters of a column modulo 16, packed."""
    counts = (f"shiftleft(CAST((length({line}) - length(replace({line}, '{c}', ''))) % 16 AS BIGINT), {4 * i})" for i, c in enumerate(_LETTERS))
    return F.expr(" | ".join(counts))


def _counts_apart(a: str, b: str) -> str:
    """An edit changes this by two at most; it never exceeds the difference of the full counts."""
    apart = (f"abs((shiftrightunsigned({a}, {4 * i}) & 15) - (shiftrightunsigned({b}, {4 * i}) & 15))" for i in range(len(_LETTERS)))
    return " + ".join(f"least({d}, 16 - {d})" for d in apart)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(a: Column, b: Column) -> Column:
    """How many characters both begin with, by halving steps; up to two million are found."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))

    def further(at: Column, step: Column) -> Column:
        fits = (at + step <= F.length(a)) & (at + step <= F.length(b))
        return F.when(fits & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def _apart(z: Column) -> Column:
    """Both strings behind what they begin with, reversed."""

    def rest(c: str, at: Column) -> Column:
        return F.reverse(F.substring(z[c], at + 1, F.length(z[c]))).alias(c)

    return _let(_common(z["s"], z["l"]), lambda at: F.struct(rest("s", at), rest("l", at)))


def near(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance is within ``threshold``, by a banded bit-parallel automaton.

    What both strings begin and end with is taken off first. For each number of errors a
    word holds the diagonals that can be reached; one step for each character that is
    left of the shorter string moves all diagonals of a word at once. All words are
    packed in one long.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    begin = sum(sum(1 << (threshold + k) for k in range(e + 1)) << 8 * e for e in range(threshold + 1))

    def step(state: Column, met: Column) -> Column:
        out = fresh = F.shiftright(state, 0).bitwiseAND(mask).bitwiseAND(met)
        for e in range(1, threshold + 1):
            word, below = F.shiftright(state, 8 * e), F.shiftright(state, 8 * (e - 1)).bitwiseAND(mask)
            fresh = word.bitwiseAND(met).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(fresh, 1)).bitwiseAND(mask)
            out = out.bitwiseOR(F.shiftleft(fresh, 8 * e))
        return out

    def automaton(v: Column) -> Column:
        def equal(c: Column, i: Column) -> Column:
            """Which diagonals have the character ``c`` where the ``i``-th character of the shorter string meets them."""
            bits = F.lit(0).cast("long")
            for d in range(width):
                at = i + (d - threshold)
                bits = bits.bitwiseOR(F.when((at >= 0) & (at < v["m"]) & (F.get(v["y"], at) == c), F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))
            return bits

        end = F.aggregate(F.transform(F.slice(v["x"], F.lit(1), v["n"]), equal), F.lit(begin).cast("long"), step)
        place = F.pow(F.lit(2), v["m"] - v["n"] + threshold).cast("long")
        return F.shiftright(end, 8 * threshold).bitwiseAND(place) != 0

    def verdict(z: Column) -> Column:
        n, m = F.length(z["s"]), F.length(z["l"])
        parts = F.struct(F.split(z["s"], "", -1).alias("x"), F.split(z["l"], "", -1).alias("y"), n.alias("n"), m.alias("m"))
        return F.when(m - n > threshold, F.lit(False)).otherwise(_let(parts, automaton))

    swap = F.length(a) > F.length(b)
    ordered = F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("l"))
    return _let(_let(_let(ordered, _apart), _apart), verdict)


def within(pairs: DataFrame, a: str, b: str, threshold: int) -> DataFrame:
    """The rows of ``pairs`` whose strings ``a`` and ``b`` are near; one expression, so that no rule of the optimizer repeats its steps."""
    return pairs.where(near(F.col(a), F.col(b), threshold))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc, row, pos, line: all lines; a row is known by its id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), text_of().alias("text"))
    return rows.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _identity(line: str) -> tuple[Column, Column]:
    """128 bits that stand for a line."""
    return F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")


def _looked_up(df: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``keys`` (materialised), which are broadcast if they are few."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_LINES else keys, on, how)


def shared_keys(lines: DataFrame, threshold: int, least: int) -> DataFrame:
    """(key, h, place): the keys of distinct lines that lines of several hashes hold, with the key's place among the line's keys; a line that occurs more than once has a row (g, h, _REPEATED) too."""
    wide = lines.withColumn("wide", F.when(F.length("line") >= least, F.encode("line", "UTF-32"))).withColumn("n", (F.octet_length("wide") / 4).cast("int"))
    made = [k.alias(f"k{i}") for i, k in enumerate(keys(F.col("wide"), F.col("n"), threshold, least))]
    names = [f"k{i}" for i in range(len(made))]
    distinct = wide.select(*_identity("line"), *made).groupBy("h", "g").agg(F.count("*").alias("times"), *(F.max(k).alias(k) for k in names))
    repeated = F.when(F.col("times") > 1, F.col("g"))
    each = distinct.select("h", F.posexplode(F.array(*names, repeated)).alias("place", "key")).where("key IS NOT NULL")
    each = each.select("key", "h", F.when(F.col("place") == len(names), _REPEATED).otherwise(F.col("place")).cast("byte").alias("place"))
    group = Window.partitionBy("key")
    several = F.col("least") != F.col("most")
    return each.withColumn("least", F.min("h").over(group)).withColumn("most", F.max("h").over(group)).where(several | (F.col("place") == _REPEATED)).drop("least", "most")


def near_lines(shared: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(h, g): the lines of ``texts`` (h, g, text, first) that have an earlier line within 1 to ``threshold`` edits, by the keys they share."""
    count = threshold + 1
    level = sum(min(i, threshold - i) * 2 + 1 for i in range(count))  # so many keys are for lines of the same length, which need to meet one way only
    known = cut(texts.select("h", "g", "first", letter_counts("text").alias("letters")))
    placed = cut(_looked_up(shared, known, ["h"]))
    line = F.struct(*(F.col(c).alias(f"other_{c}") for c in ("h", "g", "first", "letters")))
    turn = Window.partitionBy("key", F.pmod("h", F.lit(PARTS))).orderBy("first", "h", "g")
    beside = placed.withColumn("eldest", F.first(line).over(turn)).withColumn("elder", F.lag(line).over(turn))
    beside = beside.select("h", "g", "first", "letters", F.explode(F.array("eldest", "elder")).alias("other")).select("*", "other.*")
    possible = F.expr(f"other_first < first AND {_counts_apart('letters', 'other_letters')} <= {2 * threshold}")
    verdict = near(F.col("a"), F.col("b"), threshold)
    few = texts.count() <= BROADCAST_LINES // 10

    def settled(pairs: DataFrame) -> DataFrame:
        """(h, g) of the pairs that verify."""
        pairs = cut(pairs.select("h", "g", "other_h", "other_g").distinct())
        mine = texts.select("h", "g", F.col("text").alias("a"))
        other = texts.select(F.col("h").alias("other_h"), F.col("g").alias("other_g"), F.col("text").alias("b"))
        mine, other = (F.broadcast(t) if few else t for t in (mine, other))
        dealt = pairs.repartition(partitions_for(pairs.sparkSession), "h", "g", "other_h", "other_g")
        return cut(dealt.join(mine, ["h", "g"]).join(other, ["other_h", "other_g"]).where(verdict).select("h", "g").distinct())

    found = settled(beside.where(possible))
    open_ = _looked_up(placed, found, ["h", "g"], "left_anti")
    others = placed.select("key", *(F.col(c).alias(f"other_{c}") for c in ("h", "g", "first", "letters", "place")))
    due = (F.col("other_place") < count) | ((F.col("place") < count) & (F.col("other_place") >= level))
    return found.union(settled(open_.join(others, "key").where(due & possible)))


def removals(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """(doc, row, pos, n_chars): the lines to remove.

    A line goes if an equal line stands before it in the order of doc_id, row and
    position, or if any earlier line is within ``threshold`` edits, itself removed or not.
    Null texts have one empty line. Null doc_ids come first. Rows equal in id and text
    are one row. Lines shorter than ``least`` characters stay, or with ``short`` go if an
    equal line stands before and they aren't blank. Lines may have any length; an empty
    table has no lines; columns besides doc_id and text are not looked at.
    """
    lines = occurrences(docs)
    long_enough = F.length("line") >= least
    lines = lines.where((long_enough | (F.trim("line", F.lit(" \t\n\x0b\x0c\r")) != "")) if short else long_enough)
    marked = cut(shared_keys(lines, threshold, least))
    shared = marked.where(F.col("place") != _REPEATED)
    wanted = cut(marked.groupBy("h").agg(F.max(F.col("place") != _REPEATED).alias("shares")))
    own = lines.select("doc", "row", "pos", *_identity("line"), F.length("line").alias("n_chars"), "line")
    own = cut(_looked_up(own, wanted, ["h"]).withColumn("line", F.when(F.col("shares"), F.col("line"))).drop("shares"))
    place = F.struct("doc", "row", "pos")
    each = cut(own.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("line").alias("text")))
    near = cut(near_lines(shared, each.where("text IS NOT NULL"), threshold).withColumn("near", F.lit(True)))
    verdict = cut(_looked_up(each.drop("text"), near, ["h", "g"], "left").where(F.col("near") | (F.col("times") > 1)))
    own = own.drop("line")
    hot = own.count() // HOT_LINES + 1
    goes = F.col("near").isNotNull() | (place != F.col("first"))
    few = verdict.count() <= BROADCAST_LINES
    frequent = F.broadcast(verdict.where(F.col("times") > hot))
    parts = [(own, F.broadcast(verdict))] if few else [(own, frequent), (own.join(frequent, ["h", "g"], "left_anti"), verdict.where(F.col("times") <= hot))]
    out = None
    for rows, decided in parts:
        gone = rows.join(decided, ["h", "g"]).where(goes).select("doc", "row", "pos", "n_chars")
        out = gone if out is None else out.union(gone)
    return out


def dedup(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """``docs`` with the lines of ``removals`` taken out of text, all columns kept.

    n_chars, where ``docs`` has it, becomes the new length. Rows that lose no line are
    unchanged, null texts among them; rows equal in id and text lose the same lines. An
    empty table stays empty.
    """
    doc, row, gone, lines = free_names(docs, "doc", "row", "gone", "lines")
    out = removals(docs, threshold, least, short).groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.array_sort(F.collect_set("pos")).alias(gone))
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    joined = named.join(out, (named[row] == out[row]) & named["doc_id"].cast("long").eqNullSafe(out[doc]), "left").drop(out[row], named[row], out[doc])
    split = joined.withColumn(lines, F.split("text", "\n", -1))

    def run(i: Column) -> Column:
        """The lines between the i-th line to go and the one before it."""
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        return F.slice(lines, start + 1, F.coalesce(F.get(gone, i), F.size(lines)) - start)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run)), "\n")
    result = split.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).drop(gone, lines)
    return result.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else result
