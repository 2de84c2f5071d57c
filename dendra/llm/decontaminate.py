"""Benchmark decontamination by pigeonhole edit matching.

A text holds an item within an error budget of k edits only if it holds one of k+1
pieces of the item unchanged. One automaton finds all pieces in one pass over a text;
each place it points at is verified with Myers' bit-parallel edit distance. Items too
short to tell contamination from common words are held against whole texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, without

#: Edits that are allowed for each character of an item.
ERROR_RATE = 0.08
#: Characters of items that are broadcast at once; more items are searched for in several passes.
BROADCAST = 2 << 20
#: Items of fewer characters than this match whole texts alone; they stand in any text by chance.
LEAST_CHARS = 25


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of even length, with their offsets."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to any substring of ``text``, and where the first such substring ends."""
    m = len(item)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        score += bool(right & top) - bool(left & top)
        if score < best:
            best, end = score, j + 1
        right = right << 1 & full  # a match may begin anywhere: nothing is carried into the first row
        left = left << 1 & full
        up = left | (full & ~(diagonal | right))
        down = right & diagonal
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.short: dict[str, list[int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            if len(text) < LEAST_CHARS:
                self.short.setdefault(text, []).append(k)
                continue
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item, least distance) of all items within their budget in the whole text."""
        text = normal(text)
        whole = self._whole(text)
        if self.empty:
            return whole
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                starts.setdefault(k, set()).add(end + 1 - size - offset)
        out = whole
        for k, places in starts.items():
            item, own, budget = self.items[k]
            best = budget + 1
            lo = hi = None
            for s in [*sorted(places), math.inf]:  # near places are verified as one window
                if lo is not None and s > hi + len(own) + 2 * budget:
                    best = min(best, least_distance(own, text[max(0, lo - budget) : hi + len(own) + budget])[0])
                    lo = None
                lo, hi = (s, s) if lo is None else (lo, s)
            if best <= budget:
                out.append((item, best))
        return sorted(out)

    def _whole(self, text: str) -> list[tuple[int, int]]:
        """The short items that are the whole text, within their budgets."""
        if not text or len(text) > LEAST_CHARS:
            return []
        near = ((k, max(least_distance(item, text)[0], least_distance(text, item)[0])) for item, ks in self.short.items() for k in ks)
        return sorted((self.items[k][0], n) for k, n in near if n <= self.items[k][2])


_MATCHERS: dict[str, Matcher] = {}


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, broadcast_chars: int = BROADCAST) -> DataFrame:
    """(doc_id, item_id, distance): the benchmark items that a document holds within ``rate`` edits a character.

    Case and runs of white space don't count. Null or empty texts and items match
    nothing; items of fewer than ``LEAST_CHARS`` characters match a text only as a whole;
    items with one id are matched apart and the nearest counts, of items that overlap in
    a text each; repeated documents return repeated rows; texts may have any length. Items
    are broadcast in groups of bounded size. Other columns are not looked at.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND length(trim(text)) > 0").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / broadcast_chars))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for g in range(groups):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else items
        held = docs.sparkSession.sparkContext.broadcast([(r["item_id"], normal(r["text"])) for r in own.orderBy("item_id", "text").collect()])
        part = texts.mapInArrow(_search(held, rate), "doc_id long, item_id long, distance int")
        found = part if found is None else found.union(part)
    return found


def _search(held, rate: float):
    key = uuid.uuid4().hex  # workers serve several searches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _MATCHERS.get(key)
        if matcher is None:
            _MATCHERS.clear()
            matcher = _MATCHERS[key] = Matcher([x for x in held.value if x[1]], rate)
        for batch in batches:
            doc, item, distance = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                least: dict[int, int] = {}
                for i, n in matcher.matches(text.as_py()):
                    least[i] = min(n, least.get(i, n))
                for i, n in least.items():
                    doc.append(d)
                    item.append(i)
                    distance.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(distance, pa.int32())], names=["doc_id", "item_id", "distance"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` without any match, all columns kept; rows are judged one by one, by id and text."""
    row = free_names(docs, "row")[0]
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    hit = matches(named.select(F.col(row).alias("doc_id"), "text"), benchmark, rate).select(F.col("doc_id").alias(row)).distinct()
    return without(named, cut(hit), row).drop(row)
