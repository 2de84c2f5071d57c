"""SimHash near-duplicates by anchor-point covering.

A fingerprint has two 32-bit halves. Fingerprints within three bits agree within one
bit on at least one half, so each half is covered on its own: the anchors are the
code words of the perfect Hamming code on 31 of its bits (covering radius one).
Every fingerprint goes to each anchor within radius plus threshold, two bits, and
the anchor's own ball (radius one) is compared with all that came to the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, stars

_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PAIRS = 1 << 21
_BIG = 4096
#: Fingerprints of more than one in so many rows are looked up by broadcast, of which there are fewer than this.
HOT = 20_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles, in their order; a text of fewer words is one shingle, a text without words has none."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    start = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    end = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], 42) for i, j in zip(start, end, strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles; zero for a text without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(h: np.ndarray) -> int:
    """64-bit SimHash of hashes; zero for none."""
    n = len(h)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


_BITS = np.array([1 << i for i in range(31)], np.uint64)
_COLUMNS = np.arange(1, 32, dtype=np.uint64)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint, its index, an anchor within two bits, and whether that is within one."""
    index, key, home = [], [], []
    for half in (0, 1):
        word = (fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        syndrome = np.zeros(len(fp), np.uint64)
        for bit in range(31):
            syndrome ^= np.where(word & _BITS[bit], _COLUMNS[bit], np.uint64(0))
        mark = np.uint64(half << 31)
        own = np.where(syndrome > 0, word ^ np.where(syndrome > 0, _BITS[(syndrome.astype(np.int64) - 1) % 31], np.uint64(0)), word)
        index.append(np.arange(len(fp)))
        key.append(own | mark)
        home.append(np.ones(len(fp), bool))
        for bit in range(31):
            other = syndrome ^ _COLUMNS[bit]
            at = np.flatnonzero((syndrome > 0) & (other > _COLUMNS[bit]))  # each pair of columns once
            index.append(at)
            key.append((word[at] ^ _BITS[bit] ^ _BITS[other[at].astype(np.int64) - 1]) | mark)
            home.append(np.zeros(len(at), bool))
    return np.concatenate(index), np.concatenate(key), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 8192):
            part = fp[at : at + 8192]
            index, key, home = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def near_pairs(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int, deep: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``threshold`` bits of an anchor's ball and all that came to it, in blocks of bounded size."""
    order = np.argsort(key, kind="stable")
    key, fp, home = key[order], fp[order], home[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(np.arange(len(start)), size)
    if deep:
        for g in np.flatnonzero(size > _BIG):
            own = fp[start[g] : start[g] + size[g]]  # within three bits of 64, one of four quarters is equal
            for quarter in range(4):
                part = (own >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
                yield from near_pairs(part, own, np.ones(len(own), bool), threshold, deep=False)
    probes = np.flatnonzero(home & (size[group] > 1) & ((size[group] <= _BIG) | (not deep)))
    count = size[group[probes]]
    total = np.cumsum(count)
    at = 0
    while at < len(probes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
        n = count[at:to]
        left = np.repeat(probes[at:to], n)
        right = np.repeat(start[group[probes[at:to]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (fp[left] != fp[right])
        yield fp[left[near]], fp[right[near]]
        at = to


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, home = [], [], []
        for batch in batches:
            key.append(batch.column(0).to_numpy(zero_copy_only=False))
            fp.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            home.append(batch.column(2).to_numpy(zero_copy_only=False))
        if not key:
            return
        a, b, held = [], [], 0
        for x, y in near_pairs(np.concatenate(key), np.concatenate(fp), np.concatenate(home).astype(bool), threshold):
            a.append(x)
            b.append(y)
            held += len(x)
            if held > 4 * _PAIRS:
                x, y = stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        if a:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            for at in range(0, len(x), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536].view(np.int64)), pa.array(y[at : at + 65536].view(np.int64))], names=["a", "b"])

    return run


def link_fingerprints(fps: DataFrame, threshold: int = 3, parts: int | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``threshold`` (at most three) bits, transitively."""
    if not 0 <= threshold <= 3:
        raise ValueError("the covering is laid out for thresholds of 0 to 3 bits")
    spread = fps.select("fp").distinct().mapInArrow(_replicate, "anchor long, fp long, home boolean")
    dealt = spread.repartition(parts, "anchor") if parts else spread.repartition("anchor")
    return dealt.mapInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """Near-duplicate groups of ``documents``: doc_id, fp, component_id.

    Copies share a fingerprint and are carried as one; links join distinct fingerprints
    only. component_id is the least doc_id reachable. Null and empty texts have
    fingerprint zero, linked like any other. Repeated rows return repeated rows; a null
    doc_id keeps its row and never becomes a component's id unless all are null. Other
    columns of ``docs`` are not looked at.
    """
    own = cut(fingerprints(docs, shingle))
    single = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")))
    label = components(link_fingerprints(single, threshold), "a", "b").withColumnRenamed("node", "fp")
    labelled = single.join(label, "fp", "left").select("fp", "first", "times", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut(labelled.join(least, "component").select("fp", "component_id", "times"))
    hot = F.broadcast(named.where(F.col("times") > own.count() // HOT + 1).select("fp", "component_id"))
    frequent, rest = own.join(hot, "fp"), own.join(hot, "fp", "left_anti").join(named.select("fp", "component_id"), "fp")
    return frequent.union(rest).select("doc_id", "fp", "component_id")
