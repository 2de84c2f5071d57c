"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams of the whole text, hashed 4-grams of character classes,
and words that repeat the word before. A bounded sample of labelled rows is
decomposed (TF-IDF, truncated SVD) on the driver; its vectors are broadcast, and every
document's exact cosine products with all of them are computed in blocks.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Width of the hashed term space; a term vector never has more entries than this.
TERMS = 4096
_BLOCK = 512
#: Terms that count repeated words; several, so that repetition weighs as much as a group of trigrams.
_REPEATS = 32


def _classes() -> np.ndarray:
    """Byte to class: lower and upper case letters, digits, space, line end; all else by itself; bytes above 127 are letters."""
    c = np.arange(256, dtype=np.uint64)
    c[97:123] = 97
    c[128:] = 97
    c[65:91] = 65
    c[48:58] = 48
    c[9:14] = 10
    return c


_CLASS = _classes()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams, of 4-grams of character classes, and of repeated words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(TERMS, np.float32)
    half = TERMS // 2 - _REPEATS
    words = data.split()
    counts[-2 * _REPEATS :] = sum(map(operator.eq, words, words[1:]))
    for at in range(0, len(raw), 1 << 20):
        part = raw[at : at + (1 << 20) + 3]
        x = part.astype(np.uint64)
        if len(x) >= 3:
            k = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
            counts[:half] += np.bincount((k % np.uint64(half)).astype(np.int64), minlength=half)
        if len(x) >= 4:
            c = _CLASS[part]
            k = (c[:-3] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:-1] * np.uint64(0x165667B19E3779F9) ^ c[3:] * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(40)
            counts[half : 2 * half] += np.bincount((k % np.uint64(half)).astype(np.int64), minlength=half)
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass(frozen=True)
class QualityModel:
    """Latent vectors of the labelled sample, and what projects a document beside them."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float
    neighbours: int
    power: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled rows, weighted by similarity; the base rate where nothing is similar."""
        near = self.project(counts) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** self.power
        total = weight.sum(axis=1)
        vote = (weight * self.labels[top]).sum(axis=1)
        return np.divide(vote, total, out=np.full(len(vote), self.base), where=total > 1e-9)


def fit(docs: DataFrame, marks: DataFrame, sample: int = 4000, rank: int = 64, neighbours: int = 15, power: float = 8.0) -> QualityModel | None:
    """Fit on the texts of ``docs`` that ``marks`` (doc_id, label 0/1) marks; at most ``sample`` of them, half of each label where there are as many."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                rows = [term_counts(t.as_py()) for t in part.column(0)]
                packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r > 0].astype(np.float32).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), part.column(1)], names=["counts", "label"])

    got = sampled(docs, marks, (sample // 2, sample // 2)).select("text", F.col("label").cast("double")).mapInArrow(counts, "counts binary, label double").toArrow()
    if not got.num_rows:
        return None
    x = np.zeros((got.num_rows, TERMS), np.float32)
    for i, b in enumerate(got.column("counts").to_pylist()):
        n = len(b) // 6
        x[i, np.frombuffer(b, np.uint16, n)] = np.frombuffer(b, np.float32, n, 2 * n)
    y = got.column("label").to_numpy()
    order = np.lexsort((*x[:, :8].T, x.sum(axis=1), y))  # the same order on every run
    x, y = x[order], y[order]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    z = _unit(np.log1p(x) * idf)
    k = min(rank, *z.shape)
    basis = np.random.default_rng(7).standard_normal((TERMS, k + 8)).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(z.T @ (z @ basis))[0]
    _, _, v = np.linalg.svd(z @ basis, full_matrices=False)
    axes = (basis @ v.T)[:, :k].astype(np.float32)
    return QualityModel(idf, axes, _unit(z @ axes), y, float(y.mean()), neighbours, power)


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` with a score and a prediction, called as ``names`` says; needs text.

    The broadcast model is bounded by the sample and the term space. Null and empty
    texts get the sample's base rate. Without any labelled row every score is 0.5.
    Repeated rows score alike, neighbours that are equally near count by their place
    among the labelled rows, texts may have any length, an empty table stays empty. A
    column of ``docs`` that has one of the names is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                texts = part.column(part.schema.get_field_index("text"))
                if model is None:
                    s = np.full(part.num_rows, 0.5)
                else:
                    s = model.score(np.stack([term_counts(t.as_py()) for t in texts])).round(6)
                keep = [i for i, n in enumerate(part.schema.names) if n not in names]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*(part.schema.names[i] for i in keep), *names])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    fields = [f for f in docs.schema.fields if f.name not in names]
    return docs.mapInArrow(run, StructType([*fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]))


def marked(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label: the marks of one kind; nulls and values other than 0 and 1 fall out, of repeated ids one stays."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    return marks.where("label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


#: Texts of more characters than this are not sampled, so that the sample's size is bounded in bytes too.
SAMPLE_CHARS = 100_000


def sampled(docs: DataFrame, marks: DataFrame, sample: tuple[int, int]) -> DataFrame:
    """text, label of at most ``sample`` marked ids of label 0 and of label 1, chosen by a hash of the id.

    Ids are chosen before texts are read: the broadcast side has at most as many rows as
    the sample, and few texts are shuffled. Of rows that share an id the least text comes.
    """
    there = marks.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").withColumn("at", F.xxhash64("doc_id"))
    chosen = [there.where(F.col("label") == v).orderBy("at", "doc_id").limit(n) for v, n in enumerate(sample)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    own = texts.join(F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "label")), "doc_id")
    return own.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
