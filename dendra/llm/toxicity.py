"""Toxicity by compression distance.

Two zstandard dictionaries are trained, each on its own side of a bounded sample of
labelled rows: one on windows of ordinary text, and one on what sets toxic text apart,
which are its words that hold a piece far more frequent there. The ordinary side is
trained on windows without such pieces, so that what tells the sides apart is in one of
them alone. Every window of a text, its whole length over, is compressed with the
ordinary dictionary and with the toxic one laid behind it; the bytes saved are the
window's distance. In place of the toxic dictionary the first compressor has as many
bytes that match nothing, so that both find the ordinary one equally far away. How many windows save how much decides: the weights of these counts
and the cut are calibrated on labelled rows that trained neither dictionary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .quality import sampled

_WINDOW = 64
_LEVEL = 9
_SIZES = (5, 6, 7, 8)
#: Least log-likelihood ratio of a piece of a word between toxic and ordinary rows, far out for the many pieces tried, and least ratio of its rates. A word counts so often at most in one row.
_EVIDENCE, _RATIO, _IN_ROW = 40.0, 5, 3
#: One labelled row in so many calibrates; the others train the dictionaries. Rows of a label that one needs to calibrate.
_CALIBRATES, _LEAST_ROWS = 3, 4


def windows(text: str | None, size: int = _WINDOW) -> Iterator[bytes]:
    """The words of the text, lower-cased, in runs of at least ``size`` bytes; a longer word is one window."""
    held, n = [b""], 0
    for word in (text or "").lower().encode("utf-8", "surrogatepass").split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            yield b" ".join(held) + b" "
            held, n = [b""], 0
    if n:
        yield b" ".join(held) + b" "


#: Savings, in bytes, whose windows are counted.
_SAVED = (1, 2, 3, 5)


def _raw(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = _raw(content)
    held.precompute_compress(_LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, level=_LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


class Distance:
    """Bytes that the toxic dictionary saves on each window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = _compressor(ordinary + b"\x01" * len(toxic)), _compressor(ordinary + toxic)

    def features(self, text: str | None) -> np.ndarray:
        """Counts and shares of windows that save a byte or more, two and so on, over the whole text."""
        saved = Counter(len(self.plain.compress(w)) - len(self.both.compress(w)) for w in windows(text))
        n = sum(saved.values())
        above = [sum(k for s, k in saved.items() if s >= t) for t in _SAVED]
        return np.array([*(math.log1p(a) for a in above), *(math.sqrt(a / (n + 4)) for a in above)], float)


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    shift: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weight + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _words(text: str) -> list[bytes]:
    return [b" " + w + b" " for w in text.lower().encode("utf-8", "surrogatepass").split()]


def _word_counts(texts: list[str]) -> Counter:
    """How often each word occurs, in each row ``_IN_ROW`` times at most."""
    total: Counter = Counter()
    for text in texts:
        total.update({w: min(k, _IN_ROW) for w, k in Counter(_words(text)).items()})
    return total


def _pieces(word: bytes) -> set[bytes]:
    return {word[i : i + n] for n in _SIZES for i in range(len(word) - n + 1)}


def _evidence(k1: int, n1: int, k0: int, n0: int) -> float:
    """Log-likelihood ratio that a piece is more frequent in toxic rows; zero if it isn't by far."""
    if k1 * n0 <= _RATIO * k0 * n1:
        return 0.0
    p = (k1 + k0) / (n1 + n0)

    def part(k: int, n: int) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k and p < 1 else 0.0)

    return 2 * (part(k1, n1) + part(k0, n0))


def telling_pieces(toxic: Counter, ordinary: Counter) -> set[bytes]:
    """Pieces of words that are far more frequent in toxic rows than in ordinary ones."""
    n1, n0 = sum(toxic.values()), max(1, sum(ordinary.values()))
    least = math.ceil(_EVIDENCE / (2 * math.log1p(n0 / max(1, n1))))  # so many occurrences the evidence takes
    count1: Counter = Counter()
    for w, k in toxic.items():
        for g in _pieces(w):
            count1[g] += k
    frequent = {g for g, k in count1.items() if k >= least}
    count0: Counter = Counter()
    for w, k in ordinary.items():
        for g in _pieces(w) & frequent:
            count0[g] += k
    return {g for g in frequent if _evidence(count1[g], n1, count0[g], n0) >= _EVIDENCE}


def telling_part(word: bytes, pieces: set[bytes]) -> bytes:
    """The longest run of a word's bytes that lie in pieces."""
    best, start, end = b"", 0, 0
    for i in range(len(word)):
        size = max((n for n in _SIZES if word[i : i + n] in pieces), default=0)
        if not size:
            continue
        if i >= end:
            start = i
        end = max(end, i + size)
        if end - start > len(best):
            best = word[start:end]
    return best


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary trained on the samples, or their last bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str], sizes: tuple[int, int] = (4096, 1024)) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of whole texts."""
    told = telling_pieces(_word_counts(toxic), _word_counts(ordinary))
    parts = [b"".join(p for w in _words(t) if (p := telling_part(w, told))) for t in toxic]
    inside = told | {g.strip() for g in told if len(g.strip()) >= _SIZES[0]}  # what stands inside of other words would hide it too
    plain = [w for t in ordinary for w in windows(t) if inside.isdisjoint(_pieces(w))]
    return _trained(sizes[0], plain), _trained(sizes[1], [p for p in parts if len(p) >= 8])


def _weights(x: np.ndarray, y: np.ndarray, rows: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale and weights of the features and the shift: a logistic regression in which both labels weigh alike; the cut with most F1 becomes one half, where a row of a label stands for as many as ``rows`` says."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    each = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge = np.diag([*[0.5] * (len(beta) - 1), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (each * np.maximum(p * (1 - p), 1e-6))[:, None]) + ridge, z.T @ (each * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ beta
    order = np.argsort(-raw, kind="stable")
    hit, wrong = np.cumsum(y[order]) * rows[1], np.cumsum(1 - y[order]) * rows[0]
    f1 = 2 * hit / (hit + wrong + y.sum() * rows[1])
    f1[:-1][raw[order][1:] == raw[order][:-1]] = -1  # equal scores stay on one side
    best = int(f1.argmax())
    below = raw[order][best + 1] if best + 1 < len(y) else raw[order][best] - 1.0
    return mean, scale, beta[:-1], float(beta[-1] - (raw[order][best] + below) / 2)


def fit(docs: DataFrame, marks: DataFrame, sample: tuple[int, int] = (4000, 1500)) -> ToxicityModel | float | None:
    """Fit on the texts of ``docs`` that ``marks`` (doc_id, label 0/1) marks: at most ``sample`` of label 0 and of label 1, copies once.

    One row in three, by a hash of its text, calibrates; the others train the
    dictionaries. Where a label has too few rows to calibrate there is no model but the
    rate of label 1, which is then every text's score; None without any labelled row.
    """
    marked = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    got = sampled(docs, marks, sample).toArrow()
    rows = sorted(set(zip(got.column("text").to_pylist(), got.column("label").to_pylist(), strict=True)))
    if not rows:
        return None
    apart = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 7) % _CALIBRATES == 0 for t, _ in rows]
    y = np.array([float(label) for (_, label), a in zip(rows, apart, strict=True) if a])
    ordinary, toxic = ([t for (t, label), a in zip(rows, apart, strict=True) if label == v and not a] for v in (0, 1))
    if not ordinary or not toxic or y.sum() < _LEAST_ROWS or (1 - y).sum() < _LEAST_ROWS:
        return float(np.mean([label for _, label in rows]))
    plain, foul = dictionaries(toxic, ordinary)
    distance = Distance(plain, foul)
    x = np.array([distance.features(t) for (t, _), a in zip(rows, apart, strict=True) if a])
    stands_for = tuple(marked.get(v, 0) / max(1, sum(label == v for _, label in rows)) for v in (0, 1))
    return ToxicityModel(plain, foul, *_weights(x, y, stands_for))


def score(docs: DataFrame, model: ToxicityModel | float | None, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with score and predicted; needs text.

    Null and empty texts have no window and score as a text that saves nothing. Without
    any labelled row every score is 0, and with a rate in place of a model it is that
    rate. Repeated rows score alike; texts may have any length; an empty table stays
    empty. A column named score or predicted is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        distance = Distance(model.ordinary, model.toxic) if isinstance(model, ToxicityModel) else None
        for batch in batches:
            if distance and batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text"))
                s = model.probability(np.array([distance.features(t.as_py()) for t in texts])).round(6)
            else:
                s = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("score", "predicted")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*(batch.schema.names[i] for i in keep), "score", "predicted"])

    return docs.mapInArrow(run, StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
