"""N-gram language model by deleted interpolation.

Unigram and bigram maximum-likelihood estimates and a uniform one are mixed, with
weights for each bucket of context frequencies. The weights are learned by
expectation-maximisation on deleted counts: every training token is held out in turn
of the counts it is scored with, so that all of the corpus is used both ways.

Documents are dealt once into blocks. A block asks for the counts of its distinct
n-grams, packed and sorted by hash, and the answers come back as counts in the order
asked. No vocabulary is broadcast or collected; a hot word is one entry of each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_for, text_of

_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_END = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0xC2B2AE3D27D4EB4F)
_K = np.uint64(0xD6E8FEB86659FD93)
_ASK = "bucket int, block int, blob binary"
_BUCKETS_OF_CONTEXT = 24
#: Bytes of text for each partition, so that a task's memory doesn't grow with the input.
_PART = 64 << 20


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words and of one end."""
    words = _WORD.findall(text.translate(_LOWER))
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h[-1] = _END
    return h


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of each token after its predecessor; the first follows the start."""
    before = np.concatenate([[_START], h[:-1]])
    x = (before * _K) ^ (h >> np.uint64(3)) ^ (h << np.uint64(61))
    x = (x ^ (x >> np.uint64(32))) * _K
    return x ^ (x >> np.uint64(29))


def _zip(*columns: np.ndarray) -> bytes:
    """Columns of one length, as byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + planes)


def _unzip(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


@dataclass
class _Block:
    """The documents of one block, and its distinct unigrams and bigrams."""

    doc: np.ndarray
    valid: np.ndarray
    train: np.ndarray
    size: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Block:
        doc, valid, train, each = [], [], [], []
        for blob in table.column("blob"):
            raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
            n = int.from_bytes(raw[:8], "little")
            ids, flags, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
            at = 8 + 24 * n
            for d, f, s in zip(ids.tolist(), flags.tolist(), sizes.tolist(), strict=True):
                doc.append(d)
                valid.append(bool(f & 2))
                train.append(bool(f & 1))
                each.append(tokens(raw[at : at + s]))
                at += s
        return cls(np.array(doc, np.int64), np.array(valid), np.array(train), np.array([len(e) for e in each]), np.concatenate(each))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token hashes, pair hashes, which tokens begin a document, which are for training."""
        first = np.cumsum(self.size) - self.size
        pairs = _pairs(self.h)
        starts = np.full(len(first), _START)
        own = self.h[first]
        x = (starts * _K) ^ (own >> np.uint64(3)) ^ (own << np.uint64(61))
        x = (x ^ (x >> np.uint64(32))) * _K
        pairs[first] = x ^ (x >> np.uint64(29))
        begins = np.zeros(len(self.h), bool)
        begins[first] = True
        return self.h, pairs, begins, np.repeat(self.train, self.size)


def _asked(block: _Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in the order asked: by bucket, order and quotient; with training counts, and where each token finds its own."""
    h, pairs, _, train = block.grams()
    keys, counts, orders, back = [], [], [], []
    for order, g in ((0, h), (1, pairs)):
        u, inverse = np.unique(g, return_inverse=True)
        keys.append(u)
        counts.append(np.bincount(inverse[train], minlength=len(u)))
        orders.append(np.full(len(u), order, np.uint8))
        back.append(inverse + sum(map(len, keys[:-1])))
    key, count, order = np.concatenate(keys), np.concatenate(counts), np.concatenate(orders)
    bucket, quotient = (key % np.uint64(buckets)).astype(np.int64), key // np.uint64(buckets)
    place = np.lexsort((quotient, order, bucket))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    return bucket[place], quotient[place], order[place], count[place], rank[np.concatenate(back)]


def _ask(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, quotient, order, count, _ = _asked(_Block.of(table), buckets)
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blobs = []
        for s, e in zip(edge, [*edge[1:], len(bucket)], strict=True):
            step = quotient[s:e].copy()
            step[1:] -= quotient[s : e - 1]  # wraps where the order changes
            blobs.append(_zip(step, order[s:e], count[s:e].astype(np.uint32)))
        return pa.Table.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(np.full(len(edge), key[0].as_py(), np.int32)), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that is asked of one bucket, added up; each block gets its totals, and one block of each the mark to count the type."""
    now, blocks, blobs = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        parts = [_unzip(b, np.uint64, np.uint8, np.uint32) for b in blobs]
        key = np.concatenate([np.cumsum(p[0]) << np.uint64(1) | p[1] for p in parts])  # the quotient has a bit to spare
        _, inverse = np.unique(key, return_inverse=True)
        count = np.concatenate([p[2] for p in parts]).astype(np.int64)
        total = np.bincount(inverse, weights=count).astype(np.int64)
        mark = np.zeros(len(key), np.int64)
        known = np.flatnonzero(count > 0)
        first = np.full(len(total), len(key))
        np.minimum.at(first, inverse[known], known)
        mark[first[first < len(key)]] = 1
        value = (total[inverse] << 1 | mark).astype(np.uint64)
        ends = np.cumsum([len(p[0]) for p in parts])
        answers = [_zip(value[e - len(p[0]) : e]) for e, p in zip(ends, parts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([now] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(answers, pa.binary())], names=["bucket", "block", "blob"])

    for batch in batches:
        for bucket, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now and blobs:
                yield from close()
                blocks, blobs = [], []
            now = bucket
            blocks.append(block)
            blobs.append(blob)
    if blobs:
        yield from close()


def _counted(buckets: int):
    """Each document with the counts of its tokens, of their pairs and of their contexts, packed."""
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("types", pa.int64()), ("blob", pa.binary())])

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        block = _Block.of(texts)
        _, _, order, _, back = _asked(block, buckets)
        blobs = [b for _, b in sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))]
        value = np.concatenate([_unzip(b, np.uint64)[0] for b in blobs])
        total, mark = (value >> np.uint64(1)).astype(np.int64), value & np.uint64(1)
        n = len(block.h)
        one, two = total[back[:n]], total[back[n:]]
        first = np.cumsum(block.size) - block.size
        context = np.concatenate([[0], one[:-1]])
        context[first] = -1  # the start: as many as there are training documents
        known = np.add.reduceat((one > 0).astype(np.int64), first)
        packed = [_zip(one[s : s + k], two[s : s + k], context[s : s + k]) for s, k in zip(first.tolist(), block.size.tolist(), strict=True)]
        types = np.zeros(len(first), np.int64)
        types[0] = int(mark[order == 0].sum())  # a column of sums: the first document carries the block's
        return pa.Table.from_arrays([pa.array(block.doc, mask=~block.valid), pa.array(block.train), pa.array(block.size.astype(np.int64)), pa.array(known), pa.array(types), pa.array(packed, pa.binary())], schema=schema)

    return run


def _level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency: its binary logarithm, zero for one never seen."""
    return np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), _BUCKETS_OF_CONTEXT - 1)


def _cells(n: int, docs: int, vocabulary: int):
    """Deleted estimates of the training tokens, added up over a grid of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: dict[str, np.ndarray] | None = None
        shape = (_BUCKETS_OF_CONTEXT, 96, 48)
        grid = np.zeros((3, int(np.prod(shape))))
        for batch in batches:
            for train, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not train:
                    continue
                one, two, context = _unzip(blob, np.int64, np.int64, np.int64)
                context = np.where(context < 0, docs, context)
                p1 = (one - 1) / max(1, n - 1)
                p2 = np.where(context > 1, (two - 1) / np.maximum(1, context - 1), 0.0)
                q1 = np.where(one > 1, np.minimum(94, np.round(2 * np.log2(np.maximum(1, one - 1)))), 95).astype(np.int64)
                q2 = np.where(p2 > 0, np.minimum(46, np.round(-2 * np.log2(np.maximum(p2, 2.0**-23)))), 47).astype(np.int64)
                cell = np.ravel_multi_index((_level(context - 1), q1, q2), shape)
                for i, w in enumerate((None, p1, p2)):
                    grid[i] += np.bincount(cell, weights=w, minlength=grid.shape[1])
        at = np.flatnonzero(grid[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(grid[i, at]) for i in range(3))], names=["cell", "n", "p1", "p2"])

    return run


def _weights(cells: pa.Table, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (uniform, unigram, bigram) of each context bucket, by expectation-maximisation."""
    weight = np.tile([0.1, 0.9, 0.0], (_BUCKETS_OF_CONTEXT, 1))
    if not cells.num_rows:
        return weight
    cell, n, p1, p2 = (cells.column(c).to_numpy() for c in ("cell", "n", "p1", "p2"))
    level = cell // (96 * 48)
    estimates = np.stack([np.full(len(n), 1 / (vocabulary + 1)), p1 / n, p2 / n])
    share = np.full((_BUCKETS_OF_CONTEXT, 3), 1 / 3)
    for _ in range(rounds):
        part = share[level].T * estimates
        part *= n / part.sum(axis=0)
        fresh = np.stack([np.bincount(level, weights=p, minlength=_BUCKETS_OF_CONTEXT) for p in part], axis=1) + [0.5, 0.5, 0.0]
        share = fresh / fresh.sum(axis=1, keepdims=True)
    seen = np.flatnonzero(np.bincount(level, minlength=_BUCKETS_OF_CONTEXT))
    for b in range(_BUCKETS_OF_CONTEXT):  # buckets without a token take the nearest one's
        weight[b] = share[seen[np.abs(seen - b).argmin()]]
    weight[0] = [weight[0, 0], 1 - weight[0, 0], 0]
    return weight


def _scores(n: int, docs: int, vocabulary: int, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, score = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, blob in enumerate(batch.column(4).to_pylist()):
                one, two, context = _unzip(blob, np.int64, np.int64, np.int64)
                context = np.where(context < 0, docs, context)
                base[i] = np.log10((one + 0.1) / (n + 0.1 * (vocabulary + 1))).sum()
                w = weight[_level(context)]
                score[i] = np.log10(w[:, 0] / (vocabulary + 1) + w[:, 1] * one / max(1, n) + w[:, 2] * np.where(context > 0, two / np.maximum(1, context), 0.0)).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(base), pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def _blocks(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            home = batch.column(2).to_numpy(zero_copy_only=False) % blocks
            order = np.argsort(home, kind="stable")
            edge = np.flatnonzero(np.append(True, home[order][1:] != home[order][:-1])) if len(order) else []
            rows, held = [], 0
            for s, e in zip(edge, [*edge[1:], len(order)], strict=True):
                at = order[s:e]
                texts = [bytes(batch.column(3)[i].as_buffer()) for i in at.tolist()]
                head = len(at).to_bytes(8, "little") + doc[at].astype(np.int64).tobytes() + flags[at].tobytes() + np.array([len(t) for t in texts], np.int64).tobytes()
                rows.append((int(home[at[0]]), zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))))
                held += len(rows[-1][1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "blob"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "blob"])

    return run


def score(docs: DataFrame, train: str = "train", blocks_per_partition: int = 2) -> DataFrame:
    """Scores of all documents by a model of those where column ``train`` holds.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram)
    and score (the mixture), both log10 probabilities of the text's tokens and its end.
    Null texts are empty: one token, the end. Repeated rows count and return as often as
    they come; a null doc_id is kept; a null ``train`` is false. If nothing trains, all
    is uniform. Other columns are not looked at.
    """
    volume = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    parts = max(2, partitions_for(docs.sparkSession), -(-volume // _PART))
    blocks = blocks_per_partition * parts
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        (F.coalesce(F.col(train), F.lit(False)).cast("long") + 2 * F.col("doc_id").isNotNull().cast("long")).alias("flags"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("home"),
        text_of().cast("binary").alias("text"),
    )
    texts = rows.mapInArrow(_blocks(blocks), "block int, blob binary").groupBy("block")  # dealt once, read twice
    asked = texts.applyInArrow(_ask(parts), _ASK)
    answers = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, _ASK)
    counted = cut(texts.cogroup(answers.groupBy("block")).applyInArrow(_counted(parts), "doc_id long, train boolean, n_tokens long, n_known long, types long, blob binary"))
    total = counted.agg(F.sum(F.when(F.col("train"), F.col("n_tokens"))).alias("n"), F.sum("types").alias("v"), F.sum(F.col("train").cast("long")).alias("docs")).first()
    n, vocabulary, n_docs = total["n"] or 0, total["v"] or 0, total["docs"] or 0
    cells = counted.select("train", "blob").mapInArrow(_cells(n, n_docs, vocabulary), "cell long, n double, p1 double, p2 double")
    weight = _weights(cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p1", "p2"))).toArrow(), vocabulary)
    scored = counted.select("doc_id", "train", "n_tokens", "n_known", "blob").mapInArrow(_scores(n, n_docs, vocabulary, weight), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
