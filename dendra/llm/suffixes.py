"""Exact substring dedup by bucket-pointer refinement over a sampled suffix set.

Suffixes are sorted only as deep as the match length. Bucket identifiers are made
by doubling, each level from the identifiers of later offsets of the level below
(10 bytes, then 20, 40 and 50), and are content-derived 64-bit values, so that every
executor numbers equal prefixes alike without a common rank table.

1. Initial buckets: each window of ``length`` bytes is represented by the least
   q-gram bucket in it (its anchor); equal windows share their anchor, so anchors
   stand for all suffixes. Anchor buckets with one document are done.
2. Refinement: the windows of one anchor are refined together by the identifiers
   of their first and last window; where all agree, the bucket's least document
   decides for the whole run.
3. Where runs of one anchor differ but agree on the bytes before or behind it, as
   two runs with a common window must, only their first documents come again, and
   each of their windows on the side that agrees is refined on its own identifier.

Records travel packed: one row is (bucket, kind, blob) with numpy columns in a
compressed blob, so memory is that of one bucket, never of a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_for, text_of

_CHUNK = (1 << 20) - 64
_FLUSH = 16 << 20
_ROW = "bucket int, kind int, blob binary"
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K = [np.uint64(int(k) * 2 + 1) for k in _rng.integers(1 << 61, 1 << 62, 12)]
_RUN = (np.uint32, np.uint32, np.uint16, np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.int64, np.uint32, np.uint8)  # anchor bucket, run (56 bits), bytes before and behind, anchor's place, document, tag, start, last start
_SPAN = (np.int64, np.int64, np.uint32, np.uint32)  # document, tag, from, how long
_WINDOW = (np.uint32, np.uint32, np.int64, np.int64, np.uint32)  # identifier (64 bits), document, tag, start
#: Bytes of text for each bucket of documents, so that a task's memory doesn't grow with the input.
_PART = 64 << 20
_REMOVE, _LOOK, _TEXT = 0, 1, 2


def _pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    width = sum(np.dtype(k).itemsize for k in kinds)
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(raw) // width, 0
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K[0]
    return x ^ (x >> np.uint64(29))


def _join(a: np.ndarray, b: np.ndarray, offset: int, depth: int) -> np.ndarray:
    """Identifiers of a prefix followed, ``offset`` later, by another of ``depth``; each depth has its own factor."""
    return a[: len(b) - offset] * np.uint64(pow(int(_K[1]), depth, 1 << 64)) + b[offset:]


class Ladder:
    """Identifiers at the depths that doubling needs: the q-gram and the full length."""

    def __init__(self, x: np.ndarray, length: int, q: int):
        half = q // 2
        one = _BYTE[x]
        level, depth = one, 1
        while depth * 2 <= half:
            level = _join(level, level, depth, depth)
            depth *= 2
        while depth < half:
            level = _join(level, one, depth, 1)
            depth += 1
        gram = _join(level, level, half, half)
        self.gram = _mix(gram)
        wide, depth = gram, q
        while depth * 2 <= length:
            wide = _join(wide, wide, depth, depth)
            depth *= 2
        if depth < length:  # the last step overlaps
            wide = _join(wide, wide, length - depth, depth)
        self.full = _mix(wide)
        self.q, self.part = q, (length - q + 1) // 2
        side, depth = one, 1
        while depth * 2 <= self.part:
            side = _join(side, side, depth, depth)
            depth *= 2
        while depth < self.part:
            side = _join(side, one, depth, 1)
            depth += 1
        self.side = side

    def before(self, at: np.ndarray) -> np.ndarray:
        """Eight bits of the identifier of the bytes before; what lies over an edge of the text counts as zero."""
        there = at >= self.part
        return np.where(there, _mix(self.side[np.where(there, at - self.part, 0)]) >> np.uint64(56), np.uint64(0))

    def behind(self, at: np.ndarray) -> np.ndarray:
        there = at + self.q < len(self.side)
        return np.where(there, _mix(self.side[np.where(there, at + self.q, 0)]) >> np.uint64(56), np.uint64(0))


def _runs(x: np.ndarray, ends: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Of the windows of pieces that end at ``ends``: first start, last start, anchor bucket, run identifier, bytes before and behind."""
    n = len(x) - length + 1
    ids = Ladder(x, length, q)
    width = length - q + 1
    low = np.uint64((1 << 20) - 1)
    least = (ids.gram & ~low) | np.arange(len(ids.gram), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & low).astype(np.int64)[:n]
    valid = np.ones(n, bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - length + 1) : e] = False
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    run = _mix(ids.full[a] * _K[6] + ids.full[b] * _K[7] + (b - a).astype(np.uint64))
    return a, b, ids.gram[anchor[a]], run, ids.before(anchor[a]), ids.behind(anchor[a]), anchor[a] - a


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of at most a chunk: bytes, piece ends, documents, tags, offsets in the document. Pieces of a long text overlap by length-1."""
    held: list[bytes] = []
    meta: list[tuple[int, int, int]] = []
    size = 0

    def flush():
        ends = np.cumsum([len(h) for h in held])
        d, t, o = (np.array(c) for c in zip(*meta, strict=True))
        return np.frombuffer(b"".join(held), np.uint8), ends, d.astype(np.int64), t.astype(np.int64), o.astype(np.int64)

    for batch in batches:
        for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer()
            view = memoryview(raw) if raw is not None else memoryview(b"")
            step = _CHUNK // 2
            for at in range(0, max(1, len(view) - length + 1), step):
                piece = bytes(view[at : at + step + length - 1])
                if len(piece) < length:
                    continue
                if held and size + len(piece) > _CHUNK:
                    yield flush()
                    held, meta, size = [], [], 0
                held.append(piece)
                meta.append((doc, tag, at))
                size += len(piece)
    if held:
        yield flush()


def _deal(columns: list[list[np.ndarray]], bucket: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows of one kind, a blob for each bucket, in batches of bounded size."""
    order = np.argsort(bucket, kind="stable")
    joined = [np.concatenate(c)[order] if len(c) != 1 else c[0][order] for c in columns]
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    rows = [(int(bucket[s]), _pack([c[s:e] for c in joined])) for s, e in zip(edge, [*edge[1:], len(bucket)], strict=True)]
    if rows:
        yield _rows([r[0] for r in rows], kind, [r[1] for r in rows])


def _rows(buckets: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([kind] * len(buckets), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _home(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64) * _K[8] + tag.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _anchors(length: int, q: int, buckets: int, homes: int):
    """The runs of all texts, dealt out by anchor bucket.

    Where equal runs come together already here, only the first document's goes on: the
    others' bytes are spans to remove. A passage that all documents share is thus one run
    of each flush, not one of each document.
    """

    def flush(held: list[list[np.ndarray]], where: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns, bucket = [np.concatenate(c).astype(k) for c, k in zip(held, _RUN, strict=True)], np.concatenate(where)
        key, ident, doc, tag, start, more = columns[0], _ident(*columns[1:4]), *columns[7:]
        order = np.lexsort((doc, ident, key, bucket))
        new = _edges(bucket[order], key[order], ident[order])
        least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.zeros(len(doc), bool)
        gone[order] = doc[order] > least
        if gone.any():
            d, t, s = doc[gone], tag[gone], start[gone]
            yield from _deal([[d], [t], [s], [more[gone] + np.uint32(length)]], _home(d, t, homes), _REMOVE)
        yield from _deal([[c[~gone]] for c in columns], bucket[~gone], _LOOK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in _RUN]
        where: list[np.ndarray] = []
        size = 0
        for x, ends, doc, tag, offset in _pieces(batches, length):
            a, b, gram, ident, before, behind, place = _runs(x, ends, length, q)
            piece = np.searchsorted(ends, a, side="right")
            start = a - np.concatenate([[0], ends[:-1]])[piece] + offset[piece]
            parts = (ident & np.uint64(0xFFFFFFFF), (ident >> np.uint64(32)) & np.uint64(0xFFFF), (ident >> np.uint64(48)) & np.uint64(0xFF))
            for column, values in zip(held, (gram >> np.uint64(32), *parts, before, behind, place, doc[piece], tag[piece], start, b - a), strict=True):
                column.append(values)
            where.append(((gram & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64))
            size += len(x)
            if size >= _FLUSH:
                yield from flush(held, where)
                held, where, size = [[] for _ in _RUN], [], 0
        if where:
            yield from flush(held, where)

    return run


def _ident(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | middle.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64) << np.uint64(48)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (v.as_py() for v in batch.column(2)), strict=True)


def _each_bucket(work: Callable[[list[bytes]], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for bucket, kind, blob in _by_bucket(batches):
            if kind == _REMOVE:  # decided already
                yield _rows([bucket], kind, [blob])
                continue
            if bucket != now and blobs:
                yield from work(blobs)
                blobs = []
            now = bucket
            blobs.append(blob)
        if blobs:
            yield from work(blobs)

    return run


def _edges(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _refine(length: int, q: int, homes: int):
    """Anchor buckets refined by run: spans to remove, and runs whose windows have to be looked at one by one."""

    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, low, middle, high, before, behind, place, doc, tag, start, more = _unpack(blobs, _RUN)
        ident = _ident(low, middle, high)
        order = np.lexsort((doc, ident, key))
        key, ident, before, behind, place, doc, tag, start, more = (c[order] for c in (key, ident, before, behind, place, doc, tag, start, more))
        new_key, new_run = _edges(key), _edges(key, ident)
        key_at, run_at = np.cumsum(new_key) - 1, np.cumsum(new_run) - 1
        gone = doc > doc[np.flatnonzero(new_run)][run_at]
        several = np.add.reduceat(new_run.astype(np.int64), np.flatnonzero(new_key))[key_at] > 1
        agree = np.zeros((2, len(doc)), bool)
        at = np.flatnonzero(~gone & several)
        for look, side in zip(agree, (before, behind), strict=True):
            by = at[np.lexsort((ident[at], side[at], key[at]))]
            if len(by):
                new, fresh = _edges(key[by], side[by]), _edges(key[by], side[by], ident[by])
                group, first = np.cumsum(new) - 1, np.flatnonzero(new)
                runs = np.add.reduceat(fresh.astype(np.int64), first)[group]
                apart = np.minimum.reduceat(doc[by], first)[group] < np.maximum.reduceat(doc[by], first)[group]
                look[by] |= (runs > 1) & apart
        if gone.any():
            d, t, s = doc[gone], tag[gone], start[gone]
            yield from _deal([[d], [t], [s], [more[gone] + np.uint32(length)]], _home(d, t, homes), _REMOVE)
        part, place = (length - q + 1) // 2, place.astype(np.int64)  # a window with the whole part before it starts so early, and so on
        first = np.where(agree[0], 0, np.maximum(0, place - part))
        last = np.where(agree[1], more, np.minimum(more, place - part))
        look = agree.any(axis=0) & (first <= last)
        if look.any():
            d, t = doc[look], tag[look]
            yield from _deal([[d], [t], [(start[look] + first[look]).astype(np.uint32)], [(last - first + 1)[look].astype(np.uint32)]], _home(d, t, homes), _LOOK)

    return work


def _texts(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            tag = batch.column(1).to_numpy(zero_copy_only=False)
            home = _home(doc, tag, homes)
            size = np.zeros(len(doc), np.int64)
            parts: dict[int, list[int]] = {}
            for i, (h, text) in enumerate(zip(home.tolist(), batch.column(2), strict=True)):
                size[i] = len(text.as_buffer()) if text.is_valid else 0
                parts.setdefault(h, []).append(i)
            rows = []
            for h, at in parts.items():
                rows.append((h, _text_blob(doc[at], tag[at], size[at], [batch.column(2)[i] for i in at])))
                if sum(len(r[1]) for r in rows) > 8 << 20:
                    yield _rows([r[0] for r in rows], _TEXT, [r[1] for r in rows])
                    rows = []
            if rows:
                yield _rows([r[0] for r in rows], _TEXT, [r[1] for r in rows])

    return run


def _text_blob(doc: np.ndarray, tag: np.ndarray, size: np.ndarray, texts: list) -> bytes:
    head = np.array([len(doc)], np.int64).tobytes() + doc.astype(np.int64).tobytes() + tag.astype(np.int64).tobytes() + size.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(bytes(t.as_buffer()) for t in texts if t.is_valid))


def _from_blob(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, tag, size = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    at = 8 + 24 * n
    for d, t, s in zip(doc.tolist(), tag.tolist(), size.tolist(), strict=True):
        yield d, t, raw[at : at + s]
        at += s


class _Spans:
    """Spans of one bucket of documents, sorted; looked up by document and tag."""

    def __init__(self, blobs: list[bytes]):
        doc, tag, start, size = _unpack(blobs, _SPAN)
        order = np.lexsort((start, tag, doc))
        self.doc, self.tag, self.start = doc[order], tag[order], start[order].astype(np.int64)
        self.end = self.start + size[order]
        new = np.flatnonzero(_edges(self.doc, self.tag)).tolist() if len(order) else []
        self.at = {(int(self.doc[s]), int(self.tag[s])): (int(s), int(e)) for s, e in zip(new, [*new[1:], *[len(order)] * bool(new)], strict=True)}

    def of(self, doc: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.at.get((doc, tag), (0, 0))
        return self.start[s:e], self.end[s:e]


def _with_texts(texts: pa.Table, spans: pa.Table) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """Each document of a bucket with its spans."""
    own = _Spans(spans.column("blob").to_pylist())
    for blob in texts.column("blob"):
        for doc, tag, raw in _from_blob(blob.as_py()):
            yield doc, tag, raw, *own.of(doc, tag)


def _together(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(batches, schema)


def _windows(length: int, q: int, buckets: int):
    """The windows of the runs to look at, dealt out by identifier."""

    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        return _together(list(rows(texts, spans)), schema)

    def rows(texts: pa.Table, spans: pa.Table) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in _WINDOW]
        where: list[np.ndarray] = []
        if not spans.num_rows:
            return
        for doc, tag, raw, start, end in _with_texts(texts, spans):
            if not len(start):
                continue
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, end, -1)
            at = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            x = np.frombuffer(raw, np.uint8)
            step = _CHUNK // 2
            for s in range(0, len(raw), step):
                own = at[(at >= s) & (at < s + step)]
                if len(own):
                    full = Ladder(x[s : s + step + length - 1], length, q).full
                    ident = full[own - s]
                    for column, values in zip(held, (ident >> np.uint64(32), ident & np.uint64(0xFFFFFFFF), np.full(len(own), doc, np.int64), np.full(len(own), tag, np.int64), own.astype(np.uint32)), strict=True):
                        column.append(values)
                    where.append((ident % np.uint64(buckets)).astype(np.int64))
        if where:
            yield from _deal([[np.concatenate(c).astype(k)] for c, k in zip(held, _WINDOW, strict=True)], np.concatenate(where), _LOOK)

    return run


def _decide(length: int, homes: int):
    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        high, low, doc, tag, start = _unpack(blobs, _WINDOW)
        ident = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        order = np.lexsort((doc, ident))
        ident, doc, tag, start = (c[order] for c in (ident, doc, tag, start))
        new = _edges(ident)
        gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if gone.any():
            d, t, s = doc[gone], tag[gone], start[gone]
            yield from _deal([[d], [t], [s], [np.full(len(s), length, np.uint32)]], _home(d, t, homes), _REMOVE)

    return work


def _kept(keep_text: bool):
    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for doc, tag, raw, start, end in _with_texts(texts, spans):
            if len(start):
                reach = np.maximum.accumulate(end)
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > reach[:-1]
                s = start[new].tolist()
                e = reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)].tolist()
            else:
                s, e = [], []
            kept = b"".join(raw[i:j] for i, j in zip([0, *e], [*s, len(raw)], strict=True))
            rows.append((doc, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), list(zip(s, e, strict=True)) if keep_text else None, kept if keep_text else None))
        return pa.Table.from_batches([_results(rows)], _results([]).schema)

    return run


def _results(rows: list[tuple]) -> pa.RecordBatch:
    doc, n, gone, spans, digest, list_of, kept = zip(*rows, strict=True) if rows else [()] * 7
    ids = pa.array([None if d == 2**63 - 1 else d for d in doc], pa.int64())
    where = pa.array([None if x is None else [{"start": s, "end": e} for s, e in x] for x in list_of], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), where, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, q: int = 20, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans and kept bytes if ``keep_text``.

    Every byte goes that is covered by a string of ``length`` bytes which also starts in
    a document with a smaller doc_id, judged on the input. Null texts are empty; texts
    shorter than ``length`` keep all. Rows that share a doc_id don't remove each other,
    and are told apart by 64 bits of a hash of their texts; a null doc_id counts as larger
    than any other. Repeated rows return repeated rows, an empty table none. Other columns
    are not looked at.
    """
    if q < 4 or q % 2 or q >= length or length - q > 255:
        raise ValueError("q has to be even, 4 at least, and less than length, by 255 at most")
    spark = docs.sparkSession
    doc, text = F.col("doc_id").cast("long"), text_of("text")
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    repeated = bool(docs.select(doc.alias("doc")).dropna().groupBy("doc").count().where("count > 1").limit(1).count())
    parts = max(partitions_for(spark), -(-volume // _PART))
    buckets = 2 * parts  # of anchors; texts and windows have one for each partition
    tag = F.xxhash64(text) if repeated else F.when(doc.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))  # tells rows of one id apart
    rows = docs.select(F.coalesce(doc, F.lit(2**63 - 1)).alias("doc"), tag.alias("tag"), text.cast("binary").alias("text"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")

    runs = rows.mapInArrow(_anchors(length, q, buckets, parts), _ROW)
    found = cut(dealt(runs).mapInArrow(_each_bucket(_refine(length, q, parts)), _ROW))
    texts = rows.mapInArrow(_texts(parts), _ROW).groupBy("bucket")  # both cogroups read the same exchange
    windows = texts.cogroup(found.where(F.col("kind") == _LOOK).groupBy("bucket")).applyInArrow(_windows(length, q, parts), _ROW)
    late = dealt(windows).mapInArrow(_each_bucket(_decide(length, parts)), _ROW)
    spans = found.where(F.col("kind") == _REMOVE).union(late)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return texts.cogroup(spans.groupBy("bucket")).applyInArrow(_kept(keep_text), schema)
