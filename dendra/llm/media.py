"""Media columns in archives: a Spark data source over byte ranges.

An archive folder holds archives of PNG members one behind the other, each beside an
index of fixed-width records, and one manifest for each committed write. Reading
plans byte-range partitions from the manifests alone; a task finds its members in the
archive's index, streams them through Arrow in batches of bounded size, and fetches
a member again, by its offset, where a read fails or its checksum is wrong.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import text_of

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
#: offset, size, doc_id, unpadded bytes, crc32 of the member, 1 if the doc_id is null.
_ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("doc_id", "<i8"), ("n_bytes", "<u8"), ("crc", "<u4"), ("null", "<u4")])
MEMBER = "doc_id long, n_bytes long, media binary"


def payload(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of the width."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """An 8-bit greyscale PNG, ``WIDTH`` samples a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples, a row for each row of the picture; ValueError where it isn't such a picture."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, head, data = 8, None, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("wrong checksum of a chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only plain 8-bit greyscale pictures are read")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], head[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean and spread of the samples, and an 8 x 8 average hash."""
    height = len(samples)
    top = np.arange(8) * height // 8
    end = np.maximum(top + 1, (np.arange(8) + 1) * height // 8)
    cells = np.array([samples[min(a, height - 1) : b].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) for a, b in zip(top, end, strict=True)])
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"h={height};mean={samples.mean():.4f};std={samples.std():.4f};ahash={bits}"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives of its own, rolled at a size; only committed ones enter a manifest."""

    def __init__(self, path: str, roll: int, overwrite: bool):
        self.path, self.roll, self.overwrite, self.mark = path, roll, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _store(self.path)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, entries, at = None, "", [], 0

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.index") as side:
                side.write(np.array(entries, _ENTRY).tobytes())
            done.append((name, at, len(entries)))

        for batch in iterator:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = bytes(text.as_buffer()) if text.is_valid else b""
                media = to_png(payload(data))
                if out is None:
                    name, entries, at = f"archive-{self.mark}-{uuid.uuid4().hex}", [], 0
                    out = fs.open_output_stream(f"{base}/{name}")
                out.write(media)
                entries.append((at, len(media), doc or 0, len(data), zlib.crc32(media), doc is None))
                at += len(media)
                if at >= self.roll:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, base = _store(self.path)
        fs.create_dir(base, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if "/manifest-" in f.path] if self.overwrite else []
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        for path in old:
            fs.delete_file(path)
        self._clean({name for m in messages if m for name, _, _ in m.archives})

    def abort(self, messages: list) -> None:
        self._clean(set())

    def _clean(self, keep: set[str]) -> None:
        """Removes what failed or repeated tasks of this write left; archives that no manifest names are never read anyway."""
        fs, base = _store(self.path)
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            name = info.base_name.removesuffix(".index")
            if name.startswith(f"archive-{self.mark}-") and name not in keep:
                fs.delete_file(info.path)


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, span: int, attempts: int):
        self.path, self.span, self.attempts = path, span, attempts

    def partitions(self) -> list[ByteRange]:
        fs, base = _store(self.path)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(base)):
            if "/manifest-" in info.path:
                with fs.open_input_stream(info.path) as f:
                    archives = json.loads(f.read())
                out += [ByteRange(name, s, min(size, s + self.span)) for name, size, _ in archives for s in range(0, size, self.span)]
        return sorted(out, key=lambda p: (p.name, p.start)) or [ByteRange("", 0, 0)]

    def _member(self, fs: pafs.FileSystem, path: str, entry: np.void) -> bytes:
        wrong: Exception | None = None
        for _ in range(self.attempts):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(int(entry["offset"]))
                    media = f.read(int(entry["size"]))
                if zlib.crc32(media) == entry["crc"]:
                    return media
                wrong = ValueError("wrong checksum")
            except OSError as error:
                wrong = error
        raise OSError(f"{path} at {entry['offset']}: {wrong}")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, base = _store(self.path)
        path = f"{base}/{partition.name}"
        with fs.open_input_file(f"{path}.index") as f:
            entries = np.frombuffer(f.read(), _ENTRY)
        lo, hi = np.searchsorted(entries["offset"], [partition.start, partition.end])
        own = entries[lo:hi]  # the members that begin in the range
        if not len(own):
            return
        with fs.open_input_file(path) as f:
            f.seek(int(own["offset"][0]))
            held, size = [], 0
            for entry in own:
                try:
                    media = f.read(int(entry["size"]))
                except OSError:
                    media = b""
                if zlib.crc32(media) != entry["crc"]:  # this member alone is fetched again
                    media = self._member(fs, path, entry)
                    f.seek(int(entry["offset"] + entry["size"]))
                held.append((None if entry["null"] else int(entry["doc_id"]), int(entry["n_bytes"]), media))
                size += len(media)
                if size > 4 << 20:
                    yield _members(held)
                    held, size = [], 0
            if held:
                yield _members(held)


def _members(rows: list[tuple]) -> pa.RecordBatch:
    doc, n, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


class MediaArchive(DataSource):
    """``mediaarchive``: options path, rollBytes (256 MB), rangeBytes (16 MB), attempts (3)."""

    @classmethod
    def name(cls) -> str:
        return "mediaarchive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", 16 << 20)), int(self.options.get("attempts", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("rollbytes", 256 << 20)), overwrite)


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark's default file system gives it."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = plain.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(plain).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write every text as a member under ``path``, and return the members as read back by the data source.

    Null and empty texts become a member of one row of zeros. Repeated rows become
    members of their own; a null doc_id is kept. Other columns are not looked at.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    path = _qualified(spark, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    rows.write.format("mediaarchive").mode("append").save(path)
    return spark.read.format("mediaarchive").load(path)


def features(members: DataFrame) -> DataFrame:
    """Per member: sizes and digests of the payload and of the stored form, and the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                stored = media.as_py()
                samples = from_png(stored)
                data = samples.tobytes()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return members.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
