"""Media columns: lossless images in archives, written by tasks and read back by a custom data source.

A text's payload (UTF-8, zeros up to a positive multiple of 64) becomes an 8-bit greyscale
PNG of 64 samples a row. A task writes its images into ZIP archives in the shared folder,
each under a name of its own, and reports those it completed; the report is a table that
Spark commits, so archives of failed or repeated attempts are never read.

The data source plans byte ranges from the sizes of the reported archives alone. The reader
of a range takes the members whose headers begin inside it from the archive's directory,
reads each by its offset, checks its CRC, and retries it alone on failure. Payloads leave
in Arrow batches of bounded bytes.
"""

from __future__ import annotations

import binascii
import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import arrow, ragged, storage

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 4

ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS, WAIT = 3, 0.2
#: Ranges that a read is planned in at most.
MOST_RANGES = 20_000


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def encode_png(text: bytes) -> bytes:
    """The stored form of a text; its length is kept in a text chunk."""
    payload = text + bytes(-len(text) % ROW if text else ROW)
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # each row begins with its filter, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The samples and the length before padding of an image of ``encode_png``."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, width, height, length, data = len(SIGNATURE), 0, 0, -1, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != binascii.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit greyscale is read")
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes(), length


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, the mean step between neighbours, and the shares of 16 levels."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    levels = counts.reshape(16, 16).sum(1) / len(x)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.4f};levels=" + ",".join(f"{v:.4f}" for v in levels)


#: Spark's names of stores, and what Arrow calls them.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder as Spark names it, and the path there; abfss, gs, hdfs and file are called alike."""
    for scheme, own in SCHEMES.items():
        if uri.startswith(scheme):
            uri = own + uri.removeprefix(scheme).lstrip("/")
            break
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class _Archive:
    """One archive being written: complete under its name once closed."""

    def __init__(self, folder: str):
        self.system, root = file_system(folder)
        self.system.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}.zip"
        self.raw = self.system.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(_Unseekable(self.raw), "w", zipfile.ZIP_STORED)
        self.members = self.bytes = 0

    def add(self, doc_id: int | None, media: bytes) -> None:
        name = f"{self.members}/{'null' if doc_id is None else doc_id}.png"
        self.zip.writestr(zipfile.ZipInfo(name), media)  # a fixed date: equal input, equal archives
        self.members += 1
        self.bytes += len(media)

    def close(self) -> pa.RecordBatch:
        self.zip.close()
        self.raw.close()
        size = self.system.get_file_info(self.path).size
        return pa.RecordBatch.from_pydict({"archive": [self.path], "members": [self.members], "bytes": [size]})


class _Unseekable(io.RawIOBase):
    def __init__(self, raw):
        self.raw = raw

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.raw.write(data)
        return len(data)


def write_archives(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Store every row's text as an image under ``folder``; null texts count as empty, repeated rows are stored again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            buf, at = ragged.text_bytes(batch.column(1))
            raw = memoryview(buf)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                archive = archive or _Archive(f"{folder}/archives")
                archive.add(doc_id, encode_png(bytes(raw[a:b])))
                if archive.bytes >= archive_bytes:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    arrow.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    rows.mapInArrow(write, "archive string, members long, bytes long").write.parquet(f"{folder}/written")


class Ranges(InputPartition):
    """Byte ranges (archive, start, end) that one task reads, one after another."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.wait = float(options.get("wait", WAIT))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[Ranges]:
        """Byte ranges of the reported archives; only their names and sizes are looked at.

        Large archives are cut, small ones and the rests of large ones share a task, and ranges
        grow with the total, so that there are some ``MOST_RANGES`` tasks at most.
        """
        system, root = file_system(f"{self.folder}/written")
        written = ds.dataset(root, filesystem=system, format="parquet", schema=pa.schema([("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())])).to_table()
        step = max(self.range_bytes, -(-(pc.sum(written["bytes"]).as_py() or 0) // MOST_RANGES))
        tasks, held = [[]], 0
        for path, size in sorted(zip(written["archive"].to_pylist(), written["bytes"].to_pylist())):
            for start in range(0, size, step):
                end = min(start + step, size)
                if tasks[-1] and held >= step:
                    tasks.append([])
                    held = 0
                tasks[-1].append((path, start, end))
                held += end - start
        return [Ranges(t) for t in tasks]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)
        rows, held = [], 0
        try:
            for archive, start, end in partition.ranges:
                with system.open_input_file(archive) as raw, zipfile.ZipFile(raw) as directory:
                    members = [m for m in directory.infolist() if start <= m.header_offset < end]
                for member in members:
                    media, error = self._member(system, archive, member)
                    rows.append((archive, member.header_offset, member.filename, media, error))
                    held += len(media or b"")
                    if held >= BATCH_BYTES or len(rows) >= 1024:
                        yield self._batch(rows)
                        rows, held = [], 0
            if rows:
                yield self._batch(rows)
        finally:
            self._close()

    def _member(self, system: fs.FileSystem, archive: str, member: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """A member's bytes by its offset; a failure is retried on a fresh handle, for this member only."""
        error = ""
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.wait * 2 ** (attempt - 1))
            try:
                return self._at_offset(system, archive, member), None
            except (OSError, ValueError) as e:
                error = str(e)
                self._close()
        if self.permissive:
            return None, error
        raise OSError(f"{archive} at {member.header_offset}: {error}")

    handle = None

    def _close(self) -> None:
        if self.handle is not None:
            handle, self.handle = self.handle, None
            handle[1].close()

    def _at_offset(self, system: fs.FileSystem, archive: str, member: zipfile.ZipInfo) -> bytes:
        if self.handle is None or self.handle[0] != archive:
            self._close()
            self.handle = (archive, system.open_input_file(archive))
        raw = self.handle[1]
        head = raw.read_at(30, member.header_offset)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins there")
        name, extra = struct.unpack_from("<HH", head, 26)
        media = raw.read_at(member.file_size, member.header_offset + 30 + name + extra)
        if len(media) != member.file_size or binascii.crc32(media) != member.CRC:
            raise ValueError("the member's checksum differs")
        return media

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        archive, offset, name, media, error = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(offset, pa.int64()), pa.array(name, pa.string()), pa.array(media, pa.binary()), pa.array(error, pa.string())], ["archive", "offset", "member", "media", "error"])


class ArchiveSource(DataSource):
    """Members of the archives under ``path``: (archive, offset, member, media, error).

    Options: rangebytes, attempts, wait (seconds before the second attempt, doubled each time), and mode (failfast, or permissive: a member that can't be
    read has null media and its error).
    """

    @classmethod
    def name(cls) -> str:
        return "lagweave_archives"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("lagweave_archives").options(**options).load(folder)


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of images read from archives; an unreadable member (null media) gives nulls."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(name, image) for name, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("member", "media").mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _digest(member: str, image: bytes | None) -> tuple:
    name = member.rpartition("/")[2].removesuffix(".png")
    doc_id = None if name == "null" else int(name)
    if image is None:
        return (doc_id, *[None] * 7)
    samples, length = decode_png(image)
    return doc_id, length, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)


def store_and_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write every text into archives in the shared folder, read them back, and digest what was read."""
    spark = docs.sparkSession
    folder = storage.new_folder(spark, "media")
    write_archives(docs, folder, id_column, text_column)
    return media_digests(read_archives(spark, folder))
