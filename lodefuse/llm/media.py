"""Media columns in archives, by a custom Spark data source.

``media_archive`` writes members to ZIP archives (stored, since members compress themselves)
and reads them back. Planning looks at file sizes only and cuts archives into byte ranges; a
task reads its archive's central directory, takes the members whose headers start in its
range, and streams their payloads in Arrow batches. A member that fails to read or whose
CRC-32 differs is retried by its own offset, not its archive or range. Tasks write archives
under names of their own and a manifest lists those of successful attempts, so a lost
executor leaves nothing but an unlisted file.

Media here are 8-bit grey images 576 samples wide, stored as PNG, which is lossless.

Edge cases: null and empty texts are one row of padding; a very long text is one member, its
payload held whole by one task; repeated rows are separate members, told apart by offset;
nothing is ordered, so there are no ties; an empty table makes no archive and no rows; a null
doc_id is kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodefuse.llm import files
from lodefuse.llm.common import parts, shared_path, slim, table, texts

WIDTH = 576
PADDING = 255
#: Bytes from which on a task starts another archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive that a reading task takes.
RANGE_BYTES = 16 << 20
#: Bytes of payloads in an Arrow batch.
BATCH_BYTES = 4 << 20
RETRIES = 3

_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data and bytes 255 up to a positive multiple of width."""
    return data.ljust(max(1, -(-len(data) // width)) * width, bytes([PADDING]))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG of the samples, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line led by filter type 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples (height, width) of an 8-bit grey PNG whose lines are unfiltered."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey PNG is read")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash over an 8 x 8 grid of runs."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / len(flat)
    levels = np.arange(256)
    mean = float(counts @ levels) / len(flat)
    deviation = float(counts @ (levels - mean) ** 2 / len(flat)) ** 0.5
    edges = np.linspace(0, len(flat), 65).astype(np.int64)
    cell = np.add.reduceat(flat.astype(np.int64), edges[:-1]) / np.diff(edges)
    bits = int("".join("1" if c > mean else "0" for c in cell), 2)
    return f"mean={mean:.3f};sd={deviation:.3f};entropy={float(-(share * np.log2(share)).sum()):.3f};hash={bits:016x}"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


@dataclass
class _Range(InputPartition):
    name: str
    size: int
    start: int
    end: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = files.place(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out = archive = None
        at = 0
        for batch in iterator:
            for key, member in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if archive is None:
                    names.append(f"{uuid.uuid4().hex}.zip")
                    out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                    archive, at = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # repeated keys are meant
                    archive.writestr(zipfile.ZipInfo("" if key is None else str(key)), member or b"")
                at += len(member or b"") + 256
                if at > self.archive_bytes:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        files.commit(self.path, [n for m in messages if m is not None for n in m.names])

    def abort(self, messages: list) -> None:
        pass  # unlisted archives are never read


class _Tail(io.RawIOBase):
    """A seekable view of a stored file, for reading an archive's directory at its end."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at = source, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        got = self.source.read_at(n, self.at)
        self.at += len(got)
        return got


def directory(uri: str, size: int) -> list[tuple[str, int, int, int]]:
    """(key, offset, bytes, crc) of an archive's members."""
    system, path = files.place(uri)
    with system.open_input_file(path) as f, zipfile.ZipFile(_Tail(f, size)) as z:
        return [(i.filename, i.header_offset, i.file_size, i.CRC) for i in z.infolist()]


def member(uri: str, offset: int, size: int, crc: int, retries: int = RETRIES, read=files.read_at) -> bytes:
    """One member's payload by its offset; read again by itself if that fails or its checksum differs."""
    for attempt in range(retries + 1):
        try:
            head = read(uri, offset, 30)
            names, extra = struct.unpack_from("<HH", head, 26)
            data = read(uri, offset + 30 + names + extra, size)
            if len(data) == size and zlib.crc32(data) == crc:
                return data
            problem: Exception = ValueError(f"{uri}: the member at {offset} is damaged")
        except (OSError, struct.error) as e:
            problem = e
        if attempt < retries:
            time.sleep(0.1 * 2**attempt)
    raise problem


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        return [_Range(*x) for x in files.ranges(self.path, self.range_bytes)] or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        uri = f"{self.path}/{partition.name}"
        held: list[tuple[str, bytes]] = []
        mb = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k or None for k, _ in held], pa.string()), pa.array([m for _, m in held], pa.binary())], names=["key", "media"])

        system, path = files.place(uri)
        own = [x for x in directory(uri, partition.size) if partition.start <= x[1] < partition.end] if partition.size else []
        if own:
            with system.open_input_file(path) as f:
                first = [True]

                def read(_: str, start: int, n: int) -> bytes:  # one open file, until something fails
                    if first[0]:
                        try:
                            return f.read_at(n, start)
                        except OSError:
                            first[0] = False
                    return files.read_at(uri, start, n)

                for key, offset, size, crc in own:
                    held.append((key, member(uri, offset, size, crc, read=read)))
                    mb += size
                    if mb >= BATCH_BYTES:
                        yield batch()
                        held, mb = [], 0
        if held:
            yield batch()


class MediaArchive(DataSource):
    """Format media_archive: columns key string and media binary; options path, archive_bytes, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key string, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def write_media(df: DataFrame, path: str) -> None:
    """Writes (key string, media binary) to archives under path."""
    df.sparkSession.dataSource.register(MediaArchive)
    slim(df, "key", "media").write.format("media_archive").option("path", path).mode("append").save()


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(key, media) of the archives under path."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", path).load()


def as_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, media): each text as an image; the key is its doc_id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            media = [encode(padded(t, width), width) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array(media, pa.binary())], names=["key", "media"])

    return slim(docs, "doc_id", "text").mapInArrow(made, "key string, media binary")


def described(media: DataFrame) -> DataFrame:
    """Sizes, checksums and features of stored images (key, media)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for key, stored in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = decode(stored)
                payload = samples.tobytes()
                unpadded = len(payload.rstrip(bytes([PADDING])))  # UTF-8 has no byte 255
                values = (None if key is None else int(key), unpadded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

    return media.mapInArrow(made, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    write_media(as_media(table(spark, sf_dir, "documents")), path)
    return described(read_media(spark, path))
