"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the seek table of
the seekable format (a skippable frame with each frame's compressed and plain size), before
it stands another skippable frame that maps record identifiers to (frame, offset within the
frame, length). One record is read by two small reads and one frame. The Spark data source
``warc_bundle`` writes bundles and scans them by byte ranges, frame by frame.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest
identifier is a response and the others revisit it. Duplicate groups are found by one
aggregation over digests and joined back as plain shuffle join, so a large group of copies
is neither gathered nor limited.

Edge cases: null and empty payloads are responses of no bytes; rows repeated with the
largest identifier are all responses; a null identifier never is the largest, and revisits
one that isn't null; an empty table makes no bundle and no rows; a null URL leaves the
header out; a URL is written as it is, but for line breaks, which a header can't hold: they are
percent-encoded and stay so; a very long payload is a frame of its own, never cut. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodefuse.llm import files
from lodefuse.llm.common import shared_path, slim, table

MIN_REVISIT = 1000
#: Plain bytes from which on a frame ends.
FRAME_BYTES = 1 << 20
#: Compressed bytes from which on a task starts another bundle.
BUNDLE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
LEVEL = 3

# fixed values of the seekable Zstandard format
_SKIPPABLE_INDEX = 0x184D2A50
_SKIPPABLE_TABLE = 0x184D2A5E
_SEEKABLE_MAGIC = 0x8F92EAB1

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # none is given, and equal input makes equal bundles
COLUMNS = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the payload's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"" if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        safe = url.replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {safe}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at this place, and where the next one starts. The digest of a stored payload is checked."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, n = stop + 4, int(head["Content-Length"])
    block = data[start : start + n]
    body = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(b": ", 1) for x in block[: body - 4].split(b"\r\n")[1:])
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    payload = block[body:] if kind == "response" else None
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    values = (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), payload, int(http[b"Content-Length"]), digest, kind, number(head.get("WARC-Refers-To")))
    return dict(zip(COLUMNS, values, strict=True)), start + n + 4


class BundleWriter:
    """Writes one bundle to a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.plain = self.size = 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        if page_id is not None:
            self.index.append((page_id, len(self.frames), self.plain, len(data)))
        self.held.append(data)
        self.plain += len(data)
        if self.plain >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.held:
            frame = self.compressor.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.plain))
            self.size += len(frame)
            self.held, self.plain = [], 0

    def close(self) -> None:
        self._end_frame()
        body = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(struct.pack("<qIQQ", *x) for x in sorted(self.index)))
        self.out.write(struct.pack("<II", _SKIPPABLE_INDEX, len(body) + 8) + body + struct.pack("<Q", len(body)))
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", _SKIPPABLE_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE_MAGIC))


class Bundle:
    """Random access to a bundle. read(start, n) gives bytes of it."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        n, _, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != _SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        self.table_at = size - 17 - 8 * n
        entries = read(self.table_at + 8, 8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", entries, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        self.index_at = at

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.read(at, packed), max_output_size=plain)

    def index(self) -> dict[int, tuple[int, int, int]]:
        """record identifier: (frame, offset within it, length); of equal identifiers the last."""
        n = struct.unpack("<Q", self.read(self.table_at - 8, 8))[0]
        body = zstandard.ZstdDecompressor().decompress(self.read(self.index_at + 8, n), max_output_size=1 << 31)
        return {i: (f, o, n) for i, f, o, n in struct.iter_unpack("<qIQQ", body)}

    def record(self, page_id: int) -> dict:
        frame, offset, n = self.index()[page_id]
        return parsed(self.frame(frame)[offset : offset + n])[0]


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
    def __init__(self, path: str, bundle_bytes: int, frame_bytes: int):
        self.path, self.bundle_bytes, self.frame_bytes = path, bundle_bytes, frame_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = files.place(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out = bundle = None
        for batch in iterator:
            for values in zip(*[batch.column(c).to_pylist() for c in COLUMNS], strict=True):
                if bundle is None:
                    names.append(f"{uuid.uuid4().hex}.warc.zst")
                    out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                    bundle = BundleWriter(out, self.frame_bytes)
                bundle.add(values[0], record(*values))
                if bundle.size > self.bundle_bytes:
                    bundle.close()
                    out.close()
                    bundle = None
        if bundle is not None:
            bundle.close()
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        files.commit(self.path, [n for m in messages if m is not None for n in m.names])

    def abort(self, messages: list) -> None:
        pass  # unlisted bundles are never read


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, columns: list[str]):
        self.path, self.range_bytes, self.columns = path, range_bytes, columns

    def partitions(self) -> list[InputPartition]:
        return [_Range(*x) for x in files.ranges(self.path, self.range_bytes)] or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        system, path = files.place(f"{self.path}/{partition.name}")
        kinds = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        with system.open_input_file(path) as f:
            bundle = Bundle(lambda start, n: f.read_at(n, start), partition.size)
            for i, (at, _, _) in enumerate(bundle.frames):
                if partition.start <= at < partition.end:
                    data, place, rows = bundle.frame(i), 0, []
                    while place < len(data):
                        row, place = parsed(data, place)
                        rows.append(row)
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], names=self.columns)


class WarcBundle(DataSource):
    """Format warc_bundle; options path, frame_bytes, bundle_bytes, range_bytes, and columns to read."""

    @classmethod
    def name(cls) -> str:
        return "warc_bundle"

    def _columns(self) -> list[str]:
        return self.options.get("columns", ",".join(COLUMNS)).split(",")

    def schema(self) -> str:
        kinds = {"page_id": "long", "payload": "binary", "payload_bytes": "long", "refers_to": "long"}
        return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self._columns())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("bundle_bytes", BUNDLE_BYTES)), int(self.options.get("frame_bytes", FRAME_BYTES)))


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The records to write for pages (page_id, url, html): COLUMNS."""
    made = slim(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    made = made.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    twice = made.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL")
    met = made.join(twice.select("payload_digest", "largest"), "payload_digest", "left")
    revisits = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return met.select("page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("largest")).alias("refers_to"))


def write_bundles(found: DataFrame, path: str, **options) -> None:
    """Writes records (COLUMNS) to bundles under path."""
    found.sparkSession.dataSource.register(WarcBundle)
    found.select(*COLUMNS).write.format("warc_bundle").option("path", path).options(**options).mode("append").save()


def read_bundles(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The records of the bundles under path; each stored payload is read and its digest checked."""
    spark.dataSource.register(WarcBundle)
    return spark.read.format("warc_bundle").option("path", path).option("columns", ",".join(columns or COLUMNS)).options(**options).load()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_bundles(records(table(spark, sf_dir, "pages")), path)
    return read_bundles(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
