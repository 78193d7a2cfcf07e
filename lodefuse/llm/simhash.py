"""SimHash near-duplicate detection by bit-sliced comparison.

Fingerprints of whole texts are made in Arrow batches. Distinct fingerprints meet where two
of their four 16-bit blocks agree (any two within distance 2 do so); keys that hold many
fingerprints are split exactly once more, by thirds of the remaining 32 bits, of which one
must agree as well, and what is still large by pairs of blocks, each pair a bucket, so no
task holds more than two blocks of lanes. Within a bucket, bit planes are stored vertically:
plane b holds bit b of every fingerprint of a block of lanes, so one query updates the
distances to thousands of lanes with a few wide bitwise operations, counting in carry-save
form; a block is abandoned once every lane exceeds the radius. A bucket yields a spanning
forest, never all its pairs, and components follow by alternating stars, which settle in a
logarithm of rounds; beyond 60 they give up with an error.

Edge cases: null and empty texts have fingerprint zero and link like any other; a text with
fewer than three words hashes its whole word sequence; a very long text is hashed whole; bits
set in exactly half the hashes are 0; repeated rows share a component; an empty table gives
no rows; rows with a null doc_id get the least doc_id of the others that they reach, or
null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodefuse.llm.common import fresh, parts, saved, slim, table, texts
from lodefuse.llm.components import components

RADIUS = 2
SHINGLE = 3
#: Lanes of a block of bit planes.
LANES = 4096
#: Fingerprints of a key from which on it is split by a further agreeing part.
SPLIT = 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    own = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    fp = 0
    for k in range(8):
        counts = np.bincount(own[:, k], minlength=256) @ _BITS
        fp |= int(np.packbits(counts * 2 > len(hashes), bitorder="little")[0]) << (8 * k)
    return fp


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text's word shingles, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    return simhash(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return slim(docs, "doc_id", "text").mapInArrow(made, "doc_id long, fp long")


class Planes:
    """Bit planes of a block of fingerprints: plane b holds bit b of every lane."""

    def __init__(self, rows: np.ndarray):
        """rows: a fingerprint's bytes a row, bit i first in byte i // 8."""
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        self.all = (1 << len(rows)) - 1
        self.planes = [int.from_bytes(row.tobytes(), "little") for row in packed]

    def folded(self) -> Planes:
        """The planes of fingerprints whose upper half is added, bit by bit, to the lower."""
        out, half = object.__new__(Planes), len(self.planes) // 2
        out.all, out.planes = self.all, [x ^ y for x, y in zip(self.planes[:half], self.planes[half:], strict=True)]
        return out

    def near(self, fp: int, among: int, radius: int = RADIUS) -> int:
        """The lanes of `among` within the radius of fp, as a bit mask."""
        over, n = self.all & ~among, (radius + 1).bit_length()
        counters = [self.all if ((1 << n) - radius - 1) >> i & 1 else 0 for i in range(n)]  # a carry out is a distance beyond the radius
        for bit, plane in zip(f"{fp:0{len(self.planes)}b}"[::-1], self.planes, strict=True):
            carry = plane ^ self.all if bit == "1" else plane  # lanes that differ here
            for i in range(n):
                c = counters[i]
                counters[i] = c ^ carry
                carry &= c
                if not carry:
                    break
            if carry:
                over |= carry
                if over == self.all:
                    return 0  # every lane of the block exceeds the radius
        return self.all & ~over


def forest(fps: np.ndarray, radius: int = RADIUS, lanes: int = LANES) -> list[tuple[int, int]]:
    """(root, member) index pairs that span the components of fps at the radius."""
    blocks = [(at, Planes(fps[at : at + lanes].astype("<u8").view(np.uint8).reshape(-1, 8))) for at in range(0, len(fps), lanes)]
    left = [p.all for _, p in blocks]
    values = [int(x) for x in fps.astype(np.uint64)]
    out = []
    for root in range(len(fps)):
        if not left[root // lanes] >> (root % lanes) & 1:
            continue
        left[root // lanes] &= ~(1 << root % lanes)
        queue = [root]
        while queue:
            q = values[queue.pop()]
            for k, (at, block) in enumerate(blocks):
                if left[k] and (found := block.near(q, left[k], radius)):
                    left[k] &= ~found
                    while found:
                        low = found & -found
                        member = at + low.bit_length() - 1
                        out.append((root, member))
                        queue.append(member)
                        found ^= low
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the nodes of each run of equal keys."""

    def of(fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(forest(fps), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 1]]), pa.array(nodes[pairs[:, 0]])], names=["u", "v"])

    held: list[tuple] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "i", "j")]
        fps, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[a] for k in keys)
            if key != last and held:
                if sum(len(x[0]) for x in held) > 1:
                    yield of(np.concatenate([x[0] for x in held]).view(np.uint64), np.concatenate([x[1] for x in held]))
                held = []
            last = key
            held.append((fps[a:b], nodes[a:b]))
    if sum(len(x[0]) for x in held) > 1:
        yield of(np.concatenate([x[0] for x in held]).view(np.uint64), np.concatenate([x[1] for x in held]))


def links(distinct: DataFrame, split: int = SPLIT, lanes: int = LANES) -> DataFrame:
    """Edges (u, v) that span all links at distance 2 or less between distinct (fp, node)."""
    part = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    combos = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    kinds = []
    for n, (i, j) in enumerate(combos):
        a, b = (x for x in range(4) if x not in (i, j))
        kinds.append(F.struct(F.lit(n).alias("kind"), (F.shiftleft(part(i), 16) + part(j)).alias("key"), (F.shiftleft(part(a), 16) + part(b)).alias("rest")))
    keyed = distinct.select("fp", "node", F.explode(F.array(*kinds)).alias("k")).select("fp", "node", "k.*")
    sizes = keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(saved(sizes, "sizes"), ["kind", "key"])
    thirds = F.array(*[F.struct((F.col("kind") * 4 + t + 1).alias("kind"), (F.shiftleft("key", 11) + F.shiftrightunsigned("rest", s).bitwiseAND(F.lit(m))).alias("key")) for t, s, m in ((0, 21, 0x7FF), (1, 10, 0x7FF), (2, 0, 0x3FF))])
    whole = F.lit(0).cast("long")
    small = met.where(F.col("n") <= split).select("fp", "node", (F.col("kind") * 4).alias("kind"), "key", whole.alias("i"), whole.alias("j"))
    parted = met.where(F.col("n") > split).select("fp", "node", F.explode(thirds).alias("k")).select("fp", "node", "k.kind", "k.key")
    counts = saved(parted.groupBy("kind", "key").agg(F.ceil(F.count("*") / lanes).alias("blocks"), F.count("*").alias("n")).where("n > 1"), "counts")
    own = parted.join(counts.drop("n"), ["kind", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    paired = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = paired.select("fp", "node", "kind", "key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    keys = ["kind", "key", "i", "j"]
    return small.unionByName(large).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_edges, "u long, v long")


def _labelled(made: DataFrame) -> DataFrame:
    """(fp, doc_id, root): each distinct fingerprint, its least doc_id and its component's least fingerprint."""
    distinct = saved(made.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("node"))))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document; components join fingerprints within distance 2."""
    made = saved(fingerprints(docs), "fingerprints")
    labelled = saved(_labelled(made), "labelled")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return made.join(labelled.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (a null one only if there is no other)."""
    made = saved(fingerprints(docs), "fingerprints")
    labelled = _labelled(made)
    kept = labelled.groupBy("root").agg(F.min_by(F.struct("doc_id", "fp"), F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("k")).select("k.*")
    fp, at, own = fresh(docs, "fp"), fresh(docs, "kept_id"), fresh(docs, "kept_fp")
    rows = _with_fingerprint(docs, fp)
    met = rows.join(kept.select(F.col("doc_id").alias(at), F.col("fp").alias(own)), (F.col(fp) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(at)), "left_semi")
    return met.dropDuplicates(["doc_id", fp]).drop(fp)


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, name])

    return docs.mapInArrow(made, schema)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
