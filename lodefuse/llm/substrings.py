"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the 10-word grams of each 50-word window the least is chosen
(rightmost of equals), so two documents that share a window share its anchor at the same
place in it. Anchors found in one document only are discarded by one aggregation. Around
each remaining anchor a document's run of windows is described by rolling hashes, one per
place of the window's start, which is how far a match extends both ways. Runs first extend
against the smallest document that holds the anchor; what that one lacks extends against the
smallest of those that start alike, and windows still left over meet by their hash. Flagged windows of a document merge to maximal repeats, and their words go.

Documents with equal word sequences are settled beforehand by a digest of the sequence, so a
large group of copies costs one row each. No pairs within an anchor's group are made: work
is linear in its rows, and joins on anchors and digests are plain shuffle joins of stored
tables that can be split. Windows are told apart by 64-bit hashes of their words, whole
sequences by 128-bit digests.

Edge cases: null and empty texts have no words; documents under 50 words stay whole; very
long texts are hashed in overlapping stretches; of equal hashes the rightmost is the anchor;
a null
doc_id is neither smaller nor larger than any other, so such rows neither remove nor lose
words; repeated rows (equal doc_id) do not remove each other; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.llm.common import parts, saved, slim, table, texts

WINDOW = 50
GRAM = 10
#: Times that runs are extended against the smallest document's before single windows meet by hash.
ROUNDS = 3
#: Words that are hashed at once; longer documents are taken in overlapping stretches.
STRETCH = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _tables:
        _tables[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[size]


def rolling(hashes: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the hashes of all runs of so many words (polynomial modulo 2**64, mixed)."""
    up, down = _power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    out = []
    for n in lengths:
        h = (sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def chosen(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams, the place of the least one (by its upper 40 bits), rightmost of equals."""
    key = (grams & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    rest = width - span
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    return (np.uint64(0xFFFFFF) - (key & np.uint64(0xFFFFFF))).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    return np.fromiter(map(digest, words), np.uint64, len(words))


def stretches(words: list[bytes], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window's place, window hashes, gram hashes, chosen gram of each window) for stretches of a document."""
    for at in range(0, max(0, len(words) - window + 1), STRETCH):
        own = words[at : at + STRETCH + window - 1]
        windows, grams = rolling(word_hashes(own), (window, gram))
        yield at, windows, grams, chosen(grams, window - gram + 1)


def _seeds(window: int, gram: int):
    names = ["doc_id", "digest", "n_words", "kept_sha256", "anchors"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            digests, n_words, shas, anchors = [], [], [], []
            for text in texts(batch):
                words = text.split()  # of bytes: the six ASCII white-space characters
                joined = b" ".join(words)
                digests.append(hashlib.blake2b(joined, digest_size=16).digest())
                n_words.append(len(words))
                shas.append(hashlib.sha256(joined).hexdigest())
                found = [np.unique(grams[np.unique(places)]) for _, _, grams, places in stretches(words, window, gram)]
                anchors.append(np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, anchors)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *anchors])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), flat], names=names)

    return made


def _runs(window: int, gram: int):
    """Rows of candidates (doc_id, digest, text, anchors) to runs of windows that a shared anchor stands for."""
    names = ["anchor", "doc_id", "digest", "at", "first", "hashes"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows: list[list] = [[] for _ in names]
            shared_lists = batch.column("anchors")
            for k, (doc_id, digest, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), texts(batch), strict=True)):
                shared = np.asarray(shared_lists[k].values).view(np.uint64)
                for base, windows, grams, places in stretches(text.split(), window, gram):
                    anchor = grams[places]
                    hit = np.isin(anchor, shared)
                    same = np.flatnonzero((places[1:] != places[:-1])) + 1
                    for a, b in zip([0, *same.tolist()], [*same.tolist(), len(places)], strict=True):
                        if hit[a]:
                            for column, value in zip(rows, (int(anchor[a].view(np.int64)), doc_id, digest, base + a, int(places[a]) - a, windows[a:b].view(np.int64)), strict=True):
                                column.append(value)
            if rows[0]:
                hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows[5])]), pa.int32()), pa.array(np.concatenate(rows[5])))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int32()), hashes], names=names)

    return made


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each run with the base run of its anchor: windows that both have, and those left over.

    `first` is how far the anchor lies behind the run's first window, so equal places around
    the anchor have equal differences of place and `first`. What the base's own document has
    again is dropped if the base is the anchor's smallest document (`final`), as no smaller one
    can hold it then; otherwise it is left over like windows that differ.
    """
    names = ["doc_id", "digest", "anchor", "start", "length", "offset", "left"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        own, base = batch.column("hashes"), batch.column("base_hashes")
        for k, (anchor, doc_id, digest, at, first, base_id, base_first, final) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("anchor", "doc_id", "digest", "at", "first", "base_id", "base_first", "final")], strict=True)):
            mine, other = np.asarray(own[k].values), np.asarray(base[k].values)
            lo = max(0, first - base_first)  # places of mine that the base has too
            hi = min(len(mine), first - base_first + len(other))
            equal = np.zeros(len(mine), bool)
            if hi > lo:
                shift = base_first - first
                equal[lo:hi] = mine[lo:hi] == other[lo + shift : hi + shift]
            if doc_id == base_id and not final:
                equal[:] = False  # a smaller document may still hold what both places do
            cuts = [0, *(np.flatnonzero(equal[1:] != equal[:-1]) + 1).tolist(), len(mine)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                hit = bool(equal[a])
                if hit and doc_id == base_id:
                    continue  # another place in the smallest document: nothing smaller holds it
                for column, value in zip(rows, (doc_id, digest, anchor, at + a, b - a if hit else 0, first - a, None if hit else mine[a:b].tolist()), strict=True):
                    column.append(value)
        if rows[0]:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)


def _cut(window: int):
    names = ["doc_id", "digest", "n_removed", "kept_sha256", "kept"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows: list[list] = [[] for _ in names]
            for doc_id, digest, text, repeats in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), texts(batch), batch.column("repeats").to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in repeats:
                    edge[r["start"]] += 1
                    edge[r["start"] + r["length"] + window - 1] -= 1
                keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                for column, value in zip(rows, (doc_id, digest, len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    return made


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, candidates, repeats): each document's summary, the texts that may hold repeats,
    and the runs of windows (doc_id, digest, start, length) that start in a smaller document too."""
    docs = slim(docs, "doc_id", "text")
    seeds = saved(docs.mapInArrow(_seeds(window, gram), "doc_id long, digest binary, n_words long, kept_sha256 string, anchors array<long>"), "seeds")
    # stored, so that the join deals both sides by digest and document, and no large group of copies meets in one task
    least = saved(seeds.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL"), "least")
    own = seeds.join(least, ["digest", "doc_id"]).select("doc_id", "digest", F.explode("anchors").alias("anchor"))
    shared = own.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    wanted = own.join(shared, "anchor").groupBy("doc_id", "digest").agg(F.collect_set("anchor").alias("anchors"))
    # of rows with one doc_id and different texts each is looked up by its own digest
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    candidates = saved(docs.join(wanted, "doc_id").withColumn("text_sha", digest).dropDuplicates(["doc_id", "digest", "text_sha"]).drop("text_sha").mapInArrow(_matching, "doc_id long, digest binary, text string, anchors array<long>"), "candidates")
    runs = saved(candidates.mapInArrow(_runs(window, gram), "anchor long, doc_id long, digest binary, at long, first int, hashes array<long>"), "runs")
    matched, kept = [], []
    for n in range(ROUNDS):
        # first all runs of an anchor against its smallest document's; then what that left, by the window it starts with
        key = ["anchor"] if not n else ["anchor", "first", "hash"]
        runs = runs.withColumn("hash", F.get("hashes", F.lit(0)))
        base = runs.groupBy(*key).agg(F.min_by(F.struct("doc_id", "digest", "at", "first", "hashes"), F.struct("doc_id", "digest", "at")).alias("b"))
        if n:  # unlike an anchor's smallest document, these may hold windows of smaller ones that start otherwise
            kept.append(base.select("anchor", *[F.col(f"b.{c}").alias(c) for c in ("doc_id", "digest", "at", "first", "hashes")]))
        base = base.select(*key, F.col("b.doc_id").alias("base_id"), F.col("b.digest").alias("base_digest"), F.col("b.at").alias("base_at"), F.col("b.first").alias("base_first"), F.col("b.hashes").alias("base_hashes"))
        base = saved(base, "base")  # so that the join below deals both sides itself and splits what a frequent anchor holds
        met = runs.join(base, key).where("NOT (doc_id = base_id AND at = base_at AND digest = base_digest)")
        extended = saved(met.select("anchor", "doc_id", "digest", "at", "first", "hashes", "base_id", "base_first", "base_hashes", F.lit(n == 0).alias("final")).mapInArrow(_extended, "doc_id long, digest binary, anchor long, start long, length long, offset int, left array<long>"), "extended")
        matched.append(extended.where("length > 0").select("doc_id", "digest", "start", "length"))
        runs = extended.where("left IS NOT NULL").select("anchor", "doc_id", "digest", F.col("start").alias("at"), F.col("offset").alias("first"), F.col("left").alias("hashes"))
    rest = functools.reduce(DataFrame.unionByName, kept, runs)
    single = rest.select("doc_id", "digest", "anchor", "at", "first", F.posexplode("hashes").alias("i", "hash"))
    single = single.select("doc_id", "digest", "anchor", (F.col("at") + F.col("i")).alias("start"), (F.col("first") - F.col("i")).alias("offset"), "hash")
    key = ["anchor", "offset", "hash"]
    low = single.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(*key, "lo")
    more = single.join(low, key).where("doc_id > lo").select("doc_id", "digest", "start", F.lit(1).cast("long").alias("length"))
    found = functools.reduce(DataFrame.unionByName, matched, more)
    return seeds, candidates, found


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the texts whose word sequence has the digest they were looked up by."""
    for batch in parts(batches):
        keep = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() == d for t, d in zip(texts(batch), batch.column("digest").to_pylist(), strict=True)]
        yield batch.select(["doc_id", "digest", "text", "anchors"]).filter(pa.array(keep, pa.bool_()))


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document; kept is null where nothing or everything is kept."""
    seeds, candidates, found = repeats(docs, window, gram)
    # a document's runs are at most as many as its words
    merged = found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "length")).alias("repeats"))
    cut = candidates.join(merged, ["doc_id", "digest"]).select("doc_id", "digest", "text", "repeats").mapInArrow(_cut(window), "doc_id long, digest binary, n_removed long, kept_sha256 string, kept string")
    cut = cut.select("doc_id", "digest", F.col("n_removed").alias("cut_n"), F.col("kept_sha256").alias("cut_sha"), "kept")
    # copies of a smaller document's whole word sequence lose all of it
    least = seeds.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")).where("n > 1").select("digest", "least_id")
    least = saved(least, "copies")
    all_rows = seeds.drop("anchors").join(least, "digest", "left").join(cut, ["doc_id", "digest"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False))
    return all_rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_n", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "kept_sha256")).alias("kept_sha256"),
        F.when(~copy, F.col("kept")).alias("kept"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
least AS (SELECT h, min(doc_id) AS lo FROM w GROUP BY h),
hit AS (SELECT w.doc_id, w.i FROM w JOIN least USING (h) WHERE w.doc_id > least.lo),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM d),
k AS (SELECT p.doc_id, p.p, p.word, gone.p IS NOT NULL AS removed FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p),
a AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
