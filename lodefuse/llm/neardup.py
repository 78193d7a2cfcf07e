"""Near duplicates by word shingles: links at a Jaccard similarity of 0.8 or more, complete and exact.

A text is the set of its 5-word shingles. Two sets of similarity 0.8 share one of the first
n // 5 + 1 shingles of either in any common order (prefix filter), so nothing is left to
chance. The order puts shingles that a sample shows often last, which only keeps meetings few.

SimHash comes first: each set has the fingerprint of ``simhash`` over its 5-word shingles, and
fingerprints within its radius are found on bit planes as in ``op5``. No radius is complete
for a similarity of 0.8, so the prefix filter adds what SimHash leaves apart, and all
candidates of both are held against their sets.

What meets at a shingle is compared by fingerprints whose distance is a bound, not an estimate: bit i is
the parity of the shingles that hash to i, so two fingerprints differ in at most as many
bits as their sets differ in members, and alike sets stay within (a + b) / 9 bits. A
fingerprint has four to eight bits for each member of its set and folds to fewer. Where few
nodes meet at a shingle all their pairs are compared; where many meet, each is compared with
the smallest, and after components are known, bit planes of the members are compared with
carry-save counters, blocks abandoned once all lanes are beyond the radius, which gives
spanning candidates and never all pairs. Candidates are then held against their sets. Where
a candidate fails that stood for others, a round more gives the next ones, ever more at once.

Equal sets are one node. Groups of any size are split: frequent shingles by a salt, long
runs by stretches, and planes by pairs of blocks.

Edge cases: null and empty texts are alike; a text with fewer than five words is one shingle;
a very long text is a larger set, never cut; ties of doc_id and of size go to the lesser hash;
of repeated rows one stays; a null doc_id stays only where its group has no other; an
empty table gives no rows. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefuse.llm.common import fresh, parts, saved, slim, texts
from lodefuse.llm.components import components
from lodefuse.llm.simhash import Planes, links, simhash
from lodefuse.llm.substrings import rolling, word_hashes

SHINGLE = 5
#: Nodes at a shingle up to which all their pairs are compared.
FEW = 16
#: Texts that are looked at for frequent shingles, in how many of them one counts as such, and how many are told apart.
SAMPLE, OFTEN, HOT = 4096, 4, 20_000
#: Parts that the nodes of a frequent shingle are dealt to, and nodes of one shingle that a task holds at once.
SALTS, STRETCH = 64, 1 << 16
#: Nodes of a shingle that are compared as one block of bit planes.
LANES = 1024
#: Candidates that a node gives for each other component, and by how many times a round gives more than the one before.
WIDTH, MORE = 2, 8
#: Lanes from which on planes are cheaper than one comparison a lane.
WORTH = 64
#: Bits of the smallest fingerprint.
LEAST_BITS = 64
#: Slots of the coarse filter before texts are looked up.
SLOTS = 1 << 18


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's word shingles, A-Z lower-cased."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(words), (min(SHINGLE, len(words)),))[0])


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether sets of a and b members with so many in common have similarity 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def sketch(own: np.ndarray) -> bytes:
    """A set's parity fingerprint, bit i first in byte i // 8; four to eight bits for each member, a power of two."""
    bits = max(LEAST_BITS, 4 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(fp: int, bits: int, to: int) -> int:
    """A fingerprint of `bits` bits as one of `to` bits: parities of parts add."""
    while bits > to:
        bits //= 2
        fp = (fp >> bits) ^ (fp & ((1 << bits) - 1))
    return fp


def close(fp: int, bits: int, size: int, other: int, other_bits: int, other_size: int) -> bool:
    """Whether two sets can be alike by size and fingerprint; never wrong about sets that are."""
    both = size + other_size
    if 9 * abs(size - other_size) > both:
        return False
    least = min(bits, other_bits)
    return 9 * (folded(fp, bits, least) ^ folded(other, other_bits, least)).bit_count() <= both


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *[x.view(np.int64) for x in arrays]])))


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that a sample of the texts holds often; they only set the order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *map(shingles, texts(batch))]).view(np.int64))], names=["sh"])

    step = max(1, docs.count() // SAMPLE)
    seen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text").distinct().mapInArrow(made, "sh long")
    top = seen.groupBy("sh").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "sh").limit(HOT)
    return np.sort(np.array([r["sh"] for r in top.collect()], np.int64).view(np.uint64))


_SIGNATURE = "doc_id long, text_key long, node long, size int, fp long, sketch binary, prefix array<long>, often array<long>"


def _signatures(hot: np.ndarray):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in parts(batches):
            nodes, sizes, fps, sketches, prefixes, often = [], [], [], [], [], []
            for text in texts(batch):
                own = shingles(text)
                late = np.isin(own, hot)
                n = len(own) // 5 + 1
                nodes.append(digest(own.tobytes()))
                sizes.append(len(own))
                fps.append(simhash(own))
                sketches.append(sketch(own))
                prefixes.append(own[~late][:n])
                often.append(own[late][: n - len(prefixes[-1])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), _lists(prefixes), _lists(often)],
                names=["doc_id", "text_key", "node", "size", "fp", "sketch", "prefix", "often"],
            )

    return made


def _by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for x in own:
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(x[a] for x in own)
            if key != last and held:
                yield pa.concat_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sh, salt, size, node) to pairs (a, b, sh null) to compare, and members (a, b null, sh) of shingles where many meet.

    Of a shingle that is salted, or of which a task has more than STRETCH rows, all are members."""
    names = ["a", "b", "sh"]
    rest: list[np.ndarray] = []
    long = False

    def runs(sh: np.ndarray, salt: np.ndarray, size: np.ndarray, node: np.ndarray, part: bool) -> pa.RecordBatch:
        other = (sh[1:] != sh[:-1]) | (salt[1:] != salt[:-1])
        new = np.concatenate([[True], other | (node[1:] != node[:-1])])
        first = np.concatenate([[True], other])[new]
        sh, salt, size, node = sh[new], salt[new], size[new], node[new]
        cuts = np.append(np.flatnonzero(first), len(sh))
        a, b, members, at = [], [], [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            many = part or salt[lo] >= 0 or hi - lo > FEW
            if hi - lo < 2 and not many:
                continue
            n, s = node[lo:hi], size[lo:hi]
            if not many:
                i, j = np.triu_indices(hi - lo, 1)
                near = 4 * s[j] <= 5 * s[i]
                a.append(n[i[near]])
                b.append(n[j[near]])
            else:
                k = 0
                while k < len(n):  # the smallest, and those that its size allows
                    stop = max(k + 1, int(np.searchsorted(s, 5 * int(s[k]) // 4, "right")))
                    a.append(np.full(stop - k - 1, n[k]))
                    b.append(n[k + 1 : stop])
                    k = stop
                members.append(n)
                at.append(sh[lo:hi])
        one, two, many_, key = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b, members, at))
        gap = lambda x, y: pa.chunked_array([x, y]).combine_chunks()
        null = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, many_])), gap(pa.array(two), null(len(many_))), gap(null(len(one)), pa.array(key))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sh", "salt", "size", "node")]
        now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)] if rest else now
        own = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(own[-1]) + 1 if len(own) else 0  # the last run may go on
        if cut and long:  # what ends a run of which stretches went before
            end = int(np.argmax((now[0] != now[0][0]) | (now[1] != now[1][0])))
            yield runs(*[x[:end] for x in now], True)
            now, cut, long = [x[end:] for x in now], cut - end, False
        if cut:
            yield runs(*[x[:cut] for x in now], False)
        rest = [x[cut:] for x in now]
        if len(rest[0]) > STRETCH:
            yield runs(*rest, True)
            rest, long = [x[-1:] for x in rest], True  # its last node stands for the run
    if rest:
        yield runs(*rest, long)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that can be alike by their fingerprints."""
    for batch in batches:
        one, two = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))
        size_a, size_b = (batch.column(c).to_pylist() for c in ("size_a", "size_b"))
        number = lambda x: int.from_bytes(x, "little")
        keep = [close(number(x), 8 * len(x), m, number(y), 8 * len(y), n) for x, y, m, n in zip(one, two, size_a, size_b, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.column("set_a"), batch.column("set_b")
        found = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            x, y = one[k].values.to_numpy(), two[k].values.to_numpy()
            found[k] = alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["u", "v", "alike"])


def joining(labels: np.ndarray, near: Callable[[int], list[int]], width: int = 1) -> list[tuple[int, int]]:
    """Index pairs that join labels along `near`: each join is made by `width` pairs of one index, or all that it has."""
    labels = np.unique(labels, return_inverse=True)[1]
    largest = int(np.argmax(np.bincount(labels)))
    chief = int(np.flatnonzero(labels == largest)[0])
    out = []
    for q in np.flatnonzero(labels != largest).tolist():  # of two that differ one isn't with the chief
        if labels[q] == labels[chief]:
            continue
        given: dict[int, int] = {}
        for k in near(q):
            if labels[k] != labels[q]:
                out.append((q, k))
                gone, to = labels[k], labels[q]
                given[gone] = given.get(gone, 0) + 1
                if given[gone] < width:
                    continue
                if gone == labels[chief]:
                    gone, to = to, gone
                labels[labels == gone] = to
    return out


def by_planes(sketches: list[bytes], sizes: np.ndarray, lanes: int = 512, worth: int = WORTH) -> Callable[[int], list[int]]:
    """For each index those that can be alike, by bit planes of blocks of like sizes."""
    order = np.lexsort((np.array([len(s) for s in sketches]), sizes))
    values = [int.from_bytes(s, "little") for s in sketches]
    blocks, at = [], 0
    while at < len(order):
        first = order[at]
        stop = at + 1
        while stop < len(order) and stop - at < lanes and len(sketches[order[stop]]) == len(sketches[first]) and 8 * sizes[order[stop]] <= 9 * sizes[first] + 8:
            stop += 1
        own = order[at:stop]
        planes = {}
        if len(own) >= worth:
            planes[8 * len(sketches[first])] = Planes(np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(len(own), -1))
        blocks.append((own.tolist(), planes, 8 * len(sketches[first]), int(sizes[own[0]]), int(sizes[own[-1]])))
        at = stop

    def near(q: int) -> list[int]:
        size, bits, out = int(sizes[q]), 8 * len(sketches[q]), []
        for own, planes, width, low, high in blocks:
            if 4 * low > 5 * size or 5 * high < 4 * size:
                continue
            if not planes:
                out += [k for k in own if k != q and close(values[q], bits, size, values[k], width, int(sizes[k]))]
                continue
            least = min(bits, width)
            while least not in planes:
                planes[min(planes) // 2] = planes[min(planes)].folded()
            found = planes[least].near(folded(values[q], bits, least), planes[least].all, (size + high) // 9)
            while found:
                lane = (found & -found).bit_length() - 1
                found &= found - 1
                k = own[lane]
                if k != q and close(values[q], bits, size, values[k], width, int(sizes[k])):
                    out.append(k)
        return out

    return near


def _joined(width: int):
    """For each run of (sh, i, j): pairs that join its components by fingerprints; `wrong` lists a node's partners that sets refused."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _by_key(batches, ("sh", "i", "j")):
            nodes, labels, sh = (run.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "sh"))
            if len(nodes) < 2 or (labels == labels[0]).all():
                continue
            near = by_planes(run.column("sketch").to_pylist(), run.column("size").to_numpy(zero_copy_only=False))
            wrong = [frozenset(x or ()) for x in run.column("wrong").to_pylist()]
            some = lambda q: [k for k in near(q) if int(nodes[k]) not in wrong[q]]  # noqa: B023, E731
            pairs = np.array(joining(labels, some, width), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]]), pa.array(sh[pairs[:, 0]])], names=["u", "v", "sh"])

    return made


def _in_blocks(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """rows (sh, node, ...) once for each pair of blocks that its block takes part in, sorted by (sh, i, j); sizes has (sh, n)."""
    dealt = rows.join(sizes, "sh").withColumn("blocks", F.ceil(F.col("n") / most)).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).drop("n", "blocks", "own", "o")
    return dealt.repartition("sh", "i", "j").sortWithinPartitions("sh", "i", "j", "node")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) by the SimHash of (node, fp): equal fingerprints with their least node, others within the radius by bit planes."""
    heads = saved(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = nodes.select("fp", F.col("node").alias("b")).join(heads.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    return same.unionByName(links(heads).select(F.col("u").alias("a"), F.col("v").alias("b")))


def _sets(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes, made again from one text each."""
    where = saved(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_key"), "wanted")
    slots = np.sort(np.array([r["s"] for r in where.select(F.pmod("text_key", F.lit(SLOTS)).alias("s")).distinct().collect()], np.int64))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # only spares the shuffle texts
        for batch in batches:
            yield batch.filter(pa.array(np.isin(np.mod(batch.column("text_key").to_numpy(zero_copy_only=False), SLOTS), slots)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists([*map(shingles, texts(batch))])], names=["node", "set"])

    own = keyed.mapInArrow(likely, keyed.schema)
    met = own.join(where.withColumnRenamed("doc_id", "at"), "text_key").where(F.col("doc_id").eqNullSafe(F.col("at")))
    return saved(met.dropDuplicates(["node"]).select("node", "text").mapInArrow(made, "node long, set array<long>"), "sets")


def _held(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, alike): pairs (a, b) held against their sets."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}"))
    return saved(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_checked, "u long, v long, alike boolean"), "held")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _row(no: str = "no", doc: str = "doc_id", key: str = "text_key") -> Column:
    return F.min(F.struct(no, doc, key)).alias("m")


def _labelled(keyed: DataFrame, made: DataFrame) -> DataFrame:
    """(node, doc_id, text_key, root): each distinct set, the row that stands for it and its component."""
    made = made.withColumn("no", F.col("doc_id").isNull()).withColumn("at", F.coalesce("doc_id", F.lit(0).cast("long")))
    first = made.groupBy("node").agg(_row(doc="at")).select("node", "m.no", "m.at", "m.text_key")
    nodes = saved(made.join(first, ["node", "no", "at", "text_key"], "left_semi").dropDuplicates(["node", "no", "at", "text_key"]).select("node", "doc_id", "text_key", "size", "fp", "sketch", "prefix", "often"), "nodes")
    cold = nodes.select(F.explode("prefix").alias("sh"), F.lit(-1).cast("long").alias("salt"), "size", "node")
    hot = nodes.select(F.explode("often").alias("sh"), F.pmod("node", F.lit(SALTS)).cast("long").alias("salt"), "size", "node")
    met = saved(cold.union(hot).repartition("sh", "salt").sortWithinPartitions("sh", "salt", "size", "node").mapInArrow(_met, "a long, b long, sh long"), "met")
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}"))
    pairs = met.where("b IS NOT NULL").select("a", "b").unionByName(simhash_pairs(nodes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = saved(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_close, "a long, b long"), "close")
    edges = _held(pairs, _sets(keyed, nodes, _ends(pairs))).where("alike").select("u", "v")
    # where many meet, only nodes that are in different components by now can still matter
    many = met.where("b IS NULL").select(F.col("a").alias("node"), "sh").distinct()
    found = components(edges)
    wrong, width = None, WIDTH
    while True:
        more, sizes = _open(many, found)
        rows = more.join(nodes.select("node", "size", "sketch"), "node")
        if wrong is None:
            rows = rows.withColumn("wrong", F.lit(None).cast("array<long>"))
        else:  # only partners that sets have refused already, of nodes that have such
            both = wrong.select(F.col("u").alias("node"), "v").union(wrong.select(F.col("v").alias("node"), F.col("u").alias("v")))
            rows = rows.join(both.groupBy("node").agg(F.collect_list("v").alias("wrong")), "node", "left")
        seen = saved(_in_blocks(rows, sizes, LANES).mapInArrow(_joined(width), "u long, v long, sh long"), "candidates")
        new = seen.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        if seen.isEmpty():
            break
        held = _held(new, _sets(keyed, nodes, _ends(new)))
        found = _relabelled(found, held.where("alike"))
        failed = held.where("NOT alike").select("u", "v")
        if failed.isEmpty():
            break
        wrong, width = failed if wrong is None else wrong.unionByName(failed), width * MORE
        # a pair that stood for others is none: only where it did more can be missing
        ends = failed.select("u", "v")
        at = seen.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sh").join(ends, ["u", "v"], "left_semi").select("sh").distinct()
        many = saved(many.join(at, "sh", "left_semi"), "many")
    return nodes.join(found, "node", "left").select("node", "doc_id", "text_key", F.coalesce("component", "node").alias("root"))


def _relabelled(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with components joined along links (u, v): only components that are linked are looked at."""
    label = lambda at: found.select(F.col("node").alias(at), F.col("component").alias(f"{at}_of"))
    met = links.select("u", "v").join(label("u"), "u", "left").join(label("v"), "v", "left")
    between = met.select(F.coalesce("u_of", "u").alias("u"), F.coalesce("v_of", "v").alias("v"))
    moved = components(between).select(F.col("node").alias("old"), F.col("component").alias("new"))
    known = found.join(moved, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    # what stood for itself is a node of its own there
    alone = moved.select(F.col("old").alias("node"), F.col("new").alias("component")).join(found, "node", "left_anti")
    return saved(known.unionByName(alone), "components")


def _open(many: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sh, node, label) of shingles whose nodes are in several components, and (sh, n) of these."""
    own = saved(many.join(found, "node", "left").select("sh", "node", F.coalesce("component", "node").alias("label")), "many")
    sizes = saved(own.groupBy("sh").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("sh", "n"), "open")
    return own.join(sizes.select("sh"), "sh", "left_semi"), sizes


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the least doc_id (a null one only if there is no other)."""
    keyed = slim(docs, "doc_id", "text").withColumn("text_key", _text_key())
    made = saved(keyed.mapInArrow(_signatures(_frequent(slim(docs, "doc_id", "text"))), _SIGNATURE), "signatures")
    rows = _labelled(keyed, made).withColumn("no", F.col("doc_id").isNull())
    kept = rows.groupBy("root").agg(_row()).select("m.*")
    # plain equal columns, so that join and removal of repeats share one exchange of the texts
    at, no, key = fresh(docs, "kept_id"), fresh(docs, "kept_no"), fresh(docs, "kept_key")
    put = lambda df, k: df.withColumn(at, F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn(no, F.col("doc_id").isNull()).withColumn(key, k)
    rows = put(docs, _text_key()).join(put(kept, F.col("text_key")).select(at, no, key), [at, no, key], "left_semi")
    return rows.dropDuplicates([at, no, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
