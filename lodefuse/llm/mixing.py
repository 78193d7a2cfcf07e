"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents fall into about sqrt(n) blocks by a hash; a permutation of a
source's blocks decides which of them its quota of words takes, whole blocks first and the
last one in part. The blocks drawn, counted by source, are then split among output shards
by a binary tree: at each node the left half's share is a multivariate-hypergeometric draw
from the node's quotas, made source by source by inversion, so shards get exact, disjoint
block quotas whose sums are the whole. The tree is drawn by the driver down to as many nodes
as a bounded table holds; below, each node's blocks are permuted and dealt evenly to its
shards, which has the same law, so shards keep their size however large the mix is. Within a
shard rows have a shuffle key of their own.

The tables that plan this are small by construction: one row per source (at most
``MAX_SOURCES``, checked) and, while drawing, one row per block, sqrt(n) of a source with n
documents. No task ever holds a source: the only rows ordered by a window are a source's
blocks, a node's blocks, and the documents of a source's one partly taken block. Rows that are
repeated are counted and numbered first, so that copies fall into different blocks.

Edge cases: null text has size 0; very long texts are counted whole; a null source is a
source, last in order; sources without words have target 0; rows with equal doc_id, source
and text are interchangeable; ties of hashes go by block, then doc_id; a null doc_id is an id
like others; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodefuse.llm.common import WORD, fresh, literal_rows, saved, slim, stored_rows, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Words of an output shard, and nodes that the driver's tree may have, alone and times the sources.
SHARD_WORDS = 4_000_000
NODES, QUOTAS = 4096, 2_000_000
#: Sources that a mix may have; beyond, they should be grouped first.
MAX_SOURCES = 10_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's words: its weight's part of share * all, at most `most` times its size, the excess reshared."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from good and bad items are good: inversion outwards from the mode."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    f = math.lgamma
    log = f(good + 1) - f(mode + 1) - f(good - mode + 1) + f(bad + 1) - f(draws - mode + 1) - f(bad - draws + mode + 1) - (f(good + bad + 1) - f(draws + 1) - f(good + bad - draws + 1))
    p = math.exp(log)
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
        if pu < 1e-300 and pd < 1e-300:
            break
    return mode


def splitting_tree(quotas: list[int], shards: int, seed: int = 0) -> list[list[int]]:
    """Block quotas of each source in each shard: rows sum to near equal shard sizes, columns exactly to the quotas."""
    out: list[list[int]] = []

    def split(own: list[int], n: int, path: int) -> None:
        if n == 1:
            out.append(own)
            return
        total, half = sum(own), n // 2
        draws, rest = total * half // n, total
        rng, left = random.Random(f"{seed}/{path}"), []
        for q in own:  # multivariate: conditional draws, source by source
            k = hypergeometric(rng, q, rest - q, draws)
            left.append(k)
            draws, rest = draws - k, rest - q
        split(left, half, 2 * path)
        split([q - k for q, k in zip(own, left, strict=True)], n - half, 2 * path + 1)

    split(list(quotas), shards, 1)
    return out


def _word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken, shards) of every document.

    `weights` repeat over the sources by code point, null last. `taken` is the words the mix
    takes of the document, repeats counted: whole times its size, and in a source's last
    block a part of one document, so that each source's words are its target rounded.
    `shards` lists (shard, words, key): where each taking goes, and its place there by key.
    """
    spark = docs.sparkSession
    counted = slim(docs, "doc_id", "source", "text").select("doc_id", "source", F.xxhash64("text").alias("text_hash"), _word_count(F.col("text")).alias("size"))
    copies = counted.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("n"))
    numbered = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    rows = saved(numbered.withColumn("h", F.xxhash64("doc_id", "source", "text_hash", "copy", F.lit(seed))).drop("copy"), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix takes at most {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    plan = []
    for r, t in zip(found, goal, strict=True):
        size, words = r["size"], round(t)
        full = words // size if size else 0
        plan.append((r["source"], size, float(t), int(full), int(words - full * size), max(1, math.isqrt(r["n"]))))
    sources = F.broadcast(literal_rows(spark, "s string, source_size long, target double, full long, quota long, blocks long", plan))
    own = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.pmod("h", "blocks"))

    # a source's blocks in permuted order: which the quota takes whole, and which in part
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("source", "block", "quota", "full").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).withColumn("block_quota", F.greatest(F.lit(0), F.least("words", F.col("quota") - F.col("before"))))
    drawn = saved(blocks, "blocks")

    # quotas of block takings by source, split among shards; a source's takings in order go to the shards' disjoint runs
    counts = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum(F.col("full") + (F.col("block_quota") > 0).cast("long")).alias("n")).collect()}
    shards = shards or max(1, math.ceil(sum(goal) / SHARD_WORDS))
    nodes = max(1, min(NODES, QUOTAS // max(1, len(found)), shards))
    each = math.ceil(shards / nodes)
    matrix = splitting_tree([counts.get(r["source"], 0) for r in found], nodes, seed)
    edges = []
    for i, r in enumerate(found):
        at, cuts = 0, []
        for row in matrix:
            at += row[i]
            cuts.append(at)
        edges.append((r["source"], cuts))
    cuts = F.broadcast(stored_rows(spark, "s string, cuts array<long>", edges, "cuts"))  # at most QUOTAS numbers
    count = F.col("full") + (F.col("block_quota") > 0).cast("long")
    place = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(seed + 2)), "block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = drawn.withColumn("first", F.coalesce(F.sum(count).over(place), F.lit(0))).join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shard = lambda k: F.aggregate("cuts", F.lit(0), lambda a, c: a + (c <= F.col("first") + k).cast("int"))
    takes = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), shard)).otherwise(F.array().cast("array<int>"))
    dealt = dealt.select(F.col("source").alias("s"), F.col("block").alias("b"), "block_quota", "words", takes.alias("takes"))
    if each > 1:
        dealt = _deeper(dealt, each, seed)

    met = own.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    whole = met.where("block_quota = 0 OR block_quota = words").withColumn("part", F.when(F.col("block_quota") > 0, F.col("size")).otherwise(0).cast("long"))
    # the one partly taken block of each source: sqrt(n) documents, in hash order
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("h", F.lit(seed + 3)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    partly = met.where("block_quota > 0 AND block_quota < words").withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    partly = partly.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("block_quota") - F.col("before"))).cast("long")).drop("before")
    all_rows = whole.unionByName(partly)
    words = lambda i: F.when(i < F.col("full"), F.col("size")).otherwise(F.col("part"))
    listed = F.transform("takes", lambda s, i: F.struct(s.alias("shard"), words(i).alias("words"), F.xxhash64("h", i, F.lit(seed + 4)).alias("key")))
    return all_rows.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"), F.filter(listed, lambda x: x["words"] > 0).alias("shards"))


def _deeper(dealt: DataFrame, each: int, seed: int) -> DataFrame:
    """Takings of nodes as takings of shards: a node's blocks in permuted order, dealt evenly to `each` shards."""
    long = dealt.select("s", "b", F.posexplode("takes").alias("i", "node"))
    node = Window.partitionBy("node")
    place = F.row_number().over(node.orderBy(F.xxhash64("b", "s", "i", F.lit(seed + 5)), "s", "b", "i")) - 1
    below = F.floor(place * each / F.count("*").over(node)).cast("long")
    shards = long.withColumn("shard", F.col("node").cast("long") * each + below)
    again = shards.groupBy("s", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "shard"))), lambda x: x["shard"]).alias("takes")).select(F.col("s").alias("s2"), F.col("b").alias("b2"), "takes")  # a taking a round of a source
    met = dealt.drop("takes").join(again, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")), "left").drop("s2", "b2")
    return met.withColumn("takes", F.coalesce("takes", F.array().cast("array<long>")))


def mixed_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: docs' columns, a row for each taking, shards apart and shuffled within; a part is a text's first words, a space between."""
    names = docs.columns
    row, shard, key, words, n = (fresh(docs, c) for c in ("row", "shard", "key", "words", "n"))
    # plain equal columns, so that join and removal of repeats share one exchange of the texts
    at, no, of, none, h = (fresh(docs, f"mix_{c}") for c in ("id", "no_id", "source", "no_source", "hash"))
    keyed = {at: F.coalesce("doc_id", F.lit(0).cast("long")), no: F.col("doc_id").isNull(), of: F.coalesce("source", F.lit("")), none: F.col("source").isNull()}
    columns = [c.alias(k) for k, c in keyed.items()]
    takes = mixed.select("doc_id", "source", "text_hash", "size", F.explode("shards").alias("t"))
    takes = takes.select(*columns, F.col("text_hash").alias(h), F.col("size").alias(n), F.col("t.shard").alias(shard), F.col("t.words").alias(words), F.col("t.key").alias(key))
    own = docs.select(*columns, F.xxhash64("text").alias(h), F.struct(*[F.col(f"`{c}`") for c in names]).alias(row)).dropDuplicates([*keyed, h])
    met = takes.join(own, [*keyed, h])
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(row)["text"], F.lit(WORD), F.lit(0)), F.lit(1), F.col(words).cast("int")), " ")
    text = F.when(F.col(words) == F.col(n), F.col(row)["text"]).otherwise(part)
    cut = F.char_length(text).cast("long")
    changed = {"text": text} | ({"n_chars": F.coalesce(cut, F.col(row)["n_chars"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    met = met.repartition(shard).sortWithinPartitions(shard, key, at)
    return met.select(*[changed.get(c, F.col(row)[c]).alias(c) for c in names])


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shards")
