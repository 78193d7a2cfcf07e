"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's words are hashed, each k words in a row by a cyclic polynomial of their hashes (a
rolling hash), and of each window of w such grams the least is chosen, rightmost of equals.
Chosen grams keep their places, so any run of w + k - 1 words that two texts share makes
them share a fingerprint entry. Window minima are taken by doubling, three passes for w = 8.

Texts of fewer than k words have one gram of all their words. The likeness of two texts is
the Jaccard index of their sets of chosen hashes (1 for two texts without words).

The next document is found by dealing rows to ranges of doc_id, one shuffle of the texts.
Ranges grow in number with the rows: quantiles cut the ids, and each part is cut evenly as
often as it takes. A range's last document meets the next range's first, whose text alone is
read and fingerprinted once more. Rows that are repeated are one row with a number until the end.

Edge cases: null text is empty; very long texts are fingerprinted whole; equal texts have
equal fingerprints; rows of equal doc_id follow each other by text, so a repeated row's next
document is its twin; rows with a null doc_id come last; of a single row the next document is
itself; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodefuse.llm.common import let, saved, slim, table

GRAM = 3
WINDOW = 8  # a power of two
#: Rows of a range of doc_id, and quantiles that ids are cut at before parts are cut evenly.
RANGE_ROWS = 4096
QUANTILES = 1024
_LONGS = "array<long>"


def _rotate(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n else x


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Chosen grams in order: the upper 32 bits of the hash, then 31 bits of the place counted backwards."""
    none = F.array().cast(_LONGS)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def rolled(h: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(h) - (gram - 1))
        # short texts: absent words count as 0
        part = lambda i, j: _rotate(F.coalesce(F.get(h, i + j), F.lit(0).cast("long")), gram - 1 - j)

        def one(x: Column, i: Column) -> Column:
            out = _rotate(x, gram - 1)
            for j in range(1, gram):
                out = out.bitwiseXOR(part(i, j))
            # upper bits of a mixed hash, then the place counted backwards: the least is rightmost of equals
            return F.shiftleft(F.shiftrightunsigned(F.xxhash64(out), 32), 31).bitwiseOR(F.lit(2**31 - 1) - i.cast("long"))

        return F.transform(F.slice(h, F.lit(1), n), one)

    def halved(own: Column, span: int) -> Column:
        reach = F.size(own) - span
        return F.when(reach > 0, F.transform(F.slice(own, F.lit(1), F.greatest(reach, F.lit(1))), lambda x, i: F.least(x, F.get(own, i + span)))).otherwise(F.array(F.array_min(own)))

    def minima(own: Column, span: int = 1) -> Column:
        return own if span == window else let(halved(own, span), lambda a: minima(a, 2 * span))

    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    made = lambda w: let(hashes(w), lambda h: let(rolled(h), lambda g: let(minima(g), once)))
    return let(words, lambda w: F.when(F.size(w) > 0, made(w)).otherwise(none))


def places(entries: Column) -> Column:
    """(hash, position) of each entry; the position is the gram's first word."""
    return F.transform(entries, lambda x: F.struct(F.shiftrightunsigned(x, 31).alias("hash"), (F.lit(2**31 - 1) - x.bitwiseAND(F.lit(2**31 - 1))).cast("int").alias("position")))


def digest(entries: Column) -> Column:
    """A short form of a fingerprint that is equal for equal ones."""
    return F.sha2(F.array_join(entries.cast("array<string>"), ","), 256)


def hash_set(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda x: F.shiftrightunsigned(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two hash sets."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, entries): each text's chosen grams with their places."""
    rows = slim(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", places(winnowed(F.col("text"))).alias("entries"))


def _range_of(cuts: list[int], low: int, high: int, even: int) -> Column:
    """A row's range of doc_id, in their order; -1 for null. cuts part low..high, and each part has `even` ranges."""
    edges = [low, *cuts, high + 1]
    step = math.isqrt(len(cuts)) + 1
    longs = lambda own: F.array(*[F.lit(x).cast("long") for x in own]).cast(_LONGS)
    below = lambda own: F.aggregate(own, F.lit(0), lambda a, c: a + (c <= F.col("doc_id")).cast("int"))
    fine = F.array(*[longs(cuts[i : i + step]) for i in range(0, len(cuts), step)] or [longs([])])
    coarse = let(below(longs(cuts[::step])), lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + below(F.get(fine, k - 1))))  # in two levels

    def inside(k: Column) -> Column:
        a, z = (F.get(longs(edges[i:]), k).cast("double") for i in (0, 1))
        part = F.floor((F.col("doc_id").cast("double") - a) / (z - a) * even).cast("long")
        return k.cast("long") * even + F.greatest(F.lit(0).cast("long"), F.least(part, F.lit(even - 1).cast("long")))

    return F.when(F.col("doc_id").isNull(), -1).otherwise(let(coarse, inside))


def _ranges(docs: DataFrame) -> Column:
    """Each row's range, from the ids of all rows."""
    seen = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if not seen["n"]:
        return F.lit(-1).cast("long")
    ranges = max(1, math.ceil(seen["n"] / RANGE_ROWS))
    parts = min(QUANTILES, ranges)
    cuts: list[int] = []
    if parts > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * QUANTILES).alias("q")).first()["q"]
        cuts = sorted({x for x in found if x > seen["low"]})
    return _range_of(cuts, seen["low"], seen["high"], math.ceil(ranges / (len(cuts) + 1)))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n): rows once each, with how often they come. Only repeated ones are shuffled."""
    keyed = docs.select("doc_id", "text", F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("at"), F.xxhash64("text").alias("key"))
    keys = ["no", "at", "key"]
    twice = saved(keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    once = keyed.join(twice, keys, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("n"))
    return once.unionByName(keyed.join(twice, keys).dropDuplicates(keys).select("doc_id", "text", "n"))


def with_next(docs: DataFrame, make: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """make(docs) of docs (doc_id, text, ...), row by row, with next_<c> of each carried column: of
    the next row by descending doc_id, then text; of the last, the first's."""
    bucket = _ranges(docs).cast("long")
    own = make(docs)
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    out = own.withColumn("bucket", bucket)
    out = out.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried} | {"last": F.lead("bucket").over(order).isNull()})
    # the first row of a range follows the last one of the range above; heads are a row a range
    heads = docs.select(bucket.alias("head"), "doc_id").groupBy("head").agg(F.max("doc_id").alias("top"))
    down = Window.orderBy(F.desc("head"))
    heads = saved(heads.withColumn("above", F.coalesce(F.lag("head").over(down), F.min("head").over(Window.partitionBy()))), "heads")
    firsts = docs.withColumn("bucket", bucket).join(heads, (F.col("bucket") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = make(firsts.select("above", *docs.columns)).groupBy("above").agg(F.min_by(F.struct(*carried), "text").alias("first"))
    met = out.join(saved(firsts, "firsts"), (F.col("bucket") == F.col("above")) & F.col("last"), "left")
    return met.select(*own.columns, *[F.when(F.col("last"), F.col(f"first.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carried])


def _made(text: str) -> Column:
    return let(winnowed(F.col(text)), lambda e: F.struct(digest(e).alias("fingerprint"), hash_set(e).alias("hashes")))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = distinct_rows(slim(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    make = lambda d: d.withColumn("made", _made("text")).select(*d.columns, "made.fingerprint", "made.hashes")
    met = with_next(docs, make, ["text", "hashes"])
    # of n equal rows all but one are followed by their twin
    twin = F.struct((F.col("n") - 1).alias("times"), F.col("text").alias("next_text"), F.col("hashes").alias("next_hashes"))
    other = F.struct(F.lit(1).cast("long").alias("times"), F.col("next_text"), F.col("next_hashes"))
    met = met.select("doc_id", "text", "fingerprint", "hashes", F.explode(F.when(F.col("n") > 1, F.array(twin, other)).otherwise(F.array(other))).alias("x")).select("doc_id", "text", "fingerprint", "hashes", "x.*")
    half = F.floor(F.char_length("text") / 2).cast("int")
    met = met.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.left("text", F.char_length("text") - half), F.left("next_text", half)))
    met = met.withColumn("edit", _made("edited"))
    out = met.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        F.col("edit.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edit.hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        F.size("hashes").alias("n_hashes"),
        "times",
    )
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "time")
