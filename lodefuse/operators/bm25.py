"""BM25 over several text columns: an inverted index that is built once, and a scan for tables that are searched once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.functions.text import ACCENTED, FOLDED, fold

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NO_MATCH = 1e9
TOKEN = r"([\p{L}\p{N}]+)"
#: Folders that the index's terms are dealt to; a query opens those of its terms.
BUCKETS = 32
#: Tokens of a bucket beyond which it is written by several tasks.
BUCKET_TOKENS = 20_000_000
#: Places of one column lie so far from the next column's that no phrase spans both.
COLUMN_BITS = 40


def _tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(fold(column), F.lit("")), F.lit(TOKEN), F.lit(1))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def phrases(keywords: list[str]) -> list[list[str]]:
    """Keywords as token lists; quotes and blank ones are dropped."""
    table = str.maketrans(ACCENTED, FOLDED)
    found = [re.findall(r"[^\W_]+", k.replace('"', "").lower().translate(table)) for k in keywords]
    return [f for f in found if f]


def build(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Writes the index: postings (bucket, term, key, dl, places) by bucket, and one row of statistics.

    Each text is read and split once. A term's postings lie in one bucket, ordered by term;
    of large indexes a bucket is written by several tasks.
    """
    spark = df.sparkSession
    made = df.select(F.col(key).alias("key"), F.array(*[_tokens(F.col(c)) for c in columns]).alias("t"))
    made = made.withColumn("dl", F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.size(x)))
    spread = made.select("key", "dl", F.posexplode("t").alias("col", "own")).select("key", "dl", "col", F.posexplode("own").alias("pos", "term"))
    place = F.shiftleft(F.col("col").cast("long"), COLUMN_BITS) + F.col("pos")
    postings = spread.groupBy("term", "key", "dl").agg(F.sort_array(F.collect_list(place)).alias("places"))  # a list is as long as its own text at most
    stats = df.select(_sum([F.size(_tokens(F.col(c))) for c in columns]).cast("long").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("tokens"))
    stats.coalesce(1).write.parquet(f"{path}/stats")
    salts = 1 + (spark.read.parquet(f"{path}/stats").first()["tokens"] or 0) // (BUCKETS * BUCKET_TOKENS)
    dealt = postings.withColumn("bucket", _bucket(F.col("term"))).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    dealt.repartition(BUCKETS, "bucket", "salt").sortWithinPartitions("bucket", "term").drop("salt").write.partitionBy("bucket").parquet(f"{path}/postings")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """A built index."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.stats = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "stats"))

    def score(self, keywords: list[str], key: str = "listing_id") -> DataFrame:
        """(key, score) of documents that match any keyword; more negative is better.

        Only the buckets of the keywords' terms are opened, and of these the terms' row groups.
        """
        wanted = phrases(keywords)
        if not wanted:
            return self.postings.where(F.lit(False)).select(F.col("key").alias(key), F.lit(0.0).alias("score"))
        terms = sorted({t for p in wanted for t in p})
        buckets = self.postings.sparkSession.range(1).select(*[_bucket(F.lit(t)) for t in terms]).first()  # one row of as many numbers
        own = self.postings.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("term").isin(terms))
        per = {t: F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"t{i}") for i, t in enumerate(terms)}
        rows = own.groupBy("key", "dl").agg(*per.values())
        at = {t: F.col(f"t{i}") for i, t in enumerate(terms)}

        def tf(phrase: list[str]) -> Column:
            met = at[phrase[0]]
            for j, t in enumerate(phrase[1:], 1):
                met = F.array_intersect(met, _back(at[t], j))
            return F.coalesce(F.size(met), F.lit(0))

        rows = rows.select("key", "dl", F.array(*[F.when(reduce(Column.__and__, [at[t].isNotNull() for t in p]), tf(p)).otherwise(0) for p in wanted]).alias("tf"))
        found = _scored(rows, self.stats, len(wanted))
        return found.select(F.col("key").alias(key), "score")


def _back(places: Column, n: int) -> Column:
    return F.transform(places, lambda x: x - n)


def _counts(column: Column, wanted: list[list[str]]) -> Column:
    """struct(n, tf): a text's tokens, and how often each phrase stands in it. Tokens are made once."""

    def tf(t: Column, phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.size(F.filter(t, lambda x: x == phrase[0]))
        here = lambda x, i: reduce(lambda a, j: a & (F.get(t, i + j) == phrase[j]), range(1, len(phrase)), x == phrase[0])
        return F.size(F.filter(t, lambda x, i: F.coalesce(here(x, i), F.lit(False))))

    made = F.transform(F.array(_tokens(column)), lambda t: F.struct(F.size(t).alias("n"), F.array(*[tf(t, p) for p in wanted]).alias("tf")))
    return F.element_at(made, 1)


def _scored(rows: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """Adds the score to rows (key, dl, tf) of phrases; stats is the corpus's one row (n, avgdl)."""
    dfs = rows.agg(F.array(*[F.count_if(F.col("tf")[p] > 0) for p in range(n)]).alias("df"))
    hits = rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats.select("n", "avgdl"))).crossJoin(F.broadcast(dfs))  # one row each

    def part(p: int) -> Column:
        f, d = F.col("tf")[p], F.col("df")[p]
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    return hits.withColumn("score", -_sum([part(p) for p in range(n)]))


def score(df: DataFrame, key: str, columns: list[str], keywords: list[str]) -> DataFrame:
    """(key, score) as Index.score gives, by two scans of the texts: for a table that is searched once."""
    wanted = phrases(keywords)
    if not wanted:
        return df.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    own = df.select(F.col(key), *[_counts(F.col(c), wanted).alias(f"c{i}") for i, c in enumerate(columns)])
    total = lambda pick: _sum([pick(F.col(f"c{i}")) for i in range(len(columns))])
    rows = own.select(key, total(lambda c: c["n"]).alias("dl"), F.array(*[total(lambda c, p=p: c["tf"][p]) for p in range(len(wanted))]).alias("tf"))
    return _scored(rows, rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), len(wanted)).select(key, "score")
