"""Audit aggregates: coverage, histograms, curves, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, total): one pass over the table, a row for each column."""
    one = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot("total", columns, "field", "filled").select("field", "filled", "total")


def sources(state: DataFrame) -> DataFrame:
    return state.groupBy("field", "source").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n) of values from 0 to 1; the last bin is closed, empty bins are 0."""
    own = df.where(F.col(column).between(0, 1)).groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def log_histogram(df: DataFrame, column: str) -> DataFrame:
    """(magnitude, n): by the floor of the decimal logarithm."""
    return df.where(F.col(column) > 0).groupBy(F.floor(F.log10(column)).cast("int").alias("magnitude")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, by: list[str], column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    p = df.groupBy(*by).agg(F.percentile(column, list(at)).alias("p"))
    return p.select(*by, *[F.get("p", F.lit(i)).alias(f"p{round(100 * q)}") for i, q in enumerate(at)])


def isochrone(df: DataFrame, minutes: str, upto: int = 90) -> DataFrame:
    """(t, reachable): how many rows lie within t minutes, for each t."""
    counts = df.where(F.col(minutes) <= upto).groupBy(F.greatest(F.lit(1), F.ceil(minutes)).cast("int").alias("t")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, upto + 1).select(F.col("id").cast("int").alias("t")).join(counts, "t", "left")
    return every.select("t", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("t")).alias("reachable"))  # `upto` rows


def profile(df: DataFrame, column: str) -> DataFrame:
    """Null share, inferred class, distinct values and range of a text column."""
    c = F.col(column)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(c.isNull()).alias("nulls"),
        F.count_distinct(c).alias("distinct_values"),
        F.when(F.count_if(~F.rlike(c, F.lit(r"^-?\d+$"))) == 0, "int").when(F.count_if(~F.rlike(c, F.lit(r"^-?\d+(\.\d+)?$"))) == 0, "float").otherwise("text").alias("class"),
        F.min(c).alias("least"),
        F.max(c).alias("greatest"),
        F.avg(c.try_cast("double")).alias("mean"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, n): a column's most frequent values, of equally frequent ones the least."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def lift(raw: DataFrame, state: DataFrame, fields: list[str]) -> DataFrame:
    """(field, raw, enriched, total): how many rows have a value before and after enrichment; a column that raw lacks has none."""
    total = F.count("*").alias("total")
    has = lambda f: F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")) if f in raw.columns else F.lit(0).cast("long")
    before = raw.agg(total, *[has(f).alias(f) for f in fields]).unpivot(["total"], fields, "field", "raw")
    after = state.where(F.col("field").isin(fields) & ~F.col("source").isin("UNKNOWN", "UNKNOWN-pending", "DROPPED_bad_data")).groupBy("field").agg(F.count("*").alias("enriched"))
    return before.join(after, "field", "left").select("field", "raw", F.coalesce("enriched", F.lit(0)).alias("enriched"), "total")


def answerable(df: DataFrame, questions: dict[str, Column]) -> DataFrame:
    """(question, n, total, share): on how many rows each question can be answered, by a condition on one row."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(q) for q, c in questions.items()])
    return counts.unpivot(["total"], list(questions), "question", "n").select("question", "n", "total", (F.col("n") / F.col("total")).alias("share"))


def scatter(points: DataFrame, gazetteer: DataFrame, box: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """((kind, n) of a gazetteer, the points whose latitude and longitude lie in the box)."""
    kinds = gazetteer.groupBy("kind").agg(F.count("*").alias("n"))
    return kinds, points.where(" AND ".join(f"{c} BETWEEN {low} AND {high}" for c, (low, high) in box.items()))


def store_checks(images: DataFrame, vectors: DataFrame, allowed: dict[str, list[str]], seen: int | None = None) -> DataFrame:
    """(check, bad): a vector store's nine invariants, each with how many rows break it.

    images: (image_id, index_kind, label); vectors: (image_id, index_kind, embedding); seen: files on disk, if counted.
    """
    kinds = sorted(k for k in allowed if k != "dropped")
    rows = images.groupBy("index_kind").agg(F.count("*").alias("n"))
    stored = vectors.groupBy("index_kind").agg(F.count("*").alias("v"))
    gaps = rows.join(stored, "index_kind", "full").select("index_kind", F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("v", F.lit(0))).alias("bad"))
    wrong = lambda k: (F.col("index_kind") == k) & ~F.coalesce(F.col("label").cast("string").isin(allowed[k]), F.lit(False))
    of_images = images.agg(
        F.abs(F.count("*") - F.lit(seen)).alias("rows_on_disk") if seen is not None else F.lit(0).cast("long").alias("rows_on_disk"),
        *[F.count_if(wrong(k)).alias(f"labels_{k}") for k in sorted(allowed)],
        (F.count("image_id") - F.count_distinct("image_id")).alias("repeated_ids"),
    )
    from lodefuse.functions.vectors import norm

    broken = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    of_vectors = vectors.agg(F.count_if(broken).alias("not_finite"), F.count_if(~broken & ~norm(F.col("embedding")).between(0.99, 1.01)).alias("not_unit"))
    long = lambda df: df.unpivot([], df.columns, "check", "bad")
    counted = gaps.where(F.col("index_kind").isin(kinds)).select(F.concat(F.lit("rows_"), "index_kind").alias("check"), "bad")
    return long(of_images).unionByName(long(of_vectors)).unionByName(counted)


def repeated(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def vector_checks(vectors: DataFrame, dim: int, low: float = 0.99, high: float = 1.01) -> DataFrame:
    """Counts of vectors of a wrong size, not finite, not of unit length, and of repeated ids."""
    from lodefuse.functions.vectors import norm

    n = norm(F.col("embedding"))
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count("*").alias("rows"), F.count_if(F.size("embedding") != dim).alias("wrong_size"), F.count_if(bad).alias("not_finite"), F.count_if(~n.between(low, high)).alias("not_unit"), (F.count("*") - F.count_distinct("vec_id")).alias("repeated_ids"))


def first_examples(df: DataFrame, label: str, key: str, n: int = 5) -> DataFrame:
    by = Window.partitionBy(label).orderBy(key)
    return df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select(label, key, "place")
