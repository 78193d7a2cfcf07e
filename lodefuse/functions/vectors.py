"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def softmax(a: Column, scale: float = 100.0) -> Column:
    """Probabilities of scaled logits, stable against large ones."""
    top = F.array_max(a)
    powers = F.transform(a, lambda x: F.exp((x - top) * scale))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def triage(labels: list[str], scores: Column, keep: set[str], threshold: float = 0.35, margin: float = 0.05) -> Column:
    """The best label, unless it is unsure or barely ahead of one to keep: then the best one to keep."""
    p = softmax(scores)
    pairs = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("label"), p.alias("p"))
    best = F.element_at(F.array_sort(pairs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0)), 1)
    kept = F.element_at(F.array_sort(F.filter(pairs, lambda x: x["label"].isin(*keep)), lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0)), 1)
    return F.when((best["p"] < threshold) | (best["p"] - kept["p"] < margin), kept["label"]).otherwise(best["label"])
