"""Diversification: Pareto frontier and maximal marginal relevance."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodefuse.sources.shared import stored

#: Rows of a block that is cut to its own frontier.
BLOCK_ROWS = 1000
#: Blocks that are merged to one.
MERGED = 16


def pareto(df: DataFrame, key: str, minimise: list[str], maximise: list[str] = ()) -> DataFrame:
    """Rows that no other row dominates; null is worst, equal rows stay together.

    Rows are first cut to the frontier of their own block, in parallel; frontiers are then
    merged block by block, so that no task compares more than a few frontiers.
    """
    axes = [F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) for c in minimise] + [F.coalesce(-F.col(c).cast("double"), F.lit(float("inf"))) for c in maximise]
    names = [f"axis{i}" for i in range(len(axes))]
    own = df.withColumns(dict(zip(names, axes, strict=True)))
    no_worse = reduce(Column.__and__, [F.col(f"o_{n}") <= F.col(n) for n in names])
    better = reduce(Column.__or__, [F.col(f"o_{n}") < F.col(n) for n in names])
    blocked = own.withColumn("block", F.pmod(F.xxhash64(key), F.lit(max(1, own.count() // BLOCK_ROWS))))
    if len(names) == 2:  # a running minimum of the second axis in order of the first tells most dominated rows apart
        before = Window.partitionBy("block").orderBy(names[0]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        local = blocked.withColumn("least", F.min(names[1]).over(before)).where(F.col(names[1]) <= F.col("least")).drop("least")
    else:
        others = blocked.select(F.col("block").alias("o_block"), *[F.col(n).alias(f"o_{n}") for n in names]).distinct()
        local = blocked.join(others, (F.col("block") == F.col("o_block")) & no_worse & better, "left_anti")
    return _merged(local, names, no_worse & better).drop("block", *names)


def _merged(local: DataFrame, names: list[str], worse: Column) -> DataFrame:
    """Frontiers of blocks merged two by two, each time cut to the frontier of both."""
    now = stored(local, "frontier")
    blocks = now.agg(F.max("block")).first()[0] or 0
    while True:
        now = now.withColumn("block", F.floor(F.col("block") / MERGED).cast("long"))
        others = now.select(F.col("block").alias("o_block"), *[F.col(n).alias(f"o_{n}") for n in names]).distinct()
        now = stored(now.join(others, (F.col("block") == F.col("o_block")) & worse, "left_anti"), "frontier")
        blocks //= MERGED
        if not blocks:
            return now


def mmr(pool: DataFrame, key: str, relevance: str, dims: dict[str, float | None], k: int, lam: float = 0.7) -> DataFrame:
    """(key, place): greedy choice of k, relevance against the likeness to those chosen.

    dims: by column, the bucket width of a number (to the nearest multiple, half to even) or
    None for a category. A null dimension differs by nothing but counts; a null relevance is 0.
    Of equals the first in order of relevance and key wins. The choice is sequential by
    nature, so the pool, a page's candidates, is held by one task, all of it.
    """
    if not 0 <= lam <= 1:
        raise ValueError("lambda must lie between 0 and 1")
    kind = dict(pool.dtypes)[key]

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows[relevance] = rows[relevance].fillna(0.0)
        rows = rows.sort_values([relevance, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        marks = {c: rows[c].where(rows[c].notna(), None) if width is None else (rows[c] / width).round().where(rows[c].notna()) for c, width in dims.items()}
        left, picked = list(range(len(rows))), []
        far = [1.0] * len(rows)  # the least distance to those picked
        while left and len(picked) < k:
            best = max(left, key=lambda i: (lam * rows[relevance][i] + (1 - lam) * far[i], -i))
            picked.append(best)
            left.remove(best)
            for i in left:
                apart = sum(1.0 for m in marks.values() if pd.notna(m[i]) and pd.notna(m[best]) and m[i] != m[best]) / max(1, len(dims))
                far[i] = apart if len(picked) == 1 else min(far[i], apart)
        return pd.DataFrame({key: rows[key][picked].values, "place": range(1, len(picked) + 1)})

    return pool.select(key, F.col(relevance).cast("double").alias(relevance), *dims).groupBy().applyInPandas(chosen, f"{key} {kind}, place int")
