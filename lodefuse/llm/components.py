"""Connected components by alternating stars, as DataFrame joins over stored tables.

Each round writes its edges to the shared folder, so lineage stays short and lost executors
cost one round at most. No adjacency list is ever collected: a hub's edges stay separate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefuse.llm.common import saved


#: Edges of a stored file: few edges need few tasks.
FILE_EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): every neighbour v of u meets the least member of u's neighbourhood."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = around.join(least, "u")
    if large:
        return met.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (u, v bigint) that isn't its component's least node.

    Self loops and null ends are ignored; repeated edges count once; no edges give no rows.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if not seen["n"] or tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, files = tuple(seen), 1 + seen["n"] // FILE_EDGES
        now = saved(_star(saved(_star(now, True).coalesce(files), "edges"), False).coalesce(files), "edges")
    raise RuntimeError("the components did not settle")
