"""Vector stores: Parquet tables of unit vectors, checked when written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.functions.vectors import norm

DROPPED = ("dropped",)


def write(df: DataFrame, path: str, dim: int, low: float = 0.99, high: float = 1.01) -> None:
    """Writes (image_id, index_kind, embedding); fails on dropped classes, other sizes and vectors not of unit length."""
    ok = ~F.col("index_kind").isin(*DROPPED) & (F.size("embedding") == dim) & norm(F.col("embedding")).between(low, high)
    checked = df.withColumn("embedding", F.when(F.coalesce(ok, F.lit(False)), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("not to be stored: "), F.coalesce(F.col("image_id").cast("string"), F.lit("null"))))))
    checked.write.mode("overwrite").partitionBy("index_kind").parquet(path)


def read(spark: SparkSession, path: str, kind: str = "main") -> DataFrame:
    return spark.read.parquet(path).where(F.col("index_kind") == kind)
