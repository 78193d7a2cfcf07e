"""Tables that plans store for themselves, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where none is set and all runs on this machine."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='lodefuse-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already at exit
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path there, removed when this process ends."""
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written and read again: computed once, and a lost executor costs nothing that came before."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
