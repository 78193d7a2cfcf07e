"""What the corpus operators share: shared-folder tables and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One whitespace-delimited word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch, which the executor's JVM makes outside its heap and doubles as it grows.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are bounded; fewer rows stay as they are."""
    conf, name = spark.conf, "spark.sql.execution.arrow.max{}PerBatch"
    if not 0 < int(conf.get(name.format("Records"))) <= BATCH_ROWS:
        conf.set(name.format("Records"), str(BATCH_ROWS))
    conf.set(name.format("Bytes"), str(BATCH_BYTES))


def give_back() -> None:
    """Returns to the system what a worker that is used again has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where none is set and all runs on this machine."""
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
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already at exit
        pass


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df lacks, whatever its case."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], most: int = 2 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes of text, or of a single longer text: what a worker holds doesn't depend on batches."""
    give_back()  # of the task before
    for batch in batches:
        own = batch.column(name)
        sizes = own.cast(pa.large_binary()) if own.type != pa.large_binary() else own
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def slim(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that extra ones, whatever their names, never clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def literal_rows(spark: SparkSession, schema: str, rows: list) -> DataFrame:
    """A small table made of a literal, so that no Python rows take part in the plan."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(":".join(f.split(" ", 1)) for f in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def stored_rows(spark: SparkSession, schema: str, rows: list, tag: str) -> DataFrame:
    """A table of rows that the driver made, as a file in the shared folder: plans stay small, and no Python rows take part."""
    names = [f.split()[0] for f in schema.split(", ")]
    path = shared_path(spark, tag)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/rows.json")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        for r in rows:
            out.write((json.dumps(dict(zip(names, r, strict=True))) + "\n").encode())
    finally:
        out.close()
    return spark.read.schema(schema).json(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body or a lambda in it names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
