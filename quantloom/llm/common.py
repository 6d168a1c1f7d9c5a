"""Shared helpers of the training-data operators: the cluster's shared folder, staged tables, row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: dict[str, list[tuple[SparkSession, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (tests) a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        sc.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found


def new_folder(spark: SparkSession, name: str, scope: str = "query") -> str:
    """A fresh folder in the shared one. Folders of a scope go with ``release(scope)``."""
    path = f"{shared_dir(spark).rstrip('/')}/quantloom/{name}-{uuid.uuid4().hex}"
    _ROOTS.setdefault(scope, []).append((spark, path))
    return path


def release(scope: str) -> None:
    """Delete the staged tables of a scope. Frames that read them can't be used after that."""
    for spark, path in _ROOTS.pop(scope, []):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str, scope: str = "query") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and a lost executor
    costs no recomputation of what came before."""
    path = new_folder(df.sparkSession, name, scope)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(uri: str) -> str:
    """Path of a shared folder that workers open as files (memory maps); other schemes can't be mapped."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on all workers, not {uri}")
    return unquote(at.path)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def row_key(*cols: str) -> Column:
    """64-bit key of a row; unlike the columns themselves never null, so it joins null ids too."""
    return F.xxhash64(*[F.col(c) for c in cols])


def fold(doc_id: str = "doc_id", of: int = 5) -> Column:
    """crc32(doc_id as text) mod ``of``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of, F.lit(0)).cast("int")


def ranked(df: DataFrame, group: tuple[str, ...], *order: Column, scope: str = "query") -> DataFrame:
    """Add ``idx``, each row's place from 0 in its group by ``order``, and ``size``, the group's rows.

    Rows are range-partitioned by group and order, so that a group of any size is spread over tasks. A row's place is its
    place in its partition and the sizes of the partitions before. ``group`` columns must not be null (there may be none).
    """
    rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("_part", F.shiftright("_at", 33)), "ordered", scope)
    parts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    each = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # as many rows as partitions
    before = F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(each).alias("size"))
    rows = rows.join(staged(parts, "places", scope), [*group, "_part"])
    return rows.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
