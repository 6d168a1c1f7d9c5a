"""Frames written and read again, so that loops over them don't grow their plans and lost executors cost one step."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, on local masters alone, a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        sc.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/quantloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
