"""Shared places on the cluster."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Empties what a Python worker remembers between tasks of one operator.
_REMEMBERED: list[Callable[[], None]] = []


def remembered(forget: Callable[[], None]) -> None:
    _REMEMBERED.append(forget)


def forget() -> None:
    """Called where another operator's task begins in a worker: memos of the one before only take room there."""
    for f in _REMEMBERED:
        f()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not found and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="folioframe-"))
    return found or context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """df computed once, in the shared checkpoint folder: a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as Parquet in the shared folder, read again; in a folder for each value of the columns `by`."""
    place = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(place)
    schema = StructType([f for f in df.schema if f.name not in by] + [df.schema[c] for c in by])
    return df.sparkSession.read.schema(schema).parquet(place)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that `written` has made and that nothing reads any more."""
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-"
    for folder in {root + f.split("/table-", 1)[1].split("/")[0] for f in df.inputFiles() if "/table-" in f}:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours within the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession) -> SparkSession:
    """spark, with this package's folder on the Python path of its workers."""
    home, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, environment.get("PYTHONPATH")) if x)
    return spark
