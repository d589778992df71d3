"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder takes its place on one machine; on a cluster, whose
    executors would each write to their own disk, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset; {master} needs a folder that its executors share")
        found = f"file://{_own_dir()}"
    return found


@cache
def _own_dir() -> str:
    made = tempfile.mkdtemp(prefix="rowcraft-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in that folder; ``drop_scratch`` deletes what is written there."""
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what was written to new paths; call it once results are stored."""
    context = spark.sparkContext
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on what produced it: it is computed once,
    however often it is used, and a lost executor costs a read, not a rerun.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
