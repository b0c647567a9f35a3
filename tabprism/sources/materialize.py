"""Materialised derived tables (A2) and saved parameter tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path`` if it exists; else build it, write it, and read it back.

    A table counts as there when its writer committed it (``_SUCCESS``).  It is
    written beside the path and renamed, so a failed build leaves nothing that
    is read or that blocks the next one.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    done = jvm.Path(target, "_SUCCESS")
    if not fs.exists(done):
        building = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
        build().write.parquet(building)
        if fs.exists(target) and not fs.exists(done):
            fs.delete(target, True)         # what an uncommitted writer left
        if fs.exists(done) or not fs.rename(jvm.Path(building), target):
            fs.delete(jvm.Path(building), True)     # another writer was faster
        if not fs.exists(done):
            raise OSError(f"table {path!r} could not be moved into place")
    return spark.read.parquet(path)
