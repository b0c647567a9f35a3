"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabprism.sources.scratch import scratch_path

#: The ASCII letters, for lower-casing that leaves other alphabets alone.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def materialise(df: DataFrame, name: str, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` into the session's shared folder and read it back.

    Cuts lineage with a table that outlives any executor; later jobs read
    only the columns they use.  ``partition_by`` names a column with a folder per value.
    """
    path = scratch_path(df.sparkSession, name)
    write = df.write.option("compression", compression)
    (write.partitionBy(partition_by) if partition_by else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType,
                rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``rows`` cuts batches to that many rows at most."""
    def run(batches):
        for b in batches:
            step = rows or max(1, b.num_rows)
            for i in range(0, b.num_rows, step):
                yield from fn(b.slice(i, step))
    return df.mapInArrow(run, schema)


def process_cache() -> dict:
    """Objects that live as long as the Python worker, which Spark reuses for many tasks.

    Task functions travel by value, so their own module globals are new in
    every task; a named module of the process is not.
    """
    return sys.modules.setdefault("_llm_process_cache", types.ModuleType("_llm_process_cache")).__dict__


def free_tag(columns: list[str]) -> str:
    """A prefix that no column begins with: names of columns that are gone again at the end."""
    tag = "_"
    while any(c.startswith(tag) for c in columns):
        tag += "_"
    return tag


def strings(batch: pa.RecordBatch, name: str) -> list:
    """A string column as Python strings, null as the empty text."""
    return [v or "" for v in batch.column(name).to_pylist()]


def first_rows(rows: DataFrame, known: DataFrame, most: int) -> tuple[DataFrame, dict[tuple, int]]:
    """The first ``most`` rows of (_key, text) whose _key is in the small table ``known``: a fixed sample.

    Order: hash of _key, _key, hash of text, then the other columns of ``known``.
    Returns the distinct rows with their text hash ``_text`` and, by (_text, _key,
    other columns), how often each counts.
    """
    extra = [c for c in known.columns if c != "_key"]
    names = ["_text", "_key", *extra]
    met = rows.join(F.broadcast(known), "_key").select(F.xxhash64("text").alias("_text"), "_key", *extra, "text")
    counted = (met.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
               .orderBy(F.xxhash64("_key"), "_key", "_text", *extra).limit(most).collect())
    counts, left = {}, most
    for r in counted:
        if left > 0:
            counts[tuple(r[c] for c in names)] = min(left, r["_n"])
            left -= r["_n"]
    spark, schema = rows.sparkSession, met.select(*names).schema
    chosen = F.broadcast(spark.createDataFrame(list(counts), schema))
    return met.join(chosen, names, "left_semi").distinct(), counts


def size_partitions(df: DataFrame, weight: Column, per_partition: int) -> int:
    """Partitions that hold about ``per_partition`` of ``weight`` each (one small aggregate)."""
    total = df.agg(F.sum(weight).alias("w")).first()["w"] or 0
    return max(1, int(-(-int(total) // per_partition)))
