"""Streaming application of fitted row-local transforms, fixed or from a versioned parameter table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabprism.sources.params import Fitted, load_version


def stream_source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """File-folder stream with a fixed schema (no inference on a stream)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(stream: DataFrame, *transforms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chain fitted transforms (e.g. ``features.transform``, ``scoring.score_linear``)
    over a streaming DataFrame.  Each must be row-local; the result is still a stream."""
    out = stream
    for t in transforms:
        out = t(out)
    return out


def write_stream(scored: DataFrame, path: str, checkpoint: str | None = None,
                 trigger_once: bool = False):
    """Start an exactly-once parquet file sink for a scored stream.

    The query's progress lives in ``checkpoint``, by default a folder beside the
    sink, named after it: a restarted query resumes where it stopped instead of
    rescoring or skipping files.
    """
    ck = checkpoint or path.rstrip("/") + ".checkpoint"
    w = (scored.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", ck).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def write_versioned_stream(stream: DataFrame, params_path: str, apply: Callable[[DataFrame, Fitted], DataFrame], path: str,
                           checkpoint: str | None = None, trigger_once: bool = False):
    """Score every micro-batch with the parameters that are the latest when it starts (``sources.params.publish_fitted``).

    A refit reaches the running query with its next batch; ``params_version``
    tells which one scored a row.  Each batch goes to a folder of its own,
    ``batch_id=n``, overwritten if the batch runs again, so a restarted query
    leaves every row once — scored by one version, the last run's.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        params, version = load_version(batch.sparkSession, params_path)
        scored = apply(batch, params).withColumn("params_version", F.lit(version).cast("long"))
        scored.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    ck = checkpoint or path.rstrip("/") + ".checkpoint"
    w = stream.writeStream.foreachBatch(score).option("checkpointLocation", ck)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
