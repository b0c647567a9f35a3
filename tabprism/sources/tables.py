"""Parquet table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Columnar scan; column pruning and filter pushdown come from Catalyst."""
    return spark.read.parquet(table_path(sf_dir, name))
