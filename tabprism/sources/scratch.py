"""Scratch locations under the session's shared checkpoint folder (never a machine-local path)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tabprism.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex}"
