"""Plan-time column selection (no data is read)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in table order, minus the excluded roles (id, targets, categoricals)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in ex]


def exclude_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """All columns minus the listed ones, by name only (no type test)."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The subset of ``cols`` that exists in ``df`` (optional-column guard)."""
    have = set(df.columns)
    return [c for c in cols if c in have]
