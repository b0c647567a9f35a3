"""One-pass multi-column aggregation, returned in long form.

The reference computes statistics column by column (several scans per column).
Here every statistic of every column is one expression inside a single
``agg`` (partial aggregation map-side, one tiny shuffle), and the one wide
result row is turned into one row per column with ``inline``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprism.functions.expressions import nan_to_null

StatFn = Callable[[Column], Column]

#: Columns per ``agg`` before the work is split into several passes; keeps the
#: generated code and the aggregation buffer of very wide tables bounded.
MAX_COLUMNS_PER_PASS = 64


def column_stats(df: DataFrame, cols: Sequence[str], stats: dict[str, StatFn],
                 by: Sequence[str] = (), name_col: str = "column_name",
                 index_col: str | None = "column_idx") -> DataFrame:
    """One row per (group, column) with one field per statistic.

    Inputs are cast to double so that every column yields the same struct type;
    NaN counts as missing.
    """
    by = list(by)
    parts = []
    for start in range(0, len(cols), MAX_COLUMNS_PER_PASS):
        chunk = list(enumerate(cols))[start:start + MAX_COLUMNS_PER_PASS]
        aggs = [fn(nan_to_null(F.col(c).cast("double"))).alias(f"_s{i}_{k}")
                for i, c in chunk for k, fn in stats.items()]
        wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        structs = []
        for i, c in chunk:
            fields = [F.lit(c).alias(name_col)]
            if index_col:
                fields.append(F.lit(i).alias(index_col))
            fields += [F.col(f"_s{i}_{k}").alias(k) for k in stats]
            structs.append(F.struct(*fields))
        parts.append(wide.select(*by, F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
            name_col: str = "column_name", value_col: str = "value",
            cast: str = "double") -> DataFrame:
    """Wide → long: one row per (input row, column). Narrow, no shuffle."""
    structs = [F.struct(F.lit(c).alias(name_col), F.col(c).cast(cast).alias(value_col))
               for c in cols]
    return df.select(*keep, F.inline(F.array(*structs)))
