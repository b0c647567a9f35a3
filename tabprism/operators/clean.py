"""Cleaning and coercion: median imputation, keep-first de-duplication, numeric coercion, NA drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprism.functions.columns import present
from tabprism.functions.expressions import text_to_double, to_double
from tabprism.operators.quantiles import quantiles


def _missing(c: str, dtype: str):
    m = F.col(c).isNull()
    return m | F.isnan(F.col(c)) if dtype in ("double", "float") else m


def fit_medians(df: DataFrame, cols: Sequence[str], quantile_method: str = "select") -> dict[str, float | None]:
    """Median (linear interpolation, missing ignored) of each listed column present in ``df``.

    Absent columns are skipped.  One quantile pass; the result has one value
    per column, so bringing it to the driver is bounded.
    """
    cols = present(df, cols)
    if not cols:
        return {}
    rows = quantiles(df, cols, {"median": 0.5}, method=quantile_method).collect()
    return {r["column_name"]: r["median"] for r in rows}


def apply_medians(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Fill NULL/NaN of each fitted column with its median (columns become double)."""
    types = dict(df.dtypes)
    out = df
    for c, m in medians.items():
        if c not in types or m is None:
            continue
        out = out.withColumn(c, F.when(_missing(c, types[c]), F.lit(float(m)))
                             .otherwise(F.col(c).cast("double")))
    return out


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fit medians on ``df`` and fill it; columns without missing values keep type and values."""
    cols, types = present(df, cols), dict(df.dtypes)
    if not cols:
        return df
    gaps = df.agg(*[F.count_if(_missing(c, types[c])).alias(f"_n{i}") for i, c in enumerate(cols)]).first()
    return apply_medians(df, fit_medians(df, [c for i, c in enumerate(cols) if gaps[f"_n{i}"]]))


#: types that an aggregate holds in place, so that their minimum needs no sort
FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def row_digest(cols: Sequence[str], salt: int):
    """64-bit digest of several columns; a NULL is a value of its own."""
    return F.xxhash64(F.lit(salt), *[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def _least_rows(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(group, order) of the first row of each group: one minimum per order column, each among the rows the last one left.

    Joins are on the group and the order value together, so a group that
    holds a third of the rows is spread by its order values.
    """
    group, held = list(group), rows.select(*group, *order)
    for c in order:
        # NULL comes first, as in a sort
        least = held.groupBy(*group).agg(F.min(c).alias("_m"), F.max(F.col(c).isNull()).alias("_any")).select(
            *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.when(~F.col("_any"), F.col("_m")).alias("_m"))
        on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
        held = held.join(least, [*on, F.col(c).eqNullSafe(F.col("_m"))], "left_semi")
    return held


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], digest=row_digest) -> DataFrame:
    """One row per key — the first by ``order_by``, NULL first; tied rows are ordered by a hash of the row.

    Two steps: the least order values per 64-bit key digest (narrow rows, hash
    aggregates that combine before the shuffle), then a semi-join that brings
    only those rows.  Keys travel once, with the rows that stay.  A digest that
    stands for several keys (told by a second digest) is settled by the keys themselves.
    Order columns without a fixed width take ``min_by``.
    """
    keys, order_by = list(keys), list(order_by)
    types = dict(df.dtypes)
    if not all(types[c] in FIXED_WIDTH for c in order_by):
        rest = [c for c in df.columns if c not in keys]
        row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None)
        g = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(c) for c in order_by])).alias("_r"))
        return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
    order = [f"_o{i}" for i in range(len(order_by))] + ["_r"]
    tagged = df.select("*", digest(keys, 1).alias("_d"), digest(keys, 2).alias("_e"),
                       *[F.col(c).alias(o) for c, o in zip(order_by, order)], row_digest(df.columns, 3).alias("_r"))
    shared = (tagged.groupBy("_d").agg(F.min("_e").alias("_e0"), F.max("_e").alias("_e1"))
              .where(F.col("_e0") != F.col("_e1")).select(F.col("_d").alias("_c")))
    alone = F.col("_d") == F.col("_c")
    out = None
    for rows, group in ((tagged.join(shared, alone, "left_anti"), ["_d"]), (tagged.join(shared, alone, "left_semi"), keys)):
        least = _least_rows(rows, group, order)
        least = least.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate([*group, *order])])
        first = rows.join(least, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*group, *order])], "left_semi")
        # rows that are equal throughout
        first = first.distinct().select(*df.columns)
        out = first if out is None else out.unionByName(first)
    return out


def dedupe_dropped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows a keep-first de-duplication on ``keys`` removes."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_dropped"))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values that are not decimal numbers become NULL (so does NaN)."""
    out = df
    for c in present(df, cols):
        out = out.withColumn(c, text_to_double(c) if dict(df.dtypes)[c] == "string" else to_double(c))
    return out


def dropna_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C4: keep ``cols`` and drop rows with a missing value (NULL or NaN) in any of them."""
    return df.select(*cols).dropna(how="any")


def dropna_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows missing in ``subset``; other columns may stay missing."""
    return df.dropna(how="any", subset=list(subset))


def bool_to_int(df: DataFrame) -> DataFrame:
    """Boolean columns become 0/1 integers."""
    out = df
    for name, t in df.dtypes:
        if t == "boolean":
            out = out.withColumn(name, F.col(name).cast("int"))
    return out
