"""Exact quantiles (linear interpolation between order statistics).

Definition, for the n non-missing values x(0) <= ... <= x(n-1) of a group:
h = p·(n-1), q = x(floor h) + (h - floor h)·(x(ceil h) - x(floor h)).  This
is what pandas ``quantile``, Spark ``percentile`` and DuckDB
``quantile_cont`` compute.

Without groups the default is ``select`` (distributed multi-selection): each
round counts the values of all columns by 16 more bits of their order-preserving
64-bit form, and only the buckets that hold a wanted rank go on to the next.
A bucket's least and greatest value come with its count, so a rank at its end, or
in a bucket of equal values, is settled at once; four rounds settle every rank.
Nothing is sorted across tasks or written, however many values differ; what is
exchanged and reaches the driver is one row per open bucket, at most 65,536 per
bucket of the round before.

With groups every exact plan first reduces rows to (group, column, value, count),
combined before the shuffle, so a hot value is one row.  Columns are unpivoted, and:

* ``rank`` (default with groups): distributed order statistics.  The reduced rows are
  range-partitioned and given a running count inside each partition
  (``positions.ranged_running_sum``).  One row per (partition, group) turns
  local counts into ranks, and an aggregate per group picks the values at ranks
  floor(h) and ceil(h).  No task holds more than one range partition, no driver
  loop runs over groups, and the result is a DataFrame whatever the number of
  groups.
* ``percentile``: Spark's exact aggregate over the reduced rows.  A group's
  distinct values meet in one task, so it is for callers who know them few.

``method="approx"`` uses ``percentile_approx`` for callers who accept
a bounded rank error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tabprism.operators.positions import ranged_running_sum, sized_side
from tabprism.operators.stats import MAX_COLUMNS_PER_PASS, to_long

#: bits of a value settled by one round of the selection
ROUND_BITS = 16


def _finite(c):
    return c.isNotNull() & ~F.isnan(c)


def quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float],
              by: Sequence[str] = (), method: str = "select",
              accuracy: int = 10_000, name_col: str = "column_name") -> DataFrame:
    """One row per (group, column) with one double field per named probability.

    Missing values (NULL, NaN) are ignored; an all-missing column gives NULLs.
    """
    by, cols = list(by), list(cols)
    keys = [*by, name_col]
    if method == "select" and not by:
        found = select_quantiles(df, cols, list(probs.values()))
        schema = StructType([StructField(name_col, StringType()), *[StructField(k, DoubleType()) for k in probs]])
        return df.sparkSession.createDataFrame([(c, *v) for c, v in zip(cols, found)], schema)
    long = to_long(df, cols, keep=by, name_col=name_col, value_col="_v")
    long = long.select(*keys, F.when(_finite(F.col("_v")), F.col("_v")).alias("_v"))
    arr = F.array(*[F.lit(float(p)) for p in probs.values()])
    named = [F.col("_q")[j].cast("double").alias(k) for j, k in enumerate(probs)]
    if method == "approx":
        wide = long.groupBy(*keys).agg(F.percentile_approx("_v", arr, accuracy).alias("_q")).select(*keys, *named)
    elif method == "percentile":
        wide = (_counted(long, keys).groupBy(*keys).agg(F.percentile("_v", arr, F.col("_w").cast("long")).alias("_q"))
                .select(*keys, *named))
    elif method in ("rank", "select"):
        wide = _rank_quantiles(long, probs, keys)
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    if by:
        return wide
    # an empty input still yields one (NULL) row per column
    allcols = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias(name_col))
    return allcols.join(wide, name_col, "left")


# ---------------------------------------------------------------- multi-selection
def order_keys(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers in the order of the doubles (−0.0 as 0.0)."""
    b = (x + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def key_value(key: int) -> float:
    """The double of an order key."""
    k = np.array([key], np.int64)
    return float((k ^ ((k >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _merge_buckets(parts: list[tuple]) -> tuple:
    """(bucket, count, least, greatest) arrays of several batches as one, sorted by bucket."""
    bucket, n, lo, hi = (np.concatenate(v) for v in zip(*parts))
    order = np.argsort(bucket, kind="stable")
    bucket, n, lo, hi = bucket[order], n[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[first], np.add.reduceat(n, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)


def _bucket_counts(df: DataFrame, cols: list[str], wanted: list[list[int]], level: int) -> pa.Table:
    """(col, bucket, n, lo, hi): values of each column by their first ``level + 1`` rounds of bits, inside the wanted buckets."""
    known, shift = 64 - ROUND_BITS * level, 64 - ROUND_BITS * (level + 1)
    names = [f"_{i}" for i in range(len(cols))]

    def run(batches):
        held: list[list[tuple]] = [[] for _ in names]
        for batch in batches:
            for i, name in enumerate(names):
                if level and not wanted[i]:
                    continue
                x = batch.column(name).to_numpy(zero_copy_only=False)
                k = order_keys(x[~np.isnan(x)])
                if level:
                    k = k[np.isin(k >> known, wanted[i])]
                if not len(k):
                    continue
                k.sort()
                bucket = k >> shift
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                last = np.concatenate([first[1:], [len(k)]])
                held[i].append((bucket[first], last - first, k[first], k[last - 1]))
                if sum(len(p[0]) for p in held[i]) > 1_000_000:
                    held[i] = [_merge_buckets(held[i])]
        for i, parts in enumerate(held):
            if parts:
                bucket, n, lo, hi = _merge_buckets(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i, np.int32)), pa.array(bucket), pa.array(n.astype(np.int64)),
                                                  pa.array(lo), pa.array(hi)], ["col", "bucket", "n", "lo", "hi"])

    values = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)])
    counts = values.mapInArrow(run, "col int, bucket long, n long, lo long, hi long")
    return counts.groupBy("col", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()


def between(low: float, high: float, part: float) -> float:
    """Linear interpolation of two order statistics."""
    return low if part == 0 else low + part * (high - low)


def select_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[list[float | None]]:
    """Exact quantiles of whole columns by multi-selection: per column one value per probability (None without values)."""
    return [[None if f is None else between(*f) for f in found] for found in order_statistics(df, cols, probs)]


def order_statistics(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[list[tuple[float, float, float] | None]]:
    """Per column and probability the order statistics around it and the place between them (None without values)."""
    cols, out = list(cols), []
    for start in range(0, len(cols), MAX_COLUMNS_PER_PASS):
        out += _select(df, cols[start:start + MAX_COLUMNS_PER_PASS], list(probs))
    return out


def _select(df: DataFrame, cols: list[str], probs: list[float]) -> list[list[tuple | None]]:
    sizes = [0] * len(cols)
    found: list[dict[int, float]] = [{} for _ in cols]                       # rank → value
    asked: list[dict[int, list[tuple[int, int]]]] = [{} for _ in cols]       # bucket → (rank, rank inside the bucket)
    for level in range(64 // ROUND_BITS):
        table = _bucket_counts(df, cols, [list(a) for a in asked], level)
        col = table.column("col").to_numpy()
        parts = [table.column(c).to_numpy() for c in ("bucket", "n", "lo", "hi")]
        for i in range(len(cols)):
            bucket, n, lo, hi = (p[col == i] for p in parts)
            order = np.argsort(bucket)
            bucket, n, lo, hi = bucket[order], n[order], lo[order], hi[order]
            if level == 0:
                sizes[i] = int(n.sum())
                ranks = {int(r) for p in probs for h in [p * (sizes[i] - 1)] for r in (np.floor(h), np.ceil(h))} if sizes[i] else set()
                scopes = [(np.arange(len(bucket)), [(r, r) for r in sorted(ranks)])]
            else:
                above = bucket >> ROUND_BITS
                scopes = [(np.flatnonzero(above == b), inside) for b, inside in asked[i].items()]
            asked[i] = {}
            for members, wanted in scopes:
                ends = np.cumsum(n[members])
                for rank, inside in wanted:
                    at = int(np.searchsorted(ends, inside, "right"))
                    m, left = members[at], inside - int(ends[at] - n[members[at]])
                    if lo[m] == hi[m] or left in (0, n[m] - 1):
                        found[i][rank] = key_value(int(lo[m] if left == 0 else hi[m]))
                    else:
                        asked[i].setdefault(int(bucket[m]), []).append((rank, left))
        if not any(asked):
            break
    out = []
    for i in range(len(cols)):
        row = []
        for p in probs:
            h = p * (sizes[i] - 1)
            low, high = int(np.floor(h)), int(np.ceil(h))
            row.append((found[i][low], found[i][high], h - low) if sizes[i] else None)
        out.append(row)
    return out


def _counted(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (group, value) with its count ``_w``; a missing value counts 0 but keeps its group."""
    return long.groupBy(*keys, "_v").agg(F.count("_v").cast("double").alias("_w"))


def _rank_quantiles(long: DataFrame, probs: dict[str, float], keys: Sequence[str]) -> DataFrame:
    ranged = ranged_running_sum(_counted(long, keys), keys, "_v", "_w")
    # one row per (partition, group), partitions in value order: what to add to a
    # partition's running count to get ranks inside the group, and the group's size
    parts = ranged.groupBy("_pid", *keys).agg(F.sum("_w").alias("_pt"), F.max("_lcum").alias("_end"))
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = sized_side(parts.select(
        F.col("_pid").alias("_ppid"), *[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)],
        (F.sum("_pt").over(so_far) - F.col("_end")).alias("_shift"), F.sum("_pt").over(group).alias("_n")))
    on = [F.col("_pid") == F.col("_ppid")] + [F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(keys)]
    ranks = ranged.join(parts, on).withColumn("_at", F.col("_lcum") - F.col("_w") + F.col("_shift"))

    def value_at(rank):
        return F.max(F.when((F.col("_at") <= rank) & (rank < F.col("_at") + F.col("_w")), F.col("_v")))

    aggs = [F.max("_n").alias("_n")]
    for j, p in enumerate(probs.values()):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [value_at(F.floor(h)).alias(f"_lo{j}"), value_at(F.ceil(h)).alias(f"_hi{j}")]
    picked = ranks.groupBy(*keys).agg(*aggs)
    out = []
    for j, (name, p) in enumerate(probs.items()):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        out.append((F.col(f"_lo{j}") + (h - F.floor(h)) * (F.col(f"_hi{j}") - F.col(f"_lo{j}"))).alias(name))
    return picked.select(*keys, *out)
