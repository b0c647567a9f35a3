"""Positional operators: previews, pages, seeded samples, splits, evenly spaced samples.

Spark has no implicit row order, so every operator takes ``order_by``
columns forming a unique key.  Global positions come from
``positions.row_index`` (range partitioning, no single-task window).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprism.operators.positions import row_index, tag_positions
from tabprism.constants import PAGE_SIZE, PREVIEW_ROWS, SAMPLE_SEED, SCATTER_POINTS, TRAIN_FRACTION

#: evenly spaced samples and pages up to this many rows broadcast their position table
MAX_BROADCAST_SAMPLE = 100_000


def _keys(order_by) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def preview(df: DataFrame, order_by, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows by the key (TakeOrderedAndProject: a bounded heap per task)."""
    return df.orderBy(*_keys(order_by)).limit(n)


def clamp_page(page, total_rows: int, per_page: int = PAGE_SIZE) -> int:
    """Page number clamped to [1, pages]; text that is not an integer → 1."""
    try:
        p = int(page)
    except (TypeError, ValueError):
        p = 1
    pages = max(1, (total_rows + per_page - 1) // per_page)
    return max(1, min(p, pages))


def page_slice(df: DataFrame, order_by, page, per_page: int = PAGE_SIZE) -> DataFrame:
    """The rows of one page with their 0-based position ``pos``; one plan whatever the page.

    Only the keys are range-partitioned, sorted and kept.  Counts per range tell
    which ranges hold the page; its keys are read from those alone and joined
    back to the table, whose scan also gets the bounds of the page's first key.
    """
    keys = _keys(order_by)
    tagged, counts = tag_positions(df.select(*keys), keys)
    p = clamp_page(page, sum(n for _, n in counts), per_page)
    start, end, at, held = (p - 1) * per_page, p * per_page, 0, []
    for part, n in counts:
        if at < end and at + n > start:
            held.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(held, "_pid int, _off long")       # ranges that hold the page
    position = F.col("_off") + F.col("_lix")
    found = (tagged.join(F.broadcast(offsets), "_pid").where((position >= start) & (position < end))
             .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], position.alias("pos")))
    first = F.col("_k0")
    bounds = found.agg(F.min(first).alias("lo"), F.max(first).alias("hi"), F.count_if(first.isNull()).alias("gaps")).first()
    scan = df
    if bounds["lo"] is not None and not bounds["gaps"]:
        scan = df.where((F.col(keys[0]) >= F.lit(bounds["lo"])) & (F.col(keys[0]) <= F.lit(bounds["hi"])))
    side = F.broadcast(found) if per_page <= MAX_BROADCAST_SAMPLE else found       # a page has at most per_page rows
    return scan.join(side, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]).select(*df.columns, "pos")


def materialize_positions(df: DataFrame, order_by, path: str, pos_col: str = "pos") -> DataFrame:
    """Number the rows once and keep them as a parquet table (built if absent).

    The numbered frame comes out range-partitioned and sorted by the key, so
    ``pos`` rises monotonically across files and row groups: a later page is a
    filter on ``pos`` that the scan pushes down, and min/max statistics skip
    every row group outside the page.
    """
    from tabprism.sources.materialize import load_or_build
    return load_or_build(df.sparkSession, path, lambda: row_index(df, order_by, pos_col))


def page_from_positions(numbered: DataFrame, page, per_page: int = PAGE_SIZE, pos_col: str = "pos",
                        total_rows: int | None = None) -> DataFrame:
    """P8 over a materialised numbered table: clamp the page, then a pushed-down range filter."""
    total = numbered.count() if total_rows is None else total_rows
    p = clamp_page(page, total, per_page)
    start = (p - 1) * per_page
    return numbered.where((F.col(pos_col) >= start) & (F.col(pos_col) < start + per_page))


def page_index(df: DataFrame, per_page: int = PAGE_SIZE) -> DataFrame:
    """One row per page: page, first_row, last_row (1-based), has_prev, has_next, totals."""
    total = df.count()
    pages = max(1, (total + per_page - 1) // per_page)
    spark = df.sparkSession
    r = spark.range(1, pages + 1).withColumnRenamed("id", "page")
    first = (F.col("page") - 1) * per_page + 1
    last = F.least(F.col("page") * per_page, F.lit(total))
    return r.select(
        "page", F.when(F.lit(total) > 0, first).otherwise(F.lit(0)).alias("first_row"),
        last.cast("bigint").alias("last_row"),
        (F.col("page") > 1).alias("has_prev"), (F.col("page") < pages).alias("has_next"),
        F.lit(total).cast("bigint").alias("total_rows"), F.lit(pages).cast("bigint").alias("total_pages"))


def hash_order(key_cols: Sequence[str], seed: int):
    """Deterministic pseudo-random order: md5 of 'seed:key' (same text in DuckDB)."""
    parts = [F.lit(str(seed))]
    for c in key_cols:
        parts += [F.lit(":"), F.col(c).cast("string")]
    return F.md5(F.concat(*parts))


def seeded_sample(df: DataFrame, key, n: int, seed: int = SAMPLE_SEED, ties: Sequence[str] = ()) -> DataFrame:
    """min(n, rows) rows picked by a seeded hash order of the key, then ``ties``.

    A cut on the hash, counted to leave at least ``n`` rows and widened if it
    doesn't, comes before the top-n: few rows reach the last task, however
    many partitions there are.  Rows with a null key come first.
    """
    keys = _keys(key)
    hashed = df.withColumn("_h", hash_order(keys, seed))
    share = (n + 10 * math.sqrt(n) + 100) / max(1, df.count())
    while share < 1.0:
        few = hashed.where(F.col("_h").isNull() | (F.col("_h") < f"{int(share * 16 ** 12):012x}"))
        if few.count() >= n:
            hashed = few
            break
        share *= 4
    return hashed.orderBy("_h", *keys, *ties).limit(n).drop("_h")


def numbered_sample(df: DataFrame, key, n: int, seed: int = SAMPLE_SEED, ties: Sequence[str] = (),
                    pos_col: str = "pos") -> DataFrame:
    """``seeded_sample`` with each row's 0-based place in the hash order (a window over at most ``n`` rows)."""
    keys = _keys(key)
    order = Window.orderBy(hash_order(keys, seed), *keys, *ties)
    return seeded_sample(df, keys, n, seed, ties).withColumn(pos_col, (F.row_number().over(order) - 1).cast("bigint"))


def train_test_split(df: DataFrame, order_by, train_fraction: float = TRAIN_FRACTION,
                     pos_col: str = "pos") -> tuple[DataFrame, DataFrame, int]:
    """First floor(fraction·n) rows by the key are train, the rest test.

    Returns (train, test, n_train).  The numbered frame is checkpointed inside
    ``row_index``, so train and test are complementary even on recomputation.
    """
    numbered, n = row_index(df, order_by, pos_col, with_count=True)
    n_train = int(n * float(train_fraction))
    return (numbered.where(F.col(pos_col) < n_train),
            numbered.where(F.col(pos_col) >= n_train), n_train)


def split_labels(df: DataFrame, order_by, train_fraction: float = TRAIN_FRACTION,
                 pos_col: str = "pos") -> DataFrame:
    """P13 as one frame with a ``split`` column ('train' / 'test')."""
    numbered, n = row_index(df, order_by, pos_col, with_count=True)
    n_train = int(n * float(train_fraction))
    return numbered.withColumn(
        "split", F.when(F.col(pos_col) < n_train, "train").otherwise("test"))


def linspace_positions(n: int, k: int) -> list[int]:
    """Integer positions of ``numpy.linspace(0, n-1, min(k, n), dtype=int)``."""
    k = min(k, n)
    if k <= 0:
        return []
    if k == 1:
        return [0]
    step = (n - 1) / (k - 1)
    out = [int(i * step) for i in range(k)]
    out[-1] = n - 1
    return out


def linspace_sample(numbered: DataFrame, k: int = SCATTER_POINTS, pos_col: str = "pos") -> DataFrame:
    """≤ k evenly spaced rows of an already numbered frame; adds ``sample_idx``."""
    n = numbered.count()
    k = min(k, n)
    if k == 0:
        return numbered.limit(0).withColumn("sample_idx", F.lit(0).cast("bigint"))
    spark = numbered.sparkSession
    step = F.lit((n - 1) / (k - 1)) if k > 1 else F.lit(0.0)
    idx = spark.range(k).select(
        F.col("id").alias("sample_idx"),
        F.when(F.col("id") == k - 1, F.lit(n - 1)).otherwise(F.floor(F.col("id") * step))
        .cast("bigint").alias("_p"))
    # the index table has exactly k rows: broadcast it while k is small, else shuffle-join
    side = F.broadcast(idx) if k <= MAX_BROADCAST_SAMPLE else idx
    return numbered.join(side, numbered[pos_col] == idx["_p"]).drop("_p")
