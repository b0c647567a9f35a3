"""Row positions without a single-task window.

``Window.orderBy`` without ``partitionBy`` moves the whole table into one
task.  Here a position is built from a range-partitioned, locally sorted copy:

1. ``repartitionByRange`` on the order key, ``sortWithinPartitions``;
2. tag each row with its partition id and its index inside the partition
   (``monotonically_increasing_id`` minus the partition base — no shuffle);
3. checkpoint the tagged frame so the sampled range bounds can never change
   between the counting job and the numbering job, also when an executor is
   lost and its tasks are recomputed;
4. count rows per partition (one number per partition), prefix-sum those
   counts into a table with one row per partition, broadcast it and add.

The weighted variant (``ranged_running_sum``) works on pre-aggregated
(key, value, weight) rows and is the basis of exact quantiles and AUC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tabprism.session import ensure_checkpoint_dir

#: offsets tables have one row per (range partition, group); broadcast below this.
MAX_BROADCAST_ROWS = 2_000_000


def _range_partition(df: DataFrame, keys: Sequence[str], num_partitions: int | None) -> DataFrame:
    """Range-partition on ``keys``.  Without an explicit count AQE may coalesce
    adjacent ranges toward its advisory size; merged ranges stay contiguous and
    ordered, which is all the position logic needs."""
    if num_partitions:
        return df.repartitionByRange(int(num_partitions), *keys)
    return df.repartitionByRange(*keys)


def tag_positions(df: DataFrame, keys: Sequence[str], num_partitions: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` range-partitioned and sorted by ``keys``, with ``_pid`` and the index inside it ``_lix``, checkpointed;
    and the (partition, rows) counts in order: one number per range partition."""
    pid = F.spark_partition_id()
    tagged = (_range_partition(df, keys, num_partitions).sortWithinPartitions(*keys)
              .withColumn("_pid", pid)
              .withColumn("_lix", F.monotonically_increasing_id()
                          - F.shiftleft(pid.cast("long"), 33)))
    ensure_checkpoint_dir(df.sparkSession)     # the cluster's shared folder, or a clear error
    tagged = tagged.checkpoint(eager=True)
    counts = sorted((int(r["_pid"]), int(r["_pc"])) for r in
                    tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc")).collect())
    return tagged, counts


def row_index(df: DataFrame, order_by: Sequence[str] | str, name: str = "pos",
              num_partitions: int | None = None, with_count: bool = False):
    """Add a 0-based position by ``order_by`` (which must form a unique key).

    With ``with_count`` returns ``(frame, n)``; the row count comes for free
    from the per-partition counts.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    tagged, counts = tag_positions(df, keys, num_partitions)
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((p, total))
        total += c
    schema = StructType([StructField("_pid", IntegerType(), False), StructField("_off", LongType(), False)])
    offs = df.sparkSession.createDataFrame(offsets, schema)
    out = tagged.join(F.broadcast(offs), "_pid")
    out = out.withColumn(name, F.col("_off") + F.col("_lix")).drop("_pid", "_lix", "_off")
    return (out, int(total)) if with_count else out


#: a side of a join is broadcast up to this many rows, counted; beyond, Spark picks the join.
BROADCAST_ROWS = 100_000


def sized_side(small: DataFrame) -> DataFrame:
    """``small`` checkpointed and counted; marked for broadcast only if the count allows it."""
    ensure_checkpoint_dir(small.sparkSession)
    kept = small.checkpoint(eager=True)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def ranged_running_sum(df: DataFrame, groups: Sequence[str], order: str, weight: str,
                       num_partitions: int | None = None) -> DataFrame:
    """Range-partition on (groups, order), sort inside each partition, and add
    ``_pid`` (partition id) and ``_lcum`` (inclusive running sum of ``weight``
    inside the partition, across group boundaries).

    The running sum is a sequential scan of one already-sorted partition, done
    with ``mapInPandas`` (a vectorised cumsum per Arrow batch with a carry):
    no extra exchange.  The result is checkpointed, so its partitioning — and
    with it every derived rank — is fixed, also if an executor is lost later.
    Combine with ``partition_totals`` to turn ``_lcum`` into ranks per group.
    """
    groups = list(groups)
    ranged = (_range_partition(df, [*groups, order], num_partitions).sortWithinPartitions(*groups, order)
              .withColumn("_pid", F.spark_partition_id()))
    schema = StructType(ranged.schema.fields + [StructField("_lcum", DoubleType(), False)])

    def cumsum(batches):
        carry = 0.0
        for pdf in batches:
            c = pdf[weight].astype("float64").cumsum() + carry
            if len(c):
                carry = float(c.iloc[-1])
            yield pdf.assign(_lcum=c)

    ensure_checkpoint_dir(df.sparkSession)     # the cluster's shared folder, or a clear error
    return ranged.mapInPandas(cumsum, schema).checkpoint(eager=True)


def partition_totals(ranged: DataFrame, groups: Sequence[str], weight: str,
                     extra: dict | None = None, max_rows: int = MAX_BROADCAST_ROWS) -> list:
    """Per (partition, group): total weight (``_pt``) plus optional extra sums.

    Because partitions hold contiguous key ranges, there are at most
    (partitions + groups − 1) such rows; the collect is refused beyond
    ``max_rows``.  Rows come back sorted by (partition, group order).
    """
    aggs = [F.sum(weight).alias("_pt")] + [v.alias(k) for k, v in (extra or {}).items()]
    rows = (ranged.groupBy("_pid", *groups).agg(*aggs)
            .orderBy("_pid", *groups).limit(max_rows + 1).collect())
    if len(rows) > max_rows:
        raise RuntimeError(f"more than {max_rows} (partition, group) segments; too many groups")
    return rows
