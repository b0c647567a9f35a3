"""Pairwise-complete co-moments of many columns in one scan.

For every ordered pair (i, j) over the rows where both are present: how many
there are, the mean of i, its summed squared deviation, and the summed product
of both deviations.  A batch gives all pairs as four matrix products of its
values (centred on the batch, missing ones 0) and its presence mask.  Blocks
of two row sets merge exactly (the parallel variance formula per pair), inside
tasks, then in at most ``MERGE_TASKS`` tasks, then on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: tasks that merge the scan's blocks; the driver gets one block from each
MERGE_TASKS = 16


@dataclass
class PairMoments:
    """p × p matrices; entry (i, j) is over the rows where columns i and j are both present."""

    n: np.ndarray
    mean: np.ndarray        # of i
    var: np.ndarray         # Σ (i − mean)²
    co: np.ndarray          # Σ (i − mean)(j − mean of j)

    def packed(self) -> bytes:
        return np.stack([self.n, self.mean, self.var, self.co]).tobytes()

    @staticmethod
    def unpacked(blob: bytes, p: int) -> PairMoments:
        return PairMoments(*np.frombuffer(blob).reshape(4, p, p))

    def merged(self, other: PairMoments) -> PairMoments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        d = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        mean = np.where(self.n > 0, self.mean + d * share, other.mean)
        weight = self.n * share
        return PairMoments(n, mean, self.var + other.var + d * d * weight, self.co + other.co + d * d.T * weight)


def batch_moments(x: np.ndarray) -> PairMoments:
    """Co-moments of one batch (rows × columns, NaN where missing)."""
    here = ~np.isnan(x)
    seen = here.any(axis=0)
    low, high = np.where(here, x, np.inf).min(axis=0), np.where(here, x, -np.inf).max(axis=0)
    rows = np.maximum(here.sum(axis=0), 1)
    with np.errstate(invalid="ignore"):
        # a constant column is centred on its value, so that its deviations are exactly 0
        centre = np.where(~seen, 0.0, np.where(low == high, low, np.where(here, x, 0.0).sum(axis=0) / rows))
        y = np.where(here, x - centre, 0.0)
        m = here.astype(float)
        n, s, q, co = m.T @ m, y.T @ m, (y * y).T @ m, y.T @ y
    safe = np.maximum(n, 1.0)
    off = s / safe
    var = q - s * off
    var[var <= 1e-13 * q] = 0.0         # constant over the pair's rows, up to rounding
    return PairMoments(n, np.where(n > 0, centre[:, None] + off, 0.0), var, co - s * off.T)


def pair_moments(df: DataFrame, cols: Sequence[str]) -> PairMoments:
    """Co-moments of every pair of ``cols``: one scan, one exchange of a block per task."""
    p = len(cols)
    names = [f"_{i}" for i in range(p)]
    none = PairMoments(*np.zeros((4, p, p)))

    def scan(batches):
        held = none
        for b in batches:
            if b.num_rows:
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
                held = held.merged(batch_moments(x))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.packed()], pa.binary())], ["part", "block"])

    def merge(batches):
        held, first = none, None
        for b in batches:
            for k, v in zip(b.column("part").to_pylist(), b.column("block").to_pylist()):
                held, first = held.merged(PairMoments.unpacked(v, p)), k if first is None else first
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([held.packed()], pa.binary())], ["part", "block"])

    values = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)])
    blocks = values.mapInArrow(scan, "part int, block binary")
    # merged in the order of the scan's partitions, so that equal inputs give equal sums
    blocks = blocks.repartition(MERGE_TASKS, F.col("part") % MERGE_TASKS).sortWithinPartitions("part")
    held = none
    for r in sorted(blocks.mapInArrow(merge, "part int, block binary").collect(), key=lambda r: r["part"]):
        held = held.merged(PairMoments.unpacked(bytes(r["block"]), p))
    return held
