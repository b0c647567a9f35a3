"""Embedding whitening (operator 12): covariance weighted by how often a vector occurs.

1. **Integers:** each entry c becomes x = floor(scale * c).  Rows whose vector is
   null or holds a null or non-finite entry are left out.  Each scan task groups
   equal x vectors of a bounded number of rows, so that copies are
   pre-aggregated before the exchange; a row keeps the number of its vector there.
2. **Distinct vectors** are grouped over all tasks, with their counts, and written
   once.  The fit weight of a distinct vector is one, or its count.
3. **Weighted covariance:** exact integer sums first; then every task multiplies
   its centred vectors (one matrix product a batch), and the task's matrices are
   added in rounds of a few matrices per task, so that the driver gets a handful.
4. **Whitening:** each distinct vector is projected once on the leading unit
   eigenvectors and divided by the root of the eigenvalue; rows get it back in two
   equi-joins, on the vector (at most one row per task and batch) and on the number.

Defined results: repeated rows and null keys get rows of their own; vectors of
unequal length are filled up with zeros; entries beyond a 64-bit integer are held
at its ends; a component without variance (eigenvalue below rounding) has
whitened 0 and stands outside ``identity_error``; ``explained`` is 0 where all
vectors are equal; a deviation beyond a 64-bit integer is null; an empty table
gives no row.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprism.llm.common import materialise

#: Rows whose equal vectors are grouped at a time inside a task.
LOCAL_ROWS = 50_000


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    def bad(c):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda c: bad(c.cast("double")))


def _integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as 64-bit integers, held at the ends of the range."""
    with np.errstate(over="ignore"):
        x = np.floor(values.astype(np.float64) * scale)
    high = x >= 2.0 ** 63
    out = np.where(high, 0, np.maximum(x, -(2.0 ** 63))).astype(np.int64)
    out[high] = np.iinfo(np.int64).max
    return out


def local_vectors(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """Members (copies is null) and distinct vectors (x not null) of every scan task, written once."""
    plain = rows.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = plain.schema["key"].dataType.simpleString()

    def run(batches):
        base = TaskContext.get().partitionId() << 36
        held: dict[bytes, int] = {}
        copies: list[int] = []
        seen = 0

        def flush():
            nonlocal base
            vectors = [np.frombuffer(b, np.int64) for b in held]
            for at in range(0, len(vectors), 5_000):
                part = vectors[at:at + 5_000]
                x = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]), pa.int32()),
                                             pa.array(np.concatenate(part) if part else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(part), key_type), pa.array(range(base + at, base + at + len(part)), pa.int64()), x,
                     pa.array(copies[at:at + len(part)], pa.int64())], ["key", "local", "x", "copies"])
            base += len(vectors)

        key_type = None
        for batch in batches:
            column, key_type = batch.column("v"), batch.schema.field("key").type
            flat = _integers(column.flatten().to_numpy(zero_copy_only=False), scale)
            ends = np.cumsum(column.value_lengths().to_numpy())
            numbers = []
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                b = flat[start:end].tobytes()
                i = held.setdefault(b, len(held))
                if i == len(copies):
                    copies.append(0)
                copies[i] += 1
                numbers.append(base + i)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(numbers, pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
                                              pa.nulls(n, pa.int64())], ["key", "local", "x", "copies"])
            seen += n
            if seen >= LOCAL_ROWS:
                yield from flush()
                held, copies, seen = {}, [], 0
        if key_type is not None:
            yield from flush()

    return materialise(plain.mapInArrow(run, f"key {kind}, local long, x array<long>, copies long"), "local-vectors")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to ``d`` columns."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    if (lengths == d).all():
        return values.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = values
    return out


def exact_sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Weights and weighted sums per dimension, as whole numbers."""
    def run(batches):
        total, sums = 0, [0] * d
        for b in batches:
            x, w = _matrix(b.column("x"), d), b.column("w").to_numpy()
            total += sum(w.tolist())
            if len(w) and float(np.abs(x.astype(np.float64)).max(initial=0)) * float(w.sum()) < 2.0 ** 62:
                part = (w @ x).tolist()
            else:
                part = [sum(a * b for a, b in zip(c, w.tolist())) for c in x.T.tolist()]
            sums = [a + b for a, b in zip(sums, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (total, *sums)])], ["dim", "v"])

    parts = distinct.select("x", "w").mapInArrow(run, "dim int, v string")
    got = {r["dim"]: int(r["s"]) for r in parts.groupBy("dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def covariance(distinct: DataFrame, d: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Weighted covariance with divisor n, centred before multiplying."""
    def products(batches):
        c = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column("x"), d) - mean
            c += (x * b.column("w").to_numpy()[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["part", "c"])

    def add(batches):
        got = [(p, c) for b in batches for p, c in zip(b.column("part").to_pylist(), b.column("c").to_pylist())]
        if got:
            c = sum(np.frombuffer(c) for _, c in sorted(got))
            yield pa.RecordBatch.from_arrays([pa.array([min(got)[0]], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["part", "c"])

    parts = materialise(distinct.select("x", "w").mapInArrow(products, "part long, c binary"), "products")
    while (count := parts.count()) > 16:
        parts = materialise(parts.repartition(-(-count // 16), F.col("part")).mapInArrow(add, "part long, c binary"), "products")
    rows = sorted((r["part"], bytes(r["c"])) for r in parts.collect())      # 16 matrices at most
    return sum((np.frombuffer(c).reshape(d, d) for _, c in rows), np.zeros((d, d))) / n


def leading_components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors as rows, largest entry positive."""
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most].copy(), q.T[::-1][:most].copy()
    for row in q:
        row *= np.sign(row[np.argmax(np.abs(row))])
    e[e <= max(e.max(initial=0.0), 0.0) * len(v) * np.finfo(float).eps] = 0.0
    return e, q


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, weights: str = "one",
           scale: float = 256.0) -> DataFrame:
    """One row per usable row and component: key, component, n, deviation, whitened, explained, identity_error.

    ``weights``: "one" fits on every distinct vector once, "count" on every row.
    """
    found = local_vectors(rows, key, vector, scale)
    locals_ = found.where(F.col("copies").isNotNull()).select("local", "x", "copies")
    weight = {"one": F.lit(1), "count": F.sum("copies")}[weights]
    distinct = materialise(locals_.groupBy("x").agg(weight.cast("long").alias("w"), F.min("local").alias("vector")), "distinct-vectors")
    d = distinct.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    n, sums = exact_sums(distinct, d)
    mean = np.array([float(Fraction(s, n)) for s in sums]) if n else np.zeros(d)
    v = covariance(distinct, d, max(n, 1), mean)
    e, q = leading_components(v, components)
    scaled = np.array([row / np.sqrt(x) if x > 0 else np.zeros(d) for row, x in zip(q, e)]).reshape(len(e), d)
    far = float(max(map(abs, sums), default=0))
    small = np.array(sums if far < 2.0 ** 31 else [0] * d, np.int64)

    def project(batches):
        for b in batches:
            x = _matrix(b.column("x"), d)
            z = (x - mean) @ scaled.T
            if len(x) and (n * float(np.abs(x.astype(np.float64)).max(initial=0)) + far) ** 2 * d < 2.0 ** 62:
                off = ((n * x - small) ** 2).sum(1).tolist()
            else:
                off = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("vector"), b.column("w"), b.column("x"), pa.array([o if o < 2 ** 63 else None for o in off], pa.int64()),
                 pa.array(list(z), pa.list_(pa.float64()))], ["vector", "w", "x", "deviation", "z"])

    white = materialise(distinct.mapInArrow(project, "vector long, w long, x array<long>, deviation long, z array<double>"), "whitened")
    error = identity_error(white, n, [i for i, x in enumerate(e) if x > 0])
    trace = float(np.trace(v))
    share = F.array(*[F.lit(float(x / trace) if trace > 0 else 0.0) for x in [*e, 0.0]])
    own = locals_.join(white.select("x", "deviation", "z"), "x").select("local", "deviation", "z")
    members = found.where(F.col("copies").isNull()).select("key", "local")
    return (members.join(own, "local").select("key", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))


def identity_error(white: DataFrame, n: int, used: list[int]) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not used:
        return 0.0
    z, w = [F.get("z", F.lit(i)) for i in used], F.col("w")
    means = white.agg(*[F.sum(w * c).alias(f"m{i}") for i, c in enumerate(z)]).first()
    z = [c - F.lit(means[i] / n) for i, c in enumerate(z)]
    pairs = [(i, j) for i in range(len(z)) for j in range(i + 1)]
    got = white.agg(*[F.sum(w * z[i] * z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)
