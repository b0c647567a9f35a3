"""Quality classifier (operator 7): naive Bayes support vectors.

**Features** are indicators (present or not) of word unigrams and bigrams and
of one- to three-grams of word *shapes* (letter case, digits and marks at both
ends of the word, its length, "same as the word before"), hashed into ``2**hash_bits``
columns.  Only the text is read.

**Fit.**  Per column the log ratio of its smoothed share in class 1 and in
class 0 scales the indicator; a linear hinge-loss model is then fitted by dual
coordinate descent (Hsieh et al. 2008) and interpolated with the plain log-count
model.  Scores are a logistic curve of the margin (Platt scaling on margins of
rows held out of a first fit).

The fit uses at most ``max_rows`` labelled rows, those with the smallest hash of
their id: the only bounded part.  Features of those rows are made by tasks and
only their column numbers (at most ``max_features`` distinct ones a row) reach
the driver.  Scoring is one pass over whole texts.

Defined results: null and empty texts have no features and get the score of
the bias; null labels and labels other than 0 and 1 are not learned from;
without two classes in the sample the score is the share of class 1 (0.5
without any row); repeated ids are learned once per row, up to 2 * ``max_rows``
rows: the first by id hash, id and text hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from tabprism.llm.common import first_rows, free_tag, map_batches, strings

#: How many words a task remembers before it starts again.
VOCABULARY = 600_000

#: Byte classes: U upper case, l lower case or beyond ASCII, 9 digit; marks stand for themselves.
_CLASSES = bytes(85 if 65 <= c <= 90 else 108 if 97 <= c <= 122 or c > 127 else 57 if 48 <= c <= 57 else c for c in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Word to number, with the hash of the lowered word and of its shape; bounded."""

    def __init__(self):
        super().__init__()
        self.low, self.form = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.low):
            self.low, self.form = np.resize(self.low, 2 * at), np.resize(self.form, 2 * at)
        h = xxhash.xxh3_64_intdigest
        classes = word.translate(_CLASSES)
        size = min(len(word), 40) // 10
        self.low[at], self.form[at] = h(word.lower()), h(b"%b|%b|%d" % (classes[:2], classes[-3:], size)) >> 1
        self[word] = at
        return at


def _mix(a: np.ndarray, b) -> np.ndarray:
    x = (a ^ (b >> np.uint64(31))) * _ODD + b
    return (x ^ (x >> np.uint64(29))) * _ODD


def columns(text: str, bits: int, words: Vocabulary) -> np.ndarray:
    """Sorted distinct feature columns of a whole text."""
    split = text.encode("utf-8").split()
    n = len(split)
    if not n:
        return np.zeros(0, np.int64)
    if len(words) > VOCABULARY:
        words.clear()
    ids = np.fromiter(map(words.__getitem__, split), np.int64, n)
    low, forms = words.low[ids], words.form[ids] * np.uint64(2)
    forms[1:] += ids[1:] == ids[:-1]
    two = _mix(forms[:-1], forms[1:])
    found = np.concatenate([_mix(low, np.uint64(1)), _mix(_mix(low[:-1], low[1:]), np.uint64(2)), _mix(forms, np.uint64(3)),
                            _mix(two, np.uint64(4)), _mix(_mix(two[:-1], forms[2:]), np.uint64(5))]) >> np.uint64(64 - bits)
    out = np.sort(found.astype(np.uint32))
    return out[np.concatenate(([True], out[1:] != out[:-1]))].astype(np.int64)


def dual_coordinate_descent(indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int,
                            cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """L2-regularised L1-loss support vector machine; returns weights, the last one is the bias."""
    w = np.zeros(width + 1)
    alpha = np.zeros(len(y))
    rows = [(cols[a:b], vals[a:b]) for a, b in zip(indptr[:-1], indptr[1:])]
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(y)):
            c, v = rows[i]
            g = y[i] * (w[c] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[c] += step * v
                w[-1] += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-4:
            break
    return w


@dataclass
class Model:
    """Hashed linear model: margin = sum of weights of present columns + bias."""
    bits: int
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, text: str, words: Vocabulary) -> float:
        margin = float(self.weights[columns(text, self.bits, words)].sum()) + self.bias
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def _margins(indptr, cols, weights, bias):
    sums = np.concatenate(([0.0], np.cumsum(weights[cols])))
    return sums[indptr[1:]] - sums[indptr[:-1]] + bias


def fit_rows(rows: list[np.ndarray], y: np.ndarray, bits: int, cost: float = 1.0, epochs: int = 20,
             smooth: float = 1.0, mix: float = 0.25, seed: int = 7) -> Model:
    """Fit on column arrays and 0/1 labels."""
    width = 1 << bits
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(bits, np.zeros(width, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))

    def fit(keep: np.ndarray):
        part = [rows[i] for i in keep]
        labels = y[keep]
        indptr = np.concatenate(([0], np.cumsum([len(r) for r in part]))).astype(np.int64)
        cols = np.concatenate(part) if part else np.zeros(0, np.int64)
        owner = np.repeat(labels, np.diff(indptr))
        p = np.bincount(cols[owner == 1], minlength=width) + smooth
        q = np.bincount(cols[owner == 0], minlength=width) + smooth
        ratio = np.log((p / ((labels == 1).sum() + 2 * smooth)) / (q / ((labels == 0).sum() + 2 * smooth)))
        ratio[(p == smooth) & (q == smooth)] = 0.0
        # each row has unit length, so long and short texts weigh alike in the fit
        lengths = np.sqrt(np.maximum(np.bincount(np.repeat(np.arange(len(part)), np.diff(indptr)),
                                                 weights=ratio[cols] ** 2, minlength=len(part)), 1e-12))
        vals = ratio[cols] / np.repeat(lengths, np.diff(indptr))
        sign = np.where(labels == 1, 1.0, -1.0)
        weight = np.where(labels == 1, len(labels) / (2.0 * max(1, (labels == 1).sum())),
                          len(labels) / (2.0 * max(1, (labels == 0).sum())))
        w = dual_coordinate_descent(indptr, cols, vals, sign, width, cost * weight, epochs, seed)
        scaled = w[:-1]
        mean = np.abs(scaled[np.unique(cols)]).mean() if len(cols) else 0.0
        joined = (mix * mean + (1 - mix) * scaled) * ratio
        return joined, float(w[-1])

    def lengths_of(part, weights, bias):
        indptr = np.concatenate(([0], np.cumsum([len(r) for r in part]))).astype(np.int64)
        cols = np.concatenate(part) if part else np.zeros(0, np.int64)
        return _margins(indptr, cols, weights, bias)

    order = np.random.default_rng(seed).permutation(len(y))
    held = order[: max(1, len(order) // 5)]
    weights, bias = fit(order[len(held):]) if len(set(y[order[len(held):]])) == 2 else fit(order)
    slope, offset = _platt(lengths_of([rows[i] for i in held], weights, bias), y[held], n1, n0)
    weights, bias = fit(np.arange(len(y)))
    return Model(bits, weights.astype(np.float32), bias, slope, offset)


def _platt(margin: np.ndarray, y: np.ndarray, n1: int, n0: int) -> tuple[float, float]:
    """Slope and offset of the logistic curve of held-out margins (Newton steps with halving)."""
    scale = float(np.std(margin)) or 1.0
    m = margin / scale
    t = np.where(y == 1, ((y == 1).sum() + 1.0) / ((y == 1).sum() + 2.0), 1.0 / ((y == 0).sum() + 2.0))
    a, b = 1.0, float(np.log((n1 + 1.0) / (n0 + 1.0)))

    def loss(a, b):
        z = a * m + b
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-3 * (a * a))

    for _ in range(100):
        z = a * m + b
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        g = np.array([((p - t) * m).sum() + 2e-3 * a, (p - t).sum()])
        d = p * (1 - p)
        hess = np.array([[(d * m * m).sum() + 2e-3, (d * m).sum()], [(d * m).sum(), d.sum()]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(hess, g), 1.0
        while size > 1e-8 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3) / scale, b


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int,
                  bits: int, max_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature columns and labels of the ``max_rows`` labelled rows with the smallest id hashes."""
    known = (labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
             .where(F.col("_key").isNotNull() & F.col("_y").isin(0, 1))
             .orderBy(F.xxhash64("_key"), "_key", "_y").limit(max_rows))
    picked, counts = first_rows(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")), known, 2 * max_rows)

    schema = StructType([picked.schema["_text"], picked.schema["_key"], StructField("y", IntegerType()), StructField("cols", BinaryType())])
    names = schema.names

    def run(batch):
        words = Vocabulary()
        cols = [columns(t, bits, words) for t in strings(batch, "text")]
        # evenly spaced columns of the hashed, sorted set: a fixed sample of a very long text's features
        cols = [c if len(c) <= max_features else c[np.linspace(0, len(c) - 1, max_features).astype(np.int64)] for c in cols]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_text", "_key", "_y")), pa.array([c.astype("<i4").tobytes() for c in cols], pa.binary())], names)

    made = [r for r in map_batches(picked, run, schema).collect() for _ in range(counts[tuple(r)[:3]])]
    made.sort(key=lambda r: (r["y"], r["cols"]))
    return [np.frombuffer(r["cols"], "<i4").astype(np.int64) for r in made], np.array([r["y"] for r in made], np.int64)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        max_rows: int = 3000, bits: int = 18, max_features: int = 20_000) -> Model:
    """Fit on labelled documents; ``labels`` must already leave held-out rows out."""
    rows, y = training_rows(docs, labels, key, text, label, max_rows, bits, max_features)
    return fit_rows(rows, y, bits)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row and its score, a double from 0 to 1; a kept column of its name gives way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    read = free_tag(keep) + "text"
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 2**bits numbers
    fields = docs.select(*keep, F.col(text).alias(read))

    def run(batches):
        m = shared.value
        words = Vocabulary()
        for batch in batches:
            scores = [m.score(t, words) for t in strings(batch, read)]
            cols = [batch.column(c) for c in batch.schema.names if c != read]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], [*keep, name])

    schema = StructType([fields.schema[c] for c in keep] + [StructField(name, DoubleType())])
    return fields.mapInArrow(run, schema)
