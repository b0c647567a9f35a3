"""Embedding whitening against numpy over all rows."""

import math
from collections import Counter

import numpy as np
import pytest

from tabprism.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, x string"


def integers(v, d):
    x = [max(-2**63, min(2**63 - 1, math.floor(256 * float(np.float32(c))))) for c in v]
    return x + [0] * (d - len(x))


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, "k") for i, v in vectors], SCHEMA).repartition(parts)


def check(spark, vectors, weights="one", components=4):
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    got = whitening.whiten(frame(spark, vectors), components=components, weights=weights).collect()
    d = max(len(v) for _, v in usable)
    rows = [(i, integers(v, d)) for i, v in usable]
    count = Counter(tuple(x) for _, x in rows)
    fit = np.array(list(count), float)
    w = np.array([1 if weights == "one" else c for c in count.values()])
    n, sums = int(w.sum()), [sum(int(a) * x[i] for a, x in zip(w, count)) for i in range(d)]
    mean = np.array(sums) / n
    v = ((fit - mean) * w[:, None]).T @ (fit - mean) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q.T[::-1]
    k = min(components, d)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c + 1) for i, _ in rows for c in range(k))
    dev = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in rows)
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == dev
    for c in range(k):
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        want = {i: float((np.array(x) - mean) @ q[c] / np.sqrt(e[c])) for i, x in rows}
        sign = np.sign(sum(mine[i]["whitened"] * want[i] for i in want))
        for i, r in mine.items():
            assert r["n"] == n and r["whitened"] == pytest.approx(sign * want[i], abs=1e-8)
            assert r["explained"] == pytest.approx(e[c] / np.trace(v), rel=1e-9) and 0 <= r["identity_error"] < 1e-9
    return got


def vectors_of(n, d, seed):
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, d)) * np.linspace(0.05, 1, d) + r.normal(size=d)
    return [[float(np.float32(c)) for c in row] for row in a]


def test_whitening_with_copies_and_unusable_rows(spark):
    base = vectors_of(120, 6, 1)
    rows = list(enumerate(base)) + [(500 + i, base[0]) for i in range(90)] + [(700 + i, base[i]) for i in range(5)]
    rows += [(900, None), (901, [None] + base[0][1:]), (902, [float("nan")] + base[0][1:]), (903, [float("inf")] + base[0][1:]),
             (3, base[3])]
    for weights in ("one", "count"):
        check(spark, rows, weights)


def test_local_groups_of_few_rows_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LOCAL_ROWS", 1)
    base = vectors_of(40, 3, 2)
    check(spark, [(i, base[i % 30]) for i in range(90)])


def test_unequal_lengths_and_few_dimensions(spark):
    base = vectors_of(30, 3, 3)
    check(spark, [(i, v[:2] if i % 4 == 0 else v) for i, v in enumerate(base)])


def test_edges(spark):
    same = whitening.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(5)] + [(None, [0.5, 0.25])])).collect()
    assert Counter((r["vec_id"], r["component"]) for r in same) == Counter((i, c) for i in [*range(5), None] for c in (1, 2))
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, 0.0, 0.0, 0.0)}
    line = whitening.whiten(frame(spark, [(i, [float(i), float(i)]) for i in range(4)])).collect()
    assert all(r["explained"] == pytest.approx(2 - r["component"], abs=1e-12) for r in line) and len(line) == 8
    assert all(r["whitened"] == 0 for r in line if r["component"] == 2)
    for nothing in ([], [(1, None)], [(1, [float("nan")])], [(1, [])]):
        assert whitening.whiten(frame(spark, nothing)).collect() == []
    far = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1.0])])).collect()
    assert len(far) == 6 and {r["deviation"] for r in far if r["vec_id"] != 3} == {None}


def test_integers_hold_at_the_ends():
    got = whitening._integers(np.array([1e300, -1e300, 0.5, -0.001, -0.0, 2.0 ** 55]), 256.0)
    assert got.tolist() == [2**63 - 1, -2**63, 128, -1, 0, 2**63 - 1]


def test_partial_matrices_are_added_in_rounds(spark):
    base = vectors_of(200, 4, 5)
    distinct = spark.createDataFrame([([int(256 * c) for c in v], 1) for v in base], "x array<long>, w long").repartition(40)
    x = np.array([[int(256 * c) for c in v] for v in base], float)
    got = whitening.covariance(distinct, 4, 200, x.mean(0))
    assert np.allclose(got, np.cov(x.T, bias=True))
