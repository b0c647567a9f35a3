"""Multi-selection quantiles, pairwise co-moments, density curves and fits with missing inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprism.operators import chartdata as V
from tabprism.operators import metrics as MT
from tabprism.operators import models as M
from tabprism.operators import profile as P
from tabprism.operators import quantiles as Q
from tabprism.operators.comoments import PairMoments, batch_moments, pair_moments

NAN, INF = float("nan"), float("inf")


# ---------------------------------------------------------------- selection
def check_quantiles(spark, columns, probs=(0.0, 0.25, 0.5, 0.9, 1.0)):
    n = len(columns[0])
    df = spark.createDataFrame([(i, *(c[i] for c in columns)) for i in range(n)], "id long, " + ", ".join(f"c{i} double" for i in range(len(columns))))
    got = Q.select_quantiles(df.repartition(5), [f"c{i}" for i in range(len(columns))], list(probs))
    for values, mine in zip(columns, got):
        known = [v for v in values if v is not None and not math.isnan(v)]
        want = np.quantile(known, probs) if known else [None] * len(probs)
        assert mine == [pytest.approx(w, rel=1e-14, abs=0) if w is not None else None for w in want]


def test_selection_is_exact(spark):
    r = np.random.default_rng(2)
    n = 3001
    many = r.lognormal(sigma=9, size=n) * r.choice([-1, 1], n)
    close = 1.0 + np.arange(n) * np.finfo(float).eps          # values that differ in the last bits only
    gaps = [None if i % 7 == 0 else NAN if i % 5 == 0 else float(v) for i, v in enumerate(r.permutation(many))]
    zeros = [float(v) for v in r.choice([-0.0, 0.0, 5e-324, -5e-324, 1e308], n)]
    check_quantiles(spark, [many.tolist(), r.permutation(close).tolist(), gaps, zeros, [4.25] * n, [None] * n, [NAN] * (n - 1) + [2.0]])


def test_selection_of_many_distinct_values(spark):
    n = 1_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) / 3.0).alias("x"))
    assert Q.select_quantiles(df, ["x"], [0.1, 0.5, 0.999])[0] == [pytest.approx(p * (n - 1) / 3, rel=1e-12) for p in (0.1, 0.5, 0.999)]


def test_selection_edges(spark):
    df = spark.createDataFrame([(1.0, INF), (2.0, -INF), (3.0, INF)], "a double, b double")
    assert Q.select_quantiles(df, ["a", "b"], [0.5, 1.0]) == [[2.0, 3.0], [INF, INF]]
    assert Q.select_quantiles(df.limit(0), ["a"], [0.5]) == [[None]]
    keys = Q.order_keys(np.array([-INF, -1.5, -0.0, 0.0, 5e-324, 2.0, INF]))
    assert (np.diff(keys) >= 0).all() and keys[2] == keys[3] and [Q.key_value(int(k)) for k in keys[[0, 1, 4, 5]]] == [-INF, -1.5, 5e-324, 2.0]


def test_plans_of_describe_have_no_range_exchange(spark):
    df = spark.range(1000).select((F.col("id") * 0.5).alias("x"), F.col("id").alias("y"))
    plan = P.describe(df, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


# ---------------------------------------------------------------- co-moments
def pandas_corr(x):
    import pandas as pd
    return pd.DataFrame(x).corr().to_numpy()


def test_matrix_of_100_columns_with_gaps(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 100)) @ r.normal(size=(100, 100)) + 1e6
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.3
    x[:, 8] = np.nan
    df = spark.createDataFrame([[None if np.isnan(v) and j % 2 else float(v) for j, v in enumerate(row)] for row in x],
                               ", ".join(f"c{j} double" for j in range(100))).repartition(6)
    got = {(r["x"], r["y"]): r["corr"] for r in P.corr_matrix(df, df.columns, digits=9).collect()}
    want = pandas_corr(x)
    for i in range(100):
        for j in range(100):
            w, g = want[i, j], got[f"c{i}", f"c{j}"]
            assert (g is None) if np.isnan(w) or 7 in (i, j) else g == pytest.approx(w, abs=2e-8), (i, j)


def test_blocks_merge_as_one():
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 4)) + [0, 100, -5, 1e3]
    x[r.random(x.shape) < 0.3] = np.nan
    whole = batch_moments(x)
    parts = PairMoments(*np.zeros((4, 4, 4)))
    for cut in np.array_split(x, [0, 1, 3, 90, 150]):
        if len(cut):
            parts = parts.merged(batch_moments(cut))
    back = PairMoments.unpacked(parts.packed(), 4)
    for k in ("n", "mean", "var", "co"):
        assert np.allclose(getattr(back, k), getattr(whole, k), rtol=1e-9, atol=1e-9)


def test_moments_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert [r["corr"] for r in P.corr_matrix(df, ["a", "b"]).collect()] == [None] * 4
    assert pair_moments(df.limit(0), ["a", "b"]).n.sum() == 0


# ---------------------------------------------------------------- densities, histograms
def exact_density(values, x, bw, total):
    return np.exp(-0.5 * ((x[:, None] - values) / bw) ** 2).sum(1) / (total * bw * math.sqrt(2 * math.pi))


def test_binned_density_is_near_the_exact_one(spark):
    r = np.random.default_rng(8)
    rows = [(None if i % 50 == 0 else "ab"[i % 3 == 0], float(v), float(w)) for i, (v, w) in enumerate(zip(r.normal(size=700), r.exponential(size=700) * 1e3))]
    rows += [("one", 5.0, NAN), ("flat", 1.0, None), ("flat", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, u double, v double").repartition(4)
    got = V.pair_diagonal(df, ["u", "v"], "k", digits=None).collect()
    assert {(g["k"], g["column_name"]) for g in got} == {(k, c) for k in ("a", "b", None) for c in "uv"}
    for c, j in (("u", 1), ("v", 2)):
        fitted = [x for x in rows if x[0] in ("a", "b", None) and x[j] is not None and not math.isnan(x[j])]
        for k in ("a", "b", None):
            values = np.array([x[j] for x in fitted if x[0] == k])
            curve = sorted((g["point"], g["x"], g["density"]) for g in got if (g["k"], g["column_name"]) == (k, c))
            bw = values.std(ddof=1) * len(values) ** -0.2
            x = np.array([p[1] for p in curve])
            assert len(curve) == 200 and x[0] == pytest.approx(values.min() - 3 * bw) and x[-1] == pytest.approx(values.max() + 3 * bw)
            want = exact_density(values, x, bw, len(fitted))
            assert np.abs(np.array([p[2] for p in curve]) - want).max() < 2e-3 * want.max()


def test_histograms_of_columns_equal_single_ones(spark):
    r = np.random.default_rng(9)
    rows = [(float(v), int(k), None if k == 3 else 2.5, None) for v, k in zip(r.lognormal(size=500), r.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "a double, b long, c double, d double")
    got = V.histogram_columns(df, ["a", "b", "c", "d"]).collect()
    for c, j in (("a", 0), ("b", 1), ("c", 2)):
        values = [x[j] for x in rows if x[j] is not None]
        n, edges = np.histogram(values, bins="auto") if c != "b" else np.histogram(np.array(values, float), bins="auto")
        mine = sorted((g["bin"], g["n"], g["lo_edge"], g["hi_edge"]) for g in got if g["column_name"] == c)
        assert [m[1] for m in mine] == n.tolist() and [m[2] for m in mine] == pytest.approx(edges[:-1].tolist())
    assert [tuple(g)[1:] for g in got if g["column_name"] == "d"] == [(0, 0.0, 1.0, 0)]


# ---------------------------------------------------------------- missing inputs and stacked fits
def test_metrics_with_missing_rows_and_without_rows(spark):
    df = spark.createDataFrame([(1.0, 1.5, 0.9), (2.0, None, 0.2), (3.0, 2.0, None), (9.0, NAN, NAN), (NAN, 1.0, 0.1), (0.0, 0.0, 0.4)], "y double, p double, q double")
    r = MT.regression_metrics(df, "y", "p").first()
    y, p = np.array([1.0, 3.0, 0.0]), np.array([1.5, 2.0, 0.0])
    assert r["n"] == 3 and r["mse"] == pytest.approx(((y - p) ** 2).mean(), abs=1e-4)
    assert r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)
    none = MT.regression_metrics(df.where("y > 100 and p is not null and not isnan(y)"), "y", "p").first()
    assert (none["n"], none["mse"], none["r2"]) == (0, None, None)
    c = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, NAN), (0, None), (None, 0.7), (1, 0.1)], "y int, p double")
    m = MT.classification_metrics(c, "y", "p").first()
    assert (m["n"], m["tp"], m["tn"], m["fp"], m["fn"]) == (3, 1, 1, 0, 1)
    empty = MT.classification_metrics(c.where("p is null"), "y", "p").first()
    assert (empty["n"], empty["accuracy"], empty["log_loss"], empty["f1"]) == (0, None, None, 0.0)


def test_missing_inputs_count_as_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (NAN, 1.0), (0.0, 1.0)], "a double, b double")
    lin = M.LinearParams(["a", "b"], [1.0, 0.0], [2.0, 1.0], [3.0, 1.0], 0.5)
    assert len({r[0] for r in df.select(lin.predict(0.0)).collect()}) == 1
    soft = M.SoftmaxParams(["a", "b", "c"], ["a", "b"], [[0.0, 1.0], [1.0, 0.0], [0.0, 0.0]], [0.0, 0.0, 0.0])
    assert [r[0] for r in df.select(soft.predict_label()).collect()] == ["a"] * 3


def test_excluded_rows_take_no_part(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + (1000 if i % 4 == 0 else 0), 1 if i % 4 == 0 else None if i % 5 == 0 else 0) for i in range(60)],
                               "id long, x double, y double, odd int")
    prep = M.prepare(df, ["x"], "y", "id", exclude="odd")
    assert (prep.n, prep.n_train) == (45, 36) and sorted(prep.data.columns) == ["id", "pos", "split", "x", "y"]
    p = M.fit_mlr(prep.train, ["x"], "y")
    assert prep.test.agg(F.max(F.abs(p.predict() - F.col("y")))).first()[0] < 1e-4


def test_scaler_variants_equal_single_fits(spark):
    r = np.random.default_rng(10)
    x = r.normal(size=(300, 2)) * [1, 30] + [0, 100]
    y = (r.random(300) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 100) / 40)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    variants = M.fit_scaler_variants(df, ["a", "b"], "y")
    raw = M.fit_logistic(df, ["a", "b"], "y")
    assert variants["Unscaled"].coef == pytest.approx(raw.coef, rel=1e-9)
    for name, shift, scale in (("StandardScaler", x.mean(0), x.std(0)), ("MinMaxScaler", x.min(0), np.ptp(x, axis=0))):
        own = spark.createDataFrame([(*map(float, row), int(c)) for row, c in zip((x - shift) / scale, y)], "a double, b double, y int")
        want = M.fit_logistic(own, ["a", "b"], "y")
        assert variants[name].coef == pytest.approx([w / s for w, s in zip(want.coef, scale)], rel=1e-7)
        assert variants[name].intercept == pytest.approx(want.intercept - sum(w * m / s for w, m, s in zip(want.coef, shift, scale)), rel=1e-6)
