import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprism.operators import chartdata as V
from tabprism.operators import metrics as MT
from tabprism.operators import models as M
from tabprism.operators import scoring as SC


@pytest.fixture(scope="module")
def reg_data(spark):
    rng = np.random.default_rng(3)
    n = 300
    X = rng.normal(size=(n, 3)) * [1.0, 10.0, 0.1] + [5, 50, 1]
    y = 3 + X @ [2.0, -0.3, 7.0] + rng.normal(size=n)
    pdf = pd.DataFrame({"k": np.arange(n), "a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "y": y})
    return spark.createDataFrame(pdf), X, y


def test_prepare_split_and_coercion(spark):
    df = spark.createDataFrame([(i, str(i) if i != 3 else "bad", float(i)) for i in range(11)], "k long, x string, y double")
    prep = M.prepare(df, ["x"], "y", "k")
    assert prep.n == 10 and prep.n_train == 8 and prep.train.count() == 8 and prep.test.count() == 2


def test_mlr_matches_lstsq_and_orthogonal_residuals(spark, reg_data):
    df, X, y = reg_data
    p = M.fit_mlr(df, ["a", "b", "c"], "y")
    mu, sig = X.mean(axis=0), X.std(axis=0) + 1e-9
    Z = np.hstack([np.ones((len(y), 1)), (X - mu) / sig])
    theta = np.linalg.lstsq(Z, y, rcond=None)[0]
    assert np.allclose([p.intercept, *p.coef], theta, rtol=1e-9)
    res = df.withColumn("r", F.col("y") - p.predict())
    dots = res.agg(*[F.sum(F.col("r") * F.col(c)).alias(c) for c in "abc"]).first()
    assert all(abs(dots[c]) < 1e-6 for c in "abc")


def test_ridge_tends_to_ols(spark, reg_data):
    df, X, y = reg_data
    ols = M.fit_mlr(df, ["a", "b", "c"], "y")
    r = M.fit_ridge(df, ["a", "b", "c"], "y", alpha=1e-10)
    pa = df.select(ols.predict().alias("p")).collect()
    pb = df.select(r.predict().alias("p")).collect()
    assert max(abs(u["p"] - v["p"]) for u, v in zip(pa, pb)) < 1e-6
    r1 = M.fit_ridge(df, ["a", "b", "c"], "y", alpha=1.0)
    Z = (X - X.mean(0)) / X.std(0)
    w = np.linalg.solve(Z.T @ Z + np.eye(3), Z.T @ (y - y.mean()))
    assert np.allclose(r1.coef, w, rtol=1e-9)


@pytest.mark.parametrize("fit,l1,l2", [("lasso", 0.1, 0.0), ("enet", 0.05, 0.05)])
def test_penalised_kkt(spark, reg_data, fit, l1, l2):
    df, X, y = reg_data
    p = (M.fit_lasso(df, ["a", "b", "c"], "y", 0.1) if fit == "lasso"
         else M.fit_elasticnet(df, ["a", "b", "c"], "y", 0.1, 0.5))
    n = len(y)
    Z = (X - X.mean(0)) / X.std(0)
    w = np.array(p.coef)
    g = Z.T @ (y - y.mean() - Z @ w) / n - l2 * w      # gradient of the smooth part
    for j in range(3):
        if w[j] != 0:
            assert abs(g[j] - l1 * np.sign(w[j])) < 1e-8
        else:
            assert abs(g[j]) <= l1 + 1e-8


def test_gd_closed_form_matches_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(5, 10, 200)
    y = 2.5 * x + rng.normal(size=200) + 4
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    gd = M.fit_slr_gd(df, "x", "y", alpha=0.01, epochs=1000)
    mu, sig = x.mean(), x.std() + 1e-9
    z = (x - mu) / sig
    t0 = t1 = 0.0
    costs = []
    for _ in range(1000):
        e = t0 + t1 * z - y
        costs.append(np.mean(e ** 2))
        t0 -= 0.01 * (2 / 200) * e.sum()
        t1 -= 0.01 * (2 / 200) * (e * z).sum()
    assert math.isclose(gd.params.intercept, t0, rel_tol=1e-10)
    assert math.isclose(gd.params.coef[0], t1, rel_tol=1e-10)
    for k in (0, 1, 20, 500, 999):
        assert math.isclose(gd.cost(k), costs[k], rel_tol=1e-9)
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert M.fit_slr_gd(const, "x", "y").params.coef == [0.0]


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(11)
    n = 400
    X = rng.normal(size=(n, 2)) * [1.0, 3.0] + [0.5, -1]
    yv = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + X @ [1.2, -0.4])))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": yv}))
    p = M.fit_logistic(df, ["a", "b"], "y", n)
    A = np.hstack([np.ones((n, 1)), X])
    w = np.zeros(3)
    for _ in range(50):                       # Newton on Σ log-loss + ½‖coef‖² (intercept free)
        pr = 1 / (1 + np.exp(-A @ w))
        reg = np.diag([0.0, 1.0, 1.0])
        grad = A.T @ (pr - yv) + reg @ w
        H = A.T @ (A * (pr * (1 - pr))[:, None]) + reg
        w -= np.linalg.solve(H, grad)
    assert np.allclose([p.intercept, *p.coef], w, rtol=1e-8, atol=1e-10)


def test_classification_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (1, 0.5)], "y int, p double")
    r = MT.classification_metrics(df, "y", "p").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (2, 1, 1, 1)
    assert r["accuracy"] == 60.0 and r["precision"] == 66.67 and r["recall"] == 66.67 and r["f1"] == 66.67
    ll = -np.mean([np.log(.9), np.log(.4), np.log(.4), np.log(.9), np.log(.5)])
    assert r["log_loss"] == round(ll, 4)


def test_feature_auc_ties_and_single_class(spark):
    rng = np.random.default_rng(2)
    s = rng.integers(0, 5, 300).astype(float)           # heavy ties
    yv = (rng.uniform(size=300) < s / 5).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "t": s * 0 + 1.0, "y": yv}))
    got = {r["feature"]: r["auc"] for r in MT.feature_auc(df, ["s", "t"], "y").collect()}
    pos, neg = s[yv == 1], s[yv == 0]
    brute = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got["s"] == round(brute, 4) and got["t"] == 0.5
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert MT.feature_auc(one, ["s"], "y").count() == 0


def test_tiers(spark):
    df = spark.createDataFrame([("0",), (None,), ("abc",), ("5",), ("20",), ("10",)], "s string")
    med = M.positive_median(df, "s")
    assert med == 10.0
    got = [r[0] for r in df.select(M.tier_expr("s", med)).collect()]
    assert got == ["Not Placed", "Not Placed", "Not Placed", "Standard Package", "Premium Package", "Premium Package"]
    assert [r[0] for r in df.select(M.tier_expr("s", None)).collect()][3] == "Premium Package"


def test_scoring_equals_evaluation_predictions(spark, reg_data):
    df, X, y = reg_data
    p = M.fit_mlr(df, ["a", "b", "c"], "y")
    ev = df.select("k", p.predict().alias("e"))
    sc = SC.score_linear(df, p, "s", digits=None, fill_missing=0.0).select("k", "s")
    j = ev.join(sc, "k").where(F.abs(F.col("e") - F.col("s")) > 1e-12)
    assert j.count() == 0
    lp = M.LogisticParams(["a"], [1000.0], 0.0)
    out = SC.score_logistic(spark.createDataFrame([(1.0,), (-1.0,)], "a double"), lp).collect()
    assert [(r["probability"], r["prediction"]) for r in out] == [(100.0, 1), (0.0, 0)]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.lognormal(size=2000), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    h = V.histogram_auto(df, "x").orderBy("bin").collect()
    counts, edges = np.histogram(x, bins="auto")
    assert [r["n"] for r in h] == counts.tolist()
    assert np.allclose([r["lo_edge"] for r in h] + [h[-1]["hi_edge"]], edges)


def test_kde_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = V.kde_curve(df, "x", gridsize=50, digits=None).orderBy("point").collect()
    bw = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(x.min(), x.max(), 50)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.allclose([r["density"] for r in got], dens, rtol=1e-10)


def test_box_summary_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=300), [8.0, -9.0, 12.0]])
    g = np.arange(len(x)) % 2
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g}))
    for gg, r in ((r["g"], r) for r in V.box_summary(df, ["x"], by="g").collect()):
        v = x[g == gg]
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert np.isclose(r["q1"], q1) and np.isclose(r["median"], med)
        assert r["whisker_lo"] == v[v >= lo].min() and r["whisker_hi"] == v[v <= hi].max()
        assert r["n_fliers"] == int(((v < lo) | (v > hi)).sum())


def test_binned_rate_matches_pandas_cut(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.uniform(5.123, 9.876, 800), 3)
    t = (rng.uniform(size=800) < (x - 5) / 5).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "t": t}))
    got = {r["bin"]: r for r in V.binned_rate(df, "x", "t", 15, precision=3).collect()}
    ref = pd.DataFrame({"x": x, "t": t}).groupby(pd.cut(pd.Series(x), bins=15), observed=True)["t"].mean()
    assert len(got) == len(ref)
    for (iv, rate), b in zip(ref.items(), sorted(got)):
        assert math.isclose(got[b]["mid"], iv.mid) and math.isclose(got[b]["rate"], rate)


def test_pair_points_counts(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, "a"), (2, 4.0, 5.0, 6.0, "b")], "id long, p double, q double, r double, cls string")
    assert V.pair_points(df, ["p", "q", "r"], "cls", "id").count() == 2 * 6


def test_evaluation_report_rows(spark):
    from tabprism.operators.report import evaluation_report
    rng = np.random.default_rng(12)
    n = 200
    x = rng.normal(size=(n, 2))
    yv = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "a": x[:, 0], "b": x[:, 1], "y": yv}))
    prep = M.prepare(df, ["a", "b"], "y", "k")
    rep = dict(evaluation_report(prep, ["a", "b"], ["a", "b"], "y").collect())
    assert {"class_pct", "other_pct", "auc_a", "auc_b", "accuracy", "log_loss",
            "scaler_Unscaled", "scaler_StandardScaler", "scaler_MinMaxScaler"} <= set(rep)
    assert rep["class_pct"] + rep["other_pct"] == 100.0 and rep["auc_a"] > 0.8


def test_softmax_matches_numpy_newton(spark):
    rng = np.random.default_rng(21)
    n, K = 300, 3
    X = rng.normal(size=(n, 2)) * [2.0, 0.5] + [1.0, -1.0]
    S = np.stack([0.2 + X @ [1.0, 0.0], -0.1 + X @ [0.0, 2.0], np.zeros(n)], axis=1)
    yv = np.array([rng.choice(K, p=np.exp(s - s.max()) / np.exp(s - s.max()).sum()) for s in S])
    labels = np.array(["a", "b", "c"])[yv]
    df = spark.createDataFrame(pd.DataFrame({"u": X[:, 0], "v": X[:, 1], "lab": labels}))
    sm = M.fit_softmax(df, ["u", "v"], "lab")
    assert sm.classes == ["a", "b", "c"]
    # brute force: same objective, raw features, last intercept pinned to 0
    Z = np.hstack([np.ones((n, 1)), X])
    pos = [(k, j) for k in range(K) for j in range(3) if not (k == K - 1 and j == 0)]
    th = np.zeros(len(pos))
    for _ in range(60):
        B = np.zeros((K, 3))
        for i, (k, j) in enumerate(pos):
            B[k, j] = th[i]
        Sx = Z @ B.T
        P = np.exp(Sx - Sx.max(1, keepdims=True))
        P /= P.sum(1, keepdims=True)
        Y = np.eye(K)[yv]
        g = np.array([((P[:, k] - Y[:, k]) * Z[:, j]).sum() + (th[i] if j else 0.0) for i, (k, j) in enumerate(pos)])
        H = np.array([[(P[:, k] * ((k == l) - P[:, l]) * Z[:, j] * Z[:, m]).sum() + (1.0 if (a == b and j) else 0.0)
                       for b, (l, m) in enumerate(pos)] for a, (k, j) in enumerate(pos)])
        th -= np.linalg.solve(H, g)
    B = np.zeros((K, 3))
    for i, (k, j) in enumerate(pos):
        B[k, j] = th[i]
    # intercepts are defined up to one common shift (the pinned class differs in scale)
    icpt = np.array(sm.intercept) - sm.intercept[-1]
    assert np.allclose(icpt, B[:, 0] - B[-1, 0], atol=1e-7) and np.allclose(sm.coef, B[:, 1:], atol=1e-7)
    pred = [r[0] for r in df.select(sm.predict_label()).collect()]
    assert pred == list(np.array(["a", "b", "c"])[np.argmax(Z @ B.T, axis=1)])


def test_constant_column_histogram_and_cut_match_numpy_pandas(spark):
    x = np.array([5.0] * 7)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "t": [1, 0, 1, 1, 0, 1, 0]}))
    h = V.histogram_auto(df, "x").orderBy("bin").collect()
    counts, edges = np.histogram(x, bins="auto")
    assert [r["n"] for r in h] == counts.tolist()
    assert np.allclose([r["lo_edge"] for r in h] + [h[-1]["hi_edge"]], edges)
    got = V.binned_rate(df, "x", "t", 15, precision=3).collect()
    ref = df.toPandas().groupby(pd.cut(pd.Series(x), bins=15), observed=True)["t"].mean()
    assert len(got) == len(ref) == 1
    assert math.isclose(got[0]["mid"], list(ref.index)[0].mid) and math.isclose(got[0]["rate"], ref.iloc[0])


def test_page_index_empty_table(spark):
    from tabprism.operators import sampling as S
    idx = S.page_index(spark.range(0)).collect()
    assert len(idx) == 1 and idx[0]["total_rows"] == 0 and idx[0]["first_row"] == 0 and idx[0]["last_row"] == 0


def test_single_class_fits_raise(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0)], "a double, y int")
    with pytest.raises(ValueError):
        M.fit_logistic(df, ["a"], "y")
    with pytest.raises(ValueError):
        M.fit_softmax(df.selectExpr("a", "CAST(y AS STRING) AS lab"), ["a"], "lab")


def test_zero_variance_target_and_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 3.0, 7.0), (2.0, 3.0, 7.0), (4.0, 3.0, 7.0)], "a double, c double, y double")
    r = MT.regression_metrics(df.withColumn("yhat", F.lit(6.0)), "y", "yhat").first()
    assert r["r2"] == 0.0 and r["mse"] == 1.0 and r["mae"] == 1.0
    rng = np.random.default_rng(0)
    a = rng.normal(size=50)
    d2 = spark.createDataFrame(pd.DataFrame({"a": a, "c": np.full(50, 3.0), "y": 2 * a + 1}))
    p = M.fit_mlr(d2, ["a", "c"], "y")
    assert abs(p.coef[1]) < 1e-12 and abs(p.intercept - (2 * a + 1).mean()) < 1e-9


def test_degenerate_chart_inputs(spark):
    nul = spark.createDataFrame([(None, 1), (None, 0)], "x double, t int")
    h = V.histogram_auto(nul, "x").collect()
    assert len(h) == 1 and h[0]["n"] == 0
    assert V.kde_curve(spark.createDataFrame([(2.0,)], "x double"), "x").count() == 0
    assert V.binned_rate(nul, "x", "t").count() == 0
    from tabprism.operators import clean as C
    keys_only = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert sorted(tuple(r) for r in C.dedupe_keep_first(keys_only, ["k", "v"], ["k"]).collect()) == [(1, "a"), (2, "b")]
