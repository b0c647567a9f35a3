import math

import numpy as np
import pytest

from tabprism.functions.columns import exclude_columns, numeric_columns, present
from tabprism.operators import profile as P
from tabprism.operators.quantiles import quantiles


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 3)], "id long, x double, c string, t int")
    assert numeric_columns(df, exclude=["id", "t"]) == ["x"]
    assert exclude_columns(df, ["id"]) == ["x", "c", "t"]
    assert present(df, ["x", "nope"]) == ["x"]


def test_describe_edge_cases(spark):
    df = spark.createDataFrame(
        [(1, 5.0, None), (2, 5.0, None), (3, 5.0, None)], "id long, const double, allnull double")
    d = {r["column_name"]: r for r in P.describe(df, ["const", "allnull"], skew=True).collect()}
    assert d["const"]["std"] == 0.0 and d["const"]["median"] == 5.0 and d["const"]["skew"] == 0.0
    assert d["allnull"]["count"] == 0 and d["allnull"]["mean"] is None and d["allnull"]["q1"] is None
    one = P.describe(df.limit(1), ["const"], skew=True).first()
    assert one["count"] == 1 and one["std"] is None and one["skew"] is None
    empty = P.describe(df.where("id < 0"), ["const"]).first()
    assert empty["count"] == 0 and empty["median"] is None


@pytest.mark.parametrize("method", ["percentile", "rank"])
def test_quantiles_match_numpy(spark, method):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(size=400), 1)       # many ties
    vals[::3] = 0.0                                # one hot value: a third of the rows
    data = [(int(i), float(v) if i % 17 else None, int(i % 3)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(data, "id long, x double, g int")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["column_name"]: r for r in quantiles(df, ["x", "id"], probs, method=method).collect()}
    xs = np.array([v for _, v, _ in data if v is not None])
    for k, p in probs.items():
        assert math.isclose(got["x"][k], float(np.quantile(xs, p)), abs_tol=1e-12)
        assert math.isclose(got["id"][k], float(np.quantile(np.arange(400), p)), abs_tol=1e-9)
    by = {(r["g"], r["column_name"]): r["c"] for r in quantiles(df, ["x"], probs, by=["g"], method=method).collect()}
    for g in range(3):
        sub = np.array([v for i, v, gg in data if gg == g and v is not None])
        assert math.isclose(by[(g, "x")], float(np.median(sub)), abs_tol=1e-12)


def test_quantiles_nan_and_all_missing(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, None), (3.0, None)], "x double, y double")
    for m in ("percentile", "rank"):
        r = {x["column_name"]: x for x in quantiles(df, ["x", "y"], {"m": 0.5}, method=m).collect()}
        assert r["x"]["m"] == 2.0 and r["y"]["m"] is None


def test_missing_counts_nan_beside_null(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, None, None), (3, 1.0, "b")], "id long, x double, s string")
    got = {r["column_name"]: r["n_missing"] for r in P.missing_counts(df).collect()}
    assert got == {"x": 2, "s": 1}
    assert P.missing_total(df).first()["total_missing"] == 3
    ranked = P.missing_ranked(df).orderBy("rank").collect()
    assert [r["column_name"] for r in ranked] == ["x", "s"] and ranked[0]["pct_missing"] == 66.67


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert P.duplicate_rows(df).first()["n_duplicates"] == 2
    assert P.duplicate_rows(df, ["k"]).first()["n_duplicates"] == 3


def test_rates_and_balance(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("y", 1), (None, 1)], "c string, t int")
    r = {x["value"]: x["rate"] for x in P.rate_by_category(df, ["c"], "t").collect()}
    assert r == {"x": 50.0, "y": 100.0}
    b = {x["class"]: (x["n"], x["pct"]) for x in P.class_balance(df, "t").collect()}
    assert b == {1: (3, 75.0), 0: (1, 25.0)}
    f = {(x["column_name"], x["value"]): x["n"] for x in P.category_freq(df, ["c"]).collect()}
    assert f[("c", None)] == 1


def test_corr_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)],
                               "a double, b double, c double")
    m = {(r["x"], r["y"]): r["corr"] for r in P.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "b")] == 1.0 and m[("b", "a")] == 1.0
    assert m[("a", "c")] is None          # constant column


def test_iqr_outliers_and_flag(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double")
    assert P.iqr_outliers(df, ["x"]).first()["n_outliers"] == 2
    flags = dict(P.iqr_anomaly_flag(df, ["x"]).select("id", "is_anomaly").collect())
    assert flags[4] == 1 and flags[5] == 1 and flags[6] == 0 and flags[0] == 0


def test_kpi_empty_table(spark):
    df = spark.createDataFrame([], "t int, f int")
    r = P.kpi_overview(df, "t", "f").first()
    assert r["n_rows"] == 0 and r["class_pct"] == 0.0 and r["flagged_rate"] == 0.0


def test_insights_conditional_and_flag(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, 0), (1, 3.0, 1.0, 1), (0, 1.0, 5.0, 0), (0, 1.0, 5.0, 0)],
                               "t int, a double, b double, f int")
    got = dict(P.insights(df, "t", {"a": 1, "b": 1}, conditional=["a", "b"], flag="f").collect())
    assert set(got) == {"a", "class_share", "flagged"}        # b's class mean is lower: dropped
    assert got["a"] == "Rows with t = 1 average 3.0 a, against 2.0 overall."
    assert got["class_share"] == "50.0% of the 4 rows have t = 1."
    assert got["flagged"] == "1 rows (25.0%) are flagged by the IQR rule."
    always = dict(P.insights(df, "t", {"a": 1, "b": 1}, conditional=["a"]).collect())
    assert "b" in always


def test_corr_matrix_is_symmetric(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (2.0, 1.0, 0.7), (3.0, 5.0, 0.1)], "a double, b double, c double")
    m = {(r["x"], r["y"]): r["corr"] for r in P.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(m) == 9 and m[("a", "a")] == 1.0 and m[("a", "b")] == m[("b", "a")]
