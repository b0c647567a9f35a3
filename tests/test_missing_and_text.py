"""Missing values (NaN as NULL), number forms, quoted CSV text and restarted streams."""

import math

import numpy as np
import pandas as pd
import pytest

from tabprism.operators import clean, features, metrics, models, profile, scoring
from tabprism.sources.csv import read_csv, write_csv
from tabprism.sources.materialize import load_or_build
from tabprism.sources.scratch import scratch_path
from tabprism.streaming import stream_source, write_stream


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(float(i), "a" if i % 2 else "b", int(i % 2)) for i in range(41)] + [(float("nan"), "a", 1)]
    return spark.createDataFrame(rows, "x double, g string, y int")


def test_nan_is_missing(gaps):
    x = pd.Series(range(41), dtype=float)
    d = profile.describe(gaps, ["x"]).first()
    assert d["count"] == 41 and d["mean"] == pytest.approx(x.mean()) and d["max"] == 40
    assert profile.iqr_outliers(gaps, ["x"]).first()["n_outliers"] == 0
    scaled = [r["x"] for r in features.minmax_scale(gaps, ["x"]).collect()]
    assert scaled.count(None) == 1 and max(v for v in scaled if v is not None) == 1.0
    assert features.standard_params(gaps, ["x"]).first()["std"] == pytest.approx(x.std(), abs=1e-4)
    assert all(not math.isnan(r["mean"]) for r in profile.group_trend(gaps, "g", ["x"]).collect())
    assert profile.class_vs_overall_mean(gaps, "y", {"x": 2}).first()["overall_mean"] == 20.0


def test_logistic_score_counts_a_missing_input_as_zero(spark):
    p = models.LogisticParams(["x"], [2.0], -1.0)
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (3.0,)], "x double")
    got = [r["prediction"] for r in scoring.score_logistic(df, p).collect()]
    assert got == [0, 0, 0, 1]


def test_metrics_leave_missing_probabilities_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, None)], "y int, p double")
    m = metrics.classification_metrics(df, "y", "p").first()
    assert m["n"] == 2 and m["tp"] + m["tn"] == 2 and m["log_loss"] < 0.3


def test_number_forms(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "5.", "inf", "1d", "2F", "0x1p3", "1,000", "", "nan", "abc", None]
    got = [r["t"] for r in clean.coerce_numeric(spark.createDataFrame([(t,) for t in texts], "t string"), ["t"]).collect()]
    want = pd.to_numeric(pd.Series(texts), errors="coerce")
    assert [None if v is None else float(v) for v in got] == [None if pd.isna(v) else float(v) for v in want]


def test_quoted_csv_text(spark, tmp_path):
    pdf = pd.DataFrame({"a": [1, 2, 3], "t": ['he said "hi", ok', "two\nlines", "plain, text"]})
    pdf.to_csv(tmp_path / "q.csv", index=False)
    back = read_csv(spark, f"file://{tmp_path}/q.csv", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(pdf.itertuples(index=False, name=None))
    out = write_csv(back, scratch_path(spark, "csv-quotes"))
    again = read_csv(spark, out, multi_line=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, back.collect()))


def test_complete_integer_column_keeps_its_type(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (3, 6.0)], "i int, x double")
    out = clean.median_impute(df, ["i", "x"])
    assert out.dtypes == [("i", "int"), ("x", "double")] and [r["x"] for r in out.collect()] == [5.0, 4.0, 6.0]


def test_numeric_levels_sort_as_numbers(spark):
    df = spark.createDataFrame([(2,), (10,), (3,)], "k int")
    assert features.one_hot(df, ["k"]).columns == ["k_3", "k_10"]


def test_stream_restart_keeps_all_rows(spark):
    src, out = scratch_path(spark, "stream-src"), scratch_path(spark, "stream-sink")
    for part in (range(10), range(10, 20)):
        spark.createDataFrame([(i,) for i in part], "i long").write.mode("append").parquet(src)
        write_stream(stream_source(spark, src, spark.read.parquet(src).schema), out, trigger_once=True).awaitTermination(60)
    assert sorted(r["i"] for r in spark.read.parquet(out).collect()) == list(range(20))


def test_uncommitted_table_is_built_again(spark):
    path = scratch_path(spark, "built")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    jvm = spark._jvm.org.apache.hadoop.fs
    mark = jvm.Path(path, "_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
    assert load_or_build(spark, path, lambda: spark.range(5)).count() == 5
    assert load_or_build(spark, path, lambda: spark.range(9)).count() == 5


def test_newton_on_rare_heavy_tailed_classes(spark):
    """Against an independent optimum (gradient of the objective is zero)."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = rng.standard_t(1.5, size=800) * 5
        y = (rng.random(800) < 0.01 + 0.3 * (x > 40)).astype(int)
        if y.min() == y.max():
            continue
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
        p = models.fit_logistic(df, ["x"], "y", C=1.0)
        z = 1 / (1 + np.exp(-np.clip(p.intercept + p.coef[0] * x, -500, 500)))
        assert abs((z - y).sum()) < 1e-4 and abs(((z - y) * x).sum() + p.coef[0]) < 1e-2
