"""Model keys: M1–M21, A5, V13–V16."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprism import constants as C
from tabprism.functions.expressions import rnd
from tabprism.operators import metrics as MT
from tabprism.operators import models as M
from tabprism.operators import sampling as S
from tabprism.operators import scoring as SC
from tabprism.operators.report import evaluation_report
from tabprism.plans import tables as T
from tabprism.plans.registry import query
from tabprism.plans.sqlgen import (cov_name, cramer_sql, logistic_ctes, logistic_z, moments_sql, prep_sql, q,
                                    softmax_ctes, softmax_predict_sql)
from tabprism.sources.csv import read_csv, write_csv
from tabprism.sources.params import load_fitted, load_linear_params, save_fitted, save_linear_params
from tabprism.sources.scratch import scratch_path

MLR_FEATS = ["sum_qty", "n_lines", "avg_discount", "avg_tax"]
LOGR_FEATS = ["o_totalprice", "n_lines", "sum_qty", "avg_discount", "avg_tax"]
AUC_FEATS = ["o_totalprice", "n_lines", "sum_qty", "avg_discount", "avg_tax"]
OF_CTE = f"WITH of AS ({T.OF_SQL}), "
PART_CTE = "WITH "


def _mlr_prep(spark, sf):
    return M.prepare(T.of(spark, sf), MLR_FEATS, "sum_price", "o_orderkey")


# ---------------------------------------------------------------- SQL pieces
def _mlr_sql_ctes(feats, target, kind="mlr", alpha=1.0):
    """CTEs m (moments), z (normal equations), t (solution th0.. and scales sg0..)."""
    k = len(feats)
    if kind == "mlr":
        sg = [f"(SQRT(c{i}_{i}) + 1e-9)" for i in range(k)]
        a = [[f"{cov_name(i, j)} / ({sg[i]} * {sg[j]})" for j in range(k)] for i in range(k)]
        b = [f"cy{i} / {sg[i]}" for i in range(k)]
    else:  # ridge on library-standardised inputs
        sg = [f"(CASE WHEN SQRT(c{i}_{i}) = 0 THEN 1.0 ELSE SQRT(c{i}_{i}) END)" for i in range(k)]
        a = [[f"n_train * {cov_name(i, j)} / ({sg[i]} * {sg[j]})" + (f" + {alpha}" if i == j else "")
              for j in range(k)] for i in range(k)]
        b = [f"n_train * cy{i} / {sg[i]}" for i in range(k)]
    sol = cramer_sql(a, b)
    cols = ", ".join([f"{sg[i]} AS sg{i}" for i in range(k)] + [f"{sol[i]} AS th{i}" for i in range(k)])
    return f"{moments_sql(feats, target)}, t AS (SELECT *, {cols} FROM m)"


def _pred_sql(feats, fill_zero=False):
    terms = []
    for i, c in enumerate(feats):
        x = f"COALESCE(CAST({q(c)} AS DOUBLE), 0)" if fill_zero else q(c)
        terms.append(f"th{i} * (({x} - mu{i}) / sg{i})")
    return "ybar + " + " + ".join(terms)


def _metrics_sql(y="y", yhat="yhat", src="e"):
    return (f"SELECT ROUND(AVG(({y} - {yhat}) * ({y} - {yhat})), 4) + 0.0 AS mse, "
            f"ROUND(SQRT(AVG(({y} - {yhat}) * ({y} - {yhat}))), 4) + 0.0 AS rmse, "
            f"ROUND(AVG(ABS({y} - {yhat})), 4) + 0.0 AS mae, "
            f"ROUND(CASE WHEN VAR_POP({y}) * COUNT({y}) != 0 THEN 1 - SUM(({y} - {yhat}) * ({y} - {yhat})) / "
            f"(VAR_POP({y}) * COUNT({y})) ELSE 0.0 END, 4) + 0.0 AS r2, CAST(COUNT(*) AS BIGINT) AS n FROM {src}")


def _clf_sql(src: str) -> str:
    """Classification metrics over a CTE with columns y, p (probability), yp (predicted class)."""
    return (f"pc AS (SELECT y, p, LEAST(GREATEST(p, {_EPS!r}), 1 - {_EPS!r}) AS pe, yp FROM {src}), "
            "cm AS (SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE yp = 1 AND y = 1) AS BIGINT) AS tp, "
            "CAST(COUNT(*) FILTER (WHERE yp = 0 AND y = 0) AS BIGINT) AS tn, "
            "CAST(COUNT(*) FILTER (WHERE yp = 1 AND y = 0) AS BIGINT) AS fp, "
            "CAST(COUNT(*) FILTER (WHERE yp = 0 AND y = 1) AS BIGINT) AS fn, "
            "AVG(-(y * LN(pe) + (1 - y) * LN(1 - pe))) AS ll FROM pc), "
            "c2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN ROUND(tp / (tp + fp) * 100, 2) ELSE 0.0 END + 0.0 AS precision, "
            "CASE WHEN tp + fn > 0 THEN ROUND(tp / (tp + fn) * 100, 2) ELSE 0.0 END + 0.0 AS recall FROM cm), "
            "mx AS (SELECT n, tp, tn, fp, fn, ROUND((tp + tn) / n * 100, 2) + 0.0 AS accuracy, "
            "ROUND(ll, 4) + 0.0 AS log_loss, precision, recall, CASE WHEN precision + recall > 0 THEN "
            "ROUND(2 * precision * recall / (precision + recall), 2) + 0.0 ELSE 0.0 END AS f1 FROM c2)")


def _mlr_full_sql(final: str) -> str:
    return (OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", MLR_FEATS, "sum_price") + ", "
            + _mlr_sql_ctes(MLR_FEATS, "sum_price") + ", "
            + f"e AS (SELECT s.*, sum_price AS y, {_pred_sql(MLR_FEATS)} AS yhat FROM s, t WHERE split = 'test') "
            + final)


# ---------------------------------------------------------------- M1, G8
@query("train_standardise", OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", MLR_FEATS, "sum_price") + ", "
       + "st AS (SELECT " + ", ".join(f"AVG({c}) AS mu{i}, STDDEV_POP({c}) + 1e-9 AS sg{i}"
                                      for i, c in enumerate(MLR_FEATS)) + " FROM s WHERE split = 'train') "
       + "SELECT o_orderkey, split, " + ", ".join(f"ROUND(({c} - mu{i}) / sg{i}, 6) + 0.0 AS {c}"
                                                 for i, c in enumerate(MLR_FEATS)) + " FROM s, st")
def train_standardise(spark, sf):
    prep = _mlr_prep(spark, sf)
    mu, sig = M.fit_standardiser(prep.train, MLR_FEATS, ddof=0, eps=M.SIG_EPS, zero_to_one=False)
    return M.standardise(prep.data, MLR_FEATS, mu, sig, 6).select("o_orderkey", "split", *MLR_FEATS)


@query("library_standardise", OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", MLR_FEATS, "sum_price") + ", "
       + "st AS (SELECT " + ", ".join(f"AVG({c}) AS mu{i}, CASE WHEN STDDEV_POP({c}) = 0 THEN 1.0 ELSE STDDEV_POP({c}) END AS sg{i}"
                                      for i, c in enumerate(MLR_FEATS)) + " FROM s WHERE split = 'train') "
       + "SELECT o_orderkey, split, " + ", ".join(f"ROUND(({c} - mu{i}) / sg{i}, 6) + 0.0 AS {c}"
                                                 for i, c in enumerate(MLR_FEATS)) + " FROM s, st")
def library_standardise(spark, sf):
    """M2: train-fitted library scaler (population σ, constant column → σ = 1), applied to all rows."""
    prep = _mlr_prep(spark, sf)
    mu, sig = M.fit_standardiser(prep.train, MLR_FEATS, ddof=0, eps=0.0, zero_to_one=True)
    return M.standardise(prep.data, MLR_FEATS, mu, sig, 6).select("o_orderkey", "split", *MLR_FEATS)


@query("train_class_balance", OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", LOGR_FEATS, "flag") +
       " SELECT ROUND(AVG(CASE WHEN flag = 1 THEN 1.0 ELSE 0.0 END) * 100, 1) + 0.0 AS class_pct, "
       "CAST(COUNT(*) AS BIGINT) AS n_train FROM s WHERE split = 'train'")
def train_class_balance(spark, sf):
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    return prep.train.agg(rnd(F.avg(F.when(F.col("flag") == 1, 1.0).otherwise(0.0)) * 100, 1).alias("class_pct"),
                          F.count(F.lit(1)).alias("n_train"))


# ---------------------------------------------------------------- M3, M12, M17, M18
_MLR_OUT = ("SELECT ROUND(ybar, 4) + 0.0 AS intercept, "
            + ", ".join(f"ROUND(th{i}, 4) + 0.0 AS coef_{c}" for i, c in enumerate(MLR_FEATS))
            + ", mt.mse, mt.rmse, mt.mae, mt.r2, n_train, mt.n AS n_test FROM t, (" + _metrics_sql() + ") mt")


@query("mlr_fit", _mlr_full_sql(_MLR_OUT))
def mlr_fit(spark, sf):
    prep = _mlr_prep(spark, sf)
    p = M.fit_mlr(prep.train, MLR_FEATS, "sum_price")
    scored = prep.test.withColumn("yhat", p.predict())
    met = MT.regression_metrics(scored, "sum_price", "yhat")
    coefs = [rnd(F.lit(p.intercept), 4).alias("intercept")]
    coefs += [rnd(F.lit(w), 4).alias(f"coef_{c}") for c, w in zip(MLR_FEATS, p.coef)]
    return met.select(*coefs, "mse", "rmse", "mae", "r2",
                      F.lit(prep.n_train).cast("bigint").alias("n_train"), F.col("n").alias("n_test"))


@query("prediction_sample", _mlr_full_sql(
    "SELECT pos, ROUND(y, 2) + 0.0 AS actual, ROUND(yhat, 2) + 0.0 AS predicted FROM e ORDER BY pos LIMIT 10"))
def prediction_sample(spark, sf):
    prep = _mlr_prep(spark, sf)
    p = M.fit_mlr(prep.train, MLR_FEATS, "sum_price")
    return SC.prediction_sample(prep.test.withColumn("yhat", p.predict()), "sum_price", "yhat", 10)


@query("score_mlr", OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", MLR_FEATS, "sum_price") + ", "
       + _mlr_sql_ctes(MLR_FEATS, "sum_price")
       + f" SELECT o_orderkey, ROUND({_pred_sql(MLR_FEATS, fill_zero=True)}, 2) + 0.0 AS prediction FROM of, t")
def score_mlr(spark, sf):
    of = T.of(spark, sf)
    prep = M.prepare(of, MLR_FEATS, "sum_price", "o_orderkey")
    p = M.fit_mlr(prep.train, MLR_FEATS, "sum_price")
    return SC.score_linear(of, p, "prediction", 2).select("o_orderkey", "prediction")


# the features of score_mlr with gaps: NULL in some orders, NaN in others
_OF_GAPS_SQL = ("SELECT o_orderkey, n_lines, avg_tax, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN CAST('nan' AS DOUBLE) "
                "ELSE sum_qty END AS sum_qty, CASE WHEN o_orderkey % 3 = 0 THEN CAST('nan' AS DOUBLE) ELSE avg_discount END AS avg_discount FROM of")
_FILLED_SQL = ("SELECT o_orderkey, n_lines, avg_tax, CASE WHEN isnan(sum_qty) THEN NULL ELSE sum_qty END AS sum_qty, "
               "CASE WHEN isnan(avg_discount) THEN NULL ELSE avg_discount END AS avg_discount FROM (" + _OF_GAPS_SQL + ") g")


@query("score_mlr_nan", OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", MLR_FEATS, "sum_price") + ", "
       + _mlr_sql_ctes(MLR_FEATS, "sum_price") + ", gf AS (" + _FILLED_SQL
       + f") SELECT o_orderkey, ROUND({_pred_sql(MLR_FEATS, fill_zero=True)}, 2) + 0.0 AS prediction FROM gf, t")
def score_mlr_nan(spark, sf):
    """M18 on rows whose inputs are NULL or NaN: both count as 0."""
    of = T.of(spark, sf)
    p = M.fit_mlr(M.prepare(of, MLR_FEATS, "sum_price", "o_orderkey").train, MLR_FEATS, "sum_price")
    nan, key = F.lit(float("nan")), F.col("o_orderkey")
    gaps = of.withColumns({"sum_qty": F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, nan).otherwise(F.col("sum_qty")),
                           "avg_discount": F.when(key % 3 == 0, nan).otherwise(F.col("avg_discount"))})
    return SC.score_linear(gaps, p, "prediction", 2).select("o_orderkey", "prediction")


@query("prepare_excluded", OF_CTE + "fl AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS odd FROM of), "
       + prep_sql("SELECT * FROM fl WHERE odd IS NULL OR odd <> 1", "o_orderkey", MLR_FEATS, "sum_price") + ", "
       + _mlr_sql_ctes(MLR_FEATS, "sum_price") + ", "
       + f"e AS (SELECT s.*, sum_price AS y, {_pred_sql(MLR_FEATS)} AS yhat FROM s, t WHERE split = 'test') " + _metrics_sql())
def prepare_excluded(spark, sf):
    """Rows flagged 1 are left out before the split and the fit; validation metrics of the rest."""
    key = F.col("o_orderkey")
    flagged = T.of(spark, sf).withColumn("odd", F.when(key % 9 == 0, F.lit(None)).otherwise((key % 4 == 1).cast("int")))
    prep = M.prepare(flagged, MLR_FEATS, "sum_price", "o_orderkey", exclude="odd")
    p = M.fit_mlr(prep.train, MLR_FEATS, "sum_price")
    return MT.regression_metrics(prep.test.withColumn("yhat", p.predict()), "sum_price", "yhat")


@query("regression_metrics", "WITH e AS (SELECT CAST(l_tax AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) AS yhat "
       "FROM lineitem) " + _metrics_sql())
def regression_metrics(spark, sf):
    """M12 on two lineitem rate columns (one read as the prediction of the other)."""
    return MT.regression_metrics(T.load(spark, sf, "lineitem"), "l_tax", "l_discount")


# events with a class, a probability and two measures, each NULL in some rows and NaN in others
_GAPS = {"y": ("event_id % 2", 5, 0), "p": ("event_id % 100 / 100.0", 7, 9), "a": ("value", 4, 11), "b": ("user_id % 50", 6, 13)}
_GAPS_SQL = "SELECT event_id, " + ", ".join(
    f"CASE WHEN event_id % {null} = 0 THEN NULL " + (f"WHEN event_id % {nan} = 1 THEN CAST('nan' AS DOUBLE) " if nan else "")
    + f"ELSE CAST({x} AS DOUBLE) END AS {c}" for c, (x, null, nan) in _GAPS.items()) + " FROM events"
# DuckDB orders NaN above all numbers; both engines see it as missing
_KNOWN_SQL = "e AS (SELECT * FROM (" + _GAPS_SQL + ") g WHERE {0} IS NOT NULL AND {1} IS NOT NULL AND NOT isnan({0}) AND NOT isnan({1}))"


def _gaps(spark, sf):
    e = T.load(spark, sf, "events")
    cols = [F.when(F.col("event_id") % null == 0, F.lit(None).cast("double"))
            .otherwise(F.when((F.col("event_id") % nan == 1) if nan else F.lit(False), F.lit(float("nan"))).otherwise(F.expr(x).cast("double"))).alias(c)
            for c, (x, null, nan) in _GAPS.items()]
    return e.select("event_id", *cols)


@query("regression_metrics_missing", "WITH " + _KNOWN_SQL.format("a", "b") + " " + _metrics_sql("a", "b"))
def regression_metrics_missing(spark, sf):
    """M12 where values and predictions are NULL or NaN in some rows."""
    return MT.regression_metrics(_gaps(spark, sf), "a", "b")


# ---------------------------------------------------------------- M4, P15, V14, V15, M19, M21
def _slr_prep(spark, sf):
    return M.prepare(T.load(spark, sf, "part"), ["p_partkey"], "p_retailprice", "p_partkey")


_SLR_CTES = (PART_CTE + prep_sql("SELECT * FROM part", "p_partkey", ["p_partkey"], "p_retailprice")
             .replace("d AS (SELECT p_partkey, ", "d AS (SELECT p_partkey AS k, ")
             .replace("ORDER BY p_partkey", "ORDER BY k") + ", "
             "m AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_train, AVG(p_partkey) AS mu, "
             "COVAR_POP(p_partkey, p_partkey) AS vx, COVAR_POP(p_partkey, p_retailprice) AS cxy, "
             "AVG(p_retailprice) AS ybar, COVAR_POP(p_retailprice, p_retailprice) AS vy FROM s WHERE split = 'train'), "
             "g AS (SELECT *, SQRT(vx) + 1e-9 AS sig FROM m), "
             "g2 AS (SELECT *, vx / (sig * sig) AS sx, cxy / sig AS c, vy + ybar * ybar AS qq FROM g), "
             "t AS (SELECT *, ybar * (1 - POW(1 - 2 * CAST(0.01 AS DOUBLE), 1000)) AS th0, "
             "CASE WHEN sx > 0 THEN (c / sx) * (1 - POW(1 - 2 * CAST(0.01 AS DOUBLE) * sx, 1000)) ELSE 0.0 END "
             "AS th1 FROM g2)")


@query("slr_gd_fit", _SLR_CTES + ", e AS (SELECT p_retailprice AS y, th0 + th1 * ((p_partkey - mu) / sig) AS yhat "
       "FROM s, t WHERE split = 'test') SELECT ROUND(th0, 4) + 0.0 AS intercept, ROUND(th1, 4) + 0.0 AS slope, "
       "mt.mse, mt.rmse, mt.mae, mt.r2, n_train, mt.n AS n_test, 1000 AS epochs, CAST(0.01 AS DOUBLE) AS alpha "
       "FROM t, (" + _metrics_sql() + ") mt")
def slr_gd_fit(spark, sf):
    prep = _slr_prep(spark, sf)
    gd = M.fit_slr_gd(prep.train, "p_partkey", "p_retailprice")
    p = gd.params
    met = MT.regression_metrics(prep.test.withColumn("yhat", p.predict()), "p_retailprice", "yhat")
    return met.select(rnd(F.lit(p.intercept), 4).alias("intercept"), rnd(F.lit(p.coef[0]), 4).alias("slope"),
                      "mse", "rmse", "mae", "r2", F.lit(prep.n_train).cast("bigint").alias("n_train"),
                      F.col("n").alias("n_test"), F.lit(gd.epochs).alias("epochs"), F.lit(gd.alpha).alias("alpha"))


@query("gd_cost_history", _SLR_CTES + " SELECT k AS epoch, ROUND(t0 * t0 + t1 * t1 * sx + qq - 2 * t0 * ybar "
       "- 2 * t1 * c, 4) + 0.0 AS cost FROM (SELECT k, sx, qq, ybar, c, ybar * (1 - POW(1 - 2 * CAST(0.01 AS DOUBLE), k)) "
       "AS t0, CASE WHEN sx > 0 THEN (c / sx) * (1 - POW(1 - 2 * CAST(0.01 AS DOUBLE) * sx, k)) ELSE 0.0 END AS t1 "
       f"FROM t, range(0, {C.GD_EPOCHS}, {C.GD_COST_STRIDE}) r(k)) h")
def gd_cost_history(spark, sf):
    """The train MSE before every 20th epoch, from the closed-form trajectory."""
    prep = _slr_prep(spark, sf)
    gd = M.fit_slr_gd(prep.train, "p_partkey", "p_retailprice")
    k = F.col("id").cast("double")
    a = F.lit(gd.alpha)
    t0 = F.lit(gd.ybar) * (1 - F.pow(1 - 2 * a, k))
    t1 = (F.lit(gd.c / gd.s) * (1 - F.pow(1 - 2 * a * F.lit(gd.s), k))) if gd.s > 0 else F.lit(0.0)
    cost = t0 * t0 + t1 * t1 * F.lit(gd.s) + F.lit(gd.q) - 2 * t0 * F.lit(gd.ybar) - 2 * t1 * F.lit(gd.c)
    return spark.range(0, gd.epochs, C.GD_COST_STRIDE).select(F.col("id").alias("epoch"), rnd(cost, 4).alias("cost"))


@query("regression_line", _SLR_CTES + ", zr AS (SELECT MIN((p_partkey - mu) / sig) AS lo, "
       "MAX((p_partkey - mu) / sig) AS hi FROM s, t WHERE split = 'test') "
       "SELECT i AS point, ROUND(xn * sig + mu, 3) + 0.0 AS line_x, ROUND(th0 + th1 * xn, 3) + 0.0 AS line_y FROM "
       "(SELECT i, sig, mu, th0, th1, CASE WHEN i = 29 THEN hi ELSE i * ((hi - lo) / 29) + lo END AS xn "
       "FROM t, zr, range(0, 30) r(i)) l")
def regression_line(spark, sf):
    """30 points of the fitted line across the test feature range (as the reference's code does)."""
    prep = _slr_prep(spark, sf)
    p = M.fit_slr_gd(prep.train, "p_partkey", "p_retailprice").params
    r = prep.test.agg(F.min(p.z(0)).alias("lo"), F.max(p.z(0)).alias("hi")).first()
    xn = M.linspace_expr(F.col("id"), r["lo"], r["hi"], C.LINE_POINTS)
    return spark.range(C.LINE_POINTS).select(F.col("id").alias("point"),
                                  rnd(xn * F.lit(p.sig[0]) + F.lit(p.mu[0]), 3).alias("line_x"),
                                  rnd(F.lit(p.intercept) + F.lit(p.coef[0]) * xn, 3).alias("line_y"))


@query("slr_scatter", _SLR_CTES + ", te AS (SELECT s.*, pos - n_train AS tpos, COUNT(*) OVER () AS nt "
       "FROM s, m WHERE split = 'test'), kk AS (SELECT LEAST(200, COUNT(*)) AS k, COUNT(*) AS nt FROM te), "
       "idx AS (SELECT i AS sample_idx, CASE WHEN i = k - 1 THEN nt - 1 ELSE CAST(FLOOR(i * ((nt - 1) / (k - 1))) "
       "AS BIGINT) END AS pp FROM kk, range(0, k) r(i)) "
       "SELECT sample_idx, ROUND(((p_partkey - mu) / sig) * sig + mu, 3) + 0.0 AS scatter_x, "
       "ROUND(p_retailprice, 3) + 0.0 AS scatter_y FROM te JOIN idx ON tpos = pp, t")
def slr_scatter(spark, sf):
    """≤ 200 evenly spaced test points (feature restored from its z-score, target)."""
    prep = _slr_prep(spark, sf)
    p = M.fit_slr_gd(prep.train, "p_partkey", "p_retailprice").params
    test = prep.test.withColumn("tpos", F.col("pos") - F.lit(prep.n_train))
    s = S.linspace_sample(test, 200, "tpos")
    return s.select("sample_idx", rnd(p.z(0) * F.lit(p.sig[0]) + F.lit(p.mu[0]), 3).alias("scatter_x"),
                    rnd(F.col("p_retailprice"), 3).alias("scatter_y"))


@query("score_slr", _SLR_CTES + " SELECT part.p_partkey, ROUND(th0 + th1 * ((COALESCE(CAST(part.p_partkey AS DOUBLE), 0)"
       " - mu) / sig), 2) + 0.0 AS prediction FROM part, t")
def score_slr(spark, sf):
    prep = _slr_prep(spark, sf)
    p = M.fit_slr_gd(prep.train, "p_partkey", "p_retailprice").params
    part = T.load(spark, sf, "part")
    return SC.score_linear(part.select("p_partkey"), p, "prediction", 2)


@query("model_params_roundtrip", _SLR_CTES + " SELECT 'intercept' AS term, -1 AS idx, CAST(NULL AS DOUBLE) AS mu, "
       "CAST(NULL AS DOUBLE) AS sig, ROUND(th0, 6) + 0.0 AS coef FROM t UNION ALL SELECT 'p_partkey', 0, "
       "ROUND(mu, 6) + 0.0, ROUND(sig, 6) + 0.0, ROUND(th1, 6) + 0.0 FROM t")
def model_params_roundtrip(spark, sf):
    """Fitted parameters saved as a parquet table, read back, and used as a scorer."""
    prep = _slr_prep(spark, sf)
    p = M.fit_slr_gd(prep.train, "p_partkey", "p_retailprice").params
    path = save_linear_params(spark, p, scratch_path(spark, "slr-params"))
    back = load_linear_params(spark, path)
    assert back.features == p.features
    return spark.read.parquet(path).select("term", "idx", *[rnd(c, 6).alias(c) for c in ("mu", "sig", "coef")])


# ---------------------------------------------------------------- M5–M7
@query("ridge_fit", OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", MLR_FEATS, "sum_price") + ", "
       + _mlr_sql_ctes(MLR_FEATS, "sum_price", kind="ridge", alpha=1.0) + ", "
       + f"e AS (SELECT sum_price AS y, {_pred_sql(MLR_FEATS)} AS yhat FROM s, t WHERE split = 'test') "
       + "SELECT mt.r2, mt.rmse, mt.mae FROM (" + _metrics_sql() + ") mt")
def ridge_fit(spark, sf):
    prep = _mlr_prep(spark, sf)
    p = M.fit_ridge(prep.train, MLR_FEATS, "sum_price", 1.0)
    return MT.regression_metrics(prep.test.withColumn("yhat", p.predict()), "sum_price", "yhat").select(
        "r2", "rmse", "mae")


def _cd_sql(l1: float, l2: float, sweeps: int = 3000) -> str:
    """Coordinate descent on the standardised Gram matrix as a recursive CTE (one sweep per step)."""
    k = len(MLR_FEATS)
    sd = [f"(CASE WHEN SQRT(c{i}_{i}) = 0 THEN 1.0 ELSE SQRT(c{i}_{i}) END)" for i in range(k)]
    consts = [f"{sd[i]} AS sg{i}" for i in range(k)]
    consts += [f"n_train * {cov_name(i, j)} / ({sd[i]} * {sd[j]}) AS gg{i}_{j}" for i in range(k) for j in range(k)]
    consts += [f"n_train * cy{i} / {sd[i]} AS bb{i}" for i in range(k)]
    consts += [f"n_train * CAST({l1!r} AS DOUBLE) AS a1", f"n_train * CAST({l2!r} AS DOUBLE) AS a2"]
    step = "SELECT cd.it, cd.w0, cd.w1, cd.w2, cd.w3, g.* FROM cd, g WHERE cd.it < " + str(sweeps)
    for j in range(k):
        cur = [f"n{i}" if i < j else f"w{i}" for i in range(k)]
        rho = f"(bb{j} - " + " - ".join(f"gg{j}_{i} * {cur[i]}" for i in range(k) if i != j) + ")"
        step = (f"SELECT *, CASE WHEN gg{j}_{j} + a2 = 0 THEN w{j} ELSE SIGN({rho}) * "
                f"GREATEST(ABS({rho}) - a1, 0.0) / (gg{j}_{j} + a2) END AS n{j} FROM ({step}) l{j}")
    rec = ("cd(it, w0, w1, w2, w3) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), "
           f"CAST(0 AS DOUBLE) UNION ALL SELECT it + 1, n0, n1, n2, n3 FROM ({step}) st)")
    pred = "ybar + " + " + ".join(f"w{i} * (({c} - mu{i}) / sg{i})" for i, c in enumerate(MLR_FEATS))
    return ("WITH RECURSIVE of AS (" + T.OF_SQL + "), "
            + prep_sql("SELECT * FROM of", "o_orderkey", MLR_FEATS, "sum_price") + ", "
            + moments_sql(MLR_FEATS, "sum_price") + f", g AS (SELECT *, {', '.join(consts)} FROM m), {rec}, "
            + f"wf AS (SELECT w0, w1, w2, w3 FROM cd WHERE it = {sweeps}), "
            + f"e AS (SELECT sum_price AS y, {pred} AS yhat FROM s, g, wf WHERE split = 'test') "
            + "SELECT mt.r2, mt.rmse, mt.mae FROM (" + _metrics_sql() + ") mt")


@query("lasso_fit", _cd_sql(0.1, 0.0))
def lasso_fit(spark, sf):
    prep = _mlr_prep(spark, sf)
    p = M.fit_lasso(prep.train, MLR_FEATS, "sum_price", 0.1)
    return MT.regression_metrics(prep.test.withColumn("yhat", p.predict()), "sum_price", "yhat").select(
        "r2", "rmse", "mae")


@query("elasticnet_fit", _cd_sql(0.1 * 0.5, 0.1 * (1 - 0.5)))
def elasticnet_fit(spark, sf):
    prep = _mlr_prep(spark, sf)
    p = M.fit_elasticnet(prep.train, MLR_FEATS, "sum_price", 0.1, 0.5)
    return MT.regression_metrics(prep.test.withColumn("yhat", p.predict()), "sum_price", "yhat").select(
        "r2", "rmse", "mae")


# ---------------------------------------------------------------- M11, M13, M15, M16
_LPM_CTES = (OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", LOGR_FEATS, "flag") + ", "
             "lp AS (SELECT REGR_INTERCEPT(flag, sum_qty) AS b, REGR_SLOPE(flag, sum_qty) AS w FROM s "
             "WHERE split = 'train') ")


@query("linear_probability_range", _LPM_CTES + "SELECT lin_min, lin_max, printf('%s → %s', CAST(lin_min AS VARCHAR), "
       "CAST(lin_max AS VARCHAR)) AS lin_range FROM (SELECT ROUND(MIN(b + w * sum_qty), 2) + 0.0 AS lin_min, "
       "ROUND(MAX(b + w * sum_qty), 2) + 0.0 AS lin_max FROM s, lp WHERE split = 'train') r")
def linear_probability_range(spark, sf):
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    return M.lpm_range(prep.train, "sum_qty", "flag")


_EPS = MT.EPS


@query("classification_metrics", _LPM_CTES + (
    ", pr AS (SELECT flag AS y, LEAST(GREATEST(b + w * sum_qty, 0.0), 1.0) AS p FROM s, lp WHERE split = 'test'), "
    f"pc AS (SELECT y, p, LEAST(GREATEST(p, {_EPS!r}), 1 - {_EPS!r}) AS pe, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yp FROM pr), "
    "cm AS (SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE yp = 1 AND y = 1) AS BIGINT) AS tp, "
    "CAST(COUNT(*) FILTER (WHERE yp = 0 AND y = 0) AS BIGINT) AS tn, CAST(COUNT(*) FILTER (WHERE yp = 1 AND y = 0) AS BIGINT) AS fp, "
    "CAST(COUNT(*) FILTER (WHERE yp = 0 AND y = 1) AS BIGINT) AS fn, AVG(-(y * LN(pe) + (1 - y) * LN(1 - pe))) AS ll FROM pc), "
    "c2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN ROUND(tp / (tp + fp) * 100, 2) ELSE 0.0 END + 0.0 AS precision, "
    "CASE WHEN tp + fn > 0 THEN ROUND(tp / (tp + fn) * 100, 2) ELSE 0.0 END + 0.0 AS recall FROM cm) "
    "SELECT n, tp, tn, fp, fn, ROUND((tp + tn) / n * 100, 2) + 0.0 AS accuracy, ROUND(ll, 4) + 0.0 AS log_loss, "
    "precision, recall, CASE WHEN precision + recall > 0 THEN ROUND(2 * precision * recall / (precision + recall), 2) + 0.0 "
    "ELSE 0.0 END AS f1 FROM c2"))
def classification_metrics(spark, sf):
    """M13 on the straight-line probability model (clipped to [0, 1]) over the test rows."""
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    b, w = M.fit_lpm(prep.train, "sum_qty", "flag")
    p = F.least(F.greatest(F.lit(b) + F.lit(w) * F.col("sum_qty"), F.lit(0.0)), F.lit(1.0))
    return MT.classification_metrics(prep.test.withColumn("p", p), "flag", "p")


@query("classification_metrics_missing", "WITH " + _KNOWN_SQL.format("y", "p") + ", pr AS (SELECT y, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yp FROM e), "
       + _clf_sql("pr") + " SELECT * FROM mx")
def classification_metrics_missing(spark, sf):
    """M13 where classes and probabilities are NULL or NaN in some rows."""
    return MT.classification_metrics(_gaps(spark, sf), "y", "p")


def _auc_sql():
    parts = []
    for c in AUC_FEATS:
        parts.append(
            f"SELECT '{c}' AS feature, {c} AS v, SUM(flag) AS pos, SUM(1 - flag) AS neg FROM s "
            f"WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}")
    return (OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", LOGR_FEATS, "flag") + ", g AS ("
            + " UNION ALL ".join(parts) + "), r AS (SELECT *, SUM(neg) OVER (PARTITION BY feature ORDER BY v "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM g) "
            "SELECT feature, ROUND(SUM(pos * (below + 0.5 * neg)) / (SUM(pos) * SUM(neg)), 4) + 0.0 AS auc "
            "FROM r GROUP BY feature HAVING SUM(pos) > 0 AND SUM(neg) > 0")


@query("feature_auc", _auc_sql())
def feature_auc(spark, sf):
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    return MT.feature_auc(prep.train, AUC_FEATS, "flag")


_TIER_SQL = (OF_CTE + prep_sql("SELECT *, CASE WHEN flag = 1 THEN sum_price ELSE 0 END AS salary FROM of",
                               "o_orderkey", LOGR_FEATS, "flag", extra=", salary") + ", "
             "md AS (SELECT QUANTILE_CONT(salary, 0.5) FILTER (WHERE salary > 0) AS med FROM s WHERE split = 'train') "
             "SELECT o_orderkey, split, CASE WHEN salary IS NULL OR salary = 0 THEN 'Not Placed' "
             "WHEN salary < med THEN 'Standard Package' ELSE 'Premium Package' END AS tier FROM s, md")


@query("tier_labels", _TIER_SQL)
def tier_labels(spark, sf):
    prep = M.prepare(_of_salary(spark, sf), LOGR_FEATS, "flag", "o_orderkey", keep=["salary"])
    med = M.positive_median(prep.train, "salary")
    return prep.data.select("o_orderkey", "split", M.tier_expr("salary", med).alias("tier"))


# ---------------------------------------------------------------- M20 (fixed coefficients)
# A hand-set scorer used to exercise the scoring transform.
FIXED_INTERCEPT = 0.25
FIXED_COEF = [1.5, -0.5, 0.75, 0.1, -0.2]


@query("score_logistic", OF_CTE + prep_sql("SELECT * FROM of", "o_orderkey", LOGR_FEATS, "flag") + ", "
       "st AS (SELECT " + ", ".join(f"AVG({c}) AS mu{i}, STDDEV_SAMP({c}) + 1e-9 AS sg{i}"
                                    for i, c in enumerate(LOGR_FEATS)) + " FROM s WHERE split = 'train'), "
       "z AS (SELECT o_orderkey, " + f"{FIXED_INTERCEPT} + " + " + ".join(
           f"{w} * ((CAST({c} AS DOUBLE) - mu{i}) / sg{i})" for i, (c, w) in enumerate(zip(LOGR_FEATS, FIXED_COEF)))
       + " AS z FROM of, st), pz AS (SELECT o_orderkey, 1.0 / (1.0 + EXP(-LEAST(GREATEST(z, -500.0), 500.0))) AS p FROM z) "
       "SELECT o_orderkey, ROUND(p * 100, 1) + 0.0 AS probability, CAST(p >= 0.5 AS INTEGER) AS prediction, "
       f"CASE WHEN p >= 0.5 THEN '{SC.POSITIVE_LABEL}' ELSE '{SC.NEGATIVE_LABEL}' END AS label FROM pz")
def score_logistic(spark, sf):
    of = T.of(spark, sf)
    prep = M.prepare(of, LOGR_FEATS, "flag", "o_orderkey")
    mu, sig = M.fit_standardiser(prep.train, LOGR_FEATS, ddof=1, eps=M.SIG_EPS, zero_to_one=False)
    params = M.LogisticParams(LOGR_FEATS, FIXED_COEF, FIXED_INTERCEPT, mu, sig)
    return SC.score_logistic(of.select("o_orderkey", *LOGR_FEATS), params).select(
        "o_orderkey", "probability", "prediction", "label")


# ---------------------------------------------------------------- logistic family (Newton in both engines)
_LOGR_BASE = ("WITH RECURSIVE of AS (" + T.OF_SQL + "), "
              + prep_sql("SELECT * FROM of", "o_orderkey", LOGR_FEATS, "flag") + ", "
              + "tr AS (SELECT * FROM s WHERE split = 'train'), "
              + logistic_ctes("tr", LOGR_FEATS, "flag") + ", ")
_LOGR_TEST = ("pr AS (SELECT pos, CAST(flag AS INTEGER) AS y, 1 / (1 + EXP(-LEAST(GREATEST(z, -500.0), 500.0))) AS p, "
              "CASE WHEN z > 0 THEN 1 ELSE 0 END AS yp FROM (SELECT s.*, " + logistic_z(LOGR_FEATS, "lg", "s.")
              + " AS z FROM s, lg_p WHERE split = 'test') zz)")


_LOGISTIC_FIT_SQL = (_LOGR_BASE + _LOGR_TEST + ", " + _clf_sql("pr") + " SELECT mx.*, ROUND(icpt, 4) + 0.0 AS intercept, "
                     + ", ".join(f"ROUND(w{j}, 4) + 0.0 AS coef_{c}" for j, c in enumerate(LOGR_FEATS)) + " FROM mx, lg_p")


def _logistic_report(prep, p):
    test = prep.test.withColumn("_prob", p.probability()).withColumn("_pred", (p.z() > 0).cast("int"))
    met = MT.classification_metrics(test, "flag", "_prob", pred="_pred")
    return met.select("*", rnd(F.lit(p.intercept), 4).alias("intercept"),
                      *[rnd(F.lit(w), 4).alias(f"coef_{c}") for c, w in zip(LOGR_FEATS, p.coef)])


@query("logistic_fit", _LOGISTIC_FIT_SQL)
def logistic_fit(spark, sf):
    """M8: coefficients, intercept and validation metrics of the 5-feature model."""
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    return _logistic_report(prep, M.fit_logistic(prep.train, LOGR_FEATS, "flag", prep.n_train))


@query("logistic_params_roundtrip", _LOGISTIC_FIT_SQL)
def logistic_params_roundtrip(spark, sf):
    """The 5-feature model saved, read back and used to score."""
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    p = M.fit_logistic(prep.train, LOGR_FEATS, "flag", prep.n_train)
    return _logistic_report(prep, load_fitted(spark, save_fitted(spark, p, scratch_path(spark, "logistic-params"))))


@query("logistic_sample", _LOGR_BASE + _LOGR_TEST + " SELECT pos, y AS actual, ROUND(p * 100, 1) + 0.0 AS prob, "
       "yp AS pred FROM pr ORDER BY pos LIMIT 10")
def logistic_sample(spark, sf):
    """First 10 validation rows: actual class, probability % (1 dp), predicted class."""
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    p = M.fit_logistic(prep.train, LOGR_FEATS, "flag", prep.n_train)
    return (prep.test.orderBy("pos").limit(10)
            .select("pos", F.col("flag").cast("int").alias("actual"),
                    rnd(p.probability() * 100, 1).alias("prob"), (p.z() > 0).cast("int").alias("pred")))


@query("prob_by_class", _LOGR_BASE + _LOGR_TEST + " SELECT pos, y AS actual, ROUND(p, 3) + 0.0 AS prob FROM pr "
       f"QUALIFY ROW_NUMBER() OVER (PARTITION BY y ORDER BY pos) <= {C.PROB_SAMPLE_PER_CLASS}")
def prob_by_class(spark, sf):
    """Validation probabilities (3 dp) of the first 300 rows of each actual class."""
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    p = M.fit_logistic(prep.train, LOGR_FEATS, "flag", prep.n_train)
    scored = prep.test.select("pos", F.col("flag").cast("int").alias("actual"), rnd(p.probability(), 3).alias("prob"))
    # one bounded top-k per class (two classes), not a window over each whole class
    parts = [scored.where(F.col("actual") == c).orderBy("pos").limit(C.PROB_SAMPLE_PER_CLASS) for c in (1, 0)]
    return parts[0].unionByName(parts[1])


# The tier labels in sorted order (class ids of the softmax model).
TIER_CLASSES = sorted(M.TIER_LABELS)


# orders with a salary-like value: the order's worth for the positive class, else 0
OF_SALARY_SQL = "SELECT *, CASE WHEN flag = 1 THEN sum_price ELSE 0 END AS salary FROM (" + T.OF_SQL + ") o"


def _of_salary(spark, sf):
    return T.of(spark, sf).withColumn("salary", F.when(F.col("flag") == 1, F.col("sum_price")).otherwise(F.lit(0.0)))


def _softmax_parts() -> tuple[list[str], str]:
    """CTEs of the 3-tier model on standardised inputs (over s, the prepared rows), and the predicted label."""
    x = [f"CAST({c} AS DOUBLE)" for c in LOGR_FEATS]
    ft = ("fx AS (SELECT " + ", ".join(
        f"AVG({x[j]}) AS m{j}, CASE WHEN STDDEV_POP({x[j]}) = 0 THEN 1.0 ELSE STDDEV_POP({x[j]}) END AS d{j}"
        for j in range(len(LOGR_FEATS))) + " FROM s WHERE split = 'train')")
    md = "md AS (SELECT QUANTILE_CONT(salary, 0.5) FILTER (WHERE salary > 0) AS med FROM s WHERE split = 'train')"
    tiers = ("tt AS (SELECT s.*, CASE WHEN salary IS NULL OR salary = 0 THEN 'Not Placed' WHEN salary < med "
             "THEN 'Standard Package' ELSE 'Premium Package' END AS tier FROM s, md)")
    ts = ("ts AS (SELECT pos, split, tier, " + ", ".join(f"({x[j]} - m{j}) / d{j} AS {c}" for j, c in enumerate(LOGR_FEATS))
          + " FROM tt, fx), trX AS (SELECT * FROM ts WHERE split = 'train')")
    cls = "CASE tier " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(TIER_CLASSES)) + " END"
    return [ft, md, tiers, ts, softmax_ctes("trX", LOGR_FEATS, cls, TIER_CLASSES, "sx")], softmax_predict_sql(LOGR_FEATS, TIER_CLASSES, "sx", "ts.")


def _softmax_sql():
    parts, pred = _softmax_parts()
    return ("WITH RECURSIVE of AS (" + OF_SALARY_SQL + "), "
            + prep_sql("SELECT * FROM of", "o_orderkey", LOGR_FEATS, "flag", extra=", salary") + ", " + ", ".join(parts)
            + " SELECT ROUND(AVG(CASE WHEN " + pred + " = tier THEN 1.0 ELSE 0.0 END) * 100, 2) + 0.0 AS softmax_accuracy, "
            "CAST(COUNT(*) AS BIGINT) AS n_test FROM ts, sx_p WHERE split = 'test'")


def _softmax(spark, sf):
    """The 3-tier model and its standardised validation rows."""
    prep = M.prepare(_of_salary(spark, sf), LOGR_FEATS, "flag", "o_orderkey", keep=["salary"])
    med = M.positive_median(prep.train, "salary")
    data = prep.data.withColumn("tier", M.tier_expr("salary", med))
    mu, sd = M.fit_standardiser(prep.train, LOGR_FEATS, ddof=0, zero_to_one=True)
    data = M.standardise(data, LOGR_FEATS, mu, sd)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    return M.fit_softmax(train, LOGR_FEATS, "tier", prep.n_train), test


def _softmax_report(sm, test):
    hit = (sm.predict_label() == F.col("tier")).cast("double")
    return test.agg(rnd(F.avg(hit) * 100, 2).alias("softmax_accuracy"), F.count(F.lit(1)).alias("n_test"))


@query("softmax_accuracy", _softmax_sql())
def softmax_accuracy(spark, sf):
    """M9: 3-tier multinomial model on standardised features; validation accuracy %."""
    return _softmax_report(*_softmax(spark, sf))


@query("softmax_params_roundtrip", _softmax_sql())
def softmax_params_roundtrip(spark, sf):
    """The 3-tier model saved, read back and used to score."""
    sm, test = _softmax(spark, sf)
    return _softmax_report(load_fitted(spark, save_fitted(spark, sm, scratch_path(spark, "softmax-params"))), test)


GRID_FEATS = ["n_lines", "sum_qty"]


def _grid_sql():
    base = ("WITH RECURSIVE of AS (" + T.OF_SQL + "), " + prep_sql("SELECT * FROM of", "o_orderkey", GRID_FEATS, "flag")
            + ", tr AS (SELECT * FROM s WHERE split = 'train'), " + logistic_ctes("tr", GRID_FEATS, "flag") + ", ")
    n, px, py = C.GRID_SIZE, C.GRID_PAD_X, C.GRID_PAD_Y
    rng = (f"rg AS (SELECT MIN(n_lines) - {px} AS x0, MAX(n_lines) + {px} AS x1, MIN(sum_qty) - {py} AS y0, "
           f"MAX(sum_qty) + {py} AS y1 FROM tr), "
           f"gd AS (SELECT id % {n} AS ix, id // {n} AS iy, "
           f"CASE WHEN id % {n} = {n - 1} THEN x1 ELSE (id % {n}) * ((x1 - x0) / {n - 1}) + x0 END AS n_lines, "
           f"CASE WHEN id // {n} = {n - 1} THEN y1 ELSE (id // {n}) * ((y1 - y0) / {n - 1}) + y0 END AS sum_qty "
           f"FROM rg, range(0, {n * n}) r(id)) ")
    return (base + rng + "SELECT ix, iy, n_lines, sum_qty, CASE WHEN " + logistic_z(GRID_FEATS, "lg", "gd.")
            + " > 0 THEN 1 ELSE 0 END AS predicted FROM gd, lg_p")


@query("decision_grid", _grid_sql())
def decision_grid(spark, sf):
    """200×200 grid over the padded train ranges of two features, predicted class per cell."""
    prep = M.prepare(T.of(spark, sf), GRID_FEATS, "flag", "o_orderkey")
    p = M.fit_logistic(prep.train, GRID_FEATS, "flag", prep.n_train)
    r = prep.train.agg(F.min("n_lines").alias("x0"), F.max("n_lines").alias("x1"),
                       F.min("sum_qty").alias("y0"), F.max("sum_qty").alias("y1")).first()
    n = C.GRID_SIZE
    g = spark.range(n * n)
    ix, iy = F.col("id") % n, F.floor(F.col("id") / n)
    gx = M.linspace_expr(ix, r["x0"] - C.GRID_PAD_X, r["x1"] + C.GRID_PAD_X, n)
    gy = M.linspace_expr(iy, r["y0"] - C.GRID_PAD_Y, r["y1"] + C.GRID_PAD_Y, n)
    g = g.select(ix.alias("ix"), iy.alias("iy"), gx.alias("n_lines"), gy.alias("sum_qty"))
    return g.withColumn("predicted", (p.z() > 0).cast("int"))


def _scaler_sql(final_select: str, of: str = T.OF_SQL, extra: str = "") -> str:
    """Three fits (raw, library-standardised, min-max inputs) and their validation accuracy."""
    x = [f"CAST({c} AS DOUBLE)" for c in LOGR_FEATS]
    fit = ("ft AS (SELECT " + ", ".join(
        f"AVG({x[j]}) AS m{j}, CASE WHEN STDDEV_POP({x[j]}) = 0 THEN 1.0 ELSE STDDEV_POP({x[j]}) END AS d{j}, "
        f"MIN({x[j]}) AS lo{j}, CASE WHEN MAX({x[j]}) - MIN({x[j]}) = 0 THEN 1.0 ELSE MAX({x[j]}) - MIN({x[j]}) END AS rg{j}"
        for j in range(len(LOGR_FEATS))) + " FROM tr)")
    std = ("sS AS (SELECT pos, split, flag, " + ", ".join(f"({x[j]} - m{j}) / d{j} AS {c}" for j, c in enumerate(LOGR_FEATS))
           + " FROM s, ft), trS AS (SELECT * FROM sS WHERE split = 'train')")
    mm = ("sM AS (SELECT pos, split, flag, " + ", ".join(f"({x[j]} - lo{j}) / rg{j} AS {c}" for j, c in enumerate(LOGR_FEATS))
          + " FROM s, ft), trM AS (SELECT * FROM sM WHERE split = 'train')")
    parts = ["WITH RECURSIVE of AS (" + of + ")", prep_sql("SELECT * FROM of", "o_orderkey", LOGR_FEATS, "flag", extra=extra),
             "tr AS (SELECT * FROM s WHERE split = 'train')", fit, std, mm,
             logistic_ctes("tr", LOGR_FEATS, "flag", name="lgU"),
             logistic_ctes("trS", LOGR_FEATS, "flag", name="lgS"),
             logistic_ctes("trM", LOGR_FEATS, "flag", name="lgM")]
    acc = []
    for label, src, nm in (("Unscaled", "s", "lgU"), ("StandardScaler", "sS", "lgS"), ("MinMaxScaler", "sM", "lgM")):
        z = logistic_z(LOGR_FEATS, nm, f"{src}.")
        acc.append(f"SELECT '{label}' AS scaler, ROUND(AVG(CASE WHEN (CASE WHEN {z} > 0 THEN 1 ELSE 0 END) = flag "
                   f"THEN 1.0 ELSE 0.0 END) * 100, 2) + 0.0 AS accuracy FROM {src}, {nm}_p WHERE split = 'test'")
    parts.append("sc AS (" + " UNION ALL ".join(acc) + ")")
    return ", ".join(parts) + " " + final_select


@query("scaler_comparison", _scaler_sql("SELECT scaler, accuracy FROM sc"))
def scaler_comparison(spark, sf):
    """Validation accuracy % of one classifier on raw, standardised and min-max inputs."""
    prep = M.prepare(T.of(spark, sf), LOGR_FEATS, "flag", "o_orderkey")
    return M.scaler_comparison(prep, LOGR_FEATS, "flag")


def _report_sql():
    base = _scaler_sql("", OF_SALARY_SQL, ", salary")
    tier_parts, tier_pred = _softmax_parts()
    main = logistic_ctes("tr", LOGR_FEATS, "flag", name="lg")
    auc_parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS v, SUM(flag) AS pos, SUM(1 - flag) AS neg FROM tr WHERE {c} IS NOT NULL "
        f"GROUP BY {c}" for c in AUC_FEATS)
    auc = ("ag AS (" + auc_parts + "), ar AS (SELECT *, SUM(neg) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN "
           "UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM ag), "
           "au AS (SELECT 'auc_' || feature AS metric, ROUND(SUM(pos * (below + 0.5 * neg)) / (SUM(pos) * SUM(neg)), 4) "
           "+ 0.0 AS value FROM ar GROUP BY feature HAVING SUM(pos) > 0 AND SUM(neg) > 0)")
    bal = ("bl AS (SELECT AVG(CASE WHEN flag = 1 THEN 1.0 ELSE 0.0 END) * 100 AS v FROM tr)")
    return (base.rstrip() + ", " + main + ", " + _LOGR_TEST + ", " + _clf_sql("pr") + ", " + auc + ", " + bal + ", " + ", ".join(tier_parts) + " "
            "SELECT 'class_pct' AS metric, ROUND(v, 1) + 0.0 AS value FROM bl UNION ALL "
            "SELECT 'other_pct', ROUND(100 - v, 1) + 0.0 FROM bl UNION ALL SELECT metric, value FROM au UNION ALL "
            "SELECT 'accuracy', accuracy FROM mx UNION ALL SELECT 'log_loss', log_loss FROM mx UNION ALL "
            "SELECT 'scaler_' || scaler, accuracy FROM sc UNION ALL SELECT 'softmax_accuracy', ROUND(AVG(CASE WHEN "
            + tier_pred + " = tier THEN 1.0 ELSE 0.0 END) * 100, 2) + 0.0 FROM ts, sx_p WHERE split = 'test'")


@query("eval_report", _report_sql())
def eval_report(spark, sf):
    """A5: the report rows, written as CSV to the shared scratch folder and read back."""
    prep = M.prepare(_of_salary(spark, sf), LOGR_FEATS, "flag", "o_orderkey", keep=["salary"])
    rep = evaluation_report(prep, LOGR_FEATS, AUC_FEATS, "flag", tiers="salary")
    path = write_csv(rep, scratch_path(spark, "eval-report"))
    return read_csv(spark, path, schema=rep.schema)
