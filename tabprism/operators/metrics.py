"""Evaluation metrics as single aggregate passes (M12, M13) and per-feature AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprism.functions.expressions import clip, nan_to_null, rnd
from tabprism.operators.positions import partition_totals, ranged_running_sum
from tabprism.operators.stats import to_long
from tabprism.constants import CLASS_THRESHOLD

#: probability clipping for log-loss: float64 machine epsilon
EPS = 2.220446049250313e-16


def regression_metrics(df: DataFrame, y: str, yhat: str, digits: int = 4) -> DataFrame:
    """Mse, rmse, mae, r2 (0 when the actual values are constant), n — one pass.

    Rows that miss the value or the prediction (NULL or NaN) count in no figure;
    with no row left every figure is NULL and n is 0.
    """
    known = df.select(nan_to_null(F.col(y).cast("double")).alias("_y"), nan_to_null(F.col(yhat).cast("double")).alias("_p"))
    e = F.col("_y") - F.col("_p")
    a = known.where(F.col("_y").isNotNull() & F.col("_p").isNotNull()).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_ssr"),
        (F.var_pop("_y") * F.count("_y")).alias("_sst"), F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("_sst") != 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst")).when(F.col("n") > 0, F.lit(0.0))
    return a.select(rnd("mse", digits).alias("mse"), rnd(F.sqrt("mse"), digits).alias("rmse"),
                    rnd("mae", digits).alias("mae"), rnd(r2, digits).alias("r2"), "n")


def classification_metrics(df: DataFrame, y: str, prob: str, threshold: float = CLASS_THRESHOLD,
                           pred: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Accuracy %, log-loss, confusion counts, precision %, recall %, F1.

    The predicted class is ``prob >= threshold`` unless a ``pred`` column is
    given.  F1 is computed from the 2-dp percentages, as the reference does.
    Rows without a class or probability (NULL or NaN) are in no cell; with no
    row left accuracy and log-loss are NULL, the other rates 0.  ``extra``
    aggregates over the same rows are added as columns.
    """
    yy = nan_to_null(F.col(y).cast("double"))
    raw = nan_to_null(F.col(prob).cast("double"))
    p = clip(raw, EPS, 1 - EPS)
    yp = F.col(pred).cast("double") if pred else (raw >= threshold).cast("double")
    # rows without a probability or class are in no cell, so they don't count
    a = df.where(yy.isNotNull() & p.isNotNull()).agg(F.count(F.lit(1)).alias("n"),
               F.count_if((yp == 1) & (yy == 1)).alias("tp"),
               F.count_if((yp == 0) & (yy == 0)).alias("tn"),
               F.count_if((yp == 1) & (yy == 0)).alias("fp"),
               F.count_if((yp == 0) & (yy == 1)).alias("fn"),
               F.avg(-(yy * F.log(p) + (1 - yy) * F.log(1 - p))).alias("_ll"),
               *[v.alias(k) for k, v in (extra or {}).items()])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    prec = F.when(tp + fp > 0, F.round(tp / (tp + fp) * 100, 2)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, F.round(tp / (tp + fn) * 100, 2)).otherwise(F.lit(0.0))
    out = a.select("n", "tp", "tn", "fp", "fn",
                   rnd(F.try_divide(tp + tn, F.col("n")) * 100, 2).alias("accuracy"),
                   rnd("_ll", 4).alias("log_loss"), (prec + 0.0).alias("precision"),
                   (rec + 0.0).alias("recall"), *(extra or {}))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                rnd(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 2)
                ).otherwise(F.lit(0.0))
    out = out.withColumn("f1", f1)
    return out.select(*[c for c in out.columns if c not in (extra or {})], *(extra or {}))


def feature_auc(df: DataFrame, features: Sequence[str], label: str, digits: int = 4) -> DataFrame:
    """ROC AUC of each raw feature as a score for a 0/1 label, ties counted half.

    AUC = Σ_v pos(v)·(neg(< v) + ½·neg(v)) / (P·N).  Rows are pre-aggregated to
    (feature, value, pos, neg) — map-side, so a hot value is one row — then
    range-partitioned with a running count of negatives inside each partition.
    Per-(partition, feature) sums (at most partitions + features rows) finish
    the formula on the driver: no window over a whole feature, no join.
    Features whose label has a single class are omitted.
    """
    long = to_long(df, features, keep=[label], name_col="feature", value_col="v")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v") & F.col(label).isNotNull())
    yy = F.col(label).cast("double")
    g = long.groupBy("feature", "v").agg(F.sum(yy).alias("pos"), F.sum(1 - yy).alias("neg"))
    ranged = ranged_running_sum(g, ["feature"], "v", "neg")
    parts = partition_totals(ranged, ["feature"], "neg", extra={
        "_pp": F.sum("pos"), "_s1": F.sum(F.col("pos") * (F.col("_lcum") - 0.5 * F.col("neg")))})
    acc, before = {}, {}
    for r in parts:          # sorted by (partition, feature)
        f, pid = r["feature"], r["_pid"]
        a = acc.setdefault(f, [0.0, 0.0, 0.0])            # negatives so far, positives, numerator
        b = before.get(pid, 0.0)
        a[2] += r["_s1"] + r["_pp"] * (a[0] - b)
        a[0] += r["_pt"]
        a[1] += r["_pp"]
        before[pid] = b + r["_pt"]
    rows = [(f, a[2] / (a[1] * a[0])) for f, a in acc.items() if a[0] > 0 and a[1] > 0]
    out = df.sparkSession.createDataFrame(rows, "feature string, auc double")
    return out.select("feature", rnd("auc", digits).alias("auc"))
