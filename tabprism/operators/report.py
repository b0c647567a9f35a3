"""A5: the evaluation report as a (metric, value) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprism.functions.expressions import rnd
from tabprism.operators import metrics as MT
from tabprism.operators import models as M


def _row(metric: str, value: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), value.alias("value"))


def evaluation_report(prep: M.Prepared, features: Sequence[str], auc_features: Sequence[str],
                      label: str, tiers: str | None = None) -> DataFrame:
    """Train class balance, single-feature AUCs, validation accuracy and log-loss of the logistic model,
    the scaler comparison and, with ``tiers``, the accuracy of the three-tier softmax model — one row per metric.

    ``tiers`` names the column that ``tier_expr`` splits at its positive training
    median; fewer than two tiers among the training rows give no softmax row.  The
    logistic variants and the softmax model are fitted in the same passes over one
    standardised design.
    """
    y = F.col(label).cast("double")
    facts = {"_share": F.avg(y), "_one": F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)) * 100}
    tier, classes = None, []
    if tiers is not None:
        tier = M.tier_expr(tiers, M.positive_median(prep.train, tiers))
        names = sorted(M.TIER_LABELS)
        facts |= {f"_c{i}": F.count_if(tier == c) for i, c in enumerate(names)}

    def targets(known: dict) -> dict[str, Column]:
        if tier is not None:
            classes.extend(c for i, c in enumerate(names) if known[f"_c{i}"])
        return {"_y": y} | ({"_yi": M.class_number(tier, classes)} if len(classes) > 1 else {})

    design = M.build_design(prep.train, features, targets, facts)
    try:
        fits = {k: M.logistic_fit_of(design, k, "_y", design.facts["_share"], b) for k, b in M.scaler_scales(design).items()}
        softmax = M.softmax_fit_of(design, "softmax", "_yi", classes, design.sd) if len(classes) > 1 else None
        M.newton(design.frame, design.inputs, [*fits.values(), *([softmax] if softmax else [])])
    finally:
        design.frame.unpersist()
    variants = {k: M.LogisticParams(design.features, *design.raw(f.beta), iterations=f.steps) for k, f in fits.items()}
    main = variants["Unscaled"]

    one = F.lit(design.facts["_one"]).cast("double")
    rows = prep.data.sparkSession.range(1).select(F.inline(F.array(
        _row("class_pct", rnd(one, 1)), _row("other_pct", rnd(100 - one, 1)))))
    auc = MT.feature_auc(prep.train, auc_features, label).select(
        F.concat(F.lit("auc_"), F.col("feature")).alias("metric"), F.col("auc").alias("value"))
    test = prep.test.withColumn("_prob", main.probability()).withColumn("_pred", (main.z() > 0).cast("int"))
    # every accuracy in one aggregate of the validation rows
    hits = {f"scaler_{k}": (p.z() > 0).cast("int") == F.col(label) for k, p in variants.items()}
    if softmax:
        hits["softmax_accuracy"] = M.softmax_params(design, softmax, classes).predict_label() == tier
    quality = MT.classification_metrics(test, label, "_prob", pred="_pred", extra={k: F.avg(h.cast("double")) for k, h in hits.items()})
    quality = quality.select(F.inline(F.array(_row("accuracy", F.col("accuracy")), _row("log_loss", F.col("log_loss")),
                                              *[_row(k, rnd(F.col(k) * 100, 2)) for k in hits])))
    return rows.unionByName(auc).unionByName(quality)
