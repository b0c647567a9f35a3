"""Batch scoring with fitted parameters.

Every transform is a row-local projection with the parameters as literals,
so it runs identically on a batch or a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprism.functions.expressions import rnd
from tabprism.operators.models import LinearParams, LogisticParams
from tabprism.constants import CLASS_THRESHOLD, PREVIEW_ROWS

# The reference's label texts for the two predicted classes.
POSITIVE_LABEL = "Placed ✅"
NEGATIVE_LABEL = "Not Placed ❌"


def score_linear(df: DataFrame, params: LinearParams, name: str = "prediction",
                 digits: int | None = 2, fill_missing: float | None = 0.0) -> DataFrame:
    """Intercept + Σ coef·(x − μ)/σ; a missing input counts as 0, as in the form."""
    pred = params.predict(fill_missing)
    return df.withColumn(name, rnd(pred, digits) if digits is not None else pred)


def score_logistic(df: DataFrame, params: LogisticParams, prefix: str = "",
                   positive: str = POSITIVE_LABEL, negative: str = NEGATIVE_LABEL) -> DataFrame:
    """Z clipped to ±500 → sigmoid → probability % (1 dp), class at p ≥ 0.5, label."""
    p = params.probability()
    out = df.withColumn(f"{prefix}_p", p)
    return (out.withColumn(f"{prefix}probability", rnd(F.col(f"{prefix}_p") * 100, 1))
            .withColumn(f"{prefix}prediction", (F.col(f"{prefix}_p") >= CLASS_THRESHOLD).cast("int"))
            .withColumn(f"{prefix}label", F.when(F.col(f"{prefix}prediction") == 1, F.lit(positive))
                        .otherwise(F.lit(negative)))
            .drop(f"{prefix}_p"))


def prediction_sample(scored: DataFrame, actual: str, predicted: str, n: int = PREVIEW_ROWS,
                      pos_col: str = "pos", digits: int = 2) -> DataFrame:
    """First ``n`` held-out rows by position with actual and predicted values."""
    return (scored.orderBy(pos_col).limit(n)
            .select(pos_col, rnd(F.col(actual), digits).alias("actual"),
                    rnd(F.col(predicted), digits).alias("predicted")))
