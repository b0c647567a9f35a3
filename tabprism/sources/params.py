"""Fitted parameters as small tables (M21): save once, score anywhere."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprism.operators.features import ScalerParams
from tabprism.operators.models import LinearParams, LogisticParams, SoftmaxParams

Fitted = LinearParams | LogisticParams | SoftmaxParams | ScalerParams

_SCHEMA = "term string, idx int, mu double, sig double, coef double"


def linear_params_frame(spark: SparkSession, p: LinearParams) -> DataFrame:
    rows = [("intercept", -1, None, None, float(p.intercept))]
    rows += [(f, i, float(p.mu[i]), float(p.sig[i]), float(p.coef[i])) for i, f in enumerate(p.features)]
    return spark.createDataFrame(rows, _SCHEMA)


def save_linear_params(spark: SparkSession, p: LinearParams, path: str) -> str:
    linear_params_frame(spark, p).coalesce(1).write.mode("errorifexists").parquet(path)
    return path


def load_linear_params(spark: SparkSession, path: str) -> LinearParams:
    """Read a saved parameter table (a handful of rows) back into a scorer."""
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["idx"])
    icpt = [r for r in rows if r["term"] == "intercept"][0]["coef"]
    feats = [r for r in rows if r["term"] != "intercept"]
    return LinearParams([r["term"] for r in feats], [r["mu"] for r in feats],
                        [r["sig"] for r in feats], [r["coef"] for r in feats], icpt)


_FITTED = ("kind string, class string, class_idx int, term string, idx int, mu double, sig double, coef double, "
           "extra map<string,double>")


def _weights(kind: str, name: str | None, k: int, p, coef, intercept, mu=None, sig=None) -> list[tuple]:
    rows = [(kind, name, k, "intercept", -1, None, None, float(intercept), None)]
    return rows + [(kind, name, k, f, i, None if mu is None else float(mu[i]), None if sig is None else float(sig[i]),
                    float(coef[i]), None) for i, f in enumerate(p.features)]


def fitted_frame(spark: SparkSession, p: Fitted) -> DataFrame:
    """Parameters of a linear, logistic or softmax fit or of a scaler, one row per (class, term)."""
    if isinstance(p, LinearParams):
        rows = _weights("linear", None, 0, p, p.coef, p.intercept, p.mu, p.sig)
    elif isinstance(p, LogisticParams):
        rows = _weights("logistic", None, 0, p, p.coef, p.intercept, p.mu, p.sig)
    elif isinstance(p, SoftmaxParams):
        rows = [r for k, name in enumerate(p.classes) for r in _weights("softmax", name, k, p, p.coef[k], p.intercept[k])]
    elif isinstance(p, ScalerParams):
        rows = [(f"scaler:{p.kind}", None, 0, c, i, p.center[c], p.scale[c], None, p.extra.get(c)) for i, c in enumerate(p.columns)]
    else:
        raise TypeError(f"no parameter table for {type(p).__name__}")
    return spark.createDataFrame(rows, _FITTED)


def save_fitted(spark: SparkSession, p: Fitted, path: str) -> str:
    fitted_frame(spark, p).coalesce(1).write.mode("errorifexists").parquet(path)
    return path


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    """Read a saved parameter table (a row per class and column) back into a scorer or scaler."""
    return _restored(spark.read.parquet(path).collect())


def _restored(rows: list) -> Fitted:
    rows = sorted(rows, key=lambda r: (r["class_idx"], r["idx"]))
    kind = rows[0]["kind"]
    if kind.startswith("scaler:"):
        return ScalerParams(kind.partition(":")[2], [r["term"] for r in rows], {r["term"]: r["mu"] for r in rows},
                            {r["term"]: r["sig"] for r in rows}, {r["term"]: dict(r["extra"]) for r in rows if r["extra"] is not None})
    classes: dict[int, list] = {}
    for r in rows:
        classes.setdefault(r["class_idx"], []).append(r)       # the intercept first, then the terms in order
    feats = [r["term"] for r in classes[0][1:]]
    coef = [[r["coef"] for r in c[1:]] for c in classes.values()]
    intercept = [c[0]["coef"] for c in classes.values()]
    if kind == "softmax":
        return SoftmaxParams([c[0]["class"] for c in classes.values()], feats, coef, intercept)
    scaled = any(r["mu"] is not None for r in classes[0][1:])
    mu, sig = ([r[x] for r in classes[0][1:]] if scaled else None for x in ("mu", "sig"))
    return (LinearParams if kind == "linear" else LogisticParams)(
        *((feats, mu, sig, coef[0], intercept[0]) if kind == "linear" else (feats, coef[0], intercept[0], mu, sig)))


# ---------------------------------------------------------------- versions
def publish_fitted(spark: SparkSession, p: Fitted, path: str) -> int:
    """Add ``p`` as the next version of the parameter table at ``path``; returns its number.

    A version is one file, moved into place when its writer commits, so a
    reader sees it whole or not at all.  One publisher at a time.
    """
    version = (latest_version(spark, path) or 0) + 1
    frame = fitted_frame(spark, p).withColumn("version", F.lit(version).cast("long"))
    frame.coalesce(1).write.partitionBy("version").mode("append").parquet(path)
    return version


def _versions(spark: SparkSession, path: str) -> DataFrame:
    # given in full: no inference, and an empty or absent table is an empty frame
    schema = _FITTED + ", version long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The greatest published version, listed anew at every call."""
    return _versions(spark, path).agg(F.max("version").alias("v")).first()["v"]


def load_version(spark: SparkSession, path: str, version: int | None = None) -> tuple[Fitted, int]:
    """A published version (the latest by default) and its number."""
    found = _versions(spark, path)
    rows = found.collect() if version is None else found.where(F.col("version") == version).collect()   # a few rows per version
    if not rows:
        raise ValueError(f"no published parameters at {path!r}")
    last = max(r["version"] for r in rows)
    return _restored([r for r in rows if r["version"] == last]), int(last)
