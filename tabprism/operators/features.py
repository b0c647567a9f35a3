"""Scaling and encoding with a fit/transform split.

Fitting is one aggregate pass over all columns (plus one quantile pass for the
robust scaler).  The fitted parameters — one row per column — are brought to
the driver and the transform is a plain projection with literal constants:
narrow, codegen'd, and equally valid on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprism.functions.expressions import nan_to_null, rnd
from tabprism.operators.clean import bool_to_int
from tabprism.operators.quantiles import between, order_statistics, quantiles
from tabprism.operators.stats import column_stats, to_long
from tabprism.constants import DUMMY_TEXT, IQR_FENCE, MAPPING_SEPARATOR, MAPPING_TEXT

#: one-hot levels per column: no limit unless the caller sets one
MAX_LEVELS = None


@dataclass
class ScalerParams:
    kind: str                      # 'minmax' | 'standard' | 'robust'
    columns: list[str]
    center: dict[str, float | None] = field(default_factory=dict)   # min / mean / median
    scale: dict[str, float | None] = field(default_factory=dict)    # range / std / iqr
    extra: dict[str, dict] = field(default_factory=dict)


def _scaled(c: str, center, scale, digits: int | None) -> Column:
    x = nan_to_null(F.col(c).cast("double"))
    if center is None or scale is None:         # all values missing (or one value for std)
        return F.lit(None).cast("double")
    if scale == 0:                               # constant column: every row 0.0, missing rows too
        return F.lit(0.0)
    v = (x - F.lit(float(center))) / F.lit(float(scale))
    return rnd(v, digits) if digits is not None else v


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> ScalerParams:
    row = column_stats(df, cols, {"min": F.min, "max": F.max}).collect()
    p = ScalerParams("minmax", list(cols))
    for r in row:
        c = r["column_name"]
        p.center[c] = r["min"]
        p.scale[c] = None if r["min"] is None else r["max"] - r["min"]
        p.extra[c] = {"min": r["min"], "max": r["max"]}
    return p


def fit_standard(df: DataFrame, cols: Sequence[str]) -> ScalerParams:
    row = column_stats(df, cols, {"mean": F.avg, "std": F.stddev_samp}).collect()
    p = ScalerParams("standard", list(cols))
    for r in row:
        c = r["column_name"]
        p.center[c] = r["mean"]
        p.scale[c] = r["std"]
    return p


def fit_robust(df: DataFrame, cols: Sequence[str], quantile_method: str = "select") -> ScalerParams:
    rows = quantiles(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, method=quantile_method).collect()
    p = ScalerParams("robust", list(cols))
    for r in rows:
        c = r["column_name"]
        p.center[c] = r["median"]
        p.scale[c] = None if r["q1"] is None else r["q3"] - r["q1"]
        p.extra[c] = {"q1": r["q1"], "q3": r["q3"], "median": r["median"]}
    return p


def transform(df: DataFrame, params: ScalerParams, digits: int | None = 6) -> DataFrame:
    """Replace each fitted column by its scaled value (other columns untouched)."""
    return df.withColumns({c: _scaled(c, params.center[c], params.scale[c], digits)
                           for c in params.columns})


def minmax_scale(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """F1: (x - min) / (max - min), 6 dp; zero range → 0.0 for every row."""
    return transform(df, fit_minmax(df, cols), digits)


def standard_scale(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """(x - mean) / std (n-1), 6 dp; zero std → 0.0."""
    return transform(df, fit_standard(df, cols), digits)


def robust_scale(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """(x - median) / (q3 - q1), exact quantiles, 6 dp; zero IQR → 0.0."""
    return transform(df, fit_robust(df, cols), digits)


def _report(df: DataFrame, params: ScalerParams, fitted: dict[str, dict], shown: dict[str, str], scaled: dict, digits: int) -> DataFrame:
    """column_name, column_idx, fitted figures (``shown``: name → type) and statistics of the rounded scaled values, one more scan."""
    sc = column_stats(transform(df, params), params.columns, scaled)
    rows = [(c, *[fitted[c][k] for k in shown]) for c in params.columns]
    raw = df.sparkSession.createDataFrame(rows, "column_name string, " + ", ".join(f"{k} {t}" for k, t in shown.items()))
    return raw.join(sc, "column_name").select(
        "column_name", "column_idx", *[rnd(k, digits).alias(k) if t == "double" else F.col(k) for k, t in shown.items()],
        *[rnd(k, digits).alias(k) if k != "outliers" else F.col(k) for k in scaled])


#: one aggregate fits both scalers and their reports
_MOMENTS = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}


def _moments_of(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    return {r["column_name"]: r.asDict() for r in column_stats(df, cols, _MOMENTS).collect()}


def minmax_params(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """column, min, max, range, mean, std, scaled_mean, scaled_std (4 dp).

    Scaled statistics are taken over the rounded scaled values, as the
    reference does.  Two scans in all: the fit, then the scaled values.
    """
    fitted, p = _moments_of(df, cols), ScalerParams("minmax", list(cols))
    for c, f in fitted.items():
        f["range"] = None if f["min"] is None else f["max"] - f["min"]
        p.center[c], p.scale[c] = f["min"], f["range"]
    return _report(df, p, fitted, dict.fromkeys(("min", "max", "range", "mean", "std"), "double"),
                   {"scaled_mean": F.avg, "scaled_std": F.stddev_samp}, digits)


def standard_params(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """column, mean, std, min, max, scaled mean/std/min/max (4 dp); two scans as F2."""
    fitted, p = _moments_of(df, cols), ScalerParams("standard", list(cols))
    for c, f in fitted.items():
        p.center[c], p.scale[c] = f["mean"], f["std"]
    return _report(df, p, fitted, dict.fromkeys(("mean", "std", "min", "max"), "double"),
                   {"scaled_mean": F.avg, "scaled_std": F.stddev_samp, "scaled_min": F.min, "scaled_max": F.max}, digits)


def robust_params(df: DataFrame, cols: Sequence[str], digits: int = 4, k: float = IQR_FENCE) -> DataFrame:
    """column, median, q1, q3, iqr, outliers, scaled mean/std/median (4 dp).

    The selection of the quartiles, then one aggregate for the scaled moments and
    the outlier counts.  Scaling and rounding keep the order of values, so the
    median of the scaled values is that of the scaled middle values: no further pass.
    """
    cols = list(cols)
    stats = order_statistics(df, cols, [0.25, 0.5, 0.75])
    p, aggs, rows = ScalerParams("robust", cols), [], []
    for i, (c, found) in enumerate(zip(cols, stats)):
        q1, med, q3 = (None if f is None else between(*f) for f in found)
        iqr = None if q1 is None else q3 - q1
        p.center[c], p.scale[c] = med, iqr
        sc = _scaled(c, med, iqr, 6)
        x = nan_to_null(F.col(c).cast("double"))
        out = F.lit(0) if q1 is None else F.count_if((x < F.lit(q1 - k * iqr)) | (x > F.lit(q3 + k * iqr)))
        aggs += [F.avg(sc).alias(f"_m{i}"), F.stddev_samp(sc).alias(f"_s{i}"), out.cast("bigint").alias(f"_o{i}")]
        rows.append((c, i, med, q1, q3, iqr, *(found[1] or (None, None, None))))
    fit = df.sparkSession.createDataFrame(rows, "column_name string, column_idx int, median double, q1 double, q3 double, iqr double, "
                                                "_low double, _high double, _part double")
    row = df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"_o{i}").alias("outliers"), F.col(f"_m{i}").alias("scaled_mean"),
                                                           F.col(f"_s{i}").alias("scaled_std")) for i, c in enumerate(cols)])))

    def scaled(x):
        return F.when(F.col("iqr") == 0, F.lit(0.0)).otherwise(rnd((F.col(x) - F.col("median")) / F.col("iqr"), 6))

    middle = scaled("_low") + F.col("_part") * (scaled("_high") - scaled("_low"))
    return fit.join(row, F.col("column_name") == F.col("_c")).select(
        "column_name", "column_idx", *[rnd(n, digits).alias(n) for n in ("median", "q1", "q3", "iqr")], "outliers",
        *[rnd(n, digits).alias(n) for n in ("scaled_mean", "scaled_std")], rnd(middle, digits).alias("scaled_median"))


# ---------------------------------------------------------------- encoding
def ordinal_encode(df: DataFrame, mappings: dict[str, dict[str, int]]) -> DataFrame:
    """replace each present column by its mapped integer; unmapped levels → NULL."""
    out = df
    for c, m in mappings.items():
        if c not in df.columns:
            continue
        lut = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(int(v)))])
        out = out.withColumn(c, F.element_at(lut, F.col(c).cast("string")))
    return out


def mapping_text(m: dict[str, int]) -> str:
    return MAPPING_SEPARATOR.join(MAPPING_TEXT.format(k, v) for k, v in m.items())


def ordinal_meta(df: DataFrame, mappings: dict[str, dict[str, int]]) -> DataFrame:
    """per present column and observed level: mapping text, level count, code, rows.

    Unmapped levels show a NULL code, so the table is also a data check.
    """
    cols = [c for c in mappings if c in df.columns]
    long = to_long(df, cols, name_col="column_name", value_col="level", cast="string")
    g = long.groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n_rows"))
    code = F.lit(None).cast("int")
    text = F.lit(None).cast("string")
    nlev = F.lit(None).cast("int")
    for c in cols:
        m = mappings[c]
        lut = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(int(v)))])
        is_c = F.col("column_name") == c
        code = F.when(is_c, F.element_at(lut, F.col("level"))).otherwise(code)
        text = F.when(is_c, F.lit(mapping_text(m))).otherwise(text)
        nlev = F.when(is_c, F.lit(len(m))).otherwise(nlev)
    return g.select("column_name", text.alias("mapping"), nlev.alias("n_levels"),
                    "level", code.alias("code"), "n_rows")


def nominal_meta(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """per present column: distinct non-missing levels and the dummy-column prefix."""
    cols = [c for c in cols if c in df.columns]
    base = [(c, i, DUMMY_TEXT.format(c)) for i, c in enumerate(cols)]
    out = df.sparkSession.createDataFrame(base, "column_name string, column_idx int, new_columns string")
    if approx:
        row = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"_d{i}") for i, c in enumerate(cols)])
        counts = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"_d{i}").alias("_n")) for i, c in enumerate(cols)])))
    else:
        # distinct (column, level) pairs combine before the shuffle, whatever the number of columns
        floats = {c for c, t in df.dtypes if t in ("float", "double")}
        plain = df.select(*[(F.col(c) + 0.0 if c in floats else F.col(c)).alias(c) for c in cols])     # -0.0 is 0.0
        pairs = to_long(plain, cols, name_col="_c", value_col="_v", cast="string").where(F.col("_v").isNotNull()).distinct()
        counts = pairs.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    return (out.join(counts, F.col("column_name") == F.col("_c"), "left")
            .select("column_name", "column_idx", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("unique_count"), "new_columns"))


def fit_levels(df: DataFrame, cols: Sequence[str], max_levels: int | None = MAX_LEVELS) -> dict[str, list[str]]:
    """Distinct non-missing levels per column, sorted in the column's own type.

    Every level becomes a column, so the levels are as many as the result is
    wide.  With ``max_levels`` a column that has more raises.
    """
    cols = list(cols)
    long = to_long(df, cols, name_col="column_name", value_col="level", cast="string")
    found = long.where(F.col("level").isNotNull()).distinct()
    if max_levels is not None:
        found = found.limit((max_levels + 1) * max(1, len(cols)))
    rows = found.collect()
    types = dict(df.select(*cols).dtypes)
    numeric = {c for c, t in types.items() if t.split("(")[0] in
               ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        levels[r["column_name"]].append(r["level"])
    for c, lv in levels.items():
        if max_levels is not None and len(lv) > max_levels:
            raise ValueError(f"column {c!r} has more than {max_levels} levels; raise max_levels "
                             "or encode it another way")
        lv.sort(key=float if c in numeric else None)
    return levels


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True,
            max_levels: int | None = MAX_LEVELS, levels: dict[str, list[str]] | None = None,
            bools_to_int: bool = True) -> DataFrame:
    """Dummies ``{col}_{level}`` as 0/1 ints, first sorted level dropped.

    Missing values give all zeros.  Encoded columns are removed, the other
    columns keep their order and the dummies are appended column by column.
    With ``bools_to_int`` every other boolean column also becomes 0/1 (C7).
    """
    cols = [c for c in cols if c in df.columns]
    levels = levels or fit_levels(df, cols, max_levels)
    keep = [F.col(c) for c in df.columns if c not in cols]
    dummies = []
    for c in cols:
        lv = levels[c][1:] if drop_first else levels[c]
        v = F.col(c).cast("string")
        dummies += [F.coalesce(v == F.lit(x), F.lit(False)).cast("int").alias(f"{c}_{x}") for x in lv]
    out = df.select(*keep, *dummies)
    return bool_to_int(out) if bools_to_int else out
