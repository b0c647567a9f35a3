"""Schema and quality profile, descriptive statistics, class/rate aggregates.

All per-column statistics of a call are computed in one aggregate pass
(``stats.column_stats``) plus, where quantiles are needed, one quantile pass.
Only bounded rows (one per column) are ever collected, to turn fitted fences
into literals for the next pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprism.functions.expressions import nan_to_null, pair_corr, rnd
from tabprism.operators.comoments import pair_moments
from tabprism.operators.quantiles import quantiles
from tabprism.operators.stats import column_stats, to_long
from tabprism.constants import IQR_FENCE

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _isnull(c):
    return F.col(c).isNull()


# ---------------------------------------------------------------- shape / schema
def table_shape(df: DataFrame) -> DataFrame:
    """B1: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("bigint"))


def schema_profile(df: DataFrame) -> DataFrame:
    """B2 + B6: one row per column: position, Spark type, missing count."""
    return missing_counts(df, keep_zero=True, with_dtype=True)


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None,
                   keep_zero: bool = False, with_dtype: bool = False,
                   with_rows: bool = False) -> DataFrame:
    """Missing count per column (NULL, and NaN for float columns) in table order."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)

    def miss(c):
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return m

    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(miss(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    structs = []
    for i, c in enumerate(cols):
        fields = [F.lit(i).alias("column_idx"), F.lit(c).alias("column_name")]
        if with_dtype:
            fields.append(F.lit(types[c]).alias("dtype"))
        fields.append(F.col(f"_m{i}").cast("bigint").alias("n_missing"))
        if with_rows:
            fields.append(F.col("_rows").alias("n_rows"))
        structs.append(F.struct(*fields))
    out = row.select(F.inline(F.array(*structs)))
    return out if keep_zero else out.where(F.col("n_missing") > 0)


def missing_total(df: DataFrame) -> DataFrame:
    """Total missing cells of the table."""
    return missing_counts(df, keep_zero=True).agg(
        F.sum("n_missing").cast("bigint").alias("total_missing"))


def missing_ranked(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Columns with missing values: count, percent of rows, rank by count desc."""
    m = missing_counts(df, with_rows=True)
    pct = F.col("n_missing") / F.col("n_rows") * 100
    out = m.select("column_name", "n_missing",
                   (rnd(pct, digits) if digits is not None else pct).alias("pct_missing"),
                   "column_idx")
    w = Window.orderBy(F.desc("n_missing"), "column_idx")  # one row per column: tiny
    return out.withColumn("rank", F.row_number().over(w)).drop("column_idx")


# ---------------------------------------------------------------- duplicates
def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Copies beyond the first over ``cols`` (all columns by default).

    groupBy with map-side partial counts: a key holding a third of the table
    collapses to one row per task before the shuffle.
    """
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


# ---------------------------------------------------------------- describe
def describe(df: DataFrame, cols: Sequence[str], digits: int = 4, skew: bool = False,
             by: Sequence[str] = (), quantile_method: str = "select") -> DataFrame:
    """Count, mean, std (n-1), min, q1, median, q3, max [, skew].

    Skewness is the sample-adjusted form (pandas, DuckDB):
    Spark's population skewness · sqrt(n(n-1))/(n-2), NULL below 3 values.
    """
    by = list(by)
    stats = {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
    }
    if skew:
        stats["_pskew"] = lambda c: F.skewness(c)
    base = column_stats(df, cols, stats, by=by)
    q = quantiles(df, cols, QUARTILES, by=by, method=quantile_method)
    keys = [*by, "column_name"]
    cond = [base[k].eqNullSafe(q[k]) for k in keys]
    j = base.join(q, cond).select(*[base[k] for k in keys], base["column_idx"],
                                  base["count"], base["mean"], base["std"], base["min"],
                                  q["q1"], q["median"], q["q3"], base["max"],
                                  *([base["_pskew"]] if skew else []))
    out = [*keys, F.col("count").cast("bigint").alias("count")]
    out += [rnd(F.col(k), digits).alias(k)
            for k in ("mean", "std", "min", "q1", "median", "q3", "max")]
    if skew:
        n = F.col("count").cast("double")
        # constant column: pandas reports 0 where Spark's population skewness is NULL
        adj = F.when(n > 2, F.coalesce(F.col("_pskew") * F.sqrt(n * (n - 1)) / (n - 2),
                                       F.when(F.col("std") == 0, F.lit(0.0))))
        out.append(rnd(adj, digits).alias("skew"))
    return j.select(*out)


# ---------------------------------------------------------------- categories / classes
def category_freq(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts per categorical column, missing kept as a level (NULL)."""
    long = to_long(df, cols, name_col="column_name", value_col="value", cast="string")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, target: str, digits: int = 2) -> DataFrame:
    """Class counts and percent of non-missing rows."""
    g = (df.where(F.col(target).isNotNull()).groupBy(target)
         .agg(F.count(F.lit(1)).alias("n")))
    tot = F.sum("n").over(Window.partitionBy())  # over the per-class rows only
    return g.select(F.col(target).alias("class"), "n", rnd(F.col("n") / tot * 100, digits).alias("pct"))


def rate_by_category(df: DataFrame, cats: Sequence[str], target: str,
                     digits: int | None = 2) -> DataFrame:
    """Mean of a 0/1 target (in %) per level of several categoricals, ranked desc."""
    long = to_long(df, cats, keep=[target], name_col="column_name", value_col="value",
                   cast="string").where(F.col("value").isNotNull())
    g = long.groupBy("column_name", "value").agg(
        (F.avg(F.col(target).cast("double")) * 100).alias("rate"),
        F.count(F.lit(1)).alias("n"))
    rate = rnd("rate", digits) if digits is not None else F.col("rate")
    g = g.withColumn("rate", rate)
    w = Window.partitionBy("column_name").orderBy(F.desc("rate"), "value")
    return g.withColumn("rank", F.row_number().over(w))


def group_trend(df: DataFrame, by: str, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Group means of several ordered columns, long form (group, step, mean)."""
    g = df.groupBy(by).agg(*[F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"_a{i}")
                             for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("column_name"),
                        rnd(F.col(f"_a{i}"), digits).alias("mean"))
               for i, c in enumerate(cols)]
    return g.select(F.col(by).alias("grp"), F.inline(F.array(*structs)))


# ---------------------------------------------------------------- correlation
def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pairwise-complete Pearson matrix, long form (x, y, corr), from one scan however many columns.

    Rows where either side is missing are skipped for that pair only (as pandas
    does).  Constant columns give NULL.
    """
    cols = list(cols)
    m = pair_moments(df, cols)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = m.co / (np.sqrt(m.var) * np.sqrt(m.var.T))
    rows = [(x, y, float(r[i, j]) if m.var[i, j] > 0 and m.var[j, i] > 0 else None)
            for i, x in enumerate(cols) for j, y in enumerate(cols)]
    out = df.sparkSession.createDataFrame(rows, "x string, y string, corr double")
    return out.withColumn("corr", rnd(F.when(~F.isnan("corr"), F.col("corr")), digits))


def target_corr_ranked(df: DataFrame, cols: Sequence[str], target: str,
                       digits: int = 3) -> DataFrame:
    """Correlation of each column with the target (self dropped), ranked desc."""
    feats = [c for c in cols if c != target]
    row = df.agg(*[pair_corr(c, target).alias(f"_r{i}")
                   for i, c in enumerate(feats)])
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("column_idx"),
                        F.col(f"_r{i}").alias("_raw")) for i, c in enumerate(feats)]
    out = row.select(F.inline(F.array(*structs)))
    # ranked on the unrounded value, then rounded (sort, then round)
    w = Window.orderBy(F.desc_nulls_last("_raw"), "column_idx")  # one row per column
    return out.select("column_name", rnd("_raw", digits).alias("corr"),
                      F.row_number().over(w).alias("rank"))


# ---------------------------------------------------------------- IQR fences
def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = IQR_FENCE,
               quantile_method: str = "select") -> dict[str, tuple]:
    """Fit q1, q3 of every column in one pass; returns {col: (q1, med, q3, lo, hi)}.

    The result has one row per column, so collecting it is bounded.
    """
    q = quantiles(df, cols, QUARTILES, method=quantile_method)
    out = {}
    for r in q.collect():
        q1, med, q3 = r["q1"], r["median"], r["q3"]
        if q1 is None:
            out[r["column_name"]] = (None, None, None, None, None)
            continue
        iqr = q3 - q1
        out[r["column_name"]] = (q1, med, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def _outside(c, lo, hi):
    if lo is None:
        return F.lit(False)
    v = nan_to_null(F.col(c).cast("double"))
    return F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = IQR_FENCE,
                 quantile_method: str = "select") -> DataFrame:
    """Per column, count of values strictly outside [q1 - k·IQR, q3 + k·IQR], ranked desc."""
    f = iqr_fences(df, cols, k, quantile_method)
    row = df.agg(*[F.count_if(_outside(c, f[c][3], f[c][4])).alias(f"_o{i}")
                   for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("column_idx"),
                        F.col(f"_o{i}").cast("bigint").alias("n_outliers"))
               for i, c in enumerate(cols)]
    out = row.select(F.inline(F.array(*structs)))
    w = Window.orderBy(F.desc("n_outliers"), "column_idx")  # one row per column
    return out.withColumn("rank", F.row_number().over(w)).drop("column_idx")


def iqr_anomaly_flag(df: DataFrame, cols: Sequence[str], k: float = IQR_FENCE,
                     name: str = "is_anomaly", quantile_method: str = "select") -> DataFrame:
    """0/1 row flag, 1 when any listed column lies outside its IQR fences."""
    f = iqr_fences(df, cols, k, quantile_method)
    cond = F.lit(False)
    for c in cols:
        cond = cond | _outside(c, f[c][3], f[c][4])
    return df.withColumn(name, cond.cast("int"))


# ---------------------------------------------------------------- KPIs / insights
def kpi_overview(df: DataFrame, target: str, flag: str | None = None) -> DataFrame:
    """Rows, columns, class %, complement %, flagged rate %, flagged count, clean %."""
    t = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(t == 1).alias("n_class")]
    if flag:
        aggs += [F.avg(F.col(flag).cast("double")).alias("_fr"),
                 F.sum(F.col(flag)).cast("bigint").alias("n_flagged")]
    a = df.agg(*aggs)
    n = F.col("n_rows")
    pct = F.when(n > 0, rnd(F.col("n_class") / n * 100, 1)).otherwise(F.lit(0.0))
    npct = F.when(n > 0, rnd((n - F.col("n_class")) / n * 100, 1)).otherwise(F.lit(0.0))
    cols = [n, F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
            F.col("n_class").cast("bigint").alias("n_class"),
            pct.alias("class_pct"), npct.alias("other_pct")]
    if flag:
        fr = F.coalesce(rnd(F.col("_fr") * 100, 1), F.lit(0.0))
        cols += [fr.alias("flagged_rate"), F.coalesce(F.col("n_flagged"), F.lit(0)).alias("n_flagged"),
                 (F.lit(100.0) - fr).alias("clean_rate")]
    return a.select(*cols)


def class_vs_overall_mean(df: DataFrame, target: str, features: dict[str, int]) -> DataFrame:
    """Mean of each feature inside the positive class and overall, rounded per feature."""
    t = F.col(target).cast("double")
    feats = list(features)
    row = df.agg(*[F.avg(F.when(t == 1, nan_to_null(F.col(c).cast("double")))).alias(f"_c{i}") for i, c in enumerate(feats)],
                 *[F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"_a{i}") for i, c in enumerate(feats)])
    structs = [F.struct(F.lit(c).alias("feature"),
                        rnd(F.col(f"_c{i}"), features[c]).alias("class_mean"),
                        rnd(F.col(f"_a{i}"), features[c]).alias("overall_mean"))
               for i, c in enumerate(feats)]
    return row.select(F.inline(F.array(*structs)))


def insights(df: DataFrame, target: str, features: dict[str, int],
             conditional: Sequence[str] | None = None, flag: str | None = None) -> DataFrame:
    """Sentences built from the KPI and class-mean figures — ONE aggregate pass.

    One sentence per feature comparing its class mean with its overall mean;
    features listed in ``conditional`` (all of them by default) only when the
    class mean is higher after rounding.  Then the class-share sentence and,
    with ``flag``, the flagged-rows sentence.
    """
    cond = set(features if conditional is None else conditional)
    feats = list(features)
    t = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(t == 1).alias("_nc")]
    aggs += [F.avg(F.when(t == 1, nan_to_null(F.col(c).cast("double")))).alias(f"_c{i}") for i, c in enumerate(feats)]
    aggs += [F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"_a{i}") for i, c in enumerate(feats)]
    if flag:
        aggs += [F.avg(F.col(flag).cast("double")).alias("_fr"), F.sum(F.col(flag)).cast("bigint").alias("_nf")]
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(feats):
        cm, om = rnd(F.col(f"_c{i}"), features[c]), rnd(F.col(f"_a{i}"), features[c])
        keep = (cm > om) if c in cond else F.lit(True)
        items.append(F.struct(F.lit(c).alias("topic"), F.format_string(
            f"Rows with {target} = 1 average %s %s, against %s overall.", cm.cast("string"), F.lit(c),
            om.cast("string")).alias("sentence"), F.coalesce(keep, F.lit(False)).alias("_keep")))
    n = F.col("_n")
    pct = F.when(n > 0, rnd(F.col("_nc") / n * 100, 1)).otherwise(F.lit(0.0))
    items.append(F.struct(F.lit("class_share").alias("topic"), F.format_string(
        f"%s%% of the %s rows have {target} = 1.", pct.cast("string"), F.format_number(n, 0)).alias("sentence"),
        F.lit(True).alias("_keep")))
    if flag:
        fr = F.coalesce(rnd(F.col("_fr") * 100, 1), F.lit(0.0))
        items.append(F.struct(F.lit("flagged").alias("topic"), F.format_string(
            "%s rows (%s%%) are flagged by the IQR rule.", F.format_number(F.coalesce(F.col("_nf"), F.lit(0)), 0),
            fr.cast("string")).alias("sentence"), F.lit(True).alias("_keep")))
    return row.select(F.inline(F.array(*items))).where("_keep").select("topic", "sentence")
