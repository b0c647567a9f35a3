"""Chart inputs as aggregated tables (the drawing itself is not this library's job).

Each function returns the numbers a plotting call would need: histogram bins
(numpy 'auto' rule), a Gaussian KDE curve (Scott bandwidth), box-plot
summaries (matplotlib whisker rule), pair-plot points, equal-width binned
class rates (pandas ``cut`` bins).  Data-dependent constants (edges, fences,
bandwidth) are fitted in one small aggregate and applied as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprism.functions.expressions import rnd
from tabprism.operators.models import partial_sums
from tabprism.operators.positions import sized_side
from tabprism.operators.quantiles import quantiles, select_quantiles
from tabprism.operators.stats import column_stats, to_long
from tabprism.constants import CURVE_BINS, CUT_WIDENING, IQR_FENCE, KDE_BINS, KDE_GRID

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


# ---------------------------------------------------------------- V2 histogram
def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> tuple[float, float, int]:
    """numpy 'auto' binning: width = min(max(Freedman–Diaconis, sqrt-rule / 2), Sturges).

    The sqrt floor caps the bin count near 2·sqrt(n), so the bin table stays
    bounded however skewed the column is.
    """
    if n == 0:
        return 0.0, 1.0, 1
    if hi == lo:
        return lo - 0.5, hi + 0.5, 1
    sturges = (hi - lo) / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    sqrt_half = (hi - lo) / math.sqrt(n) / 2
    width = min(max(fd, sqrt_half), sturges)
    return lo, hi, int(math.ceil((hi - lo) / width))


def _edge(i: Column, lo: Column, hi: Column, k: Column) -> Column:
    """numpy.linspace(lo, hi, k + 1)[i]."""
    return F.when(i >= k, hi).otherwise(i.cast("double") * ((hi - lo) / k) + lo)


def histogram_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """V2: bins (column_name, index, edges, count) of several columns with numpy's 'auto' bin count; empty bins kept.

    One aggregate and one quantile selection fit every column's edges, one more
    pass bins all columns at once.  A column without values has one empty bin.
    """
    cols = list(cols)
    st = {r["column_name"]: r for r in column_stats(df, cols, {"n": F.count, "lo": F.min, "hi": F.max}).collect()}
    rows = []
    for c, (q1, q3) in zip(cols, select_quantiles(df, cols, [0.25, 0.75])):
        lo, hi, k = auto_bins(st[c]["n"], st[c]["lo"], st[c]["hi"], q1, q3)
        rows.append((c, lo, hi, k))
    edges = df.sparkSession.createDataFrame(rows, "column_name string, lo double, hi double, k bigint")      # a row per column
    x, lo, hi, k, i = (F.col(c) for c in ("_x", "lo", "hi", "k", "_b"))
    # numpy's bin: floor of the scaled offset, last bin closed, then the one-ulp corrections against the edges
    binned = (to_long(df, cols, name_col="_c", value_col="_x").where(_finite(x)).join(F.broadcast(edges), F.col("_c") == F.col("column_name"))
              .withColumn("_b", F.floor(((x - lo) / (hi - lo)) * k).cast("long"))
              .withColumn("_b", F.when(i == k, k - 1).otherwise(i))
              .withColumn("_b", F.when(x < _edge(i, lo, hi, k), i - 1).otherwise(i))
              .withColumn("_b", F.when((x >= _edge(i + 1, lo, hi, k)) & (i != k - 1), i + 1).otherwise(i)))
    counts = binned.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("n"))
    grid = edges.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("bin"))
    out = grid.join(counts, (F.col("column_name") == F.col("_c")) & (F.col("bin") == F.col("_b")), "left")
    b, lo, hi, k = (F.col(c) for c in ("bin", "lo", "hi", "k"))
    return out.select("column_name", "bin", _edge(b, lo, hi, k).alias("lo_edge"), _edge(b + 1, lo, hi, k).alias("hi_edge"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def histogram_auto(df: DataFrame, col: str) -> DataFrame:
    """V2: bins (index, edges, count) of one column with numpy's 'auto' bin count; empty bins kept."""
    return histogram_columns(df, [col]).drop("column_name")


# ---------------------------------------------------------------- V3 KDE
def kde_curve(df: DataFrame, col: str, gridsize: int = KDE_GRID, cut: float = 0.0,
              digits: int | None = 9) -> DataFrame:
    """V3: Gaussian KDE on ``gridsize`` points over [min − cut·bw, max + cut·bw].

    Bandwidth: Scott's factor n^(-1/5) times the sample standard deviation.
    One scan sums the kernels of every grid point inside the tasks; a partition
    sends on ``gridsize`` numbers and no value is shuffled.  Exact, at
    ``gridsize`` kernels a row; ``density_curves`` takes two additions a row.
    """
    x = F.col(col).cast("double")
    d = df.select(x.alias("_x")).where(_finite(F.col("_x")))
    st = d.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"),
               F.stddev_samp("_x").alias("sd")).first()
    n = st["n"]
    if not n or not st["sd"]:
        return df.sparkSession.range(0).select(F.col("id").alias("point"), F.lit(0.0).alias("x"),
                                               F.lit(0.0).alias("density"))
    bw = st["sd"] * n ** (-1.0 / 5.0)
    lo, hi = st["lo"] - cut * bw, st["hi"] + cut * bw
    grid = np.linspace(lo, hi, gridsize).tolist()
    points = np.asarray(grid)

    def kernels(m):
        return np.array([np.exp(-0.5 * ((g - m[:, 0]) / bw) ** 2).sum() for g in points])

    sums = partial_sums(d, ["_x"], kernels) / (n * bw * math.sqrt(2 * math.pi))
    curve = df.sparkSession.createDataFrame([(i, g, float(v)) for i, (g, v) in enumerate(zip(grid, sums))],
                                            "point bigint, x double, density double")
    return curve if digits is None else curve.withColumn("density", rnd("density", digits))


def density_curves(df: DataFrame, cols: Sequence[str], by: str | None = None, gridsize: int = KDE_GRID, cut: float = 0.0,
                   common_norm: bool = False, per_bandwidth: int = KDE_BINS, digits: int | None = 9) -> DataFrame:
    """V3/V9 diagonal: Gaussian density curves of several columns, per class with ``by``: (by, column_name, point, x, density).

    Bandwidth: Scott's factor of the group's rows.  Each value is shared
    linearly between the two nearest of bins one ``per_bandwidth``-th of the
    bandwidth wide (error about 1 / (8·per_bandwidth²) of the density); bins are
    summed before the shuffle, and only bins meet grid points, within nine
    bandwidths.  So a row costs two additions, whatever the grid.  With
    ``common_norm`` a column's curves over all classes enclose 1 together.
    Groups with fewer than two distinct values have no curve.
    """
    cols, groups = list(cols), [by] if by else []
    keys = [*groups, "column_name"]
    # the variance as a column's covariance with itself: stddev_samp may differ from the SQL's in the last bit, which shows in x's ninth digit
    st = column_stats(df, cols, {"_n": F.count, "_lo": F.min, "_hi": F.max, "_sd": lambda c: F.sqrt(F.covar_samp(c, c))}, by=groups, index_col=None)
    n = F.col("_n").cast("double")
    bw = F.col("_sd") * F.pow(n, F.lit(-1.0 / 5.0))
    st = st.where(F.col("_sd") > 0).withColumn("_bw", bw)
    total = F.sum(n).over(Window.partitionBy("column_name")) if common_norm else n     # one row per column and class
    fits = sized_side(st.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(keys)], "_lo", "_bw", (F.col("_bw") / per_bandwidth).alias("_w"),
                                (F.col("_lo") - cut * F.col("_bw")).alias("_g0"), (F.col("_hi") + cut * F.col("_bw")).alias("_g1"),
                                (total * F.col("_bw") * math.sqrt(2 * math.pi)).alias("_norm")))
    on = [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(keys)]
    long = to_long(df, cols, keep=groups, value_col="_x").where(_finite(F.col("_x"))).join(fits, on)
    u = (F.col("_x") - F.col("_lo")) / F.col("_w")
    low = F.floor(u)
    bins = (long.select(*keys, F.inline(F.array(F.struct(low.alias("_j"), (1 - (u - low)).alias("_m")),
                                                F.struct((low + 1).alias("_j"), (u - low).alias("_m")))))
            .groupBy(*keys, "_j").agg(F.sum("_m").alias("_m")))
    at, step = F.col("_lo") + F.col("_j") * F.col("_w"), (F.col("_g1") - F.col("_g0")) / (gridsize - 1)
    reach = 9 * F.col("_bw")
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((at - reach - F.col("_g0")) / step))
    last = F.least(F.lit(gridsize - 1).cast("bigint"), F.floor((at + reach - F.col("_g0")) / step))
    met = bins.join(fits, on).where(first <= last).select(*keys, "_m", at.alias("_at"), "_bw", "_g0", "_g1", F.explode(F.sequence(first, last)).alias("point"))

    def place(point):
        return F.when(point == gridsize - 1, F.col("_g1")).otherwise(point * ((F.col("_g1") - F.col("_g0")) / (gridsize - 1)) + F.col("_g0"))

    kernel = F.col("_m") * F.exp(-0.5 * F.pow((place(F.col("point")) - F.col("_at")) / F.col("_bw"), F.lit(2.0)))
    sums = met.groupBy(*keys, "point").agg(F.sum(kernel).alias("_s"))
    grid = fits.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(gridsize - 1).cast("bigint"))))
    density = F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_norm")
    return (grid.join(sums, [*on, F.col("_p") == F.col("point")], "left")
            .select(*[F.col(f"_f{i}").alias(c) for i, c in enumerate(keys)], F.col("_p").alias("point"),
                    *[(rnd(v, digits) if digits is not None else v).alias(c) for c, v in (("x", place(F.col("_p"))), ("density", density))]))


def pair_diagonal(df: DataFrame, cols: Sequence[str], class_col: str, digits: int | None = 9) -> DataFrame:
    """V9: the curves on the diagonal of a pair plot: one per column and class, three bandwidths past its
    ends, scaled by the class's share of the rows."""
    return density_curves(df, cols, by=class_col, cut=3.0, common_norm=True, digits=digits)


# ---------------------------------------------------------------- V4–V6 box summaries
def box_summary(df: DataFrame, cols: Sequence[str], by: str | None = None, k: float = IQR_FENCE,
                digits: int | None = 6) -> DataFrame:
    """V4/V5: q1, median, q3, whiskers (extreme values inside 1.5·IQR) and flier count.

    One quantile pass (per group when ``by`` is given), then one aggregate of
    the rows joined to their fences, one row per group and column; any number
    of groups.  Quartiles are reported rounded to ``digits`` (engines
    interpolate with different last-bit arithmetic).
    """
    cols = list(cols)
    groups = [by] if by else []
    keys = [*groups, "column_name"]
    q = quantiles(df, cols, QUARTILES, by=groups)
    iqr = F.col("q3") - F.col("q1")
    fences = sized_side(q.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(keys)], *QUARTILES,
                                 (F.col("q1") - k * iqr).alias("_lo"), (F.col("q3") + k * iqr).alias("_hi")))
    long = to_long(df, cols, keep=groups, value_col="_x")
    on = [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(keys)]
    x = F.when(_finite(F.col("_x")), F.col("_x"))
    quartile = [F.max(name).alias(name) for name in QUARTILES]
    out = long.join(fences, on).groupBy(*keys).agg(
        *quartile, F.min(F.when(x >= F.col("_lo"), x)).alias("whisker_lo"),
        F.max(F.when(x <= F.col("_hi"), x)).alias("whisker_hi"),
        F.count_if((x < F.col("_lo")) | (x > F.col("_hi"))).cast("bigint").alias("n_fliers"))
    return out.select(*keys, *[(rnd(F.col(c), digits) if digits is not None else F.col(c)).alias(c) for c in QUARTILES],
                      "whisker_lo", "whisker_hi", "n_fliers")


def box_by_ordered_category(df: DataFrame, value: str, category: str, order: Sequence[str],
                            where: Column | None = None) -> DataFrame:
    """V6: box summary of ``value`` per category level, levels restricted to and ranked by ``order``."""
    d = df.where(where) if where is not None else df
    d = d.where(F.col(category).isin(list(order)))
    out = box_summary(d, [value], by=category)
    rank = F.create_map(*[x for i, lv in enumerate(order) for x in (F.lit(lv), F.lit(i + 1))])
    return out.withColumn("order_idx", F.element_at(rank, F.col(category)))


# ---------------------------------------------------------------- V9 pair points
def pair_points(df: DataFrame, cols: Sequence[str], class_col: str, id_col: str) -> DataFrame:
    """V9: one row per (row, x column, y column) for every ordered pair of distinct columns."""
    cols = list(cols)
    structs = [F.struct(F.lit(a).alias("x_col"), F.lit(b).alias("y_col"),
                        F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
               for a in cols for b in cols if a != b]
    return df.select(F.col(id_col).alias("id"), F.col(class_col).alias("class"), F.inline(F.array(*structs)))


# ---------------------------------------------------------------- V11 binned rate
def label_edge(x: float, precision: int) -> float:
    """An edge as interval labels show it: ``precision`` decimals, counted from the first significant one below 1."""
    size = abs(x)
    if size == 0 or not math.isfinite(size):
        return x
    leading_zeros = 0
    if size < 1:
        # the exponent of scientific notation is the place of the first significant digit
        leading_zeros = -int(f"{size:.17e}".partition("e")[2]) - 1
    return float(np.round(x, leading_zeros + precision))


def cut_edges(lo: float, hi: float, bins: int, precision: int | None = 3):
    """Equal-width right-closed edges as ``pandas.cut(x, bins)`` builds them.

    Returns (edges used to assign rows, edges used for the interval labels).
    With ``precision`` the label edges are rounded the way pandas labels
    intervals (the smallest precision ≥ the given one that keeps edges distinct).
    """
    if lo == hi:
        lo, hi = (lo - 0.001 * abs(lo), hi + 0.001 * abs(hi)) if lo != 0 else (lo - 0.001, hi + 0.001)
        edges = np.linspace(lo, hi, bins + 1)
    else:
        edges = np.linspace(lo, hi, bins + 1)
        edges[0] -= (hi - lo) * CUT_WIDENING
    edges = edges.tolist()
    if precision is None:
        return edges, edges
    for p in range(precision, 20):
        lab = [label_edge(e, p) for e in edges]
        if len(set(lab)) == len(lab):
            return edges, lab
    return edges, edges


def binned_rate(df: DataFrame, x: str, target: str, bins: int = CURVE_BINS,
                precision: int | None = 3) -> DataFrame:
    """Class rate per equal-width right-closed bin of ``x`` (empty bins omitted).

    The bin of a row is the number of edges strictly below it (pandas'
    searchsorted rule); the mid is the centre of the (label) interval.
    """
    xv = F.col(x).cast("double")
    d = df.where(_finite(xv))
    st = d.agg(F.min(xv).alias("lo"), F.max(xv).alias("hi")).first()
    if st["lo"] is None:
        return df.sparkSession.range(0).select(F.col("id").alias("bin"), F.lit(0.0).alias("mid"),
                                               F.lit(0.0).alias("rate"), F.col("id").alias("n"))
    edges, lab = cut_edges(st["lo"], st["hi"], bins, precision)
    idx = sum((F.when(xv > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    g = (d.select(idx.alias("bin"), F.col(target).cast("double").alias("_t"))
         .where((F.col("bin") >= 1) & (F.col("bin") <= bins))
         .groupBy("bin").agg(F.avg("_t").alias("rate"), F.count(F.lit(1)).alias("n")))
    mids = F.create_map(*[v for i in range(1, bins + 1) for v in (F.lit(i), F.lit((lab[i - 1] + lab[i]) / 2))])
    return g.select("bin", F.element_at(mids, F.col("bin")).alias("mid"), "rate", "n")
