"""Chart-data keys: V2–V11 (V1, V7, V8, V10, V13–V17 are registered with their operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprism.operators import chartdata as V
from tabprism.operators import models as M
from tabprism.operators import sampling as S
from tabprism.plans import tables as T
from tabprism.plans.position_queries import LI_KEYS, LI_SAMPLE_SQL
from tabprism.plans.registry import query
from tabprism.plans.sqlgen import dbl, prep_sql, union_cols

EV_VALUE = "SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value)"
THIRD = "(CAST(-1.0 AS DOUBLE) / CAST(3.0 AS DOUBLE))"


def _edge_sql(i):
    return f"(CASE WHEN ({i}) >= k THEN hi ELSE ({i}) * ((hi - lo) / k) + lo END)"


@query("histogram_auto", (
    f"WITH d AS ({EV_VALUE}), st AS (SELECT COUNT(*) AS n, MIN(x) AS lo, MAX(x) AS hi, "
    "QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.75) AS q3 FROM d), "
    f"w AS (SELECT *, (hi - lo) / (LOG2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * POW(n, {THIRD}) AS fd FROM st), "
    "kk AS (SELECT lo, hi, CAST(CEIL((hi - lo) / LEAST(GREATEST(fd, (hi - lo) / SQRT(n) / 2), sturges)) "
    "AS BIGINT) AS k FROM w), "
    "i0 AS (SELECT x, lo, hi, k, CAST(FLOOR(((x - lo) / (hi - lo)) * k) AS BIGINT) AS b FROM d, kk), "
    "i1 AS (SELECT x, lo, hi, k, CASE WHEN b = k THEN k - 1 ELSE b END AS b FROM i0), "
    f"i2 AS (SELECT x, lo, hi, k, CASE WHEN x < {_edge_sql('b')} THEN b - 1 ELSE b END AS b FROM i1), "
    f"i3 AS (SELECT CASE WHEN x >= {_edge_sql('b + 1')} AND b <> k - 1 THEN b + 1 ELSE b END AS b FROM i2), "
    "c AS (SELECT b, COUNT(*) AS n FROM i3 GROUP BY b) "
    f"SELECT r.i AS bin, {_edge_sql('r.i')} AS lo_edge, {_edge_sql('r.i + 1')} AS hi_edge, "
    "CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM kk, range(0, kk.k) r(i) LEFT JOIN c ON c.b = r.i"))
def histogram_auto(spark, sf):
    return V.histogram_auto(T.load(spark, sf, "events"), "value")


@query("kde_curve", (
    f"WITH d AS ({EV_VALUE}), st AS (SELECT COUNT(*) AS n, MIN(x) AS lo, MAX(x) AS hi, "
    "STDDEV_SAMP(x) * POW(COUNT(*), CAST(-0.2 AS DOUBLE)) AS bw FROM d), "
    "w AS (SELECT x, COUNT(*) AS c FROM d GROUP BY x), "
    "g AS (SELECT i AS point, CASE WHEN i = 199 THEN hi ELSE i * ((hi - lo) / 199) + lo END AS gx FROM st, range(0, 200) r(i)) "
    "SELECT point, gx AS x, ROUND(SUM(c * EXP(-0.5 * POW((gx - w.x) / bw, 2))) * (1.0 / (n * bw * SQRT(2 * PI()))), 9) "
    "+ 0.0 AS density FROM g, w, st GROUP BY point, gx, n, bw"))
def kde_curve(spark, sf):
    return V.kde_curve(T.load(spark, sf, "events"), "value")


HISTOGRAM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _histograms_sql():
    """As histogram_auto for several columns at once (d: column_name, x)."""
    d = union_cols(HISTOGRAM_COLS, lambda i, c: f"SELECT '{c}' AS column_name, {dbl(c)} AS x FROM lineitem")
    key = "column_name"
    return (f"WITH d AS ({d}), st AS (SELECT {key}, COUNT(*) AS n, MIN(x) AS lo, MAX(x) AS hi, "
            f"QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.75) AS q3 FROM d GROUP BY {key}), "
            f"w AS (SELECT *, (hi - lo) / (LOG2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * POW(n, {THIRD}) AS fd FROM st), "
            f"kk AS (SELECT {key}, lo, hi, CAST(CEIL((hi - lo) / LEAST(GREATEST(fd, (hi - lo) / SQRT(n) / 2), sturges)) "
            "AS BIGINT) AS k FROM w), "
            f"i0 AS (SELECT {key}, x, lo, hi, k, CAST(FLOOR(((x - lo) / (hi - lo)) * k) AS BIGINT) AS b FROM d JOIN kk USING ({key})), "
            f"i1 AS (SELECT {key}, x, lo, hi, k, CASE WHEN b = k THEN k - 1 ELSE b END AS b FROM i0), "
            f"i2 AS (SELECT {key}, x, lo, hi, k, CASE WHEN x < {_edge_sql('b')} THEN b - 1 ELSE b END AS b FROM i1), "
            f"i3 AS (SELECT {key}, CASE WHEN x >= {_edge_sql('b + 1')} AND b <> k - 1 THEN b + 1 ELSE b END AS b FROM i2), "
            f"c AS (SELECT {key}, b, COUNT(*) AS n FROM i3 GROUP BY {key}, b), "
            f"r AS (SELECT {key}, lo, hi, k, UNNEST(range(0, k)) AS i FROM kk) "
            f"SELECT r.{key}, r.i AS bin, {_edge_sql('r.i')} AS lo_edge, {_edge_sql('r.i + 1')} AS hi_edge, "
            f"CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM r LEFT JOIN c ON c.b = r.i AND c.{key} = r.{key}")


@query("histogram_columns", _histograms_sql())
def histogram_columns(spark, sf):
    """V2 of several columns in one call."""
    return V.histogram_columns(T.load(spark, sf, "lineitem"), HISTOGRAM_COLS)


def _density_sql(src: str, cols, by: str | None, cut: float, common: bool) -> str:
    """Binned Gaussian density curves: values shared between the two nearest bins, bandwidth / 16 wide."""
    g = f"{by}, column_name" if by else "column_name"
    v = union_cols(cols, lambda i, c: f"SELECT {by + ', ' if by else ''}'{c}' AS column_name, {dbl(c)} AS x FROM ({src}) _s")
    total = "SUM(n) OVER (PARTITION BY column_name)" if common else "n"
    gx = "(CASE WHEN i = 199 THEN g1 ELSE i * ((g1 - g0) / 199) + g0 END)"
    return (f"WITH v AS ({v}), st AS (SELECT {g}, CAST(COUNT(*) AS DOUBLE) AS n, MIN(x) AS lo, MAX(x) AS hi, "
            f"STDDEV_SAMP(x) * POW(COUNT(*), CAST(-0.2 AS DOUBLE)) AS bw FROM v GROUP BY {g}), "
            f"f AS (SELECT *, bw / 16 AS w, lo - {cut!r} * bw AS g0, hi + {cut!r} * bw AS g1, {total} * bw * SQRT(2 * PI()) AS norm FROM st WHERE bw > 0), "
            f"u AS (SELECT {g}, (x - lo) / w AS u FROM v JOIN f USING ({g})), "
            f"h AS (SELECT {g}, FLOOR(u) AS j, 1 - (u - FLOOR(u)) AS m FROM u UNION ALL SELECT {g}, FLOOR(u) + 1, u - FLOOR(u) FROM u), "
            f"b AS (SELECT {g}, j, SUM(m) AS m FROM h GROUP BY {g}, j), "
            f"p AS (SELECT *, UNNEST(range(0, 200)) AS i FROM f) "
            f"SELECT {g}, i AS point, ROUND({gx}, 9) + 0.0 AS x, ROUND(SUM(m * EXP(-0.5 * POW(({gx} - (lo + j * w)) / bw, 2))) / norm, 9) + 0.0 AS density "
            f"FROM p JOIN b USING ({g}) GROUP BY {g}, i, lo, w, bw, g0, g1, norm")


@query("density_columns", _density_sql("SELECT * FROM lineitem", HISTOGRAM_COLS, None, 0.0, False))
def density_columns(spark, sf):
    """V3 of several columns in one call, two additions a value."""
    return V.density_curves(T.load(spark, sf, "lineitem"), HISTOGRAM_COLS)


def _box_sql(src, cols, by=None):
    g = f"{by}, " if by else ""
    gb = f" GROUP BY {by}" if by else ""

    def t(i, c):
        return (f"SELECT {g}'{c}' AS column_name, QUANTILE_CONT({dbl(c)}, 0.25) AS q1, "
                f"QUANTILE_CONT({dbl(c)}, 0.5) AS median, QUANTILE_CONT({dbl(c)}, 0.75) AS q3 FROM ({src}) _s{gb}")
    fences = union_cols(cols, t)

    def w(i, c):
        on = f" AND f.{by} IS NOT DISTINCT FROM _s.{by}" if by else ""
        return (f"SELECT {('_s.' + by + ', ') if by else ''}'{c}' AS column_name, ROUND(f.q1, 6) + 0.0 AS q1, "
                f"ROUND(f.median, 6) + 0.0 AS median, ROUND(f.q3, 6) + 0.0 AS q3, "
                f"MIN({dbl(c)}) FILTER (WHERE {dbl(c)} >= f.q1 - 1.5 * (f.q3 - f.q1)) AS whisker_lo, "
                f"MAX({dbl(c)}) FILTER (WHERE {dbl(c)} <= f.q3 + 1.5 * (f.q3 - f.q1)) AS whisker_hi, "
                f"CAST(COUNT(*) FILTER (WHERE {dbl(c)} < f.q1 - 1.5 * (f.q3 - f.q1) OR {dbl(c)} > "
                f"f.q3 + 1.5 * (f.q3 - f.q1)) AS BIGINT) AS n_fliers FROM ({src}) _s JOIN fences f "
                f"ON f.column_name = '{c}'{on} GROUP BY {('_s.' + by + ', ') if by else ''}f.q1, f.median, f.q3")
    return f"WITH fences AS ({fences}) " + union_cols(cols, w)


@query("box_summary", _box_sql("SELECT * FROM lineitem", T.LI_NUMERIC))
def box_summary(spark, sf):
    return V.box_summary(T.load(spark, sf, "lineitem"), T.LI_NUMERIC)


BOX_CLASS_COLS = ["sum_qty", "n_lines", "o_totalprice"]


@query("box_by_class", _box_sql(T.OF_SQL, BOX_CLASS_COLS, by="flag"))
def box_by_class(spark, sf):
    return V.box_summary(T.of(spark, sf), BOX_CLASS_COLS, by="flag")


@query("box_many_groups", _box_sql("SELECT * FROM orders", ["o_totalprice"], by="o_custkey"))
def box_many_groups(spark, sf):
    """V5 with a group per customer."""
    return V.box_summary(T.load(spark, sf, "orders"), ["o_totalprice"], by="o_custkey")


# The display order of the ordered category (most urgent first).
PRIORITY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("box_by_ordered_category", (
    _box_sql(f"SELECT * FROM ({T.OF_SQL}) o WHERE flag = 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
             ["sum_price"], by="o_orderpriority")
    .replace("WITH fences AS", "WITH b AS (SELECT 1) , fences AS", 1)
    + "").replace("SELECT _s.o_orderpriority, 'sum_price' AS column_name,",
                  "SELECT _s.o_orderpriority, 'sum_price' AS column_name, CAST(CASE _s.o_orderpriority "
                  "WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS INTEGER) AS order_idx,"))
def box_by_ordered_category(spark, sf):
    """V6: box summary of the order value per priority, positive class only, in display order."""
    return V.box_by_ordered_category(T.of(spark, sf), "sum_price", "o_orderpriority", PRIORITY_ORDER,
                                     where=F.col("flag") == 1)


PAIR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pair_sql():
    parts = [f"SELECT pos AS id, l_returnflag AS class, '{a}' AS x_col, '{b}' AS y_col, {dbl(a)} AS x, {dbl(b)} AS y "
             f"FROM smp" for a in PAIR_COLS for b in PAIR_COLS if a != b]
    return f"WITH smp AS ({LI_SAMPLE_SQL}) " + " UNION ALL ".join(parts)


@query("pair_points", _pair_sql())
def pair_points(spark, sf):
    li = T.load(spark, sf, "lineitem")
    sample = S.numbered_sample(li, LI_KEYS, 2000, seed=42, ties=li.columns)
    return V.pair_points(sample, PAIR_COLS, "l_returnflag", "pos")


@query("pair_diagonal", _density_sql(f"SELECT * FROM ({LI_SAMPLE_SQL}) q", PAIR_COLS, "l_returnflag", 3.0, True))
def pair_diagonal(spark, sf):
    """V9: class densities on the diagonal of the pair plot, over the same sample."""
    li = T.load(spark, sf, "lineitem")
    return V.pair_diagonal(S.seeded_sample(li, LI_KEYS, 2000, seed=42, ties=li.columns), PAIR_COLS, "l_returnflag")


def _binned_sql():
    edges = ["(lo - (hi - lo) * 0.001)"] + [f"({i} * ((hi - lo) / 15) + lo)" for i in range(1, 15)] + ["hi"]
    idx = " + ".join(f"CASE WHEN x > {e} THEN 1 ELSE 0 END" for e in edges)
    mid_cases = " ".join(f"WHEN {i} THEN ({edges[i - 1]} + {edges[i]}) / 2" for i in range(1, 16))
    return (f"WITH of AS ({T.OF_SQL}), " + prep_sql("SELECT * FROM of", "o_orderkey", ["o_totalprice", "n_lines",
            "sum_qty", "avg_discount", "avg_tax"], "flag") + ", tr AS (SELECT sum_qty AS x, flag FROM s WHERE split = 'train'), "
            "mm AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM tr), "
            f"b AS (SELECT {idx} AS bin, flag FROM tr, mm), "
            "g AS (SELECT bin, AVG(CAST(flag AS DOUBLE)) AS rate, CAST(COUNT(*) AS BIGINT) AS n FROM b "
            "WHERE bin BETWEEN 1 AND 15 GROUP BY bin) "
            f"SELECT bin, CASE bin {mid_cases} END AS mid, rate, n FROM g, mm")


@query("binned_rate", _binned_sql())
def binned_rate(spark, sf):
    """V11 with unrounded interval mids (exact SQL parity)."""
    prep = M.prepare(T.of(spark, sf), ["o_totalprice", "n_lines", "sum_qty", "avg_discount", "avg_tax"],
                     "flag", "o_orderkey")
    return V.binned_rate(prep.train, "sum_qty", "flag", 15, precision=None)


def _binned_labels_sql():
    """As ``_binned_sql`` but mids from pandas-style labels: each edge rounded to
    ``precision`` decimals (significant digits of the fraction when |edge| < 1),
    precision raised from 3 until all 16 labels are distinct; numpy half-even rounding."""
    base = _binned_sql()
    head, tail = base.split(" SELECT bin, CASE bin ", 1)
    edges = ("ed AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = 15 THEN hi "
             "ELSE i * ((hi - lo) / 15) + lo END AS e FROM mm, range(0, 16) r(i)), "
             "dg AS (SELECT p, i, e, CASE WHEN TRUNC(e) = 0 THEN -CAST(FLOOR(LOG10(ABS(e - TRUNC(e)))) AS INTEGER) "
             "- 1 + p ELSE p END AS d FROM ed, range(3, 20) q(p) WHERE e <> 0 UNION ALL "
             "SELECT p, i, e, 0 AS d FROM ed, range(3, 20) q(p) WHERE e = 0), "
             "rf AS (SELECT p, i, CASE WHEN e = 0 THEN e ELSE ROUND_EVEN(e * POW(10, d), 0) / POW(10, d) END AS lab "
             "FROM dg), "
             "pp AS (SELECT COALESCE(MIN(p), 3) AS p FROM (SELECT p FROM rf GROUP BY p HAVING COUNT(DISTINCT lab) = 16) u), "
             "lb AS (SELECT rf.i, rf.lab FROM rf, pp WHERE rf.p = pp.p) ")
    return (head + ", " + edges + "SELECT g.bin, (a.lab + b.lab) / 2 AS mid, g.rate, g.n FROM g "
            "JOIN lb a ON a.i = g.bin - 1 JOIN lb b ON b.i = g.bin")


@query("binned_rate_labels", _binned_labels_sql())
def binned_rate_labels(spark, sf):
    """V11 with mids taken from pandas-style rounded interval labels (the reference's bin centres)."""
    prep = M.prepare(T.of(spark, sf), ["o_totalprice", "n_lines", "sum_qty", "avg_discount", "avg_tax"],
                     "flag", "o_orderkey")
    return V.binned_rate(prep.train, "sum_qty", "flag", 15, precision=3)
