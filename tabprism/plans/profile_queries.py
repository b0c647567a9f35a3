"""Profile keys: B1–B10, G1–G15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprism.functions.columns import exclude_columns, numeric_columns
from tabprism.operators import profile as P
from tabprism.plans import tables as T
from tabprism.plans.registry import query
from tabprism.plans.sqlgen import dbl, describe_sql, fences_sql, q, r, union_cols

LI = "SELECT * FROM lineitem"


# ---------------------------------------------------------------- describe family
@query("describe_numeric", describe_sql(LI, T.LI_NUMERIC, 4))
def describe_numeric(spark, sf):
    li = T.load(spark, sf, "lineitem")
    cols = numeric_columns(li, exclude=T.LI_IDS)
    return P.describe(li, cols, digits=4)


@query("describe_numeric_rank", describe_sql(LI, T.LI_NUMERIC, 4))
def describe_numeric_rank(spark, sf):
    """Same as describe_numeric, forcing the distributed order-statistics path."""
    li = T.load(spark, sf, "lineitem")
    return P.describe(li, numeric_columns(li, exclude=T.LI_IDS), digits=4, quantile_method="rank")


@query("describe_skew", describe_sql(LI, T.LI_NUMERIC, 2, skew=True))
def describe_skew(spark, sf):
    li = T.load(spark, sf, "lineitem")
    return P.describe(li, T.LI_NUMERIC, digits=2, skew=True)


@query("describe_skew_nulls", describe_sql(T.EVN_SQL, ["user_id", "value"], 2, skew=True))
def describe_skew_nulls(spark, sf):
    return P.describe(T.evn(spark, sf), ["user_id", "value"], digits=2, skew=True)


@query("filtered_describe", describe_sql(LI, ["l_extendedprice", "l_quantity"], 2,
                                         where="l_returnflag = 'A'"))
def filtered_describe(spark, sf):
    li = T.load(spark, sf, "lineitem").where(F.col("l_returnflag") == "A")
    return P.describe(li, ["l_extendedprice", "l_quantity"], digits=2)


# ---------------------------------------------------------------- shape / schema / columns
@query("table_shape", "SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def table_shape(spark, sf):
    return P.table_shape(T.load(spark, sf, "lineitem"))


def _numeric_columns_sql():
    def t(i, c):
        return (f"SELECT {i} AS column_idx, '{c}' AS column_name, "
                f"CAST(COUNT({q(c)}) AS BIGINT) AS n_values FROM lineitem")
    return union_cols(T.LI_NUMERIC, t)


@query("numeric_columns", _numeric_columns_sql())
def numeric_columns_q(spark, sf):
    li = T.load(spark, sf, "lineitem")
    cols = numeric_columns(li, exclude=T.LI_IDS)
    return P.missing_counts(li.select(cols), keep_zero=True, with_rows=True).select(
        "column_idx", "column_name", (F.col("n_rows") - F.col("n_missing")).alias("n_values"))


@query("exclude_columns", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
                          "l_linestatus, l_shipdate FROM lineitem")
def exclude_columns_q(spark, sf):
    li = T.load(spark, sf, "lineitem")
    return li.select(exclude_columns(li, T.LI_IDS))


EVN_COLS = ["event_id", "user_id", "event_type", "value"]
EVN_TYPES = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}


def _missing_sql(keep_zero: bool, extra: str = "") -> str:
    def t(i, c):
        miss = f"{q(c)} IS NULL" + (f" OR isnan({q(c)})" if EVN_TYPES[c] == "double" else "")
        return (f"SELECT {i} AS column_idx, '{c}' AS column_name, '{EVN_TYPES[c]}' AS dtype, "
                f"CAST(COUNT(*) FILTER (WHERE {miss}) AS BIGINT) AS n_missing, "
                f"CAST(COUNT(*) AS BIGINT) AS n_rows FROM evn")
    body = union_cols(EVN_COLS, t)
    return f"WITH evn AS ({T.EVN_SQL}), m AS ({body}) " + extra


@query("schema_profile", _missing_sql(True, "SELECT column_idx, column_name, dtype, n_missing FROM m"))
def schema_profile(spark, sf):
    return P.schema_profile(T.evn(spark, sf))


@query("missing_total", _missing_sql(True, "SELECT CAST(SUM(n_missing) AS BIGINT) AS total_missing FROM m"))
def missing_total(spark, sf):
    return P.missing_total(T.evn(spark, sf))


@query("missing_by_column", _missing_sql(
    False, "SELECT column_idx, column_name, n_missing FROM m WHERE n_missing > 0"))
def missing_by_column(spark, sf):
    return P.missing_counts(T.evn(spark, sf))


@query("missing_pct_ranked", _missing_sql(
    False, "SELECT column_name, n_missing, ROUND(n_missing / n_rows * 100, 2) + 0.0 AS pct_missing, "
           "CAST(ROW_NUMBER() OVER (ORDER BY n_missing DESC, column_idx) AS INTEGER) AS rank "
           "FROM m WHERE n_missing > 0"))
def missing_pct_ranked(spark, sf):
    return P.missing_ranked(T.evn(spark, sf), digits=2)


@query("missing_bar", _missing_sql(
    False, "SELECT column_name, n_missing, n_missing / n_rows * 100 AS pct_missing, "
           "CAST(ROW_NUMBER() OVER (ORDER BY n_missing DESC, column_idx) AS INTEGER) AS rank "
           "FROM m WHERE n_missing > 0"))
def missing_bar(spark, sf):
    return P.missing_ranked(T.evn(spark, sf), digits=None)


# ---------------------------------------------------------------- duplicates
@query("duplicate_rows", "SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS n_duplicates FROM "
                         "(SELECT COUNT(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus, "
                         "l_linenumber, l_quantity) g")
def duplicate_rows(spark, sf):
    li = T.load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return P.duplicate_rows(li)


@query("duplicate_rows_full", "SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS n_duplicates FROM "
                              "(SELECT COUNT(*) AS c FROM lineitem GROUP BY ALL_COLS) g".replace(
                                  "ALL_COLS", ", ".join(T.LI_IDS + T.LI_NUMERIC + [
                                      "l_returnflag", "l_linestatus", "l_shipdate"])))
def duplicate_rows_full(spark, sf):
    return P.duplicate_rows(T.load(spark, sf, "lineitem"))


@query("duplicate_keys", "SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS n_duplicates FROM "
                         "(SELECT COUNT(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) g")
def duplicate_keys(spark, sf):
    return P.duplicate_rows(T.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- categories / classes
def _freq_sql(table, cols):
    def t(i, c):
        return (f"SELECT '{c}' AS column_name, CAST({q(c)} AS VARCHAR) AS value, "
                f"CAST(COUNT(*) AS BIGINT) AS n FROM {table} GROUP BY {q(c)}")
    return union_cols(cols, t)


@query("category_freq", _freq_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def category_freq(spark, sf):
    return P.category_freq(T.load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("category_freq_part", _freq_sql("part", ["p_brand", "p_type", "p_size"]))
def category_freq_part(spark, sf):
    return P.category_freq(T.load(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


OF_CTE = f"WITH of AS ({T.OF_SQL}) "


@query("class_balance", OF_CTE + "SELECT flag AS class, CAST(COUNT(*) AS BIGINT) AS n, "
       "ROUND(COUNT(*) / SUM(COUNT(*)) OVER () * 100, 2) + 0.0 AS pct FROM of "
       "WHERE flag IS NOT NULL GROUP BY flag")
def class_balance(spark, sf):
    return P.class_balance(T.of(spark, sf), "flag")


def _rate_sql(digits):
    def t(i, c):
        return (f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, "
                f"AVG(CAST(flag AS DOUBLE)) * 100 AS rate, CAST(COUNT(*) AS BIGINT) AS n "
                f"FROM of WHERE {c} IS NOT NULL GROUP BY {c}")
    body = union_cols(["o_orderstatus", "o_orderpriority"], t)
    return (OF_CTE + f", g AS ({body}) SELECT column_name, value, {r('rate', digits)} AS rate, n, "
            f"CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY {r('rate', digits)} DESC, value) "
            f"AS INTEGER) AS rank FROM g")


@query("rate_by_category", _rate_sql(2))
def rate_by_category(spark, sf):
    return P.rate_by_category(T.of(spark, sf), ["o_orderstatus", "o_orderpriority"], "flag", 2)


@query("rate_by_category_bars", _rate_sql(None))
def rate_by_category_bars(spark, sf):
    return P.rate_by_category(T.of(spark, sf), ["o_orderstatus", "o_orderpriority"], "flag", None)


def trend_sql(table, by, cols):
    def t(i, c):
        return (f"SELECT {by} AS grp, {i + 1} AS step, '{c}' AS column_name, "
                f"ROUND(AVG({dbl(c)}), 2) + 0.0 AS mean FROM {table} GROUP BY {by}")
    return union_cols(cols, t)


@query("group_trend", trend_sql("lineitem", "l_returnflag", T.LI_NUMERIC))
def group_trend(spark, sf):
    return P.group_trend(T.load(spark, sf, "lineitem"), "l_returnflag", T.LI_NUMERIC, 2)


# ---------------------------------------------------------------- correlation
def _corr_sql(src, cols, digits=6):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            x, y = (a, b) if i <= j else (b, a)
            e = f"CORR(CASE WHEN NOT isnan({dbl(x)}) THEN {dbl(x)} END, CASE WHEN NOT isnan({dbl(y)}) THEN {dbl(y)} END)"
            e = f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, {r(e, digits)} AS corr FROM ({src}) _t")
    return " UNION ALL ".join(parts)


@query("corr_matrix", _corr_sql(LI, T.LI_NUMERIC))
def corr_matrix(spark, sf):
    return P.corr_matrix(T.load(spark, sf, "lineitem"), T.LI_NUMERIC)


@query("corr_matrix_nulls", _corr_sql(T.EVN_SQL, ["event_id", "user_id", "value"]))
def corr_matrix_nulls(spark, sf):
    return P.corr_matrix(T.evn(spark, sf), ["event_id", "user_id", "value"])


def _target_corr_sql():
    feats = [c for c in T.OF_NUMERIC if c != "flag"]

    def t(i, c):
        return (f"SELECT '{c}' AS column_name, {i} AS column_idx, "
                f"CORR({dbl(c)}, CAST(flag AS DOUBLE)) AS corr FROM of")
    return (OF_CTE + f", c AS ({union_cols(feats, t)}) SELECT column_name, ROUND(corr, 3) + 0.0 AS corr, "
            "CAST(ROW_NUMBER() OVER (ORDER BY corr DESC NULLS LAST, column_idx) AS INTEGER) AS rank FROM c")


@query("target_corr_ranked", _target_corr_sql())
def target_corr_ranked(spark, sf):
    return P.target_corr_ranked(T.of(spark, sf), T.OF_NUMERIC, "flag", 3)


# ---------------------------------------------------------------- IQR
def outliers_sql(src, cols):
    def t(i, c):
        return (f"SELECT '{c}' AS column_name, {i} AS column_idx, CAST(COUNT(*) FILTER (WHERE "
                f"{dbl(c)} < f.lo OR {dbl(c)} > f.hi) AS BIGINT) AS n_outliers FROM ({src}) _s, "
                f"(SELECT lo, hi FROM fences WHERE column_name = '{c}') f")
    return (f"WITH fences AS ({fences_sql(src, cols)}), o AS ({union_cols(cols, t)}) "
            "SELECT column_name, n_outliers, CAST(ROW_NUMBER() OVER (ORDER BY n_outliers DESC, "
            "column_idx) AS INTEGER) AS rank FROM o")


@query("iqr_outliers", outliers_sql("SELECT * FROM events", ["value", "user_id"]))
def iqr_outliers(spark, sf):
    return P.iqr_outliers(T.load(spark, sf, "events"), ["value", "user_id"])


@query("iqr_outliers_li", outliers_sql(LI, T.LI_NUMERIC))
def iqr_outliers_li(spark, sf):
    return P.iqr_outliers(T.load(spark, sf, "lineitem"), T.LI_NUMERIC)


@query("iqr_anomaly_flag", f"WITH fences AS ({fences_sql('SELECT * FROM events', ['value'])}) "
       "SELECT event_id, CAST(COALESCE(value < f.lo OR value > f.hi, false) AS INTEGER) AS is_anomaly "
       "FROM events, fences f")
def iqr_anomaly_flag(spark, sf):
    e = T.load(spark, sf, "events").select("event_id", "value")
    return P.iqr_anomaly_flag(e, ["value"]).select("event_id", "is_anomaly")


# ---------------------------------------------------------------- KPIs
_KPI_SRC = (f"WITH of AS ({T.OF_SQL}), fences AS ({fences_sql('SELECT * FROM of', ['o_totalprice'])}), "
            "ofa AS (SELECT of.*, CAST(COALESCE(o_totalprice < f.lo OR o_totalprice > f.hi, false) "
            "AS INTEGER) AS is_anomaly FROM of, fences f) ")


@query("kpi_overview", _KPI_SRC + (
    "SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_cols, "
    "CAST(COUNT(*) FILTER (WHERE flag = 1) AS BIGINT) AS n_class, "
    "ROUND(COUNT(*) FILTER (WHERE flag = 1) / COUNT(*) * 100, 1) + 0.0 AS class_pct, "
    "ROUND((COUNT(*) - COUNT(*) FILTER (WHERE flag = 1)) / COUNT(*) * 100, 1) + 0.0 AS other_pct, "
    "ROUND(AVG(CAST(is_anomaly AS DOUBLE)) * 100, 1) + 0.0 AS flagged_rate, "
    "CAST(SUM(is_anomaly) AS BIGINT) AS n_flagged, "
    "100.0 - (ROUND(AVG(CAST(is_anomaly AS DOUBLE)) * 100, 1) + 0.0) AS clean_rate FROM ofa"))
def kpi_overview(spark, sf):
    df = P.iqr_anomaly_flag(T.of(spark, sf), ["o_totalprice"])
    return P.kpi_overview(df, "flag", "is_anomaly")


KPI_FEATURES = {"n_lines": 1, "sum_qty": 2, "o_totalprice": 2}


def _cvo_sql():
    def t(i, c):
        d = KPI_FEATURES[c]
        return (f"SELECT '{c}' AS feature, {r(f'AVG(CASE WHEN flag = 1 THEN {dbl(c)} END)', d)} AS class_mean, "
                f"{r(f'AVG({dbl(c)})', d)} AS overall_mean FROM of")
    return union_cols(list(KPI_FEATURES), t)


@query("class_vs_overall_mean", OF_CTE + _cvo_sql())
def class_vs_overall_mean(spark, sf):
    return P.class_vs_overall_mean(T.of(spark, sf), "flag", KPI_FEATURES)


INSIGHT_CONDITIONAL = ["n_lines", "o_totalprice"]


@query("insights", _KPI_SRC + (
    f", m AS ({_cvo_sql().replace('FROM of', 'FROM ofa')}) SELECT feature AS topic, "
    "printf('Rows with flag = 1 average %s %s, against %s overall.', "
    "CAST(class_mean AS VARCHAR), feature, CAST(overall_mean AS VARCHAR)) AS sentence FROM m "
    "WHERE feature NOT IN ('n_lines', 'o_totalprice') OR class_mean > overall_mean "
    "UNION ALL SELECT 'class_share' AS topic, "
    "printf('%s%% of the %s rows have flag = 1.', CAST(ROUND(COUNT(*) FILTER (WHERE flag = 1) / COUNT(*) * 100, 1) + 0.0 "
    "AS VARCHAR), format('{:,}', COUNT(*))) AS sentence FROM ofa "
    "UNION ALL SELECT 'flagged' AS topic, printf('%s rows (%s%%) are flagged by the IQR rule.', "
    "format('{:,}', SUM(is_anomaly)), CAST(ROUND(AVG(CAST(is_anomaly AS DOUBLE)) * 100, 1) + 0.0 AS VARCHAR)) "
    "AS sentence FROM ofa"))
def insights(spark, sf):
    df = P.iqr_anomaly_flag(T.of(spark, sf), ["o_totalprice"])
    return P.insights(df, "flag", KPI_FEATURES, conditional=INSIGHT_CONDITIONAL, flag="is_anomaly")
