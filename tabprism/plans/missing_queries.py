"""Keys on inputs with gaps: the same operators where values are NULL in some rows and NaN in others.

Both count as missing, so the SQL sides run on a table that has NULL in both places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprism.operators import features as FE
from tabprism.operators import profile as P
from tabprism.operators import scoring as SC
from tabprism.operators.models import LogisticParams
from tabprism.plans import tables as T
from tabprism.plans.feature_queries import params_sql, scale_sql
from tabprism.plans.model_queries import FIXED_COEF, FIXED_INTERCEPT, LOGR_FEATS
from tabprism.plans.profile_queries import outliers_sql, trend_sql
from tabprism.plans.registry import query
from tabprism.plans.sqlgen import describe_sql
from tabprism.sources.csv import NA_TOKENS, read_csv, write_csv
from tabprism.sources.scratch import scratch_path

GAP_COLS = ["user_id", "value"]
NAN = float("nan")


def _events(spark, sf):
    """events whose measures are NULL in some rows and NaN in others."""
    key = F.col("event_id")
    return T.load(spark, sf, "events").select(
        "event_id", "event_type", F.when(key % 11 == 0, F.lit(None)).when(key % 6 == 1, F.lit(NAN)).otherwise(F.col("user_id").cast("double")).alias("user_id"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 1, F.lit(NAN)).otherwise(F.col("value")).alias("value"))


EVENTS_SQL = ("SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 OR event_id % 6 = 1 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS user_id, "
              "CASE WHEN event_id % 7 = 0 OR event_id % 5 = 1 THEN NULL ELSE value END AS value FROM events")
GAPS = f"WITH gaps AS ({EVENTS_SQL}) "


def _with_gaps(sql: str) -> str:
    """``sql`` over the table ``gaps``."""
    return GAPS + (", " + sql[5:] if sql.startswith("WITH ") else sql)


@query("describe_nan", _with_gaps(describe_sql("SELECT * FROM gaps", GAP_COLS, 4, skew=True)))
def describe_nan(spark, sf):
    return P.describe(_events(spark, sf), GAP_COLS, digits=4, skew=True)


@query("iqr_outliers_nan", _with_gaps(outliers_sql("SELECT * FROM gaps", GAP_COLS)))
def iqr_outliers_nan(spark, sf):
    return P.iqr_outliers(_events(spark, sf), GAP_COLS)


@query("minmax_scale_nan", _with_gaps(scale_sql("minmax", GAP_COLS, ["event_id", "event_type"], "gaps")))
def minmax_scale_nan(spark, sf):
    return FE.minmax_scale(_events(spark, sf), GAP_COLS)


@query("standard_params_nan", _with_gaps(params_sql("standard", GAP_COLS, ["event_id", "event_type"], "gaps")))
def standard_params_nan(spark, sf):
    return FE.standard_params(_events(spark, sf), GAP_COLS)


@query("group_trend_nan", _with_gaps(trend_sql("gaps", "event_type", GAP_COLS)))
def group_trend_nan(spark, sf):
    return P.group_trend(_events(spark, sf), "event_type", GAP_COLS, 2)


# orders with gaps in two of the model's inputs; both count as 0 in a score
_SCORE_Z = " + ".join([repr(FIXED_INTERCEPT)] + [f"{w!r} * CAST({c} AS DOUBLE)" for c, w in zip(LOGR_FEATS, FIXED_COEF)])


@query("score_logistic_missing", f"WITH g AS (SELECT o_orderkey, o_totalprice / 1e5 AS o_totalprice, n_lines, "
       "CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 1 THEN 0.0 ELSE sum_qty / 100 END AS sum_qty, "
       f"CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE avg_discount END AS avg_discount, avg_tax FROM ({T.OF_SQL}) o), "
       f"p AS (SELECT o_orderkey, 1 / (1 + EXP(-LEAST(GREATEST({_SCORE_Z}, -500.0), 500.0))) AS p FROM g) "
       "SELECT o_orderkey, ROUND(p * 100, 1) + 0.0 AS probability, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, "
       f"CASE WHEN p >= 0.5 THEN '{SC.POSITIVE_LABEL}' ELSE '{SC.NEGATIVE_LABEL}' END AS label FROM p")
def score_logistic_missing(spark, sf):
    """M20 on rows whose inputs are NULL or NaN."""
    key = F.col("o_orderkey")
    of = T.of(spark, sf).withColumns({
        "o_totalprice": F.col("o_totalprice") / 1e5,
        "sum_qty": F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 1, F.lit(NAN)).otherwise(F.col("sum_qty") / 100),
        "avg_discount": F.when(key % 3 == 0, F.lit(NAN)).otherwise(F.col("avg_discount"))})
    return SC.score_logistic(of, LogisticParams(LOGR_FEATS, FIXED_COEF, FIXED_INTERCEPT)).select(
        "o_orderkey", "probability", "prediction", "label")


_NA_LIST = ", ".join("'" + t + "'" for t in NA_TOKENS)


def _csv_text(c: str) -> str:
    return f"CASE WHEN {c} IN ({_NA_LIST}) THEN NULL ELSE {c} END AS {c}"


@query("csv_documents_roundtrip", f"SELECT doc_id, {_csv_text('text')}, {_csv_text('lang')}, {_csv_text('source')}, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def csv_documents_roundtrip(spark, sf):
    """A1/A3: texts with quotes, commas and line breaks, written as CSV parts and read back."""
    docs = T.load(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return read_csv(spark, write_csv(docs, scratch_path(spark, "documents-csv")), multi_line=True)


# The line numbers of an order in the driver tables, in numeric order; the first is the reference level.
LINE_NUMBERS = [1, 2, 3, 4, 5, 6, 7]


@query("one_hot_numeric", "SELECT l_orderkey, l_quantity, " + ", ".join(
    f"CAST(COALESCE(l_linenumber = {x}, false) AS INTEGER) AS \"l_linenumber_{x}\"" for x in LINE_NUMBERS[1:]) + " FROM lineitem")
def one_hot_numeric(spark, sf):
    """F8 on a numeric category: levels in numeric order."""
    return FE.one_hot(T.load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber"), ["l_linenumber"])
