"""Cleaning keys: C1–C6."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprism.operators import clean as C
from tabprism.operators.sampling import split_labels
from tabprism.plans import tables as T
from tabprism.plans.registry import query

EVN_CTE = f"WITH evn AS ({T.EVN_SQL}) "


@query("median_impute", EVN_CTE + (
    ", med AS (SELECT QUANTILE_CONT(CAST(user_id AS DOUBLE), 0.5) AS mu, "
    "QUANTILE_CONT(value, 0.5) AS mv FROM evn) "
    "SELECT event_id, COALESCE(CAST(user_id AS DOUBLE), mu) AS user_id, event_type, "
    "CASE WHEN value IS NULL OR isnan(value) THEN mv ELSE value END AS value FROM evn, med"))
def median_impute(spark, sf):
    # 'missing_col' is listed but absent: skipped, as the reference skips absent columns
    return C.median_impute(T.evn(spark, sf), ["user_id", "value", "missing_col"])


@query("dedupe_keep_first", "SELECT doc_id, text, lang, source, n_chars FROM documents "
       "QUALIFY ROW_NUMBER() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_keep_first(spark, sf):
    return C.dedupe_keep_first(T.load(spark, sf, "documents"), ["text"], ["doc_id"])


@query("dedupe_dropped", "SELECT CAST(COUNT(*) - COUNT(DISTINCT text) AS BIGINT) AS n_dropped FROM documents")
def dedupe_dropped(spark, sf):
    return C.dedupe_dropped(T.load(spark, sf, "documents"), ["text"])


@query("coerce_numeric", "SELECT event_id, TRY_CAST(props AS DOUBLE) AS props, "
       "TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, "
       "TRY_CAST(event_type AS DOUBLE) AS event_type, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value "
       "FROM events")
def coerce_numeric(spark, sf):
    e = T.load(spark, sf, "events").select(
        "event_id", "props", F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        "event_type", F.col("value").cast("string").alias("value"))
    return C.coerce_numeric(e, ["props", "k", "event_type", "value"])


@query("dropna_any", EVN_CTE + "SELECT user_id, value FROM evn WHERE user_id IS NOT NULL "
       "AND value IS NOT NULL AND NOT isnan(value)")
def dropna_any(spark, sf):
    return C.dropna_any(T.evn(spark, sf), ["user_id", "value"])


@query("dropna_subset", EVN_CTE + "SELECT * FROM evn WHERE value IS NOT NULL AND NOT isnan(value)")
def dropna_subset(spark, sf):
    return C.dropna_subset(T.evn(spark, sf), ["value"])


@query("impute_train_median", EVN_CTE + (
    ", pos AS (SELECT *, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS pos, COUNT(*) OVER () AS n FROM evn), "
    "lab AS (SELECT *, CASE WHEN pos < CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train' "
    "ELSE 'test' END AS split FROM pos), "
    "med AS (SELECT QUANTILE_CONT(CAST(user_id AS DOUBLE), 0.5) AS mu, QUANTILE_CONT(value, 0.5) AS mv "
    "FROM lab WHERE split = 'train') "
    "SELECT event_id, split, COALESCE(CAST(user_id AS DOUBLE), mu) AS user_id, "
    "COALESCE(value, mv) AS value FROM lab, med"))
def impute_train_median(spark, sf):
    lab = split_labels(T.evn(spark, sf), "event_id")
    med = C.fit_medians(lab.where(F.col("split") == "train"), ["user_id", "value"])
    return C.apply_medians(lab, med).select("event_id", "split", "user_id", "value")
