"""Input tables and derived fixtures, in Spark and in DuckDB SQL (same definitions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprism.sources.tables import read_table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# ---------------------------------------------------------------- EVN
def evn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with NULLs injected identically in both engines."""
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        "event_type",
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))


EVN_SQL = ("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id, "
           "event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")


# ---------------------------------------------------------------- OF
def of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to their lineitem aggregates, plus a 0/1 class ``flag``."""
    li = load(spark, sf_dir, "lineitem")
    a = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.round(F.avg("l_tax"), 6).alias("avg_tax"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    j = o.join(a, o.o_orderkey == a.l_orderkey)
    return j.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                    "n_lines", "sum_qty", "avg_discount", "avg_tax", "sum_price",
                    F.when(F.col("sum_price") > 200000, 1).otherwise(0).alias("flag"))


OF_SQL = ("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, n_lines, sum_qty, "
          "avg_discount, avg_tax, sum_price, CASE WHEN sum_price > 200000 THEN 1 ELSE 0 END AS flag "
          "FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS n_lines, SUM(l_quantity) AS sum_qty, "
          "ROUND(AVG(l_discount), 6) AS avg_discount, ROUND(AVG(l_tax), 6) AS avg_tax, "
          "ROUND(SUM(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY l_orderkey) a "
          "ON o_orderkey = l_orderkey")

#: fixed role mapping of the fixtures (FIXTURES.md)
LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
OF_FEATURES = ["sum_qty", "n_lines", "avg_discount", "avg_tax"]
OF_NUMERIC = ["o_totalprice", "n_lines", "sum_qty", "avg_discount", "avg_tax", "sum_price"]


def with_cte(body: str, **ctes: str) -> str:
    """Prefix ``body`` with WITH name AS (sql), ..."""
    if not ctes:
        return body
    parts = ", ".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {parts} {body}"
