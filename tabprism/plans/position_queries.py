"""Positional keys: P7–P14."""

from __future__ import annotations


from tabprism.operators import sampling as S
from tabprism.operators.positions import row_index
from tabprism.plans import tables as T
from tabprism.plans.registry import query

ORD_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _orders(spark, sf):
    return T.load(spark, sf, "orders").select(*[c.strip() for c in ORD_COLS.split(",")])


@query("row_index", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def row_index_q(spark, sf):
    return row_index(T.load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("train_test_split", "SELECT o_orderkey, pos, CASE WHEN pos < CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) "
       "AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM (SELECT o_orderkey, "
       "ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos, COUNT(*) OVER () AS n FROM orders) t")
def train_test_split(spark, sf):
    return S.split_labels(T.load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def _page_sql(page):
    return (f"WITH p AS (SELECT {ORD_COLS}, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), "
            "n AS (SELECT COUNT(*) AS n, GREATEST(1, CAST(CEIL(COUNT(*) / 50.0) AS BIGINT)) AS pages FROM orders), "
            f"c AS (SELECT GREATEST(1, LEAST({page}, pages)) AS page FROM n) "
            "SELECT p.* FROM p, c WHERE pos >= (page - 1) * 50 AND pos < page * 50")


@query("page_slice", _page_sql(3))
def page_slice(spark, sf):
    return S.page_slice(_orders(spark, sf), "o_orderkey", 3)


@query("page_slice_deep", _page_sql(250))
def page_slice_deep(spark, sf):
    return S.page_slice(_orders(spark, sf), "o_orderkey", 250)


@query("page_slice_clamped", _page_sql(1))
def page_slice_clamped(spark, sf):
    """A page given as text that is not an integer falls back to page 1."""
    return S.page_slice(_orders(spark, sf), "o_orderkey", "abc")


@query("page_slice_materialized", _page_sql(250))
def page_slice_materialized(spark, sf):
    """P8 served from a numbered table materialised once in the shared folder."""
    from tabprism.sources.scratch import scratch_path
    numbered = S.materialize_positions(_orders(spark, sf), "o_orderkey", scratch_path(spark, "orders-pos"))
    return S.page_from_positions(numbered, 250)


@query("page_index", "WITH n AS (SELECT COUNT(*) AS n, GREATEST(1, CAST(CEIL(COUNT(*) / 50.0) AS BIGINT)) "
       "AS pages FROM orders) SELECT page, CASE WHEN n > 0 THEN (page - 1) * 50 + 1 ELSE 0 END AS first_row, "
       "CAST(LEAST(page * 50, n) AS BIGINT) AS last_row, page > 1 AS has_prev, page < pages AS has_next, "
       "CAST(n AS BIGINT) AS total_rows, CAST(pages AS BIGINT) AS total_pages "
       "FROM n, range(1, pages + 1) r(page)")
def page_index(spark, sf):
    return S.page_index(T.load(spark, sf, "orders"), 50)


def _sample_sql(src, key, n, cols):
    return (f"SELECT {cols} FROM ({src}) s ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key} LIMIT {n}")


@query("random_sample", _sample_sql("SELECT * FROM orders", "o_orderkey", 10, ORD_COLS))
def random_sample(spark, sf):
    return S.seeded_sample(_orders(spark, sf), "o_orderkey", 10, seed=42)


LI_ALL = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
          "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
LI_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LI_HASH = "md5('42:' || " + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in LI_KEYS) + ")"
#: 2,000 lineitem rows in hash order of their keys; equal keys are ordered by all columns.
LI_SAMPLE_SQL = (f"SELECT ROW_NUMBER() OVER (ORDER BY {_LI_HASH}, {LI_ALL}) - 1 AS pos, {LI_ALL} FROM lineitem "
                 "QUALIFY pos < 2000")


@query("pair_sample", LI_SAMPLE_SQL)
def pair_sample(spark, sf):
    li = T.load(spark, sf, "lineitem")
    return S.numbered_sample(li, LI_KEYS, 2000, seed=42, ties=li.columns).select("pos", *li.columns)


@query("linspace_sample", (
    "WITH p AS (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos, "
    "COUNT(*) OVER () AS n FROM orders), k AS (SELECT LEAST(200, COUNT(*)) AS k, COUNT(*) AS n FROM orders), "
    "idx AS (SELECT i AS sample_idx, CASE WHEN i = k - 1 THEN n - 1 ELSE CAST(FLOOR(i * ((n - 1) / (k - 1))) "
    "AS BIGINT) END AS p FROM k, range(0, k) r(i)) "
    "SELECT o_orderkey, o_totalprice, pos, sample_idx FROM p JOIN idx ON pos = idx.p"))
def linspace_sample(spark, sf):
    numbered = row_index(T.load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return S.linspace_sample(numbered, 200)


@query("preview_orders", f"SELECT {ORD_COLS} FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_orders(spark, sf):
    return S.preview(_orders(spark, sf), "o_orderkey", 10)
