"""Plan shape: pruning, pushdown, no single-task window or cartesian product over big inputs."""

import os

import pytest
from pyspark.sql import functions as F

from tabprism.operators import chartdata as V
from tabprism.operators import profile as P
from tabprism.operators.positions import row_index

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_describe_prunes_columns_and_pushes_filters(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_returnflag") == "A")
    p = plan(P.describe(li, ["l_quantity"], quantile_method="percentile"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in p
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,A)]" in p


def test_quantiles_reduce_rows_to_counted_values_first(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert "percentile(" not in plan(P.describe(li, ["l_quantity"]))
    p = plan(P.describe(li, ["l_quantity"], quantile_method="percentile"))
    assert "partial_count" in p and "percentile(_v" in p


def test_row_index_has_no_global_window_over_data(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(row_index(o, "o_orderkey"))
    # the only window runs over one row per partition (the per-partition counts)
    assert p.count("Window ") <= 1
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_kde_has_no_cartesian_product(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    p = plan(V.kde_curve(e, "value"))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_one_aggregate_for_all_missing_counts(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    p = plan(P.missing_counts(e))
    assert p.count("HashAggregate") <= 2      # partial + final of ONE aggregate


def test_materialized_pages_push_the_position_filter(spark):
    from tabprism.operators import sampling as S
    from tabprism.sources.scratch import scratch_path
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    numbered = S.materialize_positions(o, "o_orderkey", scratch_path(spark, "pos"))
    page = S.page_from_positions(numbered, 3)
    assert sorted(r["pos"] for r in page.collect()) == list(range(100, 150))
    assert "GreaterThanOrEqual(pos,100)" in plan(page) and "LessThan(pos,150)" in plan(page)
