"""Property checks of the distributed primitives against plain Python."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabprism.operators.positions import row_index
from tabprism.operators.quantiles import quantiles

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e3, 1e3, allow_nan=False)),
                  min_size=0, max_size=60)


@settings(max_examples=12, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, parts=st.integers(1, 5))
def test_rank_quantiles_equal_numpy(spark, vals, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double").repartition(parts)
    got = quantiles(df, ["x"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}, method="rank").first()
    xs = np.array([v for v in vals if v is not None])
    for k, p in {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}.items():
        if len(xs) == 0:
            assert got[k] is None
        else:
            assert abs(got[k] - float(np.quantile(xs, p))) <= 1e-9 * max(1.0, abs(float(np.quantile(xs, p))))


@settings(max_examples=10, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(-10**12, 10**12), unique=True, max_size=80), parts=st.integers(1, 6))
def test_row_index_is_a_permutation_in_key_order(spark, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    out, n = row_index(df, "k", num_partitions=parts, with_count=True)
    got = sorted((r["pos"], r["k"]) for r in out.collect())
    assert n == len(keys) and got == list(enumerate(sorted(keys)))
