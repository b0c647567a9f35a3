"""Every registered key against its DuckDB SQL (sf0.001 here; the driver uses sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

SF = os.environ.get("TABPRISM_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_all_keys_match_oracle(spark):
    import oracle_check
    res = oracle_check.compare(spark, SF)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS-ONLY")}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns[0] == "column_name"
    # every key of the library's own operators has an exact oracle
    from tabprism.plans import registry
    assert set(registry.ORACLE) == set(registry.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
