"""Registered queries: each key pairs a Spark plan with equivalent DuckDB SQL.

Importing this package fills ``registry.QUERIES`` and ``registry.ORACLE``.
"""

from tabprism.plans import registry  # noqa: F401
from tabprism.plans import (  # noqa: F401
    profile_queries, clean_queries, position_queries, feature_queries,
    chart_queries, model_queries, missing_queries,
)
