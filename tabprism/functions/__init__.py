"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from tabprism.functions.expressions import (  # noqa: F401
    clip, nan_to_null, pair_corr, rnd, sigmoid, to_double,
)
from tabprism.functions.columns import (  # noqa: F401
    exclude_columns, numeric_columns, present,
)
