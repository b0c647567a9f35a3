"""Small expression builders shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int) -> Column:
    """Round half-up to ``digits`` places; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(_c(x), digits) + F.lit(0.0)


def nan_to_null(x) -> Column:
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(x) -> Column:
    """Coerce to double; text that is not a number becomes NULL, as does NaN.

    ``try_cast`` is required: with ANSI mode on a plain cast raises.
    """
    c = _c(x).try_cast("double")
    return nan_to_null(c)


#: Decimal numbers with an optional exponent, and the infinities: what pandas reads as a number.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def text_to_double(x) -> Column:
    """As ``to_double`` for text: forms that only Java reads as numbers (``1d``, ``0x1p3``) are missing."""
    c = _c(x)
    return F.when(c.rlike(NUMBER), to_double(c))


def clip(x, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]; a missing value stays missing (``least`` and ``greatest`` alone would skip it)."""
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def pair_corr(a, b) -> Column:
    """Pearson correlation over rows where both sides are present (NULL/NaN skipped).

    NULL when either side is constant: ``try_divide`` instead of the ``corr``
    aggregate, which raises on a zero variance under ANSI mode.
    """
    x, y = nan_to_null(_c(a).cast("double")), nan_to_null(_c(b).cast("double"))
    both = x.isNotNull() & y.isNotNull()
    xa, ya = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xa, ya), F.stddev_pop(xa) * F.stddev_pop(ya))
