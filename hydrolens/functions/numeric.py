"""Numeric cleaning: lenient casts, NaN -> NULL, numpy-style rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double_lenient(c) -> Column:
    """Text -> DOUBLE: trims, accepts a decimal comma ('2,14'), zero padding
    ('0004.46'); anything else -> NULL (never raises under ANSI mode): no
    type suffixes, no NaN or Infinity in words."""
    t = F.replace(F.trim(_c(c).cast("string")), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
