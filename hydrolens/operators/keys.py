"""Joins on group keys where NULL is a key value like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left`` with ``right``'s other columns; null-safe equality on ``keys``
    (still an equi join: Spark hashes both sides).  Without keys, ``right``
    is one row of fitted scalars, which are fetched and put into the plan."""
    keys = list(keys)
    if not keys:
        row = right.first()
        return left.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType)
                                 for f in right.schema.fields})
    r = right.withColumnsRenamed({k: f"_hl_key{i}" for i, k in enumerate(keys)})
    cond = [left[k].eqNullSafe(r[f"_hl_key{i}"]) for i, k in enumerate(keys)]
    return left.join(r, cond, how).drop(*[f"_hl_key{i}" for i in range(len(keys))])
