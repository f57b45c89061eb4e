"""Reject capture: split parsed rows into good rows and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_rejects(df: DataFrame, required: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``required`` maps a parsed column to the reason used when it is NULL.
    Returns (good, rejects); rejects carry ``reject_reason`` (first failing
    column in the given order).  Both come from the same lazily planned input."""
    reason = None
    for c, why in required.items():
        reason = (F.when(F.col(c).isNull(), F.lit(why)) if reason is None
                  else reason.when(F.col(c).isNull(), F.lit(why)))
    tagged = df.withColumn("reject_reason", reason)
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.where(F.col("reject_reason").isNotNull())
    return good, bad
