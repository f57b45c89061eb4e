"""Sorts, top-k, cumulative shares and arg-max selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_number


def top_k(df: DataFrame, k: int, order_by) -> DataFrame:
    """Global top-k (plans as TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order_by).limit(k)


def top_k_per_group(df: DataFrame, k: int, group_by, order_by, rank_col: str = "rank",
                    salt_buckets: int = 16) -> DataFrame:
    """Top-k rows per group with their rank.

    Two stages so that a hot group never sorts in one task: rank inside
    (group, salt) slices and keep k per slice, then rank the <= k*salt
    survivors of each group.  ``order_by`` must be a total order.
    """
    group_by = list(group_by)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salt_buckets))
    s = df.withColumn("_hl_salt", salt)
    w1 = Window.partitionBy(*group_by, "_hl_salt").orderBy(*order_by)
    s = s.withColumn("_hl_r", F.row_number().over(w1)).where(F.col("_hl_r") <= k)
    w2 = Window.partitionBy(*group_by).orderBy(*order_by)
    return (s.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
            .drop("_hl_salt", "_hl_r"))


def cumulative_share(df: DataFrame, value: str, order_by, group_by=(), out: str = "cumulative") -> DataFrame:
    """Running sum of ``value`` in ``order_by`` order divided by the group total.

    For ranked feature lists (one row per feature): windows here are bounded
    by the number of features per group.
    """
    group_by = list(group_by)
    w = Window.partitionBy(*group_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*group_by)
    return df.withColumn(out, F.try_divide(F.sum(value).over(w), F.sum(value).over(tot)))


def cumulative_cut(df: DataFrame, value: str, order_by, group_by=(), threshold: float = 0.95,
                   min_keep: int = 5) -> DataFrame:
    """Keep rows whose cumulative share is <= ``threshold`` (the row that
    crosses is excluded; the test is row-wise, so negative values can make
    later rows qualify again).  If fewer than ``min_keep`` rows qualify, the
    first ``min_keep`` rows in order are kept instead.  Adds ``cumulative``
    and the 1-based ``position`` in order."""
    group_by = list(group_by)
    c = cumulative_share(df, value, order_by, group_by)
    w = Window.partitionBy(*group_by).orderBy(*order_by)
    c = c.withColumn("position", F.row_number().over(w).cast("long"))
    sel = F.coalesce(F.col("cumulative") <= threshold, F.lit(False))
    c = c.withColumn("_hl_nsel", F.sum(sel.cast("int")).over(Window.partitionBy(*group_by)))
    keep = F.when(F.col("_hl_nsel") < min_keep, F.col("position") <= min_keep).otherwise(sel)
    return c.where(keep).drop("_hl_nsel")


def best_by(df: DataFrame, group_by, pick: str, score: str, out: str | None = None) -> DataFrame:
    """Arg-max: the ``pick`` value with the highest ``score`` per group.  A best
    value has a name and a score, so rows where either is NULL don't compete
    (a group without any other row keeps its row, with NULLs); equal scores go
    to the first name in order."""
    valid = F.col(pick).isNotNull() & F.col(score).isNotNull()
    best = F.min(F.when(valid, F.struct((-F.col(score)).alias("s"), F.col(pick).alias("p"))))
    return (df.groupBy(*group_by).agg(best.alias("_hl_best"))
            .select(*group_by, F.col("_hl_best.p").alias(out or f"best_{pick}"),
                    (-F.col("_hl_best.s")).alias(f"best_{score}")))


def sorted_pairs(df: DataFrame, actual: str, key: str, group_by=(), rank_col: str = "position") -> DataFrame:
    """Rows ordered by ``actual`` (``key`` breaks ties) with a 1-based
    position per group: the x axis of a sorted actual-vs-predicted plot.
    Distributed ranking, so a model with most of the rows is not one task."""
    return row_number(df, [actual, key], rank_col, group_by=list(group_by))
