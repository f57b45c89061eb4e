"""Projection, schema adaptation, filters and the row funnel."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Accepted spellings of the target columns, first present wins.
TURBIDITY_ALIASES = ["turbidez", "Turbidez", "turbidity"]
CHLOROPHYLL_ALIASES = ["clorofila", "Clorofila", "clorofila_a", "Clorofila_a", "chlorophyll"]
# the tuner knows fewer spellings
TUNER_TURBIDITY_ALIASES = ["turbidez", "Turbidez"]
TUNER_CHLOROPHYLL_ALIASES = ["clorofila", "Clorofila"]


def project(df: DataFrame, columns) -> DataFrame:
    """Keep exactly ``columns`` in that order; a missing column is an error."""
    require_columns(df, columns)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def require_columns(df: DataFrame, columns) -> None:
    """Raise ValueError before planning when a required column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def resolve_alias(df: DataFrame, aliases) -> str | None:
    """First alias present in ``df`` (schema lookup only, no data read)."""
    for a in aliases:
        if a in df.columns:
            return a
    return None


def detect_targets(df: DataFrame, alias_lists=(TURBIDITY_ALIASES, CHLOROPHYLL_ALIASES)) -> list[str]:
    """Target columns present in ``df``, one per alias list (warns on none)."""
    found = []
    for aliases in alias_lists:
        c = resolve_alias(df, aliases)
        if c is None:
            log.warning("no column among %s", aliases)
        else:
            found.append(c)
    return found


def present_features(df: DataFrame, features) -> list[str]:
    """Feature list restricted to columns that exist (warns about the rest).
    Returns a new list; the caller's list is not mutated."""
    have = [c for c in features if c in df.columns]
    missing = [c for c in features if c not in df.columns]
    if missing:
        log.warning("missing feature columns: %s", missing)
    return have


def threshold_filter(df: DataFrame, column: str, threshold: float, required: bool = True) -> DataFrame:
    """Keep rows with ``column <= threshold`` (NULL removed).  When the column
    is absent: error if ``required`` else the input unchanged."""
    if column not in df.columns:
        if required:
            raise ValueError(f"column {column!r} not found")
        log.warning("%s not found, skipping threshold filter", column)
        return df
    return df.where(F.col(column) <= threshold)


def drop_null_any(df: DataFrame, subset) -> DataFrame:
    """Drop rows with a NULL in any ``subset`` column."""
    return df.na.drop(how="any", subset=list(subset))


def drop_null_all(df: DataFrame, subset) -> DataFrame:
    """Drop rows whose ``subset`` columns are all NULL."""
    return df.na.drop(how="all", subset=list(subset))


def geo_range(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Keep valid coordinates: lat in [-90, 90] and lon in [-180, 180]; NULL removed."""
    return df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def fill_null(df: DataFrame, value, subset=None) -> DataFrame:
    """Replace NULL by a constant (e.g. 0 in an importance matrix)."""
    return df.na.fill(value, subset=list(subset) if subset else None)


def canonical_order(df: DataFrame, keys) -> DataFrame:
    """Key columns first, the rest sorted by code point."""
    rest = sorted(c for c in df.columns if c not in keys)
    return df.select(*[F.col(f"`{c}`") for c in [*keys, *rest]])


def rename_with_units(df: DataFrame, columns, unit: str) -> DataFrame:
    """'Actual' -> 'Actual (NTU)' for each named column."""
    return df.withColumnsRenamed({c: f"{c} ({unit})" for c in columns})


def row_funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cumulative predicate, in one pass.

    ``steps`` is [(name, predicate)]; predicate i applies on top of 1..i-1.
    Returns (step_no, step, rows_before, rows_after, removed, pct_removed).
    """
    aggs = [F.count(F.lit(1)).alias("c0")]
    acc = F.lit(True)
    for i, (_, pred) in enumerate(steps, start=1):
        acc = acc & F.coalesce(pred, F.lit(False))
        aggs.append(F.count_if(acc).alias(f"c{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                 F.col(f"c{i - 1}").alias("rows_before"), F.col(f"c{i}").alias("rows_after"))
        for i, (name, _) in enumerate(steps, start=1)])).alias("s")).select("s.*")
    removed = F.col("rows_before") - F.col("rows_after")
    return long.select("*", removed.alias("removed"),
                       F.try_divide(removed * 100.0, F.col("rows_before")).alias("pct_removed"))
