"""Reshaping: run ids, the last-run long->wide pivot, pivot+fill, unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordered import RANGE, n_ranges, previous_row, range_bounds, row_number, running_sum


def _key_changed(df: DataFrame, keys, suffix="_prev") -> F.Column:
    ch = None
    for k in keys:
        t = ~F.col(k).eqNullSafe(F.col(k + suffix))
        ch = t if ch is None else ch | t
    return ch


#: a pivot makes a column (or two) of every label
MAX_LABELS = 2000


def distinct_labels(df: DataFrame, column: str) -> list:
    """Sorted distinct non-NULL labels that become columns; an error when
    there are more than ``MAX_LABELS``, so none is dropped without a word."""
    got = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_LABELS + 1).collect()]
    if len(got) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} distinct values of {column} to pivot")
    return sorted(got)


def run_ids(df: DataFrame, keys, order: str, out: str = "run_id") -> DataFrame:
    """Number contiguous runs of equal ``keys`` in ``order`` order (1-based).

    A new run starts whenever any key differs from the previous row's.
    Distributed: previous-row values and the running count come from
    range partitions plus a per-partition offset table.
    """
    bounds = range_bounds(df, order, n_ranges(df))  # fitted once for both steps
    p = previous_row(df, keys, [order], bounds=bounds)
    p = p.withColumn("_hl_start", F.when(_key_changed(p, keys), 1).otherwise(0))
    r = running_sum(p, "_hl_start", [order], out, bounds=bounds)
    return r.drop("_hl_start", *[k + "_prev" for k in keys])


def pivot_last_run(df: DataFrame, keys, order: str, parameter: str, value: str, unit: str,
                   parameters=None, unit_suffix: str = "_UN") -> DataFrame:
    """Long -> wide, one row per key, with the field script's replacement rule.

    Rows are read in ``order``; a run is a maximal stretch of rows with the
    same ``keys``.  A later run of a key replaces the whole earlier row, so
    only each key's *last* run counts; inside it the last value (and unit)
    per parameter wins, NULLs included.  Output columns: keys, then
    ``<param>`` and ``<param>_UN`` sorted by code point, for every parameter
    met in the data (or the ``parameters`` asked for).  Rows without a
    parameter keep their key's row but fill no column.

    Scale: one pass over the rows.  Each range of the order is reduced to states,
    one per (range, key, label): whether a run of the key starts in the range,
    and the last value and unit since that start (since the range's begin, if
    none).  States merge by range number -- a later start replaces what came
    before, otherwise later values lie over earlier ones -- so only states are
    shuffled by key, at most one per range, key and label, and no row is joined
    back.
    """
    keys = list(keys)
    p = previous_row(df, keys, [order], keep_range=True)
    local = Window.partitionBy(RANGE, *keys)  # the rows of a range lie together already
    start = F.max(F.when(_key_changed(p, keys), F.col(order))).over(local)
    p = p.withColumn("_hl_start", start)
    live = F.col("_hl_start").isNull() | (F.col(order) >= F.col("_hl_start"))
    last = F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col(unit).alias("u"))
    states = p.groupBy(RANGE, *keys, F.col(parameter).alias("_hl_label")).agg(
        F.max("_hl_start").alias("_hl_start"), F.max_by(F.when(live, last), F.when(live, F.col(order))).alias("_hl_last"))
    states = stored(states, "run-states")
    newest = F.max(F.when(F.col("_hl_start").isNotNull(), F.col(RANGE))).over(Window.partitionBy(*keys))
    alive = states.withColumn("_hl_newest", newest).where(F.col(RANGE) >= F.coalesce("_hl_newest", F.lit(-1)))
    parameters = list(parameters) if parameters is not None else distinct_labels(states, "_hl_label")
    hit = [F.max_by(F.when(F.col("_hl_label") == prm, F.col("_hl_last")),
                    F.when(F.col("_hl_label") == prm, F.col("_hl_last.o"))).alias(f"_hl_c{i}")
           for i, prm in enumerate(parameters)]
    wide = alive.groupBy(*keys).agg(*hit) if hit else alive.select(*keys).distinct()
    cells = {}
    for i, prm in enumerate(parameters):
        cells |= {prm: F.col(f"_hl_c{i}.v"), prm + unit_suffix: F.col(f"_hl_c{i}.u")}
    return wide.select(*keys, *[cells[c].alias(c) for c in sorted(cells)])


def pivot_fill_rank(df: DataFrame, row: str, column: str, value: str, columns=None,
                    fill=0.0, rank_col: str = "rank") -> DataFrame:
    """Pivot ``value`` to one column per ``columns`` entry, fill gaps, and
    rank rows by their mean across the pivoted columns (descending; the mean
    itself is dropped).  Rows = distinct ``row`` values (e.g. features)."""
    columns = list(columns) if columns is not None else distinct_labels(df, column)
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
    if fill is not None:
        wide = wide.na.fill(fill, subset=[str(c) for c in columns])
    mean = sum(F.col(f"`{c}`") for c in columns) / F.lit(float(len(columns)))
    ranked = row_number(wide.withColumn("_hl_mean", -mean), ["_hl_mean", row], rank_col)
    return ranked.withColumn(rank_col, F.col(rank_col).cast("int")).drop("_hl_mean")


def unpivot_metrics(df: DataFrame, ids, metrics, name: str = "metric", value: str = "value") -> DataFrame:
    """Wide metric table -> long (ids..., metric, value)."""
    return df.unpivot(list(ids), list(metrics), name, value)
