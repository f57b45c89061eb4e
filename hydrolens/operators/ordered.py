"""Order-dependent operators that stay distributed.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task.  These helpers give the same results -- global (or per-group) row
numbers, previous-row values, running sums -- by cutting the order key into
ranges, computing the local part inside each range, and adding offsets from a
small table with one row per (range, group).

The range id is a pure function of the row (bounds are fitted once), so every
branch of the plan -- and every retry after an executor loss -- assigns a row
to the same range.  There is about one range per ``ROWS_PER_RANGE`` rows,
whatever the session's shuffle settings, and at most ``MAX_RANGES``, which
bounds the sketch and the bounds.  A value of the first order column that
fills a whole range is cut further along the second one.  Order columns are
ascending; pass a negated column for descending order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from .keys import join_on_keys

_PID = RANGE = "_hl_pid"
ROWS_PER_RANGE = 50_000
MAX_RANGES = 4096
#: text order columns: bounds come from a sample of this many rows
TEXT_SAMPLE = 20_000
MAX_TEXT_RANGES = 256
#: ranges that one repeated value is cut into along the next order column
SUB_RANGES = 64


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def n_ranges(df: DataFrame, n: int | None = None) -> int:
    return n or min(MAX_RANGES, max(1, -(-df.count() // ROWS_PER_RANGE)))


def _as_number(df: DataFrame, col: str) -> Column | None:
    """An order-preserving DOUBLE of a number, date or timestamp."""
    t = df.schema[col].dataType
    if isinstance(t, NumericType):
        return F.col(col).cast("double")
    if isinstance(t, DateType):
        return F.unix_date(col).cast("double")
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return None


def range_bounds(df: DataFrame, col: str, n: int) -> list:
    """At most n-1 ascending cut points of ``col`` (NULLs ignored); a value
    that comes up twice fills a whole range."""
    if n <= 1:
        return []
    x = _as_number(df, col)
    if x is not None:
        qs = df.select(x.alias("_x")).approxQuantile("_x", [i / n for i in range(1, n)], 1.0 / (8 * n))
        return sorted(q for q in qs if q is not None)
    n = min(n, MAX_TEXT_RANGES)
    total = df.count()
    share = min(1.0, TEXT_SAMPLE / max(total, 1))
    vals = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).sample(False, share, seed=17).collect())
    return sorted({vals[i * len(vals) // n] for i in range(1, n)}) if vals else []


def with_range_id(df: DataFrame, col: str, n: int | None = None, out: str = _PID,
                  bounds: list | None = None, then: str | None = None) -> DataFrame:
    """Add ``out`` = index of the range the row falls in (monotone in
    (``col``, ``then``); NULL -> first).  Deterministic: a function of the
    values only.  ``bounds`` may be given when the distribution is known."""
    if bounds is None:
        n = n_ranges(df, n)
        bounds = range_bounds(df, col, n)
    if not bounds:
        return df.withColumn(out, F.lit(0).cast("long"))
    x = _as_number(df, col)
    if x is None:
        arr = F.array(*[F.lit(b) for b in bounds])
        pid = F.size(F.filter(arr, lambda b: b < F.col(col)))
        return df.withColumn(out, F.when(F.col(col).isNull(), F.lit(0)).otherwise(pid).cast("long"))
    from pyspark.ml.feature import Bucketizer  # binary search on the JVM
    # a repeated cut point is a value that fills a range: it gets a range of its own
    hot = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b and abs(a) < 2.0 ** 53})
    cuts = sorted({*map(float, bounds), *hot, *(math.nextafter(h, math.inf) for h in hot)})

    def bucket(d, number, splits, name):
        full = [float("-inf"), *splits, float("inf")]
        b = Bucketizer(splits=full, inputCol="_hl_in", outputCol=name, handleInvalid="keep")
        d = b.transform(d.withColumn("_hl_in", F.coalesce(number, F.lit(float("-inf")))))
        return d.withColumn(name, F.col(name).cast("long")).drop("_hl_in")
    d = bucket(df, x, cuts, out)
    y = _as_number(df, then) if then and hot else None
    if y is None:
        return d
    rows = df.where(x.isin(hot))
    sub = sorted(set(range_bounds(rows, then, SUB_RANGES)))
    if not sub:
        return d
    d = bucket(d, y, sub, "_hl_sub")
    inner = F.when(x.isin(hot), F.col("_hl_sub")).otherwise(F.lit(0))
    return d.withColumn(out, F.col(out) * F.lit(len(sub) + 2) + inner).drop("_hl_sub")


def running_sum(df: DataFrame, value, order_by, out: str, group_by=(), n: int | None = None,
                inclusive: bool = True, bounds: list | None = None) -> DataFrame:
    """Cumulative sum of ``value`` in ``order_by`` order (within ``group_by``).

    ``order_by`` must be a total order (names, ascending).  Rows of one range
    are summed locally; the sum of all earlier ranges of the same group comes
    from a per-(range, group) table, so no task ever holds more than one
    range of one group.
    """
    group_by = list(group_by)
    order_by = list(order_by)
    v = F.col(value) if isinstance(value, str) else value
    r = with_range_id(df.withColumn("_hl_v", v), order_by[0], n, bounds=bounds,
                      then=order_by[1] if len(order_by) > 1 else None)
    frame = Window.partitionBy(_PID, *group_by).orderBy(*_cols(order_by))
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = r.withColumn("_hl_local", F.coalesce(F.sum("_hl_v").over(frame), F.lit(0)))
    per_range = r.groupBy(_PID, *group_by).agg(F.sum("_hl_v").alias("_hl_tot"))
    before = Window.partitionBy(*group_by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(_PID, *group_by,
                               F.coalesce(F.sum("_hl_tot").over(before), F.lit(0)).alias("_hl_off"))
    if not group_by:
        # one row per range: size bounded by the range count
        offsets = F.broadcast(offsets)
    return (join_on_keys(local, offsets, [_PID, *group_by])
            .withColumn(out, F.col("_hl_off") + F.col("_hl_local"))
            .drop("_hl_v", "_hl_local", "_hl_off", _PID))


def row_number(df: DataFrame, order_by, out: str = "rn", group_by=(), n: int | None = None,
               bounds: list | None = None) -> DataFrame:
    """1-based row number in ``order_by`` order (within ``group_by``), distributed."""
    return running_sum(df, F.lit(1).cast("long"), order_by, out, group_by, n, bounds=bounds)


def previous_row(df: DataFrame, cols, order_by, suffix: str = "_prev", n: int | None = None,
                 bounds: list | None = None, keep_range: bool = False) -> DataFrame:
    """Add ``<c><suffix>`` = value of ``c`` in the previous row of the global
    order (NULL for the first row), without a single-partition window.
    ``keep_range`` leaves the range number (``RANGE``), by which the rows lie
    together."""
    cols = list(cols)
    order_by = list(order_by)
    r = with_range_id(df, order_by[0], n, bounds=bounds, then=order_by[1] if len(order_by) > 1 else None)
    w = Window.partitionBy(_PID).orderBy(*_cols(order_by))
    local = r.withColumn("_hl_first", F.row_number().over(w) == 1)
    for c in cols:
        local = local.withColumn(c + suffix, F.lag(c).over(w))
    order_struct = F.struct(*_cols(order_by))
    last = (r.groupBy(_PID)
            .agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]), order_struct).alias("_hl_last")))
    # previous non-empty range's last row; this table has <= range-count rows
    carry = last.select(_PID, F.lag("_hl_last").over(Window.orderBy(_PID)).alias("_hl_carry"))
    out = local.join(F.broadcast(carry), _PID, "inner")
    for c in cols:
        out = out.withColumn(c + suffix, F.when(F.col("_hl_first"), F.col("_hl_carry." + c))
                             .otherwise(F.col(c + suffix)))
    return out.drop("_hl_first", "_hl_carry", *([] if keep_range else [_PID]))

