"""Exact quantiles (linear interpolation), one path at every size.

Equal values are one (value, count) row after a partial aggregation, so a
repeated value is never copied or sorted.  The running counts of these rows
are computed over value ranges (``ordered.running_sum``: no task holds more
than one range of one group), and the row that covers a wanted rank is then a
plain filter.  The result equals numpy/pandas ``quantile`` (linear) and SQL
``quantile_cont``; Spark's own exact ``percentile`` would keep every distinct
value of a group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import join_on_keys
from .ordered import n_ranges, range_bounds, running_sum


def exact_quantiles(df: DataFrame, value: str, probs, group_by=(), names=None, n: int | None = None) -> DataFrame:
    """One row per group (NULL is a group): ``group_by`` columns + one DOUBLE
    column per prob.

    NULL and NaN values are ignored; a group without values gets NULL
    quantiles (the global form always returns exactly one row).  ``n`` is the
    number of value ranges (from the row count by default).
    """
    group_by = list(group_by)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    v = F.col(value).cast("double")
    # negative zero and zero are one value; a group without values keeps its row
    base = df.select(*group_by, F.when(~F.isnan(v), v + F.lit(0.0)).alias("_v"))
    n = n or n_ranges(df)
    counts = base.groupBy(*group_by, "_v").agg(F.count("_v").alias("_c"))
    run = running_sum(counts.where("_v IS NOT NULL"), "_c", ["_v"], "_upto", group_by=group_by, n=n,
                      bounds=range_bounds(base, "_v", n))
    total = counts.groupBy(*group_by).agg(F.sum("_c").alias("_n"))
    run = join_on_keys(run, total, group_by)
    first = F.col("_upto") - F.col("_c")  # 0-based ranks first ... _upto - 1 hold this value
    aggs, out = [], []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        k = F.floor(pos).cast("long")
        k1 = F.least(k + 1, F.col("_n") - 1)
        aggs += [F.max(F.when((k >= first) & (k < F.col("_upto")), F.col("_v"))).alias(f"_a{i}"),
                 F.max(F.when((k1 >= first) & (k1 < F.col("_upto")), F.col("_v"))).alias(f"_b{i}"),
                 F.max(pos - k).alias(f"_f{i}")]
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        out.append(F.when((F.col(f"_f{i}") == 0) | (a == b), a).otherwise(a + F.col(f"_f{i}") * (b - a)).alias(names[i]))
    found = run.groupBy(*group_by).agg(*aggs).select(*group_by, *out)
    return join_on_keys(total.select(*group_by), found, group_by, "left") if group_by else found
