"""Profiling operators: missing values, group means, quantiles, IQR fences,
boxplot statistics, residual summaries, histogram and Gaussian KDE."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import join_on_keys
from .quantiles import exact_quantiles

IQR_K = 1.5


def group_mean_count(df: DataFrame, key: str, value: str, scale: int = 3,
                     mean_name: str = "mean", count_name: str = "n_samples") -> DataFrame:
    """Mean (half-even rounded to ``scale``) and non-NULL count of ``value``
    per ``key``; NULL keys dropped.

    The mean is taken over the exact decimal values, so the rounding of a tie
    (…5 in the next digit) never depends on summation order; where a value or
    the sum is too large for that, it is the DOUBLE mean.  NaN counts as
    missing."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    dec = v.try_cast("decimal(38,18)")
    exact = F.when(F.count(dec) == F.count(v), F.try_avg(dec))
    mean = F.coalesce(F.bround(exact, scale).cast("double"), F.bround(F.avg(v), scale))
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(mean.alias(mean_name), F.count(v).alias(count_name)))


def missing_profile(df: DataFrame, columns=None, scale: int = 2, only_missing: bool = False) -> DataFrame:
    """One row per column: ``column``, ``missing`` (NULL or NaN count) and
    ``pct_missing`` (share in %, half-even rounded).  One pass over the data."""
    columns = list(columns or df.columns)
    num = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        miss = F.col(c).isNull() | F.isnan(c) if c in num else F.col(c).isNull()
        aggs.append(F.count_if(miss).alias(f"_m{i}"))
    wide = df.agg(*aggs)
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"), F.lit(i).alias("pos"))
        for i, c in enumerate(columns)])).alias("m")).select("_n", "m.*")
    out = long.select("column", "pos", F.col("missing").cast("long").alias("missing"),
                      F.bround(F.try_divide(F.col("missing") * 100.0, F.col("_n")), scale).alias("pct_missing"))
    if only_missing:
        out = out.where(F.col("missing") > 0)
    return out


def iqr_fences(df: DataFrame, value: str, group_by=(), k: float = IQR_K) -> DataFrame:
    """Q1, Q3 (linear interpolation) and the fences Q1 - k*IQR, Q3 + k*IQR."""
    q = exact_quantiles(df, value, [0.25, 0.75], group_by, names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(*group_by, "q1", "q3", (F.col("q1") - k * iqr).alias("lower"),
                    (F.col("q3") + k * iqr).alias("upper"))


def _with_fences(df: DataFrame, value: str, group_by, k: float) -> DataFrame:
    f = iqr_fences(df, value, group_by, k)
    if group_by:
        return join_on_keys(df, f, group_by, "left")
    row = f.first()  # four fitted scalars
    return df.select("*", *[F.lit(row[c]).cast("double").alias(c) for c in ("q1", "q3", "lower", "upper")])


def iqr_keep(df: DataFrame, value: str, group_by=(), k: float = IQR_K) -> DataFrame:
    """Keep rows with lower <= value <= upper (inclusive); NULL values dropped."""
    j = _with_fences(df, value, group_by, k)
    return j.where(F.col(value).between(F.col("lower"), F.col("upper"))).drop("q1", "q3", "lower", "upper")


def iqr_outliers(df: DataFrame, value: str, group_by=(), k: float = IQR_K) -> DataFrame:
    """Rows strictly outside the fences; NULL values are never outliers."""
    j = _with_fences(df, value, group_by, k)
    return j.where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))) \
            .drop("q1", "q3", "lower", "upper")


def target_summary(df: DataFrame, value: str, group_by=()) -> DataFrame:
    """min / max / mean / median of a target."""
    group_by = list(group_by)
    med = exact_quantiles(df, value, [0.5], group_by, names=["median"])
    agg = [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")]
    if group_by:
        return df.groupBy(*group_by).agg(*agg).transform(lambda d: join_on_keys(d, med, group_by, "left"))
    row = med.first()
    return df.agg(*agg).select("*", F.lit(row["median"]).cast("double").alias("median"))


def boxplot_stats(df: DataFrame, value: str, group_by, k: float = IQR_K) -> DataFrame:
    """Per group: quartiles, median, whiskers at the last datum inside the
    fences, and the number of fliers (the fliers themselves are the rows of
    :func:`iqr_outliers`, never collected into one cell)."""
    group_by = list(group_by)
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], group_by, names=["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    q = q.select(*group_by, "q1", "median", "q3", (F.col("q1") - k * iqr).alias("lower"),
                 (F.col("q3") + k * iqr).alias("upper"))
    v = F.col(value)
    inside = v.between(F.col("lower"), F.col("upper"))
    agg = (join_on_keys(df.where(v.isNotNull()), q.select(*group_by, "lower", "upper"), group_by)
           .groupBy(*group_by)
           .agg(F.count(v).alias("n"),
                F.min(F.when(inside, v)).alias("whisker_low"),
                F.max(F.when(inside, v)).alias("whisker_high"),
                F.count_if(~inside).alias("n_fliers")))
    return join_on_keys(q, agg, group_by)


def cv_mean_std(scores: DataFrame, score: str, group_by) -> DataFrame:
    """Mean, population std (saved) and sample std (plotted) of CV scores."""
    return scores.groupBy(*group_by).agg(F.avg(score).alias("cv_mean"),
                                         F.stddev_pop(score).alias("cv_std"),
                                         F.stddev_samp(score).alias("cv_std_sample"))


def residual_stats(df: DataFrame, actual: str, predicted: str, group_by=()) -> DataFrame:
    """error = predicted - actual: mean and population std."""
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(*group_by).agg(F.count(e).alias("n"), F.avg(e).alias("mean_error"),
                                     F.stddev_pop(e).alias("std_error"))


def joint_range(df: DataFrame, actual: str, predicted: str, group_by=()) -> DataFrame:
    """Common axis range of actual and predicted values (over all models)."""
    return df.groupBy(*group_by).agg(
        F.least(F.min(actual), F.min(predicted)).alias("range_min"),
        F.greatest(F.max(actual), F.max(predicted)).alias("range_max"))


def histogram(df: DataFrame, value: str, bins: int = 30, group_by=()) -> DataFrame:
    """Equal-width histogram over [min, max] (per group, NULL included); the
    max falls in the last bin.  Returns (bin, bin_start, bin_end, count) for
    all bins, empty ones too; a group without values has none.  Equal values
    lie in the first bin of width one."""
    group_by = list(group_by)
    v = F.col(value).cast("double")
    base = df.select(*group_by, F.when(~F.isnan(v), v).alias("_v")).where("_v IS NOT NULL")
    st = base.groupBy(*group_by).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx")).where("_mn IS NOT NULL")
    st = st.select(*group_by, "_mn", F.when(F.col("_mx") > F.col("_mn"), (F.col("_mx") - F.col("_mn")) / F.lit(bins))
                   .otherwise(F.lit(1.0)).alias("_w"))
    grid = st.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    b = F.least(F.floor((F.col("_v") - F.col("_mn")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = join_on_keys(base, st, group_by).groupBy(*group_by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return join_on_keys(grid, counts, [*group_by, "bin"], "left").select(
        *group_by, "bin", (F.col("_mn") + F.col("bin") * F.col("_w")).alias("bin_start"),
        (F.col("_mn") + (F.col("bin") + 1) * F.col("_w")).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"))


def gaussian_kde(df: DataFrame, value: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE on an evenly spaced grid, Scott bandwidth n^(-1/5)*sigma
    (sigma = sample std).  One aggregate pass holding one running sum per grid
    point: no row is paired with the grid, nothing is collected."""
    st = df.agg(F.count(value).alias("n"), F.min(value).alias("mn"), F.max(value).alias("mx"),
                F.stddev_samp(value).alias("sd")).first()
    n = st["n"]
    if not n or st["sd"] is None or st["sd"] == 0:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    h = float(st["sd"]) * n ** (-0.2)
    lo, hi = float(st["mn"]) - cut * h, float(st["mx"]) + cut * h
    xs = [lo + i * (hi - lo) / (grid - 1) for i in range(grid)]
    # equal values once, with their count
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))

    def term(x):
        z = (F.lit(x) - F.col("_v")) / F.lit(h)
        return F.col("_c") * F.exp(F.lit(-0.5) * (z * z))
    sums = [F.sum(term(x)).alias(f"s{i}") for i, x in enumerate(xs)]
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    wide = counts.agg(*sums)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), (F.col(f"s{i}") * F.lit(norm)).alias("density"))
        for i, x in enumerate(xs)])).alias("k")).select("k.*")


#: fine bins per bandwidth and reach of the kernel (beyond it, below 1e-15 of the peak)
KDE_BINS_PER_WIDTH, KDE_REACH = 400, 8.5


def binned_kde(df: DataFrame, value: str, group_by=(), grid: int = 200) -> DataFrame:
    """Gaussian KDE per group on ``grid`` even points from its least to its
    greatest value, Scott bandwidth h = n^(-1/5) * sample deviation.

    Values are binned first: each gives its two neighbours on a fine lattice of
    step h / ``KDE_BINS_PER_WIDTH`` the weights that keep its place, and only the
    occupied bins meet the grid points within reach.  Work is rows + bins * points
    in reach, whatever the group sizes; a hot group is summed before any shuffle.
    The error is below 1 / (8 * KDE_BINS_PER_WIDTH^2) < 8e-7 of the kernel's peak.
    Groups without two different values have no density and no rows."""
    group_by = list(group_by)
    if not group_by:
        return binned_kde(df.select(F.lit(0).alias("_hl_all"), value), value, ["_hl_all"], grid).drop("_hl_all")
    base = df.select(*group_by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    st = base.groupBy(*group_by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
                                     F.stddev_samp("_v").alias("_sd")).where("_sd > 0")
    st = st.select(*group_by, "_n", "_mn", (F.col("_sd") * F.pow("_n", F.lit(-0.2))).alias("_h"),
                   ((F.col("_mx") - F.col("_mn")) / F.lit(grid - 1)).alias("_step"))
    j = join_on_keys(base, st, group_by)
    at = (F.col("_v") - F.col("_mn")) / (F.col("_h") / KDE_BINS_PER_WIDTH)
    low = F.floor(at)
    halves = F.array(F.struct(low.alias("b"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("b"), (at - low).alias("w")))
    own = [*group_by, "_n", "_mn", "_h", "_step"]
    bins = j.select(*own, F.inline(halves)).groupBy(*own, "b").agg(F.sum("w").alias("w"))
    m = F.col("b") * (F.col("_h") / KDE_BINS_PER_WIDTH)
    reach = F.lit(KDE_REACH) * F.col("_h")
    first = F.greatest(F.ceil((m - reach) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((m + reach) / F.col("_step")), F.lit(grid - 1))
    near = bins.where(last >= first).select(*own, "w", m.alias("m"), F.explode(F.sequence(first, last)).alias("i"))
    z = (F.col("i") * F.col("_step") - F.col("m")) / F.col("_h")
    sums = near.groupBy(*group_by, "i").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
    points = st.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))).alias("i"))
    full = join_on_keys(points, sums, [*group_by, "i"], "left")
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    return full.select(*group_by, F.col("i").cast("int").alias("i"), (F.col("_mn") + F.col("i") * F.col("_step")).alias("x"),
                       (F.coalesce("s", F.lit(0.0)) / norm).alias("density"))


def coverage(df: DataFrame, marker: str) -> DataFrame:
    """Total rows, rows where ``marker`` is present, and their share in %."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(marker).alias("with_image"),
                  (F.count(marker) * 100.0 / F.count(F.lit(1))).alias("pct_with_image"))
