"""Statistical learning: preparation (encode, impute, split, scale, folds),
metrics, calibration, and regressors.

Linear models are fitted from per-fold sufficient statistics (n, Σx, Σy,
Σxxᵀ, Σxy, Σy²) gathered in ONE distributed aggregate; each alpha / fold is
then a p×p solve on those statistics (p = number of features), so a 100-alpha
5-fold search costs one pass over the data.  Boosted trees use MLlib, forests
``forest``.
"""

from __future__ import annotations

import math
import warnings
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import row_number
from .quantiles import exact_quantiles

SEED = 42


# ---------------------------------------------------------------- preparation
def category_codes(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Codes 0..k-1 of the sorted distinct text values; NULL -> -1.
    Non-text columns are returned unchanged (no code column added unless
    ``out`` differs, then it is a copy)."""
    out = out or column
    if dict(df.dtypes)[column] != "string":
        return df if out == column else df.withColumn(out, F.col(column))
    cats = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = row_number(cats, [column], "_hl_code").withColumn("_hl_code", (F.col("_hl_code") - 1).cast("int"))
    j = df.join(codes, column, "left")
    return j.withColumn(out, F.coalesce(F.col("_hl_code"), F.lit(-1))).drop("_hl_code")


def fit_medians(df: DataFrame, features) -> dict[str, float | None]:
    """Exact median of each feature (linear interpolation) -> fitted scalars."""
    features = list(features)
    # only columns that have a gap need a median
    gaps = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first().asDict()
    todo = [f for f in features if gaps[f]]
    if not todo:
        return {f: None for f in features}
    features = todo
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]) \
             .unpivot([], features, "_hl_feature", "_hl_value")
    rows = exact_quantiles(long, "_hl_value", [0.5], ["_hl_feature"], names=["m"]).collect()
    got = {r["_hl_feature"]: r["m"] for r in rows}  # one scalar per feature
    return {f: got.get(f) for f in features}  # features without gaps map to None: nothing to fill


def impute_median(df: DataFrame, features, medians: dict | None = None) -> DataFrame:
    """Fill NULL features with the median.  By default the medians are fitted
    on ``df`` itself (all rows, before any split -- the field scripts' choice);
    pass ``medians`` fitted on train rows to avoid that leak."""
    medians = medians if medians is not None else fit_medians(df, features)
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(medians[f]).cast("double"))
                           for f in features if medians.get(f) is not None})


def fit_scaler(df: DataFrame, features) -> dict[str, tuple[float, float]]:
    """Mean and POPULATION std per feature (one aggregate)."""
    row = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in features}


def standardise(df: DataFrame, features, scaler: dict) -> DataFrame:
    """(x - mean) / std with the fitted scaler; zero std divides by 1."""
    cols = {}
    for f in features:
        m, s = scaler[f]
        s = 1.0 if (s is None or s == 0 or math.isnan(s)) else s
        cols[f] = (F.col(f) - F.lit(m)) / F.lit(s)
    return df.withColumns(cols)


def split_hash(key: str, seed: int = SEED):
    """Portable pseudo-random order: md5 of '<key>|<seed>'."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


#: distinct hashes of a bucket that the search for a cut point reads at the end
_CUT_HASHES = 5000


def hash_cuts(df: DataFrame, key: str, ranks, seed: int = SEED) -> tuple[int, dict[int, str]]:
    """(number of rows, {rank: hash of the row with this 1-based rank}) in md5
    order.  No row is moved or ranked: counts per hash prefix say which prefix
    holds the rank; it is refined until few different hashes share it, and only
    their counts are read.  Rows that share a key share its hash, count as one
    hash however many they are, and are never cut apart.  ``ranks`` may be a
    function of the number of rows."""
    h = F.coalesce(split_hash(key, seed), F.lit(""))
    rows = df.select(h.alias("h"))
    cuts: dict[int, str] = {}
    todo: dict[str, list[tuple[int, int]]] = {}  # prefix -> (rank wanted, rank among the rows of the prefix)
    whole: dict[str, list[tuple[int, int]]] = {}  # the same for prefixes of few hashes
    width, total = 0, None
    while todo or total is None:
        width += 3
        inside = rows.where(F.substring("h", 1, width - 3).isin(list(todo))) if width > 3 else rows
        got = sorted((r["p"], r["n"], r["d"]) for r in inside.groupBy(F.substring("h", 1, width).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).collect())
        if total is None:
            total = sum(n for _, n, _ in got)
            todo = {"": [(r, r) for r in (ranks(total) if callable(ranks) else ranks) if 0 < r <= total]}
        deeper: dict[str, list[tuple[int, int]]] = {}
        for prefix, wanted in todo.items():
            at = 0
            for p, n, d in got:
                if p.startswith(prefix):
                    here = [(rank, r - at) for rank, r in wanted if at < r <= at + n]
                    if here:
                        (whole if d <= _CUT_HASHES else deeper)[p] = here
                    at += n
        todo = deeper
    by_width: dict[int, list[str]] = {}
    for p in whole:
        by_width.setdefault(len(p), []).append(p)
    for w, ps in by_width.items():  # one read per depth, a single one on even hashes
        counts = sorted((r["h"], r["n"]) for r in rows.where(F.substring("h", 1, max(w, 1)).isin(ps))
                        .groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect())
        for p in ps:
            at = 0
            for x, n in counts:
                if x.startswith(p) and (p or not x):
                    cuts |= {rank: x for rank, r in whole[p] if at < r <= at + n}
                    at += n
    return total, cuts


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = SEED,
               exact: bool = True, out: str = "is_test") -> DataFrame:
    """Seeded 80/20 split.  ``exact``: the ceil(f*n) rows first in md5 order
    are test (sklearn's test size), by one cut point, so the split is a plain
    column.  Otherwise a per-row md5 threshold (size ≈ f*n).  A NULL key comes
    first; rows that share a key fall on the same side."""
    h = F.coalesce(split_hash(key, seed), F.lit(""))
    if not exact:
        u = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16 ** 12)
        return df.withColumn(out, u < test_fraction)
    # exact decimal, no float rounding
    asked = lambda n: [math.ceil(Fraction(str(test_fraction)) * n)]
    total, cuts = hash_cuts(df, key, asked, seed)
    if cuts:
        cut, rank = max(cuts.values()), max(cuts)
        held = df.where(h <= F.lit(cut)).count()
        if held > 2 * rank + 100:
            raise ValueError(f"{held} of {total} rows would be test rows where {rank} were asked for: "
                             f"too many share one {key}; split by a key that tells them apart")
    return df.withColumn(out, h <= F.lit(max(cuts.values())) if cuts else F.lit(False))


def _segments(df: DataFrame, key: str, ends, seed: int, out: str) -> DataFrame:
    """``out`` = number of the 1-based ranks in ``ends`` whose row comes before."""
    _, cuts = hash_cuts(df, key, ends, seed)
    h = F.coalesce(split_hash(key, seed), F.lit(""))
    before = [(h > F.lit(cuts[e])).cast("int") for e in sorted(cuts)]
    return df.withColumn(out, sum(before[1:], before[0]) if before else F.lit(0))


def fold_ends(n: int, k: int) -> list[int]:
    """Rows up to the end of each of k contiguous folds (larger ones first)."""
    q, rem = divmod(n, k)
    return [(i + 1) * q + min(i + 1, rem) for i in range(k)]


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = SEED, out: str = "fold") -> DataFrame:
    """k contiguous folds (sizes differ by at most one, larger first) over the
    md5 order -- the unshuffled K-fold of the train rows."""
    return _segments(df, key, lambda n: fold_ends(n, k)[:-1], seed, out)


# ---------------------------------------------------------------- metrics
def regression_metrics(df: DataFrame, actual: str, predicted: str, group_by=()) -> DataFrame:
    """RMSE, MAE and R² = 1 - SSE/SST (about the group's own mean; may be
    negative; a constant target scores 1 if SSE = 0 else 0).  One pass."""
    e = F.col(predicted) - F.col(actual)
    g = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.sum(F.abs(e)).alias("_sae"),
        F.var_pop(actual).alias("_var"))
    sst = F.col("n") * F.col("_var")
    r2 = F.when(sst == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("_sse") / sst)
    return g.select(*group_by, "n", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
                    (F.col("_sae") / F.col("n")).alias("mae"), r2.alias("r2"))


def ols_calibration(df: DataFrame, x: str, y: str, group_by=()) -> DataFrame:
    """Least-squares y ≈ slope·x + intercept with its R², per group."""
    return df.groupBy(*group_by).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
                                     F.regr_slope(y, x).alias("slope"),
                                     F.regr_intercept(y, x).alias("intercept"),
                                     F.regr_r2(y, x).alias("r2"))


# ---------------------------------------------------------------- linear models from sufficient statistics
def gram_stats(df: DataFrame, features, target: str, group_by=()) -> dict:
    """Per group: n, Σx, Σy, Σxxᵀ, Σxy, Σy² as numpy arrays (one aggregate;
    the result is p×p per group, independent of the row count)."""
    p = len(features)
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    aggs += [F.sum(x[i]).alias(f"sx{i}") for i in range(p)]
    aggs += [F.sum(x[i] * y).alias(f"sxy{i}") for i in range(p)]
    aggs += [F.sum(x[i] * x[j]).alias(f"sxx{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = df.groupBy(*group_by).agg(*aggs).collect()  # one small row per group
    out = {}
    for r in rows:
        key = tuple(r[g] for g in group_by)
        xx = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                xx[i, j] = xx[j, i] = r[f"sxx{i}_{j}"]
        out[key] = dict(n=float(r["n"]), sy=float(r["sy"]), syy=float(r["syy"]),
                        sx=np.array([r[f"sx{i}"] for i in range(p)], dtype=float),
                        sxy=np.array([r[f"sxy{i}"] for i in range(p)], dtype=float), sxx=xx)
    return out


def _add(a, b, sign=1.0):
    return {k: a[k] + sign * b[k] for k in a}


def _centered(s):
    n = s["n"]
    mx, my = s["sx"] / n, s["sy"] / n
    cxx = s["sxx"] - n * np.outer(mx, mx)
    cxy = s["sxy"] - n * mx * my
    return n, mx, my, cxx, cxy


def ridge_solve(s, alpha: float):
    """Ridge with intercept: (XcᵀXc + αI) w = Xcᵀyc (sklearn's objective)."""
    n, mx, my, cxx, cxy = _centered(s)
    w = np.linalg.solve(cxx + alpha * np.eye(len(mx)), cxy)
    return w, my - mx @ w


def lasso_solve(s, alpha: float, tol: float = 1e-4, max_iter: int = 20_000, w0=None):
    """Lasso (1/(2n))||y - Xw - b||² + α||w||₁ by covariance-form coordinate descent."""
    n, mx, my, cxx, cxy = _centered(s)
    g, c = cxx / n, cxy / n
    p = len(mx)
    w = np.zeros(p) if w0 is None else w0.copy()
    diag = np.diag(g).copy()
    gw = g @ w
    for _ in range(max_iter):
        dmax = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            old = w[j]
            rho = c[j] - gw[j] + diag[j] * old
            new = math.copysign(max(abs(rho) - alpha, 0.0), rho) / diag[j]
            if new != old:
                gw += g[:, j] * (new - old)
                w[j] = new
                dmax = max(dmax, abs(new - old))
        if dmax <= tol * max(1e-12, float(np.max(np.abs(w))) if w.any() else 1.0):
            break
    else:
        warnings.warn(f"lasso (alpha {alpha:g}) stopped after {max_iter} sweeps", stacklevel=2)
    return w, my - mx @ w


def sse_from_stats(s, w, b) -> float:
    """Σ(y - b - xᵀw)² expanded over a fold's sufficient statistics."""
    return float(s["syy"] - 2 * w @ s["sxy"] - 2 * b * s["sy"] + w @ s["sxx"] @ w
                 + 2 * b * (w @ s["sx"]) + s["n"] * b * b)


def r2_from_stats(s, w, b) -> float:
    sst = s["syy"] - s["sy"] ** 2 / s["n"]
    sse = sse_from_stats(s, w, b)
    if sst <= 0:
        return 1.0 if sse <= 1e-12 else 0.0
    return 1 - sse / sst


def lasso_alpha_grid(s, n_alphas: int = 100, eps: float = 1e-3):
    n, mx, my, cxx, cxy = _centered(s)
    amax = float(np.max(np.abs(cxy)) / n) if n else 1.0
    if amax <= 0:
        amax = 1e-12
    return list(np.logspace(math.log10(amax * eps), math.log10(amax), n_alphas)[::-1])


def linear_cv(fold_stats: dict, kind: str, alphas=None):
    """Choose alpha by k-fold CV on per-fold statistics.
    ridge: best mean R² (default alphas 0.1, 1, 10); lasso: least mean MSE
    over the 100-alpha path.  Returns (alpha, w, b, fold_scores_r2)."""
    total = None
    for s in fold_stats.values():
        total = s if total is None else _add(total, s)
    if kind == "ridge":
        alphas = alphas or [0.1, 1.0, 10.0]
    else:
        alphas = alphas or lasso_alpha_grid(total)
    best = None
    warm = {}
    for a in alphas:  # lasso alphas descend: each fold warm-starts from the previous alpha
        r2s, mses = [], []
        for f, s in fold_stats.items():
            tr = _add(total, s, -1.0)
            if kind == "ridge":
                w, b = ridge_solve(tr, a)
            else:
                w, b = lasso_solve(tr, a, w0=warm.get(f))
                warm[f] = w
            r2s.append(r2_from_stats(s, w, b))
            mses.append(sse_from_stats(s, w, b) / s["n"])
        score = float(np.mean(r2s)) if kind == "ridge" else -float(np.mean(mses))
        if best is None or score > best[0]:
            best = (score, a)
    alpha = best[1]
    w, b = ridge_solve(total, alpha) if kind == "ridge" else lasso_solve(total, alpha)
    return alpha, w, b


def linear_predict(df: DataFrame, features, w, b, out: str = "prediction") -> DataFrame:
    """Score rows with fitted linear coefficients (a Column expression)."""
    e = F.lit(float(b))
    for f, c in zip(features, w):
        e = e + F.col(f) * F.lit(float(c))
    return df.withColumn(out, e)


def fold_r2_linear(df: DataFrame, features, target: str, kind: str, key: str, k: int = 5, alphas=None,
                   seed: int = SEED) -> dict[int, float]:
    """K-fold R² of a ridge/lasso whose alpha is chosen by a K-fold search of
    its own inside each train part: contiguous inner folds over the train
    rows' order.  All inner and outer folds are unions of the stretches
    between their cut points, so one aggregate per stretch serves them all."""
    outer: list[tuple[int, int]] = []
    inner: dict[int, list[list[tuple[int, int]]]] = {}
    marks: list[int] = []

    def lay_out(n):
        ends = fold_ends(n, k)
        outer[:] = zip([0, *ends], ends)
        for f, (a, b) in enumerate(outer):
            stops = fold_ends(n - (b - a), k)
            place = lambda r, a=a, b=b: r if r <= a else r + (b - a)  # noqa: E731  rank among the train rows -> rank
            parts = []
            for lo, hi in zip([0, *stops], stops):
                x, y = (lo if lo < a else lo + (b - a)), place(hi)
                parts.append([(x, y)] if not x < a < b < y else [(x, a), (b, y)])
            inner[f] = parts
        marks[:] = sorted({0, n, *ends, *(e for ps in inner.values() for p in ps for ab in p for e in ab)})
        return marks[1:-1]
    seg = _segments(df, key, lay_out, seed, "_hl_seg")
    st = {s[0]: v for s, v in gram_stats(seg, features, target, ["_hl_seg"]).items()}

    def total(spans):
        out = None
        for i, (a, b) in enumerate(zip(marks, marks[1:])):
            if i in st and any(lo <= a and b <= hi for lo, hi in spans):
                out = st[i] if out is None else _add(out, st[i])
        return out
    scores = {}
    for f, (a, b) in enumerate(outer):
        folds = {g: t for g, t in enumerate(map(total, inner[f])) if t is not None}
        _, w, c = linear_cv(folds, kind, alphas)
        scores[f] = r2_from_stats(total([(a, b)]), w, c)
    return scores


def fold_linear_scores(df: DataFrame, features, target: str, alpha: float = 0.0, fold: str = "fold") -> DataFrame:
    """K-fold scores of a (ridge, alpha >= 0; OLS at 0) linear fit: fold
    statistics in one aggregate, train = total - fold, coefficients joined
    back (k rows), R² per fold in a second aggregate."""
    st = gram_stats(df, features, target, [fold])
    total = None
    for s in st.values():
        total = s if total is None else _add(total, s)
    rows = []
    for (f,), s in st.items():
        w, b = ridge_solve(_add(total, s, -1.0), alpha)
        rows.append((f, float(b), *[float(x) for x in w]))
    coef_cols = [f"_w{i}" for i in range(len(features))]
    spark = df.sparkSession
    coefs = spark.createDataFrame(rows, [fold, "_b", *coef_cols])
    pred = F.col("_b")
    for f, c in zip(features, coef_cols):
        pred = pred + F.col(f) * F.col(c)
    scored = df.join(F.broadcast(coefs), fold, "inner").withColumn("_pred", pred)  # k rows
    return regression_metrics(scored, target, "_pred", [fold]).select(fold, "n", "r2")


# ---------------------------------------------------------------- tree ensembles and robust regression
def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def random_forest(n_trees: int = 100, max_depth: int = 30, min_leaf: int = 1, feature_subset: str = "all",
                  bootstrap: bool = True, max_bins: int = 32, label: str = "label"):
    """Regression forest with the field scripts' settings (unlimited depth -> 30
    levels; every feature considered at each split).  Splits are searched on
    ``max_bins`` quantile bins per feature (exact thresholds are a single-machine
    luxury); deep trees are grown in pieces, see ``forest``."""
    from .forest import RandomForest
    return RandomForest(n_trees, max_depth, min_leaf, feature_subset, bootstrap, max_bins, SEED, label)


def gradient_boosting(label: str = "label"):
    """GBTRegressor: 100 stages, step 0.1, depth 3, squared loss."""
    from pyspark.ml.regression import GBTRegressor
    return GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, featureSubsetStrategy="all", seed=SEED,
                        lossType="squared", checkpointInterval=10, labelCol=label, featuresCol="features")


def rff_columns(df: DataFrame, features, n_components: int = 100, gamma: float | None = None,
                seed: int = SEED, prefix: str = "rff") -> tuple[DataFrame, list[str]]:
    """Random Fourier features approximating an RBF kernel (Rahimi & Recht
    2007): z = sqrt(2/D)·cos(Wx + b), W ~ N(0, 2γ); gamma defaults to 1/p
    (standardised inputs).  One numpy matrix product per Arrow batch
    (``mapInPandas``); the seeded W is the same on every executor."""
    p = len(features)
    gamma = gamma if gamma is not None else 1.0 / p
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(p, n_components))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    names = [f"{prefix}{i}" for i in range(n_components)]
    feats = list(features)

    def project(batches):
        import pandas as pd
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype="float64", na_value=np.nan)
            z = scale * np.cos(x @ w + b)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(z, columns=names)], axis=1)

    schema = df.schema
    from pyspark.sql.types import DoubleType, StructField, StructType
    out_schema = StructType(list(schema.fields) + [StructField(n, DoubleType(), True) for n in names])
    return df.mapInPandas(project, out_schema), names


def huber_regression(label: str = "label", reg: float = 0.0, epsilon: float = 1.35):
    """Robust linear fit on the RFF features: the declared stand-in for the
    kernel SVR (MLlib has no kernel SVR)."""
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(loss="huber", epsilon=epsilon, regParam=reg, elasticNetParam=0.0,
                            standardization=False, maxIter=200, labelCol=label, featuresCol="features")
