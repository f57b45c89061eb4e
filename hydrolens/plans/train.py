"""Entry point C: preprocess, split, scale, train and compare regressors.

preprocess (schema adapt → cloud filter → season → encode → NULL target →
IQR keep → select → median impute) → seeded hash split → population-std
scaling fitted on train rows → five regressors → metrics, K-fold scores and
importances.  The rows and columns that training needs are written once per
target, before the first fence or median is fitted; every later step reads that
narrow table, nothing is held in memory, and nothing is collected except fitted
scalars and per-fold statistics.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import season_of_month
from ..functions.spectral import FEATURE_COLUMNS
from ..operators import learn as L
from ..operators.clean import (drop_null_any, present_features, require_columns, threshold_filter)
from ..operators.forest import ForestModel
from ..operators.profile import iqr_keep
from ..operators.svr import SVRModel, fit_svr, rbf_map
from ..session import checkpoint_dir, stored
from ..sources import sinks

log = logging.getLogger(__name__)

MODEL_NAMES = ["RandomForest", "GradientBoosting", "Lasso", "Ridge", "SVR"]


def preprocess(df: DataFrame, target: str, features=FEATURE_COLUMNS, cloud_threshold: float = 20,
               cloud_required: bool = False, key: str = "sample_id", impute: str = "all") -> tuple[DataFrame, list[str]]:
    """Rows ready for training: (key, label, features...).

    ``cloud_required``: a missing cloud column is an error instead of a
    skipped filter.  ``impute``: 'all'
    fits the medians on every preprocessed row (the scripts' choice, before
    the split); 'none' leaves NULLs for a later train-only imputation.
    """
    feats = present_features(df, features)
    if "Month" in df.columns and "Season" not in df.columns:
        df = df.withColumn("Season", season_of_month(F.col("Month")))
        if "Season" in features and "Season" not in feats:
            feats.append("Season")
    df = threshold_filter(df, "Cloud_Percentage", cloud_threshold, required=cloud_required)
    if "Season" in df.columns and dict(df.dtypes)["Season"] == "string":
        df = L.category_codes(df, "Season")
    require_columns(df, [target])
    df = drop_null_any(df, [target])
    df = stored(df.select(key, F.col(target).cast("double").alias("label"),
                          *[F.col(f).cast("double").alias(f) for f in feats]), "train-rows")
    df = iqr_keep(df, "label")
    if impute == "all":
        df = L.impute_median(df, feats)
    return df, feats


def split_and_scale(df: DataFrame, feats, key: str = "sample_id", test_fraction: float = 0.2):
    """Seeded split, scaler fitted on the train rows and applied to both."""
    s = L.hash_split(df, key, test_fraction)
    scaler = L.fit_scaler(s.where(~F.col("is_test")), feats)
    s = L.standardise(s, feats, scaler)
    return s.where(~F.col("is_test")), s.where(F.col("is_test")), scaler


# ---------------------------------------------------------------- fitting
def fit_predict(kind: str, train: DataFrame, test: DataFrame, feats, key: str = "sample_id",
                fold_col: str | None = None, rf_params: dict | None = None):
    """Fit one model kind on ``train`` and predict ``test``.
    Returns (predictions(key, label, prediction), fitted model or coefficients)."""
    if kind in ("RandomForest", "GradientBoosting"):
        # iterative fitters checkpoint their node ids / residuals every 10
        # iterations into the cluster's shared folder: lineage stays short
        checkpoint_dir(train.sparkSession)
    if kind == "RandomForest":
        m = L.random_forest(**(rf_params or {})).fit(L.assemble(train, feats))
        return m.transform(L.assemble(test, feats)).select(key, "label", "prediction"), m
    if kind == "GradientBoosting":
        m = L.gradient_boosting().fit(L.assemble(train, feats))
        return m.transform(L.assemble(test, feats)).select(key, "label", "prediction"), m
    if kind in ("Lasso", "Ridge"):
        tr = train if fold_col else L.assign_folds(train, key, 5)
        st = L.gram_stats(tr, feats, "label", [fold_col or "fold"])
        alpha, w, b = L.linear_cv({k[0]: v for k, v in st.items()}, kind.lower())
        pred = L.linear_predict(test, feats, w, b).select(key, "label", "prediction")
        return pred, {"alpha": alpha, "coef": list(map(float, w)), "intercept": float(b)}
    if kind == "Linear":
        w, b = L.ridge_solve(L.gram_stats(train, feats, "label")[()], 0.0)
        return (L.linear_predict(test, feats, w, b).select(key, "label", "prediction"),
                {"coef": list(map(float, w)), "intercept": float(b)})
    if kind == "SVR":
        m = fit_svr(train, feats, feature_map=rbf_map(len(feats)))
        return m.transform(test.select(key, "label", *feats)).select(key, "label", "prediction"), m
    if kind == "RFFHuber":
        trr, cols = L.rff_columns(train, feats)
        ter, _ = L.rff_columns(test, feats)
        m = L.huber_regression().fit(L.assemble(trr, cols))
        return m.transform(L.assemble(ter, cols)).select(key, "label", "prediction"), m
    raise ValueError(f"unknown model {kind}")


def cv_scores(kind: str, train: DataFrame, feats, key: str = "sample_id", k: int = 5,
              rf_params: dict | None = None) -> list[float]:
    """R² of each of k contiguous folds of the train rows (md5 order)."""
    f = L.assign_folds(train, key, k).cache()
    try:
        if kind in ("Lasso", "Ridge"):
            sc = L.fold_r2_linear(train, feats, "label", kind.lower(), key, k)
            return [sc[i] for i in sorted(sc)]
        from concurrent.futures import ThreadPoolExecutor

        def one(i):
            pred, _ = fit_predict(kind, f.where(F.col("fold") != i), f.where(F.col("fold") == i), feats, key,
                                  rf_params=rf_params)
            return L.regression_metrics(pred, "label", "prediction").first()["r2"]

        # the k fits are independent Spark jobs: submit them concurrently
        with ThreadPoolExecutor(max_workers=k) as ex:
            return list(ex.map(one, range(k)))
    finally:
        f.unpersist()


def train_models(df: DataFrame, target: str, models=MODEL_NAMES, cloud_threshold: float = 20,
                 with_cv: bool = True, key: str = "sample_id", features=FEATURE_COLUMNS) -> dict:
    """Train each model kind on one target; a failing model is logged and
    reported, the others go on.  Returns metrics rows, predictions, models."""
    from concurrent.futures import ThreadPoolExecutor
    prep, feats = preprocess(df, target, features, cloud_threshold=cloud_threshold, key=key)
    train, test, scaler = split_and_scale(prep, feats, key)

    def run(kind):
        try:
            pred, m = fit_predict(kind, train, test, feats, key)
            met = L.regression_metrics(pred, "label", "prediction").first()
            cv = cv_scores(kind, train, feats, key) if with_cv else []
            row = (target, kind, met["rmse"], met["mae"], met["r2"],
                   float(np.mean(cv)) if cv else None, float(np.std(cv)) if cv else None, None)
            return row, pred, m, cv
        except Exception as e:  # noqa: BLE001 - failure isolation per model
            log.exception("model %s failed for %s", kind, target)
            return (target, kind, None, None, None, None, None, f"{type(e).__name__}: {e}"), None, None, []

    # independent model fits run as concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=len(models)) as ex:
        done = list(ex.map(run, models))
    rows = [d[0] for d in done]
    preds = {k: d[1] for k, d in zip(models, done) if d[1] is not None}
    fitted = {k: d[2] for k, d in zip(models, done) if d[2] is not None}
    scores = {k: d[3] for k, d in zip(models, done)}
    return {"target": target, "rows": rows, "predictions": preds, "models": fitted, "features": feats,
            "scaler": {f: list(v) for f, v in scaler.items()}, "cv_scores": scores}


def prediction_table(result: dict) -> DataFrame | None:
    """(model, key, label, prediction) of every fitted model, long."""
    out = None
    for kind, pred in result["predictions"].items():
        p = pred.select(F.lit(kind).alias("model"), "*")
        out = p if out is None else out.unionByName(p)
    return out


def cv_score_table(spark: SparkSession, result: dict) -> DataFrame:
    """(model, fold, r2): the scores behind the mean and deviation."""
    rows = [(k, i, float(v)) for k, scores in result["cv_scores"].items() for i, v in enumerate(scores)]
    return spark.createDataFrame(rows, "model string, fold int, r2 double")


def write_run(spark: SparkSession, result: dict, root: str, stamp: str | None = None) -> str:
    """Everything of one training run in a folder of its own: comparison, fold
    scores, predictions, features, scaler and every fitted model (linear
    coefficients as scalars)."""
    folder = sinks.run_folder(root, result["target"], stamp)
    comparison_frame(spark, result["rows"]).write.parquet(f"{folder}/comparison")
    cv_score_table(spark, result).write.parquet(f"{folder}/cv_scores")
    preds = prediction_table(result)
    if preds is not None:
        preds.write.parquet(f"{folder}/predictions")
    sinks.artifacts_frame(spark, folder, "features", result["features"]).write.parquet(f"{folder}/features")
    sinks.save_fitted(spark, result["scaler"], f"{folder}/scaler")
    for kind, m in result["models"].items():
        if isinstance(m, SVRModel):
            m = m.as_scalars()
        if isinstance(m, dict):
            sinks.save_fitted(spark, m, f"{folder}/models/{kind}")
        elif isinstance(m, ForestModel):
            m.save(f"{folder}/models/{kind}")
        else:
            sinks.save_model(m, f"{folder}/models/{kind}")
    return folder


COMPARISON_SCHEMA = ("target string, model string, rmse double, mae double, r2 double, cv_mean double, "
                     "cv_std double, error string")


def comparison_frame(spark: SparkSession, rows) -> DataFrame:
    """(target, model, rmse, mae, r2, cv_mean, cv_std, error) -- one row per
    fitted model (a handful of metric values, not data rows)."""
    return spark.createDataFrame(rows, COMPARISON_SCHEMA)


def feature_importances(spark: SparkSession, model, feats) -> DataFrame:
    """Impurity importances of a tree ensemble, sorted by the caller."""
    imp = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)], "feature string, importance double")


def permutation_importance(model, train: DataFrame, feats, key: str = "sample_id", repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Permutation importance of a fitted model, scored on the train rows."""
    from pyspark.ml.functions import array_to_vector
    from ..operators.importance import permutation_importance as permute
    return permute(train, key, "label", feats,
                   lambda d: model.transform(d.withColumn("features", array_to_vector("f"))), repeats, seed,
                   model.permuted if isinstance(model, ForestModel) else None)


# ---------------------------------------------------------------- tuning
# The random-search grid of the tuner.
RF_GRID = {
    "n_estimators": [50, 100, 200, 300, 500],
    "max_depth": [None, 10, 20, 30, 40, 50],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["auto", "sqrt", "log2", None],
    "bootstrap": [True, False],
}


def sample_grid(n_iter: int, seed: int = 42, grid=RF_GRID) -> list[dict]:
    """n_iter distinct seeded draws from the grid (of 2,160 combinations)."""
    keys = list(grid)
    sizes = [len(grid[k]) for k in keys]
    total = int(np.prod(sizes))
    rng = np.random.default_rng(seed)
    picks = rng.choice(total, size=min(n_iter, total), replace=False)
    out = []
    for p in picks:
        d, rest = {}, int(p)
        for k, s in zip(keys, sizes):
            d[k] = grid[k][rest % s]
            rest //= s
        out.append(d)
    return out


def to_mllib(params: dict) -> dict | None:
    """Grid draw → MLlib forest settings.  'auto' features is rejected by
    current libraries, so such a draw fails (None); min_samples_split has no
    MLlib counterpart; depth is capped at 30."""
    mf = params["max_features"]
    if mf == "auto":
        return None
    depth = params["max_depth"]
    return {"n_trees": params["n_estimators"], "max_depth": 30 if depth is None else min(depth, 30),
            "min_leaf": params["min_samples_leaf"], "bootstrap": params["bootstrap"],
            "feature_subset": {"sqrt": "sqrt", "log2": "log2", None: "all"}[mf]}


def random_search(train: DataFrame, feats, n_iter: int = 20, k: int = 5, key: str = "sample_id",
                  seed: int = 42, parallelism: int = 8) -> tuple[dict, float, list[tuple]]:
    """Random search by mean k-fold R²; returns (best draw, best score, all
    (draw, mean, std) results).  Draws are evaluated concurrently."""
    from concurrent.futures import ThreadPoolExecutor
    draws = sample_grid(n_iter, seed)
    f = L.assign_folds(train, key, k).cache()

    def score(d):
        mp = to_mllib(d)
        if mp is None:
            return d, float("nan"), float("nan")
        sc = []
        for i in range(k):
            pred, _ = fit_predict("RandomForest", f.where(F.col("fold") != i), f.where(F.col("fold") == i),
                                  feats, key, rf_params=mp)
            sc.append(L.regression_metrics(pred, "label", "prediction").first()["r2"])
        return d, float(np.mean(sc)), float(np.std(sc))

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        results = list(ex.map(score, draws))
    f.unpersist()
    ok = [r for r in results if not math.isnan(r[1])]
    best = max(ok, key=lambda r: r[1]) if ok else (None, float("nan"), float("nan"))
    return best[0], best[1], results


def train_all_targets(df: DataFrame, targets, **kwargs) -> tuple[list, list]:
    """Run :func:`train_models` for each target; an error in one target is
    recorded as a status row and the others go on.  Returns (metric rows,
    status rows (target, step, error))."""
    rows, status = [], []
    for t in targets:
        try:
            res = train_models(df, t, **kwargs)
            rows += res["rows"]
            status.append((t, "train", None))
        except Exception as e:  # noqa: BLE001 - failure isolation per target
            log.exception("target %s failed", t)
            status.append((t, "train", f"{type(e).__name__}: {e}"))
    return rows, status
