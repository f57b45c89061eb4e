"""Forest tuning job: engineered features → default forest → permutation
importance → features up to 95 % cumulative importance (at least 5) →
random search over the forest grid with k-fold CV → refit and test metrics.

Not registered as a benchmark query: a faithful search is n_iter × k forest
fits (150 for the field settings), far beyond a smoke-check budget; it is
tested on a small fixture instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectral import engineered_features
from ..operators import learn as L
from ..operators.ranking import cumulative_cut
from . import train as TR


def select_by_importance(importance: DataFrame, threshold: float = 0.95, min_keep: int = 5) -> list[str]:
    """Feature names in importance order up to the cumulative threshold.
    The list has one entry per feature (bounded), so it may be collected."""
    kept = cumulative_cut(importance, "importance_mean",
                          [F.col("importance_mean").desc(), F.col("feature")], [], threshold, min_keep)
    return [r["feature"] for r in kept.orderBy("position").select("feature").collect()]


def optimise_forest(df: DataFrame, target: str, cloud_threshold: float = 20, n_iter: int = 20, k: int = 5,
                    key: str = "sample_id") -> dict:
    """The tuner end to end for one target.  Returns selected features, best
    draw, CV score and test metrics (rmse, mae, r2)."""
    prep, feats = TR.preprocess(df, target, cloud_threshold=cloud_threshold, key=key, impute="none")
    eng = engineered_features(prep)
    feats = feats + [c for c in eng.columns if c not in prep.columns]
    eng = L.impute_median(eng, feats)
    train, test, _ = TR.split_and_scale(eng, feats, key)
    _, base = TR.fit_predict("RandomForest", train, test, feats, key)
    imp = TR.permutation_importance(base, train, feats, key)
    selected = select_by_importance(imp)
    best, cv, _ = TR.random_search(train, selected, n_iter=n_iter, k=k, key=key)
    params = TR.to_mllib(best) if best else {}
    pred, model = TR.fit_predict("RandomForest", train, test, selected, key, rf_params=params)
    met = L.regression_metrics(pred, "label", "prediction").first()
    return {"target": target, "selected_features": selected, "best_params": best, "cv_r2": cv,
            "rmse": met["rmse"], "mae": met["mae"], "r2": met["r2"], "model": model}


def tuning_metrics_frame(spark: SparkSession, results) -> DataFrame:
    """(Target, R2, RMSE, MAE, CV_R2) rows of finished tuning runs."""
    rows = [(r["target"], r["r2"], r["rmse"], r["mae"], float(r["cv_r2"]) if r["cv_r2"] == r["cv_r2"] else None)
            for r in results]
    return spark.createDataFrame(rows, "Target string, R2 double, RMSE double, MAE double, CV_R2 double")

