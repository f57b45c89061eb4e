"""Validation: ML predictions vs closed-form spectral indices.

Same preprocessing and split as training; the index side is the raw
estimator of the parameter (F07), optionally calibrated to the parameter's
units by least squares on the TRAIN rows (G09, F18).  Both sides are scored
with the same metrics (G11) on the TEST rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import calibrated, raw_estimator
from ..functions.text import PARAMETER_UNITS
from ..operators import learn as L
from . import train as TR


def calibrate(train: DataFrame, parameter: str, target: str = "label") -> dict:
    """OLS target ≈ slope·raw + intercept on the train rows (three scalars)."""
    r = L.ols_calibration(train.withColumn("_raw", raw_estimator(parameter)), "_raw", target).first()
    return {"slope": r["slope"], "intercept": r["intercept"], "r2": r["r2"], "n": r["n"]}


def index_predictions(test: DataFrame, parameter: str, cal: dict | None, key: str = "sample_id") -> DataFrame:
    """Raw (or calibrated) index prediction for each test row."""
    raw = raw_estimator(parameter)
    pred = raw if cal is None else calibrated(raw, F.lit(cal["slope"]), F.lit(cal["intercept"]))
    return test.select(key, "label", pred.alias("prediction"))


def validate(df: DataFrame, parameter: str, target: str, cloud_threshold: float = 10, calibrate_index: bool = True,
             with_ml: bool = True, key: str = "sample_id", ml_kind: str = "RandomForest", ml_features=None):
    """Returns (assembled rows: key, Actual, ML_Predicted, Index_Based, bands;
    metrics rows: method, r2, rmse; unit)."""
    prep, feats = TR.preprocess(df, target, cloud_threshold=cloud_threshold, cloud_required=True, key=key)
    # the index needs raw bands: split the unscaled rows, scale only for the ML model
    split = L.hash_split(prep, key)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    cal = calibrate(train, parameter) if calibrate_index else None
    idx = index_predictions(test, parameter, cal, key).withColumnRenamed("prediction", "Index_Based")
    out = test.select(key, F.col("label").alias("Actual"), *[F.col(b).alias(f"{b}_value") for b in
                                                              ("B2", "B3", "B4", "B5", "B8", "B11")])
    out = out.join(idx.drop("label"), key, "inner")
    metrics = [L.regression_metrics(idx.withColumnRenamed("Index_Based", "prediction"), "label", "prediction")
               .select(F.lit("Index_Based").alias("method"), "r2", "rmse")]
    if with_ml:
        feats = list(ml_features or feats)
        scaler = L.fit_scaler(train, feats)
        tr, te = L.standardise(train, feats, scaler), L.standardise(test, feats, scaler)
        ml, _ = TR.fit_predict(ml_kind, tr, te, feats, key)
        out = out.join(ml.select(key, F.col("prediction").alias("ML_Predicted")), key, "inner")
        metrics.append(L.regression_metrics(ml, "label", "prediction")
                       .select(F.lit("ML_Predicted").alias("method"), "r2", "rmse"))
    m = metrics[0]
    for x in metrics[1:]:
        m = m.unionByName(x)
    return out, m, PARAMETER_UNITS.get(parameter, "")
