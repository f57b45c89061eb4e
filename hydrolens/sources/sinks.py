"""Sinks: conditional, dual, timestamped run folders, artefacts, models."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug_py
from .csv_io import write_csv


def write_if_nonempty(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Write only when there is at least one row (checks one row, not a count)."""
    if df.isEmpty():
        return False
    (write_csv(df, path) if fmt == "csv" else df.write.mode("overwrite").parquet(path))
    return True


def write_dual(df: DataFrame, all_path: str, subset_path: str, subset_pred, fmt: str = "parquet") -> None:
    """Complete set and a filtered subset from one cached computation."""
    df = df.cache()
    try:
        for d, p in ((df, all_path), (df.where(subset_pred), subset_path)):
            (d.write.mode("overwrite").parquet(p) if fmt == "parquet" else write_csv(d, p))
    finally:
        df.unpersist()


def run_stamp(now: _dt.datetime | None = None) -> str:
    """yyyyMMdd_HHmmss stamp of a run."""
    return (now or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")


def run_folder(root: str, target: str, stamp: str | None = None) -> str:
    """``<root>/<slug(target)>_<stamp>`` for one run's outputs."""
    return f"{root.rstrip('/')}/{slug_py(target)}_{stamp or run_stamp()}"


def write_run_partitioned(df: DataFrame, root: str, target: str, stamp: str | None = None) -> None:
    """Append a run's rows partitioned by (target, run_ts): later runs never
    overwrite earlier ones, and readers prune by partition."""
    stamp = stamp or run_stamp()
    (df.withColumn("target", F.lit(slug_py(target))).withColumn("run_ts", F.lit(stamp))
     .write.mode("append").partitionBy("target", "run_ts").parquet(root))


def artifacts_frame(spark: SparkSession, run: str, kind: str, values) -> DataFrame:
    """Small key/value or list artefacts (feature names, best parameters,
    metrics row) as rows (run, kind, pos, key, value)."""
    if isinstance(values, dict):
        rows = [(run, kind, i, str(k), str(v)) for i, (k, v) in enumerate(values.items())]
    else:
        rows = [(run, kind, i, None, str(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run string, kind string, pos int, key string, value string")


def save_model(model, path: str) -> None:
    """Persist any fitted MLlib model, or a pipeline of them (replaces pickles)."""
    from pyspark.ml import PipelineModel
    whole = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    whole.write().overwrite().save(path)


def load_model(path: str):
    """What :func:`save_model` wrote: the model itself, or the pipeline."""
    from pyspark.ml import PipelineModel
    whole = PipelineModel.load(path)
    return whole.stages[0] if len(whole.stages) == 1 else whole


def save_fitted(spark: SparkSession, values: dict, path: str) -> None:
    """Persist fitted scalars (scaler, medians, linear coefficients) as one JSON row."""
    spark.createDataFrame([(json.dumps(values),)], "fitted string").coalesce(1).write.mode("overwrite").json(path)


def load_fitted(spark: SparkSession, path: str) -> dict:
    """What :func:`save_fitted` wrote; tuples come back as lists."""
    return json.loads(spark.read.schema("fitted string").json(path).first()["fitted"])
