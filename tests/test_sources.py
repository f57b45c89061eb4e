"""Sources, sinks and schema helpers."""

import os

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import clean as C
from hydrolens.sources import sinks
from hydrolens.sources.csv_io import read_csv, read_csv_text, write_csv
from hydrolens.sources.rejects import split_rejects
from hydrolens.sources.snapshots import read_latest_snapshot


def test_csv_round_trip_and_text_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5, None)], "id int, s string, x double, y double")
    p = str(tmp_path / "c")
    write_csv(df, p)
    back = read_csv(spark, p, df.schema).first()
    assert (back["s"], back["x"], back["y"]) == ("a,b", 2.5, None)
    txt = read_csv_text(spark, p, ["id", "s", "x", "y"]).first()
    assert txt["x"] == "2.5"


def test_conditional_and_dual_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "x int")
    assert sinks.write_if_nonempty(empty, str(tmp_path / "e")) is False
    assert not os.path.exists(tmp_path / "e")
    df = spark.range(10).withColumn("img", F.when(F.col("id") % 2 == 0, F.lit(1)))
    sinks.write_dual(df, str(tmp_path / "all"), str(tmp_path / "sub"), F.col("img").isNotNull())
    assert spark.read.parquet(str(tmp_path / "all")).count() == 10
    assert spark.read.parquet(str(tmp_path / "sub")).count() == 5


def test_run_folders_artifacts_and_models(spark, tmp_path):
    assert sinks.run_folder("/x", "Clorofila a", "20240101_000000") == "/x/clorofila_a_20240101_000000"
    root = str(tmp_path / "runs")
    sinks.write_run_partitioned(spark.range(3), root, "Turbidez", "20240101_000000")
    sinks.write_run_partitioned(spark.range(2), root, "Turbidez", "20240102_000000")
    r = spark.read.parquet(root)
    assert r.where("run_ts = '20240102_000000'").count() == 2 and r.count() == 5
    a = sinks.artifacts_frame(spark, "r1", "best_params", {"n_estimators": 100, "bootstrap": True})
    assert [x["key"] for x in a.orderBy("pos").collect()] == ["n_estimators", "bootstrap"]
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    tr = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "x double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression()]).fit(tr)
    sinks.save_model(model, str(tmp_path / "m"))
    again = sinks.load_model(str(tmp_path / "m"))
    assert again.transform(tr).count() == 3
    sinks.save_model(model.stages[1], str(tmp_path / "m1"))
    assert sinks.load_model(str(tmp_path / "m1")).coefficients == model.stages[1].coefficients
    fitted = {"scaler": {"x": [2.0, 0.8]}, "coef": [1.5], "alpha": 0.1}
    sinks.save_fitted(spark, fitted, str(tmp_path / "f"))
    assert sinks.load_fitted(spark, str(tmp_path / "f")) == fitted


def test_latest_snapshot(spark, tmp_path):
    import time
    root = str(tmp_path / "snap")
    spark.createDataFrame([(1,)], "v int").write.parquet(root + "/features_a")
    time.sleep(1.1)
    # many part files, written one after another: all of them are the snapshot
    spark.range(0, 40, numPartitions=5).selectExpr("CAST(id AS INT) AS v").write.parquet(root + "/features_b")
    time.sleep(1.1)
    spark.createDataFrame([(9,)], "v int").write.parquet(root + "/other")
    got = read_latest_snapshot(spark, root, "features_")
    assert sorted(r["v"] for r in got.collect()) == list(range(40))
    with pytest.raises(FileNotFoundError):
        read_latest_snapshot(spark, root, "none_")


def test_resume_raises_on_unreadable_output(spark, tmp_path):
    from hydrolens.sources.resume import enrich_incrementally
    out = tmp_path / "out"
    df = spark.range(5).withColumnRenamed("id", "k")
    assert enrich_incrementally(spark, df, str(out), "k", lambda d: d) == 1
    assert enrich_incrementally(spark, df, str(out), "k", lambda d: d) == 0
    (out / "part-bad.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        enrich_incrementally(spark, df, str(out), "k", lambda d: d)


def test_reject_split(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 1.0), (2, None, 1.0), (3, "2024-01-01", None)],
                               "id int, d string, v double")
    good, bad = split_rejects(df, {"d": "unparseable date", "v": "unparseable number"})
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reject_reason"] for r in bad.collect()} == {2: "unparseable date", 3: "unparseable number"}


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "Turbidez int, B2 double, B3 double")
    assert C.resolve_alias(df, C.TURBIDITY_ALIASES) == "Turbidez"
    assert C.detect_targets(df) == ["Turbidez"]
    feats = ["B2", "B3", "B4"]
    assert C.present_features(df, feats) == ["B2", "B3"] and feats == ["B2", "B3", "B4"]
    with pytest.raises(ValueError):
        C.require_columns(df, ["clorofila"])
    with pytest.raises(ValueError):
        C.project(df, ["B9"])
    with pytest.raises(ValueError):
        C.threshold_filter(df, "Cloud_Percentage", 10, required=True)
    assert C.threshold_filter(df, "Cloud_Percentage", 10, required=False).count() == 1
    assert C.canonical_order(df, ["Turbidez"]).columns == ["Turbidez", "B2", "B3"]
    assert C.rename_with_units(df, ["B2"], "NTU").columns[1] == "B2 (NTU)"
