"""Golden tests: recompute stored outputs of the field scripts from their stored inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from core_paths import fixture_path
from hydrolens.functions.geo import with_utm_inverse
from hydrolens.functions.spectral import calibrated, normalized_difference
from hydrolens.operators import learn as L
from hydrolens.operators import profile as P
from hydrolens.operators.joins import lookup_left, override
from hydrolens.sources.csv_io import read_csv

WIDE_SCHEMA = ("PONTO string, DATA date, `Clorofila a` double, `Transparência da Água` double, "
               "`Sólidos Dissolvidos` double, `Sólidos Dissolvidos Totais` double, `Sólidos Sedimentáveis` double, "
               "`Sólidos Suspensos Totais` double, `Sólidos Totais` double, Turbidez double")


@pytest.fixture(scope="module")
def located(spark):
    return read_csv(spark, fixture_path("wide_samples_located.csv"),
                    WIDE_SCHEMA + ", Latitude double, Longitude double")


def test_missing_profile(located):
    got = {r["column"]: (r["missing"], r["pct_missing"]) for r in P.missing_profile(located).collect()}
    want = pd.read_csv(fixture_path("golden_missing_profile.csv"), index_col=0)
    assert len(got) == len(want)
    for col, row in want.iterrows():
        assert got[col][0] == row["Valores Ausentes"], col
        assert got[col][1] == pytest.approx(row["Porcentagem (%)"], abs=1e-9), col


@pytest.mark.parametrize("col,golden", [("Clorofila a", "golden_mean_chlorophyll.csv"),
                                         ("Turbidez", "golden_mean_turbidity.csv")])
def test_group_mean_count(located, col, golden):
    got = {r["PONTO"]: (r["mean"], r["n_samples"])
           for r in P.group_mean_count(located, "PONTO", col).collect()}
    want = pd.read_csv(fixture_path(golden))
    assert len(got) == len(want)
    for _, row in want.iterrows():
        assert got[row["PONTO"]][0] == pytest.approx(row["Média"], abs=1e-12)
        assert got[row["PONTO"]][1] == row["Número de Amostras"]


@pytest.mark.parametrize("col,golden,n", [("Clorofila a", "golden_outliers_chlorophyll.csv", 23),
                                           ("Turbidez", "golden_outliers_turbidity.csv", 19)])
def test_iqr_outliers(spark, col, golden, n):
    pdf = pd.read_csv(fixture_path("wide_samples_located.csv"))
    pdf["row_index"] = range(len(pdf))  # file order of the stored input
    df = spark.createDataFrame(pdf[["row_index", "PONTO", "DATA", col]].rename(columns={col: "v"}))
    df = df.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = sorted((r["row_index"], r["PONTO"], r["DATA"], r["v"]) for r in P.iqr_outliers(df, "v").collect())
    want = pd.read_csv(fixture_path(golden), index_col=0)
    assert len(got) == n == len(want)
    assert [g[0] for g in got] == list(want.index)
    assert [g[3] for g in got] == pytest.approx(list(want[col]))


def test_iqr_fences_match_stored(spark):
    pdf = pd.read_csv(fixture_path("wide_samples_located.csv"))
    df = spark.createDataFrame(pdf[["Clorofila a"]].rename(columns={"Clorofila a": "v"}).dropna())
    f = P.iqr_fences(df, "v").first()
    assert f["lower"] == pytest.approx(-1.9375) and f["upper"] == pytest.approx(4.5625)


def _overrides():
    lines = open(fixture_path("station_overrides.txt"), encoding="utf-8").read().split("TO:")[1].strip().splitlines()
    out = []
    for ln in lines:
        point, coords = ln.split("\t")
        lat, lon = (float(x) for x in coords.split(","))
        out.append((point.strip(), lat, lon))
    return out


def test_utm_inverse_and_overrides(spark):
    st = read_csv(spark, fixture_path("stations_utm.csv"),
                  "point string, X int, Y int, description string")
    ll = with_utm_inverse(st, "X", "Y", zone=22, south=True, lat="latitude", lon="longitude")
    fixes = spark.createDataFrame(_overrides(), "point string, latitude double, longitude double")
    fixed = override(ll.select("point", "latitude", "longitude"), fixes, "point", ["latitude", "longitude"])
    got = {r["point"]: (r["latitude"], r["longitude"]) for r in fixed.collect()}
    want = pd.read_csv(fixture_path("stations_lat_lon.csv"))
    overridden = {p for p, _, _ in _overrides()}
    assert len(got) == len(want) == 12
    for _, row in want.iterrows():
        p = row["Ponto de amostragem"]
        tol = 1e-12 if p in overridden else 1e-8  # the stored file and the override list differ by 1 ulp
        assert abs(got[p][0] - row["Latitude"]) <= tol, p
        assert abs(got[p][1] - row["Longitude"]) <= tol, p


def test_lookup_left_reproduces_located_samples(spark, located):
    wide = read_csv(spark, fixture_path("wide_samples.csv"), WIDE_SCHEMA)
    st = read_csv(spark, fixture_path("stations_lat_lon.csv"),
                  "PONTO string, X int, Y int, description string, Latitude double, Longitude double")
    got = lookup_left(wide, st.select("PONTO", "Latitude", "Longitude"), "PONTO")
    assert got.count() == 267
    diff = got.exceptAll(located.select(*got.columns))
    assert diff.count() == 0


@pytest.mark.parametrize("kind,golden,metrics,param", [
    ("turbidity", "golden_validation_turbidity.csv", "golden_validation_metrics_turbidity.csv", "Turbidez"),
    ("chlorophyll", "golden_validation_chlorophyll.csv", "golden_validation_metrics_chlorophyll.csv", "Clorofila a"),
])
def test_validation_metrics_and_calibrated_index(spark, kind, golden, metrics, param):
    pdf = pd.read_csv(fixture_path(golden))
    pdf.columns = ["actual", "ml", "index", "B2", "B3", "B4", "B5", "B8", "B11"]
    df = spark.createDataFrame(pdf)
    # metrics of both methods equal the stored ones
    m = pd.read_csv(fixture_path(metrics)).set_index("Method")
    for method, col in (("ML_Model", "ml"), ("Index_Based", "index")):
        r = L.regression_metrics(df, "actual", col).first()
        assert r["r2"] == pytest.approx(m.loc[method, "R2"], rel=1e-9)
        assert r["rmse"] == pytest.approx(m.loc[method, "RMSE"], rel=1e-9)
    # the index column is an exact linear calibration of the raw estimator
    from hydrolens.functions.spectral import raw_estimator
    raw = df.select(raw_estimator(param).alias("raw"), "index").toPandas()
    slope, intercept = np.polyfit(raw["raw"], raw["index"], 1)
    cal = df.select(calibrated(raw_estimator(param), F.lit(slope), F.lit(intercept)).alias("c"), "index").toPandas()
    assert np.allclose(cal["c"], cal["index"], rtol=1e-9, atol=1e-9)
    assert normalized_difference is not None


PARAMS = ["Clorofila a", "Transparência da Água", "Sólidos Dissolvidos", "Sólidos Dissolvidos Totais",
          "Sólidos Sedimentáveis", "Sólidos Suspensos Totais", "Sólidos Totais", "Turbidez"]


def test_prepare_field_data_end_to_end(spark):
    """Long measurements -> last-run pivot -> project -> UTM + overrides ->
    lookup reproduces the stored located samples."""
    from hydrolens.plans.prepare import prepare_field_data
    wide = pd.read_csv(fixture_path("wide_samples.csv"))
    long = []
    for i, r in wide.iterrows():
        for j, p in enumerate(PARAMS):  # empty results stay as rows with NULL, as in a long file
            long.append((i * 100 + j, r["PONTO"], r["DATA"], p, None if pd.isna(r[p]) else float(r[p]), None))
    ldf = spark.createDataFrame(long, "ord long, point string, sample_date string, parameter string, "
                                      "result double, unit string")
    st = read_csv(spark, fixture_path("stations_utm.csv"), "point string, X int, Y int, description string")
    fixes = spark.createDataFrame(_overrides(), "point string, latitude double, longitude double")
    out = prepare_field_data(ldf, st, fixes, PARAMS, PARAMS).toPandas()
    want = pd.read_csv(fixture_path("wide_samples_located.csv"))
    assert len(out) == len(want) == 267
    got = out.set_index(["point", "sample_date"]).sort_index()
    exp = want.set_index(["PONTO", "DATA"]).sort_index()
    for p in PARAMS:
        assert np.allclose(got[p].to_numpy(dtype=float), exp[p].to_numpy(dtype=float), equal_nan=True), p
    assert np.allclose(got["latitude"].to_numpy(), exp["Latitude"].to_numpy(), atol=1e-8)
    assert np.allclose(got["longitude"].to_numpy(), exp["Longitude"].to_numpy(), atol=1e-8)
