"""Learning pieces: split, folds, scaler, metrics, linear models vs numpy,
and the MLlib jobs on a small fixture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolens.operators import learn as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=n) + 3
    data = [(i, float(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(data, "sample_id long, label double, f0 double, f1 double, f2 double"), x, y


def test_split_and_folds(rows):
    df, _, _ = rows
    s = L.hash_split(df, "sample_id").cache()
    n_test = s.where("is_test").count()
    assert n_test == math.ceil(0.2 * 400)
    f = L.assign_folds(s.where(~F.col("is_test")), "sample_id", 5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [64, 64, 64, 64, 64]


def test_ridge_matches_normal_equations(rows):
    df, x, y = rows
    st = L.gram_stats(df, ["f0", "f1", "f2"], "label")[()]
    w, b = L.ridge_solve(st, 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w_ref = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(w, w_ref) and b == pytest.approx(y.mean() - x.mean(0) @ w_ref)


def test_lasso_shrinks_and_recovers(rows):
    df, x, y = rows
    st = L.gram_stats(df, ["f0", "f1", "f2"], "label")[()]
    w0, _ = L.lasso_solve(st, 1e-6)
    ols = np.linalg.lstsq(np.c_[x, np.ones(len(y))], y, rcond=None)[0]
    assert np.allclose(w0, ols[:3], atol=1e-4)
    w_big, b_big = L.lasso_solve(st, 100.0)
    assert np.allclose(w_big, 0) and b_big == pytest.approx(y.mean())


def test_metrics_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "a double, p double")
    assert L.regression_metrics(df, "a", "p").first()["r2"] == 1.0
    df2 = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "a double, p double")
    assert L.regression_metrics(df2, "a", "p").first()["r2"] == 0.0


def test_scaler_uses_population_std(rows):
    df, x, _ = rows
    sc = L.fit_scaler(df, ["f0"])
    assert sc["f0"][1] == pytest.approx(x[:, 0].std(ddof=0))


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert [r["c"] for r in L.category_codes(df, "c").orderBy("c").collect()] == [-1, 0, 1, 1]


def test_models_and_search_small(spark, rows):
    from hydrolens.plans import train as TR
    df, _, _ = rows
    feats = ["f0", "f1", "f2"]
    s = L.hash_split(df, "sample_id")
    tr, te = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    for kind in ("Ridge", "Lasso"):
        pred, _ = TR.fit_predict(kind, tr, te, feats)
        assert L.regression_metrics(pred, "label", "prediction").first()["r2"] > 0.8
    pred, m = TR.fit_predict("RandomForest", tr, te, feats, rf_params={"n_trees": 10, "max_depth": 5})
    assert pred.count() == 80
    pi = {r["feature"]: r["importance_mean"] for r in TR.permutation_importance(m, tr, feats, repeats=2).collect()}
    assert pi["f0"] > pi["f2"]
    best, score, results = TR.random_search(tr, feats, n_iter=3, k=2, parallelism=3)
    assert len(results) == 3 and (best is None or score == max(r[1] for r in results if not math.isnan(r[1])))


def test_tuning_job_small(spark):
    from hydrolens.plans import tune
    rng = np.random.default_rng(1)
    n = 300
    data = []
    for i in range(n):
        b = rng.uniform(100, 900, 6)
        data.append((i, 5.0, float(b[1] / b[2] * 10 + rng.normal()), *map(float, b), 1, 1))
    df = spark.createDataFrame(data, "sample_id long, Cloud_Percentage double, turbidity double, B2 double, "
                                     "B3 double, B4 double, B5 double, B8 double, B11 double, Month int, Season int")
    from hydrolens.functions.spectral import with_spectral_indices
    df = with_spectral_indices(df.withColumn("Image_Date", F.current_date()))
    res = tune.optimise_forest(df, "turbidity", n_iter=2, k=2)
    assert 5 <= len(res["selected_features"]) <= 19 and res["r2"] is not None


def test_failure_isolation_per_target(spark):
    from hydrolens.functions.spectral import with_spectral_indices
    from hydrolens.plans import train as TR
    rng = np.random.default_rng(2)
    data = []
    for i in range(200):
        b = rng.uniform(100, 900, 6)
        data.append((i, 5.0, float(b[0] / 100 + rng.normal()), *map(float, b), 3, 2))
    df = spark.createDataFrame(data, "sample_id long, Cloud_Percentage double, turbidity double, B2 double, "
                                     "B3 double, B4 double, B5 double, B8 double, B11 double, Month int, Season int")
    df = with_spectral_indices(df.withColumn("Image_Date", F.current_date()))
    rows, status = TR.train_all_targets(df, ["turbidity", "clorofila"], models=["Ridge"], with_cv=False)
    st = {t: err for t, _, err in status}
    assert st["turbidity"] is None and "clorofila" in st and st["clorofila"]
    assert [r[1] for r in rows] == ["Ridge"] and rows[0][4] is not None
