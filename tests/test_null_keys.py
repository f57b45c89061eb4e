"""NULL group keys, unlisted labels, repeated keys, empty bins and other rows
that must not get lost."""

import pytest

from hydrolens.functions.dates import parse_date_multi
from hydrolens.functions.numeric import to_double_lenient
from hydrolens.operators import joins as J
from hydrolens.operators import learn as L
from hydrolens.operators import ordered as O
from hydrolens.operators import profile as P
from hydrolens.operators import ranking as R
from hydrolens.operators import reshape as RS


def _values(spark):
    return spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 3, 5.0), (None, 4, 6.0), ("b", 5, None)],
                                 "g string, k long, v double")


def test_sorted_pairs_and_latest_keep_the_null_group(spark):
    df = _values(spark)
    got = sorted((r.k, r.position) for r in R.sorted_pairs(df, "v", "k", ["g"]).collect())
    assert got == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 1)]
    assert sorted(r.k for r in J.latest_per_group(df, ["g"], "k").collect()) == [2, 4, 5]


def test_boxplot_and_outliers_keep_the_null_group(spark):
    rows = [(None, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])] + [("a", i, float(v)) for i, v in enumerate([1, 2, 3])]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    got = {r.g: (r.n, r.n_fliers) for r in P.boxplot_stats(df, "v", ["g"]).collect()}
    assert got == {None: (5, 1), "a": (3, 0)}
    assert [(r.g, r.v) for r in P.iqr_outliers(df, "v", ["g"]).collect()] == [(None, 100.0)]
    assert {r.g: r.median for r in P.target_summary(df, "v", ["g"]).collect()} == {None: 3.0, "a": 2.0}


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 3.0), ("a", 3.0), (None, 1.0), ("a", float("nan"))], "g string, v double")
    got = [(r.bin, r["count"]) for r in P.histogram(df, "v", 3).orderBy("bin").collect()]
    assert got == [(0, 1), (1, 1), (2, 2)]
    by = {(r.g, r.bin): r["count"] for r in P.histogram(df, "v", 3, ["g"]).collect()}
    assert by == {("a", 0): 1, ("a", 1): 0, ("a", 2): 2, (None, 0): 1, (None, 1): 0, (None, 2): 0}
    assert P.histogram(df.where("1 = 0"), "v", 3).count() in (0, 3)


def test_mean_of_large_values_and_nan(spark):
    df = spark.createDataFrame([("a", 6e19)] * 4 + [("b", 1.0), ("b", float("nan"))], "g string, v double")
    got = {r.g: (r["mean"], r.n_samples) for r in P.group_mean_count(df, "g", "v").collect()}
    assert got == {"a": (6e19, 4), "b": (1.0, 1)}


def test_pivot_takes_every_parameter(spark):
    df = spark.createDataFrame([(1, "p", "x", 1.0, "u"), (2, "p", "new", 2.0, None)],
                               "ord long, point string, parameter string, result double, unit string")
    w = RS.pivot_last_run(df, ["point"], "ord", "parameter", "result", "unit")
    assert w.columns == ["point", "new", "new_UN", "x", "x_UN"] and tuple(w.first()) == ("p", 2.0, None, 1.0, "u")


def test_repeated_lookup_key(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    look = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "k int, o int, v string")
    with pytest.raises(ValueError, match="repeats"):
        J.lookup_left(df, look, "k")
    assert sorted(map(str, J.lookup_left(df, look, "k", order="o").collect())) == ["Row(k=1, v='new')", "Row(k=2, v=None)"]
    with pytest.raises(ValueError, match="repeats"):
        J.override(df.selectExpr("k", "'x' AS v"), look.select("k", "v"), "k", ["v"])


def test_long_source_keeps_its_values(spark):
    df = spark.createDataFrame([("S1", "05/03/2021", "Turbidez (NTU)", "2,5"), ("S1", "05/03/2021", "Clorofila a", "1,25"),
                                ("S2", "06/03/2021", "pH", "7")], "sitio_cod string, data string, paramet string, result string")
    assert {(r.turbidity, r.chlorophyll) for r in J.harmonise(df, "z").collect()} == {(2.5, None), (None, 1.25), (None, None)}


def test_number_and_date_forms(spark):
    df = spark.createDataFrame([("1d",), ("1f",), ("NaN",), ("Infinity",), (" 2,5 ",), ("-.5",), ("1e3",), ("",), ("1,2,3",)], "t string")
    assert [r[0] for r in df.select(to_double_lenient("t")).collect()] == [None, None, None, None, 2.5, -0.5, 1000.0, None, None]
    df = spark.createDataFrame([("5/3/2021",), ("2021-3-5",), ("2021-03-05 10:00:00",), ("05/03/2021",), ("2021-03-05T10:00",), ("x",)], "t string")
    assert [str(r[0]) for r in df.select(parse_date_multi("t")).collect()] == ["2021-03-05"] * 5 + ["None"]


def test_hot_first_value_is_cut_along_the_second(spark):
    from pyspark.sql import functions as F
    df = spark.range(20_000).selectExpr("CASE WHEN id % 5 > 0 THEN 0D ELSE CAST(id AS DOUBLE) END AS v", "id")
    r = O.with_range_id(df, "v", 16, then="id")
    assert r.groupBy("_hl_pid").count().agg(F.max("count")).first()[0] < 4000
    got = O.row_number(df, ["v", "id"], "rn", n=16).select("v", "id", "rn").toPandas().sort_values("rn")
    want = df.toPandas().sort_values(["v", "id"])
    assert got.id.tolist() == want.id.tolist() and got.rn.tolist() == list(range(1, 20_001))


def test_split_and_folds_are_plain_columns(spark):
    import hashlib
    import math
    df = spark.range(7001).selectExpr("id AS k")
    order = sorted(range(7001), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())
    s = L.hash_split(df, "k")
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert {r.k for r in s.where("is_test").collect()} == set(order[:math.ceil(0.2 * 7001)])
    folds = {r.k: r.fold for r in L.assign_folds(df, "k", 5).collect()}
    ends = L.fold_ends(7001, 5)
    assert all(folds[k] == next(f for f, e in enumerate(ends) if i < e) for i, k in enumerate(order))
    assert L.hash_split(df.where("k < 0"), "k").count() == 0


def test_nested_search_in_ridge_scores(spark):
    import hashlib

    import numpy as np
    rng = np.random.default_rng(4)
    n = 83
    x = rng.normal(size=n)
    y = 2 * x + rng.normal(size=n) * 3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x double, label double")
    got = L.fold_r2_linear(df, ["x"], "label", "ridge", "k", 5, alphas=[0.1, 10.0, 100.0])
    order = sorted(range(n), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())

    def fit(rows, alpha):
        a, b = x[rows], y[rows]
        w = ((a - a.mean()) @ (b - b.mean())) / (((a - a.mean()) ** 2).sum() + alpha)
        return w, b.mean() - w * a.mean()

    def r2(rows, w, b):
        return 1 - ((y[rows] - b - w * x[rows]) ** 2).sum() / ((y[rows] - y[rows].mean()) ** 2).sum()

    def folds(rows):
        e = [0, *L.fold_ends(len(rows), 5)]
        return [rows[a:b] for a, b in zip(e, e[1:])]
    for f, test in enumerate(folds(order)):
        train = [k for k in order if k not in set(test)]
        best = max([0.1, 10.0, 100.0], key=lambda a: np.mean([
            r2(part, *fit([k for k in train if k not in set(part)], a)) for part in folds(train)]))
        assert got[f] == pytest.approx(r2(test, *fit(train, best)), rel=1e-9)


def test_a_run_is_written_whole(spark, tmp_path):
    from core_paths import SF_SMALL
    from hydrolens.plans import standins as SI
    from hydrolens.plans import train as T
    from hydrolens.sources import sinks
    res = T.train_models(SI.training_rows(spark, SF_SMALL), "turbidity", models=["Ridge"])
    folder = T.write_run(spark, res, str(tmp_path), "20240101_000000")
    assert spark.read.parquet(f"{folder}/comparison").first().model == "Ridge"
    assert spark.read.parquet(f"{folder}/cv_scores").count() == 5
    assert spark.read.parquet(f"{folder}/predictions").where("prediction IS NOT NULL").count() > 0
    assert sinks.load_fitted(spark, f"{folder}/models/Ridge") == res["models"]["Ridge"]
    assert set(sinks.load_fitted(spark, f"{folder}/scaler")) == set(res["features"])
