"""Exact quantiles against numpy, for few and many value ranges."""

import numpy as np
import pytest

from hydrolens.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _data(n, groups, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    v = rng.lognormal(2, 1, n)
    if ties:
        v = np.round(v, 0)
    return g, v


@pytest.mark.parametrize("n", [None, 2, 40])
@pytest.mark.parametrize("ties", [False, True])
def test_grouped_against_numpy(spark, n, ties):
    g, v = _data(3000, 3, ties=ties)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    got = exact_quantiles(df, "v", PROBS, ["g"], n=n)
    for r in got.collect():
        want = np.quantile(v[g == r["g"]], PROBS)
        assert [r[f"q{i}"] for i in range(len(PROBS))] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_global_with_nulls_and_nan(spark):
    vals = [1.0, None, 2.0, float("nan"), 3.0, 4.0]
    df = spark.createDataFrame([(x,) for x in vals], "v double")
    r = exact_quantiles(df, "v", [0.25, 0.5, 0.75], n=3).first()
    assert (r["q0"], r["q1"], r["q2"]) == pytest.approx((1.75, 2.5, 3.25))


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "v double")
    r = exact_quantiles(empty, "v", [0.5]).collect()
    assert len(r) == 1 and r[0]["q0"] is None
    one = spark.createDataFrame([(7.0,)], "v double")
    assert exact_quantiles(one, "v", [0.25, 0.75]).first()["q1"] == 7.0


def test_null_group_and_group_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), ("b", None)], "g string, v double")
    got = {r["g"]: r["q0"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {"a": 2.0, None: 6.0, "b": None}


def test_repeated_value_is_one_row_and_nothing_stays_cached(spark):
    df = spark.range(100_000).selectExpr("CASE WHEN id % 10 > 0 THEN 0D ELSE CAST(id AS DOUBLE) END AS v")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    r = exact_quantiles(df, "v", [0.5, 0.95], n=16).first()
    v = np.where(np.arange(100_000) % 10 > 0, 0.0, np.arange(100_000))
    assert (r["q0"], r["q1"]) == pytest.approx(tuple(np.quantile(v, [0.5, 0.95])))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
