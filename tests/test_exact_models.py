"""SVR, exact trees, permutation importance and cut points against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolens.operators import learn as L
from hydrolens.operators.importance import permutation_importance
from hydrolens.operators.svr import FeatureMap, fit_svr, rbf_map
from hydrolens.operators.tree import grow_tree, predict_tree


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    x[:40, 1] = np.round(x[:40, 1])  # ties
    y = 20 + 3 * x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=240)
    rows = [(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(240)]
    return spark.createDataFrame(rows, "sample_id long, label double, f0 double, f1 double").repartition(3), x, y


def _objective(x, y, w, b, cost, eps):
    return 0.5 * w @ w + cost * np.maximum(np.abs(y - x @ w - b) - eps, 0).sum()


def test_linear_svr_beats_every_nearby_point(table):
    df, x, y = table
    m = fit_svr(df, ["f0", "f1"], cost=0.5, epsilon=0.2, tol=1e-8)
    best = _objective(x, y, m.w, m.b, 0.5, 0.2)
    assert m.objective == pytest.approx(best, rel=1e-9) and m.gap <= 1e-8 * best and m.n == 240
    rng = np.random.default_rng(0)
    for scale in (1e-4, 1e-2, 1.0):
        for _ in range(300):
            d = rng.normal(size=3) * scale
            assert _objective(x, y, m.w + d[:2], m.b + d[2], 0.5, 0.2) >= best - m.gap
    got = {r["sample_id"]: r["prediction"] for r in m.transform(df).collect()}
    assert got[5] == pytest.approx(x[5] @ m.w + m.b)


def test_rbf_svr_gap_and_missing_rows(table, spark):
    df, x, y = table
    z = rbf_map(2, n_components=30)
    holes = df.unionByName(spark.createDataFrame([(900, 1.0, None, 2.0), (901, None, 1.0, 2.0), (902, 1.0, math.nan, 1.0)],
                                                 df.schema))
    m = fit_svr(holes, ["f0", "f1"], feature_map=z)
    assert m.n == 240 and 0 <= m.gap <= 1e-5 * m.objective
    f = z(x)
    assert m.objective == pytest.approx(_objective(f, y, m.w, m.b, 1.0, 0.1))
    got = {r["sample_id"]: r["prediction"] for r in m.transform(holes).collect()}
    assert got[7] == pytest.approx(f[7] @ m.w + m.b) and got[900] is None and got[902] is None and got[901] is not None
    with pytest.raises(RuntimeError, match="gap"):
        fit_svr(df, ["f0", "f1"], max_passes=3)
    with pytest.raises(ValueError):
        fit_svr(df.where("false"), ["f0"], feature_map=FeatureMap())


def _brute_tree(x, y, names, depth, max_depth, split, leaf, node=""):
    out = {node: (depth, len(y), round(float(np.mean(y)), 6), None, None)}
    if (max_depth is not None and depth >= max_depth) or len(y) < split or np.var(y) == 0:
        return out
    best = None
    for j in sorted(range(len(names)), key=lambda j: names[j]):
        vs = np.unique(x[:, j])
        for a, b in zip(vs, vs[1:]):
            left = x[:, j] <= a
            n = int(left.sum())
            if min(n, len(y) - n) < leaf:
                continue
            gain = round(y[left].sum() ** 2 / n + y[~left].sum() ** 2 / (len(y) - n) - y.sum() ** 2 / len(y), 6)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, j, (a + b) / 2, left)
    if best is None:
        return out
    _, j, t, left = best
    out[node] = (*out[node][:3], names[j], round(float(t), 9))
    out |= _brute_tree(x[left], y[left], names, depth + 1, max_depth, split, leaf, node + "L")
    return out | _brute_tree(x[~left], y[~left], names, depth + 1, max_depth, split, leaf, node + "R")


def test_tree_is_the_exact_one(table):
    df, x, y = table
    nodes = grow_tree(df, ["f0", "f1"], max_depth=3, min_samples_split=30, min_samples_leaf=7)
    got = {r["node"]: (r["depth"], r["n"], round(r["value"], 6), r["feature"],
                       None if r["threshold"] is None else round(r["threshold"], 9)) for r in nodes.collect()}
    want = _brute_tree(x, y, ["f0", "f1"], 0, 3, 30, 7)
    assert got == want
    pred = {r["sample_id"]: round(r["prediction"], 6) for r in predict_tree(df, nodes, ["f0", "f1"]).collect()}
    assert len(pred) == 240 and set(pred.values()) == {v[2] for v in want.values() if v[3] is None}


def test_tree_of_unlimited_depth_fits_small_data(spark):
    rows = [(i, float(i % 5), float(i), None if i % 4 == 0 else 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id long, label double, f0 double, f1 double")
    nodes = grow_tree(df, ["f0", "f1"])
    pred = predict_tree(df, nodes, ["f0", "f1"]).collect()
    assert all(r["prediction"] == pytest.approx(r["label"]) for r in pred)
    assert grow_tree(df.where("false"), ["f0"]).count() == 0


def test_permutation_blocks(spark):
    n = 150
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2))
    df = spark.createDataFrame([(i, float(5 * a + 1), float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "sample_id long, label double, f0 double, f1 double")
    got = {r["feature"]: r for r in permutation_importance(
        df, "sample_id", "label", ["f0", "f1"], lambda d: d.withColumn("prediction", F.get("f", F.lit(0)) * 5 + 1),
        repeats=6).collect()}
    assert got["f0"]["importance_mean"] > 1 and got["f0"]["importance_std"] > 0
    assert got["f1"]["importance_mean"] == 0 == got["f1"]["importance_std"]


def test_cut_points_with_nearly_all_keys_missing(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    total, cuts = L.hash_cuts(df, "k", [1, 17_999, 18_000, 18_001, 20_000])
    hs = sorted(h or "" for h, in df.select(L.split_hash("k")).collect())
    assert total == 20_000 and cuts == {r: hs[r - 1] for r in (1, 17_999, 18_000, 18_001, 20_000)}
    with pytest.raises(ValueError, match="share one k"):
        L.hash_split(df, "k")
    one_key = spark.range(3000).select(F.lit(7).alias("k"))
    assert L.hash_cuts(one_key, "k", [5])[1] == {5: one_key.select(L.split_hash("k")).first()[0]}
