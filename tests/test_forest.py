"""Forest grown in pieces: the same trees whatever the piece size, full depth,
permuted scores, and a saved copy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hydrolens.operators import forest, importance
from hydrolens.operators import learn as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 20, 600), rng.integers(0, 30, 600), rng.normal(size=600)])
    y = 3.0 * x[:, 0] - x[:, 1] + rng.integers(0, 9, 600)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(600)],
                               "k long, label double, a double, b double, c double")
    return L.assemble(df.withColumn("f", F.array("a", "b", "c")), ["a", "b", "c"]).repartition(5)


def _scores(model, rows):
    return {r["k"]: r["prediction"] for r in model.transform(rows).select("k", "prediction").collect()}


def test_pieces_give_the_trees_of_one_piece(spark, rows, tmp_path):
    kind = L.random_forest(n_trees=3, feature_subset="sqrt")
    whole, cut = kind.fit(rows), kind.fit(rows.repartition(3), piece=150)
    assert whole.parts.count() == 3 and cut.parts.count() > 6 and len(cut.tops[0][0]) > 3
    a, b = _scores(whole, rows), _scores(cut, rows)
    assert len(a) == 600 and all(a[k] == pytest.approx(b[k]) for k in a)
    assert whole.featureImportances.toArray() == pytest.approx(cut.featureImportances.toArray())
    assert sum(whole.featureImportances.toArray()) == pytest.approx(1)
    cut.save(str(tmp_path / "m"))
    assert _scores(forest.ForestModel.load(spark, str(tmp_path / "m")), rows) == b


def test_a_full_tree_holds_every_group_and_depth_one_the_best_cut(rows):
    few = rows.where("c > 0").withColumn("features", array_to_vector(F.array("a", "b")))
    model = L.random_forest(n_trees=1, bootstrap=False).fit(few, piece=120)
    means = {(r["a"], r["b"]): r["m"] for r in few.groupBy("a", "b").agg(F.avg("label").alias("m")).collect()}
    for r in model.transform(few).collect():
        assert r["prediction"] == pytest.approx(means[r["a"], r["b"]])
    stump = L.random_forest(n_trees=1, bootstrap=False, max_depth=1).fit(few)
    d = few.select("a", "b", "label").toPandas()
    sse = {(f, c): sum(((g - g.mean()) ** 2).sum() for _, g in d.label.groupby(d[f] <= c))
           for f in ("a", "b") for c in sorted(set(d[f]))[:-1]}
    f, c = min(sse, key=sse.get)
    for r in stump.transform(few).collect():
        side = d.label[(d[f] <= c) == (r[f] <= c)]
        assert r["prediction"] == pytest.approx(side.mean())


def test_permuted_scores_are_those_of_the_copies(rows):
    model = L.random_forest(n_trees=4, max_depth=6).fit(rows)
    blocks = importance.hash_blocks(rows, "k", "label", ["a", "b", "c"], block=250)
    got = model.permuted(blocks, 2)
    plain = model.transform(importance.permuted(blocks, 3, 2).withColumn("features", array_to_vector("f")))
    order = ["feature", "repeat", "label", "prediction"]
    a, b = (sorted(map(tuple, d.select(*order).collect())) for d in (got, plain))
    assert len(a) == 3600 and [r[:3] for r in a] == [r[:3] for r in b]
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b])


class _Counted:
    """A tree's nodes, and how many are looked up."""

    def __init__(self, nodes):
        self.nodes, self.n = nodes, 0

    def take(self, at):
        self.n += len(at)
        return self.nodes.take(at)


def _table(n, p, bins, seed=5):
    rng = np.random.default_rng(seed)
    return rng.integers(0, bins, (n, p)).astype(np.uint8), rng.normal(size=n), rng.integers(1, 4, n).astype(np.uint8)


def test_copies_of_a_row_are_not_walked_one_by_one():
    x, y, w = _table(6000, 12, 16)
    tree = forest._grow(x, y, w, 0, 1, 30, 16, 1, 12, 42)[:4]
    rows, turns = x[:300], [(j, np.roll(x[:300, j], -k)) for k in range(1, 11) for j in range(12)]
    nodes, value = forest._packed(tree)
    assert (forest._said((nodes, value), rows) == value[forest._walk(tree, rows)]).all()
    wanted = forest._wanted(rows, turns, 16)
    held, counted = np.zeros(wanted.size), _Counted(nodes)
    forest._spread((counted, value), rows, np.full(12, 15), wanted, held)
    told = np.cumsum(held.reshape(wanted.shape), axis=2)
    steps = 0
    for j, v in turns:
        copy = rows.copy()
        copy[:, j] = v
        single = _Counted(nodes)
        want = forest._said((single, value), copy)
        steps += single.n
        assert told[np.arange(300), j, v] == pytest.approx(want)
    assert counted.n * 4 < steps


def test_nodes_of_few_rows_split_as_others(monkeypatch):
    x, y, w = _table(3000, 5, 20)
    y = np.round(y)  # many equal gains
    for subset, least in ((5, 1), (2, 4)):
        args = (x, y, w, 7, 1, 30, 20, least, subset, 42)
        monkeypatch.setattr(forest, "FEW", 1)
        want = forest._grow(*args)
        monkeypatch.setattr(forest, "FEW", 6)
        monkeypatch.setattr(forest, "CELLS", 300)
        got = forest._grow(*args)
        monkeypatch.undo()
        for a, b in zip(got, want):
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_few_trees_are_told_by_the_task_that_scores_them(rows):
    model = L.random_forest(n_trees=4, max_depth=6).fit(rows)
    blocks = importance.hash_blocks(rows, "k", "label", ["a", "b", "c"], block=20)
    plan = model.permuted(blocks, 2)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan
    assert model.permuted(blocks, 2).count() == 3600
