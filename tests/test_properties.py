"""Property tests: randomised inputs against plain statements of the rules."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydrolens.operators import clean as C
from hydrolens.operators import learn as L
from hydrolens.operators import profile as P
from hydrolens.operators.reshape import pivot_last_run, run_ids

SCHEMA = "ord long, point string, sample_date string, parameter string, result double, unit string"


def _statement(rows):
    out, cur, key = {}, None, None
    for o, p, d, prm, val, unit in sorted(rows, key=lambda r: r[0]):
        if (p, d) != key:
            if key is not None:
                out[key] = cur
            key, cur = (p, d), {}
        cur[prm] = val
        cur[prm + "_UN"] = unit
    if key is not None:
        out[key] = cur
    return out


row = st.tuples(st.sampled_from(["A", "B", "C", None]), st.sampled_from(["d1", "d2"]), st.sampled_from(["x", "y", "z"]),
                st.one_of(st.none(), st.floats(-5, 5, allow_nan=False)), st.one_of(st.none(), st.sampled_from(["u", "v"])))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=25))
def test_pivot_last_run_random(spark, rows):
    data = [(i * 3 + 1, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["point"], r["sample_date"]): r.asDict() for r in
           pivot_last_run(df, ["point", "sample_date"], "ord", "parameter", "result", "unit", ["x", "y", "z"]).collect()}
    want = _statement(data)
    assert set(got) == set(want)
    for k, d in want.items():
        for c in ("x", "y", "z", "x_UN", "y_UN", "z_UN"):
            assert got[k][c] == d.get(c)
    runs = [r["run_id"] for r in run_ids(df, ["point", "sample_date"], "ord").orderBy("ord").collect()]
    keys = [(r[1], r[2]) for r in data]
    assert runs == list(np.cumsum([1] + [int(a != b) for a, b in zip(keys, keys[1:])]))


def test_iqr_partition_of_input(spark):
    rng = np.random.default_rng(5)
    vals = [float(v) if rng.random() > 0.1 else None for v in rng.lognormal(1, 1, 500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    keep, out = P.iqr_keep(df, "v"), P.iqr_outliers(df, "v")
    nulls = df.where(F.col("v").isNull())
    ids = [r["id"] for r in keep.union(out).union(nulls).collect()]
    assert sorted(ids) == list(range(500))


def test_funnel_drops_add_up(spark):
    df = spark.range(1000).withColumn("a", F.col("id") % 7).withColumn("b", F.when(F.col("id") % 5 == 0, None).otherwise(1))
    f = C.row_funnel(df, [("a<5", F.col("a") < 5), ("b set", F.col("b").isNotNull())]).orderBy("step_no").collect()
    final = df.where((F.col("a") < 5) & F.col("b").isNotNull()).count()
    assert f[0]["rows_before"] - f[-1]["rows_after"] == sum(r["removed"] for r in f) == 1000 - final


def test_split_disjoint_and_stable(spark):
    df = spark.range(777).withColumnRenamed("id", "k")
    a = L.hash_split(df, "k")
    b = L.hash_split(df.repartition(5), "k")
    ta = {r["k"] for r in a.where("is_test").collect()}
    assert ta == {r["k"] for r in b.where("is_test").collect()}
    assert len(ta) == 156 and not ta & {r["k"] for r in a.where("not is_test").collect()}
