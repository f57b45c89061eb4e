"""Distributed row numbers / previous rows / running sums vs pandas."""

import numpy as np
import pandas as pd

from hydrolens.operators.ordered import previous_row, row_number, running_sum
from hydrolens.operators.reshape import pivot_last_run, run_ids


def _frame(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"ord": rng.permutation(n).astype("int64"), "g": rng.integers(0, 4, n).astype("int64"),
                        "v": rng.normal(size=n)})
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_row_number_and_running_sum(spark):
    df, pdf = _frame(spark)
    got = row_number(df, ["ord"], "rn", n=5).toPandas().sort_values("ord")
    assert list(got["rn"]) == list(range(1, len(pdf) + 1))
    g = running_sum(df, "v", ["ord"], "cs", group_by=["g"], n=6).toPandas().sort_values(["g", "ord"])
    want = pdf.sort_values(["g", "ord"]).groupby("g")["v"].cumsum()
    assert np.allclose(g["cs"].to_numpy(), want.to_numpy())


def test_previous_row(spark):
    df, pdf = _frame(spark)
    got = previous_row(df, ["g", "v"], ["ord"], n=9).toPandas().sort_values("ord")
    s = pdf.sort_values("ord")
    assert got["g_prev"].iloc[0] is None or np.isnan(got["g_prev"].iloc[0])
    assert list(got["g_prev"].iloc[1:].astype(int)) == list(s["g"].iloc[:-1])


LONG = [  # ord, point, date, parameter, result, unit
    (1, "A", "2024-01-01", "x", 1.0, "u"), (2, "A", "2024-01-01", "y", 2.0, "u"),
    (3, "A", "2024-01-01", "x", 3.0, None),            # repeated parameter inside a run: last wins
    (4, "B", "2024-01-01", "x", 4.0, "u"),
    (5, "A", "2024-01-01", "y", 5.0, "v"),             # key comes back: replaces the whole earlier row
    (6, "B", "2024-01-02", "x", None, "u"),            # NULL value still wins
]


def _reference_pivot(rows):
    """Plain statement of the field script: dict replaced per contiguous run."""
    out, cur, key = {}, None, None
    for o, p, d, prm, val, unit in sorted(rows):
        if (p, d) != key:
            if key is not None:
                out[key] = cur
            key, cur = (p, d), {}
        cur[prm] = val
        cur[prm + "_UN"] = unit
    out[key] = cur
    return out


def test_pivot_last_run_matches_statement(spark):
    df = spark.createDataFrame(LONG, "ord long, point string, sample_date string, parameter string, result double, unit string")
    got = {(r["point"], r["sample_date"]): r.asDict() for r in
           pivot_last_run(df, ["point", "sample_date"], "ord", "parameter", "result", "unit", ["x", "y"]).collect()}
    want = _reference_pivot(LONG)
    assert set(got) == set(want)
    for k, d in want.items():
        for c in ("x", "y", "x_UN", "y_UN"):
            assert got[k][c] == d.get(c), (k, c)


def test_run_ids(spark):
    df = spark.createDataFrame(LONG, "ord long, point string, sample_date string, parameter string, result double, unit string")
    got = [r["run_id"] for r in run_ids(df, ["point", "sample_date"], "ord").orderBy("ord").collect()]
    assert got == [1, 1, 1, 2, 3, 4]
