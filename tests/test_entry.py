"""Driver contract: entry() runs; every query has an oracle unless it is a
model fit; oracle and Spark agree on the smallest scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from core_paths import SF_SMALL

ROWS_ONLY = {"rf_regression", "gbt_regression", "lasso_cv", "ridge_cv", "rff_huber", "svr_rbf", "kfold_rf",
             "feature_importance", "permutation_importance", "model_comparison", "validation_assembly"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "NDCI" in df.columns


def test_every_query_has_oracle_or_is_a_fit():
    q, s = E.queries(), E.oracle_sql()
    extra = {"pipeline"} | (set(E.LLM.QUERIES) if E.LLM else set())
    assert set(q) - set(s) - extra == ROWS_ONLY
    assert set(s) <= set(q)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF_SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sdf.columns
    srows = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in sdf.collect())
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == sorted(cols)
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
    assert srows == drows
