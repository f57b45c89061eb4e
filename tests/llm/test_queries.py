"""Every query with SQL against DuckDB; entry registration."""

import duckdb
import pytest
from odd_texts import SF

from hydrolens.llm import queries as Q

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} - {"operator"}
    assert "pipeline" in names and set(Q.ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    got = Q.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = db.execute(Q.ORACLES[name]())
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(
        str(tuple(r)) for r in cur.fetchall())
