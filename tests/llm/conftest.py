import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
from odd_texts import CLASHES, SF, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit(-7) for c in CLASHES})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of the smallest table, by id."""
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return sorted(zip(t["doc_id"], t["text"]))
