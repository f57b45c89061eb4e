"""Helpers shared by the training-text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.session import checkpoint_dir

#: Rows per Arrow batch; long texts make even this many rows tens of megabytes.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage
    ends there, and a lost executor costs no more than its running tasks."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Prepare for Python tasks: small Arrow batches, as texts may be very
    long, and this package's code handed to the executors by Spark."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    sc = spark.sparkContext
    if not getattr(sc, "_llm_code_sent", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), "llm_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        f = os.path.join(folder, name)
                        z.write(f, os.path.relpath(f, os.path.dirname(top)))
        sc.addPyFile(path)
        sc._llm_code_sent = True


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """``doc`` (all columns as one struct) beside the ``used`` columns, so that
    an operator's own columns can never clash with a column of the table."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       *[F.col(f"`{c}`").alias(c) for c in used])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("doc.*")


def join_on_hot_key(big: DataFrame, small: DataFrame, key: str, counts: DataFrame,
                    total: int, shares: int = 200) -> DataFrame:
    """Left join ``big`` with ``small`` (one row per ``key``, null included)
    without sending a hot key to one task.

    ``counts`` (``key``, ``n``) holds the rows of ``big`` per key and ``total``
    their sum.  At most ``shares`` keys can hold over ``total / shares`` rows
    each: those few rows of ``small`` are broadcast (a bound that does not
    depend on the data), all other keys meet in an ordinary join.
    """
    hot = counts.where(F.col("n") * shares > total).select(F.col(key).alias("_hot"))
    few = small.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot"))).drop("_hot")
    marked = big.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))),
                      F.col(key).eqNullSafe(F.col("_hot")), "left").drop("_hot")
    values = [c for c in small.columns if c != key]
    right = lambda df: df.select(F.col(key).alias("_k"), *values)
    a = (marked.where("_is_hot").drop("_is_hot")
         .join(F.broadcast(right(few)), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k"))
    b = (marked.where("_is_hot IS NULL").drop("_is_hot")
         .join(right(small), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k"))
    return a.unionByName(b)
