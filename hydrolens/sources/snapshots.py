"""Latest snapshot selection among entries sharing a name prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its file system; other errors rise."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def latest_snapshot_path(spark: SparkSession, root: str, prefix: str) -> str | None:
    """The newest entry of ``root`` (a file, or a folder of part files) whose
    own name starts with ``prefix``; of equal times the greater name."""
    fs, p = _file_system(spark, root)
    found = [(s.getModificationTime(), s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)
             if s.getPath().getName().startswith(prefix)]
    return max(found)[2] if found else None


def read_latest_snapshot(spark: SparkSession, root: str, prefix: str, fmt: str = "parquet",
                         schema=None) -> DataFrame:
    """All rows of the newest snapshot; only that one is read."""
    path = latest_snapshot_path(spark, root, prefix)
    if path is None:
        raise FileNotFoundError(f"no snapshot {prefix}* in {root}")
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    return r.load(path)
