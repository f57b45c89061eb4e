"""CSV scans and sinks with explicit schemas (never inferred in production)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, date_format: str = "yyyy-MM-dd",
             mode: str = "PERMISSIVE") -> DataFrame:
    """Typed CSV scan: header row, UTF-8, comma, quoted fields; malformed
    values become NULL (PERMISSIVE) rather than failing the job."""
    return (spark.read.schema(schema).option("header", True).option("mode", mode)
            .option("encoding", "UTF-8").option("dateFormat", date_format).option("quote", '"')
            .option("escape", '"').csv(path))


def read_csv_text(spark: SparkSession, path: str, columns) -> DataFrame:
    """Every field as STRING (parse later with try_* functions)."""
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    return read_csv(spark, path, schema)


def read_csv_lines(spark: SparkSession, path: str, columns, sep: str = ",") -> DataFrame:
    """Text scan that loses no line: the ``columns`` as STRING, ``malformed``
    (the whole line, where it has too few or too many fields; else NULL) and
    ``file``.  All columns are parsed whatever is selected later, so the verdict
    on a line doesn't depend on the query."""
    schema = StructType([StructField(c, StringType(), True) for c in [*columns, "malformed"]])
    lines = (spark.read.schema(schema).option("header", False).option("sep", sep).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "malformed").option("columnPruning", False)
             .option("encoding", "UTF-8").option("quote", '"').option("escape", '"').csv(path))
    return lines.select("*", F.col("_metadata.file_path").alias("file"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """CSV sink with header; dates as yyyy-MM-dd."""
    w = df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def with_row_index(df: DataFrame, order, name: str = "row_index") -> DataFrame:
    """A 0-based index column in ``order`` (the index column some reports
    carry), assigned without a single-partition window."""
    from ..operators.ordered import row_number
    return row_number(df, order, name).withColumn(name, F.col(name) - 1)
