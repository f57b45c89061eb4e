"""Front of the enrichment job: field sample files to clean samples.

Scan (malformed lines kept as text), parse dates and numbers, tag each row with
the first reason to reject it, count, and give samples and rejects apart.  The
files are read once: the tagged rows are written as a table, the counts per
reason are observed while that table is written, and both outputs are filters of
it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date_multi
from ..functions.numeric import to_double_lenient
from ..session import stored
from ..sources.csv_io import read_csv_lines

FIELDS = ["sample_id", "sample_date", "value", "latitude", "longitude"]
#: reasons in the order in which they are tried
REASONS = ["malformed line", "missing key", "unparseable date", "unparseable number", "outside the globe"]


@dataclass
class Ingested:
    samples: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def tag_rows(lines: DataFrame) -> DataFrame:
    """Parsed columns, the source file and line, and ``reject_reason`` (NULL: a
    sample)."""
    parsed = lines.select(
        F.expr("try_cast(trim(sample_id) AS BIGINT)").alias("sample_id"),
        parse_date_multi("sample_date").alias("sample_date"),
        *[to_double_lenient(c).alias(c) for c in FIELDS[2:]], "malformed", "file")
    inside = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    tests = [F.col("malformed").isNotNull(), F.col("sample_id").isNull(), F.col("sample_date").isNull(),
             F.col("value").isNull(), ~F.coalesce(inside, F.lit(False))]
    reason = F.when(tests[0], REASONS[0])
    for test, why in zip(tests[1:], REASONS[1:]):
        reason = reason.when(test, why)
    return parsed.withColumn("reject_reason", reason)


def ingest(spark: SparkSession, path: str, sep: str = ";") -> Ingested:
    """Samples, rejects and counts (per reason, and ``kept``) of the files below
    ``path``, whose lines hold ``FIELDS``."""
    tagged = tag_rows(read_csv_lines(spark, path, FIELDS, sep))
    seen = Observation("ingest")
    why = F.col("reject_reason")
    tagged = tagged.observe(seen, F.count_if(why.isNull()).alias("kept"),
                            *[F.count_if(why == r).alias(r) for r in REASONS])
    table = stored(tagged, "ingest")
    good = table.where(why.isNull()).select(*FIELDS)
    bad = table.where(why.isNotNull()).select("reject_reason", "malformed", "file", *FIELDS)
    return Ingested(good, bad, dict(seen.get))
