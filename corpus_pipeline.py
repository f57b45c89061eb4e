"""Training-text pipeline: quality rules, near-duplicates, decontamination,
mixing and sharding, each stage on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as a table and reread as the next stage's ``docs``; all but the last return the
columns of ``documents``.  Nulls, repeated rows, empty tables and extra columns
are treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.llm import decontaminate, host_quality, mixing, sharding, simhash
from hydrolens.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules on hosts that stand."""
    return host_quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their fitted rates say."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot.  A column of the documents
    that has the name of a result column comes back as ``doc_<name>``."""
    out = sharding.shard_documents(docs)
    own = [c for c in out.columns if c != "doc"]
    rest = [F.col(f"doc.`{c}`").alias(f"doc_{c}" if c in own else c) for c in docs.columns if c != "doc_id"]
    return out.select(*own, *rest)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_targets", mixing_to_targets),
    ("sharding", shard),
]

#: fingerprints, the fitted classifier and the random shuffle have no SQL form;
#: the tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
