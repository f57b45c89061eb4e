"""Resumable enrichment: process only samples not enriched yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import resume_pending
from .snapshots import path_exists


def enrich_incrementally(spark: SparkSession, samples: DataFrame, out_path: str, key: str, enrich) -> int:
    """Append ``enrich(pending)`` for samples whose key is not yet in
    ``out_path`` (parquet).  Safe to re-run after a failure: finished keys
    are skipped, the write is an atomic append of the missing ones."""
    done = spark.read.parquet(out_path).select(key) if path_exists(spark, out_path) else None
    pending = samples if done is None else resume_pending(samples, done, key)
    if pending.isEmpty():
        return 0
    enrich(pending).write.mode("append").parquet(out_path)
    return 1
