"""Incremental, restartable scene enrichment with Structured Streaming.

New sample files dropped into ``samples_dir`` are picked up by a file
source; each micro-batch skips samples already present in the output
(anti join on the key, so a batch replayed after a failure writes nothing
twice) and appends the enriched rows.  Progress lives in
``<checkpoint>/...`` on the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import resume_pending
from ..plans.enrich import enrich
from ..session import checkpoint_dir
from ..sources.snapshots import path_exists


def start_incremental_enrichment(spark: SparkSession, samples_dir: str, sample_schema, scenes: DataFrame,
                                 pixels: DataFrame, out_path: str, key: str = "sample_id",
                                 fmt: str = "parquet", query_name: str = "incremental_enrichment",
                                 trigger_once: bool = True, **enrich_kwargs):
    """Start (or resume) the stream; returns the StreamingQuery."""
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/{query_name}"
    stream = spark.readStream.schema(sample_schema).format(fmt)
    if fmt == "csv":
        stream = stream.option("header", True)
    samples = stream.load(samples_dir)

    def process(batch: DataFrame, batch_id: int) -> None:
        pending = batch
        if path_exists(batch.sparkSession, out_path):
            pending = resume_pending(batch, batch.sparkSession.read.parquet(out_path).select(key), key)
        if not pending.isEmpty():
            enrich(pending, scenes, pixels, key=key, **enrich_kwargs).write.mode("append").parquet(out_path)

    w = samples.writeStream.foreachBatch(process).option("checkpointLocation", ckpt).queryName(query_name)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")
    return w.start()
