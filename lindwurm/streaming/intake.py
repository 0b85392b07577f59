"""Watching a folder for listing files: one micro-batch ingests, a callback recomputes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from lindwurm.sources import listing_files

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
LOG = "filename string, file_hash string, source_code string, event_count int, status string, error_message string"


def known_files(spark: SparkSession, log: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(log)
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def ingest(spark: SparkSession, raw: DataFrame, events: str, log: str, dead: str | None = None) -> DataFrame:
    """Append the events of new files and the log of all of them; returns the new log rows.

    Files seen before, with whatever outcome, are skipped; invalid ones are
    logged as failed and bring no events. With ``dead`` their contents and
    errors are set aside there.
    """
    fresh = listing_files.parsed(listing_files.new_files(listing_files.described(raw), known_files(spark, log))).persist()
    try:
        listing_files.flattened(fresh).write.mode("append").parquet(events)
        entries = listing_files.ingestions(fresh)
        entries.write.mode("append").parquet(log)
        if dead:
            fresh.where("error is not null").select("path", "file_hash", "content", "error").write.mode("append").parquet(dead)
        return entries
    finally:
        fresh.unpersist()


def watch(spark: SparkSession, folder: str, events: str, log: str, checkpoint: str, recompute: Callable[[SparkSession], None] | None = None, once: bool = False, dead: str | None = None) -> StreamingQuery:
    """Ingest every new ``*.json`` of a folder; each micro-batch ends with one recomputation."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.json").load(folder)

    def batch(raw: DataFrame, number: int) -> None:
        ingest(raw.sparkSession, raw, events, log, dead)
        if recompute is not None:
            recompute(raw.sparkSession)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
