"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ["match", "no_match", "ambiguous"]


def file_stats(files: DataFrame, since: str | None = None) -> DataFrame:
    """Counts of files and events since a time; sums of nothing are 0."""
    own = files.where(F.col("ingested_at") >= F.lit(since).cast("timestamp_ntz")) if since else files
    return own.agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_events"),
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


def daily_history(files: DataFrame, since: str | None = None) -> DataFrame:
    own = files.where(F.col("ingested_at") >= F.lit(since).cast("timestamp_ntz")) if since else files
    return own.groupBy(F.to_date("ingested_at").alias("day")).agg(
        F.count(F.lit(1)).alias("files_processed"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events_ingested"), F.count_if(F.col("status") == "error").alias("errors")
    ).orderBy("day")


def decision_counts(decisions: DataFrame) -> DataFrame:
    """(decision, n) of the three decisions, zero-filled; other spellings are no decision."""
    fixed = decisions.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    found = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(found, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def canonical_stats(records: DataFrame) -> DataFrame:
    """Total, records to review and mean confidence to 4 places; a mean of 0 is null."""
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("needs_review").alias("needs_review"), F.nullif(F.round(F.avg("match_confidence"), 4), F.lit(0.0)).alias("avg_confidence")
    )


def cluster_counts(label: DataFrame) -> DataFrame:
    """(clusters, singletons) of a labelling (id, cluster)."""
    sizes = label.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"))


def usage_summary(log: DataFrame, since: str | None = None) -> DataFrame:
    """Batches, requests, cached requests and token sums of a usage log since a time."""
    own = log.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) if since else log
    return own.agg(
        F.count_distinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("requests"), F.count_if("cached").alias("cached"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def confidence_bands(records: DataFrame, column: str = "match_confidence") -> DataFrame:
    """Percent and band (high, medium, low) of a confidence; null stays null."""
    c = F.col(column)
    return records.select("id", F.round(c * 100).cast("int").alias("percent"), F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c.isNotNull(), "low").alias("band"))
