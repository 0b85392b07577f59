"""The whole program: pairs, scores, clusters, merged records."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindwurm.config import DEFAULTS
from lindwurm.operators import graph, pairs, survivorship
from lindwurm.runtime import Scratch


@dataclass
class Outcome:
    decisions: DataFrame
    clusters: DataFrame
    report: DataFrame
    records: DataFrame


def run(events: DataFrame, config: dict = DEFAULTS) -> Outcome:
    """Match, cluster and merge source events; every id ends up in exactly one cluster."""
    scratch = Scratch(events.sparkSession, "pipeline")
    decisions = scratch.put(pairs.score_candidates(events, config))
    return from_decisions(events, decisions, config)


def from_decisions(events: DataFrame, decisions: DataFrame, config: dict = DEFAULTS) -> Outcome:
    """Rebuild clusters and records from decisions (id_a, id_b, combined_score, decision, tier)."""
    label = graph.components(decisions.where("decision = 'match'"), events)
    days = events.select("id", F.explode("dates.date").alias("day"))
    report = graph.cluster_report(label, decisions.withColumnRenamed("combined_score", "score"), days, config)
    members = pairs.one_per_id(events).join(label, "id")
    records = survivorship.synthesize(members).join(report.select("cluster", F.col("confidence").alias("match_confidence"), F.col("flagged").alias("needs_review"), "ai_assisted"), "cluster")
    return Outcome(decisions, label, report, records)


def replace_all(outcome: Outcome, folder: str) -> None:
    """Write decisions, clusters and records anew beside the old ones, then swap each table in by renaming.

    If writing fails, the old tables stay as they are.
    """
    spark = outcome.records.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names, fresh = ("decisions", "clusters", "records"), f"{folder}/.fresh-{uuid.uuid4().hex}"
    try:
        for name in names:
            getattr(outcome, name).write.parquet(f"{fresh}/{name}")
        for name in names:
            files.delete(path(f"{folder}/{name}"), True)
            files.rename(path(f"{fresh}/{name}"), path(f"{folder}/{name}"))
    finally:
        files.delete(path(fresh), True)
