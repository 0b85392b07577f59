"""Consolidating pairwise links into groups: the links that count, and their components.

The components (peeling by breadth-first joins, then propagation of the least
id) are the core's, see ``operators/graph``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindwurm.operators.graph import connected_components


def spelled(decision: Column) -> Column:
    """A decision in lower case, with spaces, hyphens and underscores alike."""
    return F.trim(F.regexp_replace(F.lower(decision), r"(?U)[\s_\-]+", " "))


def current_links(decisions: DataFrame, *, a: str = "source_event_id_a", b: str = "source_event_id_b", decision: str = "decision", decided_at: str = "decided_at", key: str = "id", wanted: str = "match") -> DataFrame:
    """(a, b) with a < b of each pair whose latest non-null decision is ``wanted``.

    Pairs are unordered; rows with a null end, a null decision or both ends
    equal don't count. A null time is older than any other; of several rows at
    the latest time the one with the greatest ``key`` holds.
    """
    return (
        decisions.where((F.col(a) != F.col(b)) & F.col(decision).isNotNull())
        .groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .agg(F.max_by(spelled(F.col(decision)), F.struct(F.col(decided_at), F.col(key))).alias("decision"))
        .where(F.col("decision") == wanted)
        .select("a", "b")
    )


def groups_of_decisions(decisions: DataFrame, **options) -> DataFrame:
    """(source_event_id, group_id) of every event linked by a match with another."""
    return connected_components(current_links(decisions), **options).select(F.col("node").alias("source_event_id"), F.col("component").alias("group_id"))
