"""Manual corrections as pure rewrites of the link table, and re-merged records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindwurm.operators import survivorship


def split(links: DataFrame, record: int, source_ids: list[str], target: int) -> DataFrame:
    """Links with the given sources of a record moved to another one; an emptied record has no links left.

    Sources that are not linked to the record are an error.
    """
    own = links.where((F.col("canonical_event_id") == record) & F.col("source_event_id").isin(source_ids)).select("source_event_id").distinct().count()
    if own != len(set(source_ids)):
        raise ValueError("a source is not linked to the record")
    moved = F.when((F.col("canonical_event_id") == record) & F.col("source_event_id").isin(source_ids), F.lit(target)).otherwise(F.col("canonical_event_id"))
    return links.select(moved.cast(dict(links.dtypes)["canonical_event_id"]).alias("canonical_event_id"), "source_event_id").distinct()


def merge(links: DataFrame, donor: int, target: int) -> DataFrame:
    """Links with all sources of the donor on the target, each once; merging a record with itself is an error."""
    if donor == target:
        raise ValueError("a record can't be merged with itself")
    return merge_many(links, links.sparkSession.createDataFrame([(donor, target)], "donor bigint, target bigint"))


def merge_many(links: DataFrame, moves: DataFrame) -> DataFrame:
    """The same for a table of (donor, target)."""
    wanted = moves.where("donor <> target").select("donor", F.col("target").alias("moved_to"))
    both = links.join(wanted, F.col("canonical_event_id") == F.col("donor"), "left")
    return both.select(F.coalesce("moved_to", "canonical_event_id").alias("canonical_event_id"), "source_event_id").distinct()


def added_links(links: DataFrame, donor: int, target: int) -> DataFrame:
    """Sources of the donor that the target does not have yet."""
    has = links.where(F.col("canonical_event_id") == target).select("source_event_id")
    return links.where(F.col("canonical_event_id") == donor).select("source_event_id").distinct().join(has, "source_event_id", "left_anti")


def split_many(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links with each (canonical_event_id, source_event_id) of ``moves`` on its ``target`` instead; moves of no link do nothing."""
    wanted = moves.select("canonical_event_id", "source_event_id", F.col("target").alias("moved_to")).distinct()
    both = links.select("canonical_event_id", "source_event_id").distinct().join(wanted, ["canonical_event_id", "source_event_id"], "left")
    return both.select(F.coalesce("moved_to", "canonical_event_id").alias("canonical_event_id"), "source_event_id").distinct()


def added_many(links: DataFrame, moves: DataFrame) -> DataFrame:
    """(canonical_event_id, source_event_id) that merges of (donor, target) add to the targets."""
    own = links.select("canonical_event_id", "source_event_id").distinct()
    brought = own.join(moves.select(F.col("donor").alias("canonical_event_id"), "target"), "canonical_event_id").select(F.col("target").alias("canonical_event_id"), "source_event_id").distinct()
    return brought.join(own, ["canonical_event_id", "source_event_id"], "left_anti")


def resynthesized(events: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Merged records (column cluster) of all records whose links changed; an emptied record gives none."""
    own = [x.select("canonical_event_id", "source_event_id").distinct() for x in (before, after)]
    changed = own[0].exceptAll(own[1]).unionByName(own[1].exceptAll(own[0])).select("canonical_event_id").distinct()
    return survivorship.synthesize(survivorship.members_of(events, own[1].join(changed, "canonical_event_id", "left_semi")))


def emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    """(canonical_event_id) of records that an edit left without links; they are to be deleted."""
    return before.select("canonical_event_id").distinct().join(after.select("canonical_event_id").distinct(), "canonical_event_id", "left_anti")


def audit_rows(before: DataFrame, after: DataFrame, action: str, at: str) -> DataFrame:
    """One audit row per record an edit changed: canonical_event_id, action, links before and after, created_at."""
    count = lambda x, name: x.select("canonical_event_id", "source_event_id").distinct().groupBy("canonical_event_id").agg(F.count(F.lit(1)).alias(name), F.bit_xor(F.xxhash64("source_event_id")).alias(f"{name}_key"))
    both = count(before, "links_before").join(count(after, "links_after"), "canonical_event_id", "full")
    changed = both.where(~F.col("links_before_key").eqNullSafe(F.col("links_after_key")))
    return changed.select("canonical_event_id", F.lit(action).alias("action"), F.coalesce("links_before", F.lit(0)).alias("links_before"), F.coalesce("links_after", F.lit(0)).alias("links_after"), F.lit(at).cast("timestamp_ntz").alias("created_at"))


def audited(log: DataFrame, *, record: int | None = None, action: str | None = None) -> DataFrame:
    """Audit rows of a record and an action, the newest first."""
    out = log if record is None else log.where(F.col("canonical_event_id") == record)
    out = out if action is None else out.where(F.col("action") == action)
    return out.orderBy(F.desc("created_at"), "id")
