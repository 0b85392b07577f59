"""Candidate pairs by blocking keys, their scores and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindwurm.config import DEFAULTS
from lindwurm.functions import scores

FIELDS = ["id", "title", "short_description", "description", "location_name", "geo_latitude", "geo_longitude", "geo_confidence", "source_code", "source_type", "categories", "dates"]


def one_per_id(events: DataFrame) -> DataFrame:
    """One row per id: that of the smallest file, where an id was delivered again; of several there the least by its hash.

    The row is chosen by a hash of its content first, so that only short columns are aggregated.
    """
    if "file_ingestion_id" not in events.columns:
        return events.where("id is not null").dropDuplicates(["id"])
    plain = [F.to_json(c) if t.startswith(("map", "array", "struct")) else F.col(c).cast("string") for c, t in events.dtypes]
    content = F.xxhash64(*[F.coalesce(c, F.lit("\0")) for c in plain])
    own = events.where("id is not null").withColumn("_pick", F.struct("file_ingestion_id", content.alias("h")))
    first = own.groupBy(F.col("id").alias("_id")).agg(F.min("_pick").alias("_first"))
    return own.join(first, (F.col("id") == F.col("_id")) & F.col("_pick").eqNullSafe(F.col("_first"))).drop("_id", "_first", "_pick").dropDuplicates(["id"])


def candidate_pairs(events: DataFrame, *, cross_source: bool = False) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of ids that share a blocking key, each once.

    Null, empty and repeated keys add nothing. The self-join is an equi-join on
    the key's hash; a hot key is split by the engine's skew handling, as each
    side of the join is a plain shuffle on the key.
    """
    keyed = events.where("id is not null").select("id", "source_code", F.explode(F.array_distinct("blocking_keys")).alias("key")).where("key is not null").distinct()
    met = keyed.alias("a").join(keyed.alias("b"), "key").where("a.id < b.id")
    if cross_source:
        met = met.where("a.source_code <> b.source_code")
    return met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def with_records(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs with the records of both ids as structs a and b; pairs with a missing side drop out."""
    own = one_per_id(events.select(*[c for c in [*FIELDS, "file_ingestion_id"] if c in events.columns])).select(*[c for c in FIELDS if c in events.columns])
    left = own.select(F.col("id").alias("id_a"), F.struct(*own.columns).alias("a"))
    right = own.select(F.col("id").alias("id_b"), F.struct(*own.columns).alias("b"))
    return pairs.join(left, "id_a").join(right, "id_b")


def candidates_with_records(events: DataFrame, own: DataFrame) -> DataFrame:
    """``candidate_pairs`` with the records of both ids as structs a and b, in one join on the key.

    ``own`` has one row per id. Records go to their keys, so that no pair is
    shuffled; a pair comes out at the least of its common keys only.
    """
    keys = events.where("id is not null").select("id", F.explode("blocking_keys").alias("key")).where("key is not null").groupBy("id").agg(F.collect_set("key").alias("keys"))
    kept = [F.col(c) for c in own.columns if c != "id"]
    keyed = own.join(keys, "id").select("id", F.struct("id", *kept).alias("own"), F.when(F.size("keys") > 1, F.col("keys")).alias("keys"), F.explode("keys").alias("key"))
    # keys are more rows than the estimate has, so they must not be broadcast
    met = keyed.alias("a").join(keyed.alias("b").hint("merge"), "key").where("a.id < b.id")
    met = met.where(F.coalesce(F.col("key") == F.array_min(F.array_intersect("a.keys", "b.keys")), F.lit(True)))
    return met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.own").alias("a"), F.col("b.own").alias("b"))


def score_candidates(events: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """``score_pairs`` of all candidate pairs."""
    own = one_per_id(events.select(*[c for c in [*FIELDS, "file_ingestion_id"] if c in events.columns]))
    own = own.select(*[c for c in FIELDS if c in own.columns and c != "dates"], scores.starts(F.col("dates")).alias("starts"))
    return _scored(candidates_with_records(events, own), scores.start_score(F.col("a.starts"), F.col("b.starts"), config), config)


def score_pairs(pairs: DataFrame, events: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """Signals, combined score, decision and tier of each pair."""
    return _scored(with_records(pairs, events), scores.date_score(F.col("a.dates"), F.col("b.dates"), config), config)


def _scored(both: DataFrame, date: Column, config: dict) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    signals = both.select(
        "id_a", "id_b", date.alias("date_score"),
        scores.geo_score(a, b, config, scores.venue_factor(a["location_name"], b["location_name"], config)).alias("geo_score"),
        scores.title_score(a, b, config).alias("title_score"), scores.description_score(a, b).alias("description_score"),
        *[w.alias(f"w_{s}") for s, w in scores.weights(a, b, config).items()],
    )
    score = scores.combined({s: F.col(f"{s}_score") for s in config["scoring"]}, {s: F.col(f"w_{s}") for s in config["scoring"]})
    return signals.withColumn("combined_score", score).withColumn("decision", scores.decide(F.col("combined_score"), F.col("title_score"), config)).select(
        "id_a", "id_b", "date_score", "geo_score", "title_score", "description_score", "combined_score", "decision", F.lit("deterministic").alias("tier")
    )


def blocking_stats(events: DataFrame) -> DataFrame:
    """(events, possible_pairs, blocked_pairs, reduction_pct); 0 % where no pair is possible."""
    ids = events.where("id is not null").select("id").distinct().agg(F.count(F.lit(1)).alias("events"))
    blocked = candidate_pairs(events).agg(F.count(F.lit(1)).alias("blocked_pairs"))
    both = ids.join(blocked, F.lit(True))
    possible = F.expr("events * (events - 1) div 2")
    return both.select("events", possible.alias("possible_pairs"), "blocked_pairs", F.when(possible > 0, F.round(100.0 * (1 - F.col("blocked_pairs") / possible), 6)).otherwise(0.0).alias("reduction_pct"))
