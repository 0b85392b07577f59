"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindwurm.llm import addresses, canonical, components, history, linkage, mixing, sentences, survivors, tokens
from lindwurm.runtime import Scratch, load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field, place_id) of the place values that are no listed names."""
    return canonical.map_places(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "places"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_event_id, group_id) over the current match decisions."""
    return components.groups_of_decisions(load(spark, sf_dir, "match_decisions"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of listings of different sources that announce one occasion."""
    return p3_matches(spark, sf_dir).select("id_a", "id_b")


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b, confidence) of the same pairs."""
    return linkage.matches(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "places"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_ingestion_id, id, first_id) of rows that repeat an accepted listing."""
    return history.repeats(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "file_ingestions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical_event_id, field, source_event_id) of the best values of each group."""
    return survivors.provenance(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "canonical_event_sources"), load(spark, sf_dir, "places"))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per group, with the provenance of its fields."""
    return survivors.survivors(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "canonical_event_sources"), load(spark, sf_dir, "places"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of records that write one place in different ways."""
    return addresses.same_places(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "places"))


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, place_id) of every record with a place, by the smallest id there."""
    return addresses.memberships(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "places"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return tokens.encode_texts(load(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = tokens.encode_texts(documents.withColumn("own", F.struct("doc_id", "source")), key="own", counts_only=True)
    sized = Scratch(spark, "mixing").put(counted.select("own.doc_id", F.array_compact(F.array("own.source")).alias("members"), "tokens"))
    return mixing.mixture(sized, load(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source) of the targets whose quota the flow leaves open."""
    return _mixture(spark, sf_dir)[1].where(~F.col("reached")).select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: what is there, wanted, routed and used, and the share reached."""
    return _mixture(spark, sf_dir)[1]


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, repeats) of the documents drawn for the mixture."""
    return _mixture(spark, sf_dir)[0]


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture in which a text that several sources carry may serve each of them.

    Equal texts (reprints) are one document, a member of all their sources;
    null texts are members of nothing.
    """
    documents = load(spark, sf_dir, "documents").where("text is not null")
    carried = documents.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("members"))  # as many as there are sources
    own = carried.join(documents.select("doc_id", "text"), "doc_id").select(F.struct("doc_id", "members").alias("own"), "text")
    counted = tokens.encode_texts(own, key="own", counts_only=True)
    sized = Scratch(spark, "overlaps").put(counted.select("own.doc_id", "own.members", "tokens"))
    return mixing.mixture(sized, load(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence of every document."""
    return sentences.sentence_offsets(load(spark, sf_dir, "documents"))


QUERIES = {"p5_found": p5_found, "p5_survivors": p5_survivors, "p4_found": p4_found, "p3_found": p3_found, "p3_matches": p3_matches, "p6_found": p6_found, "p6_places": p6_places, "p1_found": p1_found, "p10_found": p10_found, "p2_found": p2_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_shares": p9_shares, "p9_uses": p9_uses, "p9_overlaps": p9_overlaps}

SQL = {
    "p2_found": """
WITH RECURSIVE last AS (
  SELECT least(source_event_id_a, source_event_id_b) AS a, greatest(source_event_id_a, source_event_id_b) AS b,
         trim(regexp_replace(lower(decision), '[\\s_\\-]+', ' ', 'g')) AS decision,
         row_number() OVER (PARTITION BY least(source_event_id_a, source_event_id_b), greatest(source_event_id_a, source_event_id_b)
                            ORDER BY decided_at DESC NULLS LAST, id DESC) AS k
  FROM match_decisions
  WHERE decision IS NOT NULL AND source_event_id_a <> source_event_id_b
), link AS (
  SELECT a AS u, b AS v FROM last WHERE k = 1 AND decision = 'match'
  UNION SELECT b, a FROM last WHERE k = 1 AND decision = 'match'
), reach(u, v) AS (
  SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
)
SELECT u AS source_event_id, least(u, min(v)) AS group_id FROM reach GROUP BY u
""",
}
