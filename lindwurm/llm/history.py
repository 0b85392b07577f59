"""Deduplicating new batches against all history by a segment index.

Every accepted string is cut into a fixed number of segments and stored by
length, segment position and text. A new string probes, for each length within
reach, only those of its substrings that a stored string within the distance
must share; what is hit is verified by the exact edit distance. Appending a
batch writes its own segments and leaves the history as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from lindwurm.llm.components import connected_components
from lindwurm.llm.edits import borders, osa, piece_key
from lindwurm.llm.folding import folded, one_row, squeezed, zip5
from lindwurm.llm.listings import days, plain
from lindwurm.runtime import Scratch

#: Edits within which strings count as near: for short and for longer ones.
SHORT_EDITS, LONG_EDITS, LONG_FROM = 2, 3, 18
SEGMENTS = LONG_EDITS + 1
#: Listings of a scope up to which all its pairs are compared; larger scopes are probed by segments. Both find the same.
PAIRED_ROWS = 64
# Remarks put before or after a title.
REMARKS_AFTER = r"\((nachtrag|abgesagt|neu)\)\s*$"
REMARKS = r"^\s*((abgesagt|verlegt|verschoben|entfaellt|neu|termin|heute|tipp|veranstaltungstipp|aus der nachbarschaft|lokales|\+\+\+ ?neu ?\+\+\+)\s*[:|!–-]*\s*)+|\((nachtrag|abgesagt|neu)\)\s*$"

# Titles that say nothing, kinds of occasions alone, and those whose names are cut off.
EMPTY_TITLES = r"^(titel folgt|o\. ?t\.?|veranstaltung|termin|veranstaltungshinweis|unbenannte veranstaltung.*|\[?ohne titel\]?|n/?a|-|tba|n\. ?n\.?)$"
KINDS_ALONE = r"^(konzert|markt|versammlung|theater|wanderung|vortrag|lesung|gottesdienst|ausstellung|kindertheater|sport|fasnacht|fest)$"
NAMELESS = r"^[a-z-]+ (m|mi|mit|d|de|der|die|das|des|v|vo|von|vom|um|fuer|im|in|am)\s*(…|\.\.\.)?$|^[a-z-]+\s*(…|\.\.\.|:)$"


def reach(length: int) -> int:
    return SHORT_EDITS if length < LONG_FROM else LONG_EDITS


def stored_keys(text: str) -> list[int]:
    """Keys under which a string is stored, one per segment."""
    return [piece_key(text[at : at + size], len(text), i) for i, (at, size) in enumerate(borders(len(text), SEGMENTS))]


def probe_keys(text: str, longer: bool = True) -> list[int]:
    """Keys of all substrings by which a stored string within reach can be hit.

    A stored string of length l within k edits shares one of its segments with
    the text at a shift that the edits left and right of it must pay for.
    Without ``longer`` only strings of at most the text's length are probed:
    enough where all stored strings probe as well.
    """
    own, found = len(text), set()
    k = LONG_EDITS
    for length in range(max(0, own - k), own + (k if longer else 0) + 1):
        delta = own - length
        k = max(reach(own), reach(length))
        if abs(delta) > k:
            continue
        for i, (at, size) in enumerate(borders(length, SEGMENTS)):
            low = max(0, at - i, at + delta - (SEGMENTS - 1 - i), at - k)
            high = min(own - size, at + i, at + delta + (SEGMENTS - 1 - i), at + k)
            for start in range(low, high + 1):
                found.add(piece_key(text[start : start + size], length, i))
                if start and size:  # neighbours swapped across the border before it
                    found.add(piece_key(text[start - 1] + text[start + 1 : start + size], length, i))
    return list(found)


def _keys(how) -> object:
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([how(t) for t in batch], dtype=object)

    return F.pandas_udf(keys, ArrayType(LongType()))


def segments(strings: DataFrame) -> DataFrame:
    """(bucket, scope, text, ref) of the stored side; ``strings`` has scope, text, ref."""
    return strings.select(F.explode(_keys(stored_keys)("text")).alias("key"), "scope", "text", "ref").select(F.xxhash64("scope", "key").alias("bucket"), "scope", "text", "ref")


def probe(strings: DataFrame, stored: DataFrame, longer: bool = True) -> DataFrame:
    """(ref, hit, edits) of strings and stored strings of one scope within reach.

    Texts of equal content meet at distance 0. Swapped neighbours count as one
    edit.
    """
    probes = strings.select(F.explode(_keys(partial(probe_keys, longer=longer))("text")).alias("key"), "scope", "text", "ref").select(F.xxhash64("scope", "key").alias("bucket"), F.col("text").alias("own"), "ref")
    met = probes.join(stored.select("bucket", F.col("text").alias("kept"), F.col("ref").alias("hit")), "bucket").where("ref <> hit").select("ref", "hit", "own", "kept").distinct()
    return _within(met)


def paired(strings: DataFrame) -> DataFrame:
    """What ``probe`` finds among the strings themselves (ref < hit), by comparing all of a scope."""
    limit = F.when(F.greatest(F.length("own"), F.length("kept")) < LONG_FROM, SHORT_EDITS).otherwise(LONG_EDITS)
    a, b = strings.select("scope", "ref", F.col("text").alias("own")), strings.select("scope", F.col("ref").alias("hit"), F.col("text").alias("kept"))
    met = a.join(b, "scope").where((F.col("ref") < F.col("hit")) & (F.abs(F.length("own") - F.length("kept")) <= limit))
    # a swap is two plain edits
    rough = F.levenshtein("own", "kept", 2 * LONG_EDITS)
    return _within(met.where((F.col("own") == F.col("kept")) | rough.between(0, 2 * limit)).select("ref", "hit", "own", "kept").distinct())


def _within(met: DataFrame) -> DataFrame:
    """(ref, hit, edits) of the pairs (ref, hit, own, kept) whose texts lie within reach."""

    @F.pandas_udf(IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(osa(a.tolist(), b.tolist()), dtype="int32")

    longest = F.greatest(F.length("own"), F.length("kept"))
    limit = F.when(longest < LONG_FROM, SHORT_EDITS).otherwise(LONG_EDITS)
    return met.withColumn("edits", F.when(F.col("own") == F.col("kept"), 0).otherwise(distance("own", "kept"))).where(F.col("edits") <= limit).select("ref", "hit", "edits")


class SegmentIndex:
    """A segment index in a folder: ``probe`` a batch, then ``append`` it.

    Batches have scope, text and ref (unique strings). Nothing stored is read
    again to append; an index that does not exist yet is empty.
    """

    SHAPE = StructType([StructField("bucket", LongType()), StructField("scope", StringType()), StructField("text", StringType()), StructField("ref", StringType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SHAPE).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SHAPE)

    def probe(self, batch: DataFrame) -> DataFrame:
        return probe(batch, self.stored())

    def append(self, batch: DataFrame) -> None:
        segments(batch.select("scope", "text", "ref")).write.mode("append").parquet(self.path)


def bare_title(title: Column) -> Column:
    """A title without tags, remarks, case, blanks and marks."""
    text = F.regexp_replace(squeezed(plain(title)), REMARKS_AFTER, "")
    rest = F.regexp_replace(F.regexp_replace(text, REMARKS, ""), "[^a-z0-9]+", "")
    return F.when(rest != "", rest).otherwise(F.regexp_replace(text, "[^a-z0-9]+", ""))


def generic_title(title: Column) -> Column:
    """Whether a title names no occasion by itself; decided from its text alone, so alike at every size."""
    text = squeezed(plain(title))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, REMARKS_AFTER, ""), REMARKS, ""))
    plainest = F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""))
    return (plainest == "") | F.regexp_like(text, F.lit(EMPTY_TITLES)) | F.regexp_like(plainest, F.lit("|".join((EMPTY_TITLES, KINDS_ALONE, NAMELESS))))


def repeats(events: DataFrame, files: DataFrame, *, paired_rows: int = PAIRED_ROWS) -> DataFrame:
    """(file_ingestion_id, id, first_id) of rows that repeat an accepted listing.

    Listings of one source repeat each other if they have a day in common,
    titles within reach of each other, and enough equal fields (place, street,
    town, postcode, text, start). Equal ids always do. ``first_id`` is the id in
    the earliest such file, the smallest if a file holds several. Only
    completed files count; rows of no such file or without id or source give
    nothing. A null title repeats only under its own id.
    """
    scratch = Scratch(events.sparkSession, "history")
    accepted = files.where("status = 'completed' and ingested_at is not null").select(F.col("id").alias("file_ingestion_id"), "ingested_at")
    sent = events.where("id is not null and source_code is not null")
    rows = sent.select("file_ingestion_id", "id", "source_code").distinct().join(accepted, "file_ingestion_id")
    letters = lambda c: F.regexp_replace(folded(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", "")
    text = F.lower(F.translate("description", " \n\r\t\u00a0", ""))
    read = sent.select(
        "id", "file_ingestion_id", F.concat_ws("|", "source_code", "id").alias("ref"), "source_code", bare_title(F.col("title")).alias("text"), generic_title(F.col("title")).alias("generic"), days(F.col("dates")).alias("days"),
        letters("location_name").alias("place"), F.regexp_replace(letters("location_street"), "[0-9]+", "").alias("road"), letters("location_city").alias("town"), zip5(F.col("location_zipcode")).alias("code"),
        F.when(F.col("description").isNotNull() & (text != ""), F.xxhash64(text)).alias("body"),
    )
    told = scratch.put(one_row(read, "ref", "file_ingestion_id").withColumn("no", F.monotonically_increasing_id()))
    # one scope per least set of equal fields that can give the points a link needs (two): no pair that the points accept is kept apart
    day, start = F.col("d.day").cast("string"), F.coalesce(F.col("d.start").cast("string"), F.lit("-"))
    told_town, told_code = F.col("town") != "", F.col("code") != ""
    way = lambda kind, there, *fields: F.when(there, F.concat_ws("|", F.lit(kind), *fields))
    ways = F.array(
        way("p", F.col("place") != "", "place"), way("r", F.col("road") != "", "road"), way("b", F.col("body").isNotNull(), "body"),
        way("tc", told_town & told_code, "town", "code"), way("ts", told_town, "town", start), way("cs", told_code, "code", start),
    )
    scoped = told.where("text <> ''").withColumn("d", F.explode("days")).select("no", "source_code", day.alias("day"), F.explode(F.array_compact(ways)).alias("way")).select("no", F.xxhash64("source_code", "day", "way").alias("scope")).distinct()
    # scopes that hold the same listings (several days, place and street) give the same pairs: one of them is probed
    held = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("no")).alias("x"), F.bit_xor(F.xxhash64(F.lit("|"), "no")).alias("y")).where("n > 1")
    kept = held.groupBy("n", "x", "y").agg(F.min("scope").alias("scope")).select("scope", "n")
    strings = scratch.put(scoped.join(kept, "scope").join(told.select("no", "text"), "no").select("scope", "n", "text", F.col("no").alias("ref")))
    small, large = strings.where(F.col("n") <= paired_rows), strings.where(F.col("n") > paired_rows)
    probed = probe(large, segments(large), longer=False).select(F.least("ref", "hit").alias("ref"), F.greatest("ref", "hit").alias("hit"))
    near = paired(small).select("ref", "hit").unionByName(probed).distinct().select(F.col("ref").alias("no"), "hit")
    facts = told.select("no", "ref", "days", "place", "road", "town", "code", "body", "generic", F.length("text").alias("size"))
    same = lambda c: (F.col(f"a.{c}") == F.col(f"b.{c}")) & (F.col(f"a.{c}") != "")
    both = near.join(facts.select("no", F.struct("*").alias("a")), "no").join(facts.select(F.col("no").alias("hit"), F.struct("*").alias("b")), "hit")
    start = F.size(F.array_intersect("a.days", "b.days")) > 0
    body = F.coalesce(F.col("a.body") == F.col("b.body"), F.lit(False))
    points = sum((F.when(c, w).otherwise(0) for c, w in ((same("place"), 2), (same("road"), 2), (same("town"), 1), (same("code"), 1), (body, 2), (start, 1))), F.lit(0))
    vague = F.col("a.generic") | F.col("b.generic") | (F.least("a.size", "b.size") < 10)
    linked = scratch.put(both.where(points >= F.when(vague, 5).when(F.least("a.size", "b.size") >= LONG_FROM, 2).otherwise(3)).select(F.col("a.ref").alias("u"), F.col("b.ref").alias("v")))
    label = connected_components(linked, a="u", b="v", prefix="history-groups").select(F.col("node").alias("ref"), F.col("component").alias("least"))
    grouped = rows.withColumn("ref", F.concat_ws("|", "source_code", "id")).join(label, "ref", "left").withColumn("listing", F.coalesce("least", "ref"))
    first = grouped.groupBy("listing").agg(F.min(F.struct("ingested_at", "id")).alias("first"))
    late = grouped.join(first, "listing").where(F.col("ingested_at") > F.col("first.ingested_at"))
    return late.select("file_ingestion_id", "id", F.col("first.id").alias("first_id")).distinct()
