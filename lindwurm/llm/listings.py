"""What listings say, in comparable form: place, days, times and telling words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lindwurm.llm.addresses import places_of
from lindwurm.llm.canonical import tokens_of
from lindwurm.llm.folding import folded, folded_text
from lindwurm.runtime import Scratch

#: A word is telling if at most TELLING_ROWS and this share of the listings use it.
TELLING_SHARE = 0.002
TELLING_ROWS = 12
#: Words a worker counts before it hands the counts on.
COUNTED_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]{5,}")
# where a text has no other letters a plain class finds the same words sooner
FOREIGN, PLAIN_WORD = re.compile("[^\\x00-\\x7f„“”‚‘’–—…»«•·€°]"), re.compile("[a-z]{5,}")
MARKUP = re.compile("<[^>]*>|&[a-z]{2,6};?|&#[0-9]+;?")


def plain(text: Column) -> Column:
    """Folded text without tags."""
    return F.regexp_replace(folded(F.coalesce(text, F.lit(""))), "<[^>]*>|&[a-z]{2,6};?|&#[0-9]+;?", " ")


def words_of(*texts: str | None) -> list[str]:
    """The distinct words of five letters or more of folded texts without tags, in any script, in order."""
    text = folded_text("\n".join(t for t in texts if t))
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return list(dict.fromkeys((PLAIN_WORD if text.isascii() or not FOREIGN.search(text) else WORD).findall(text)))


def parted(words: Column) -> Column:
    """The words of a text in which blanks part them; of an empty one none."""
    return F.array_remove(F.split(words, " "), "")


def minutes(time: Column) -> Column:
    """Minutes since midnight of H:M[:S], else null."""
    hour, minute = F.regexp_extract(time, r"^\s*(\d{1,2})[:.](\d{2})", 1), F.regexp_extract(time, r"^\s*(\d{1,2})[:.](\d{2})", 2)
    return F.when(hour != "", hour.cast("int") * 60 + minute.cast("int"))


def days(dates: Column) -> Column:
    """(day, start) of every day of every entry, ranges expanded; odd entries give nothing.

    A range that runs backwards or over more than a year counts as its first day.
    """
    def spread(entry: Column) -> Column:
        first, last = F.try_to_date(entry["date"]), F.try_to_date(entry["end_date"])
        until = F.when((last >= first) & (F.datediff(last, first) <= 366), last).otherwise(first)
        return F.when(first.isNotNull(), F.transform(F.sequence(first, until), lambda d: F.struct(d.alias("day"), minutes(entry["start_time"]).alias("start"))))

    return F.array_distinct(F.flatten(F.filter(F.transform(dates, spread), lambda x: x.isNotNull())))


def worded(listings: DataFrame, texts: list[str]) -> DataFrame:
    """Listings with the words of the first text, and those of the others that it lacks, in the place of texts.

    Columns ``title`` and ``rest`` have them parted by blanks. Workers count the
    listings that use a word while they read: further rows, with nulls else,
    have (``word``, ``uses``).
    """
    keep = [c for c in listings.columns if c not in texts]
    schema = StructType([listings.schema[c] for c in keep] + [StructField(c, StringType()) for c in ("title", "rest", "word")] + [StructField("uses", LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: Counter = Counter()
        names, types = [*keep, "title", "rest", "word", "uses"], [pa.string()] * 3 + [pa.int64()]
        kinds: list[pa.DataType] = []

        def counted() -> pa.RecordBatch:
            none = [pa.nulls(len(uses), t) for t in [*kinds, *types[:2]]]
            return pa.RecordBatch.from_arrays([*none, pa.array(uses.keys(), types[2]), pa.array(uses.values(), types[3])], names)

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in keep]
            first, rest = [], []
            for title, *others in zip(*(batch.column(c).to_pylist() for c in texts)):
                own = words_of(title)
                more = [w for w in words_of(*others) if w not in own]
                uses.update(own), uses.update(more)
                first.append(" ".join(own)), rest.append(" ".join(more))
            none = [pa.nulls(len(first), t) for t in types[2:]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(first, types[0]), pa.array(rest, types[1]), *none], names)
            if len(uses) > COUNTED_WORDS:
                yield counted()
                uses.clear()
        if uses:
            yield counted()

    return listings.select(*keep, *texts).mapInArrow(read, schema)


def common_words(words: DataFrame, rows: int) -> list[str]:
    """Words (word, uses) too frequent to tell anything; at most (words per text) / TELLING_SHARE of them."""
    most = TELLING_ROWS + TELLING_SHARE * rows
    return [r[0] for r in words.groupBy("word").agg(F.sum("uses").alias("uses")).where(F.col("uses") > most).select("word").collect()]


def features(events: DataFrame, reference: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per id: no, id, source, muni, place, number, days, title_words, words, lat, lon.

    ``title_words`` and ``words`` (of all texts) hold the telling words, without
    those of the listing's own place; ``no`` is a number of the row. Rows
    without an id are left out; of an id that was delivered again the row of
    the smallest file counts. Texts are read once, where they are scanned; only
    their telling words are shuffled.
    """
    located = scratch.put(places_of(events, reference, scratch))
    scratch.settle()
    fields = ["title", "short_description", "description"]
    read = scratch.put(worded(events.where("id is not null").select(
        "id", "file_ingestion_id", F.col("source_code").alias("source"), days(F.col("dates")).alias("days"),
        F.when(F.col("geo_latitude").between(-90, 90) & (F.abs("geo_latitude") > 1), F.col("geo_latitude").cast("float")).alias("lat"),
        F.when(F.col("geo_longitude").between(-180, 180) & (F.abs("geo_longitude") > 1), F.col("geo_longitude").cast("float")).alias("lon"),
        *fields,
    ), fields))
    own = read.where("id is not null")
    sent = events.sparkSession.sparkContext.broadcast(frozenset(common_words(read.where("word is not null").select("word", "uses"), own.count())))

    @F.pandas_udf("struct<title:string,rest:string>")
    def telling(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            yield pd.DataFrame({c: pd.Series([" ".join([w for w in t.split() if w not in known]) for t in texts], dtype=object) for c, texts in zip(("title", "rest"), batch)})

    texts = own.select("id", "file_ingestion_id", "source", "days", telling("title", "rest").alias("w"), "lat", "lon")
    venues = located.where("place is not null and stem <> ''").groupBy("place", "stem").count().groupBy("place").agg(F.max_by("stem", F.struct("count", "stem")).alias("venue"))
    cities = reference.where("kind = 'city'").select(F.concat(F.lit("c"), F.col("place_id").cast("string")).alias("muni"), F.array_join(tokens_of(F.col("name")), " ").alias("called"))
    here = located.join(venues, "place", "left").join(cities, "muni", "left").select(
        "id", "muni", "place", "number",
        F.transform(F.filter(F.concat(F.array("venue", "lane"), F.split(F.coalesce("called", F.substring("muni", 2, 1000)), " ")), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 8)).alias("around"),
    )
    told = texts.join(here, "id", "left")
    foreign = lambda words: F.filter(parted(words), lambda w: ~F.coalesce(F.exists("around", lambda o: F.startswith(w, o)), F.lit(False)))
    told = told.select("id", "file_ingestion_id", "source", "muni", "place", "number", "days", foreign(F.col("w.title")).alias("title_words"), foreign(F.col("w.rest")).alias("rest"), "lat", "lon")
    told = told.select("id", "file_ingestion_id", "source", "muni", "place", "number", "days", "title_words", F.concat("title_words", "rest").alias("words"), "lat", "lon")
    told = told.groupBy("id").agg(F.min(F.struct(*[c for c in told.columns[1:]])).alias("x")).select("id", *[f"x.{c}" for c in told.columns[2:]])
    kept = scratch.put(told.withColumn("no", F.monotonically_increasing_id()))
    scratch.drop(located)
    scratch.drop(read)
    scratch.settle()
    return kept
