"""Listing, filtering, sorting and paging of merged records, and the review queue."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindwurm.operators.pairs import one_per_id

SORTS = {"title": "title", "city": "location_city", "date": "first_date", "categories": "categories", "source_count": "source_count", "confidence": "match_confidence", "review": "needs_review"}


def filtered(records: DataFrame, *, q: str | None = None, cities: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """Title search, any of the cities, dates contained in the range, all of the categories.

    ``%`` and ``_`` of the caller stay wildcards; categories are searched in
    the list's JSON text, as parts of words too.
    """
    out = records
    if q:
        out = out.where(F.col("title").ilike(f"%{q}%"))
    if cities:
        out = out.where(reduce(lambda a, b: a | b, [F.col("location_city").ilike(f"%{c}%") for c in cities]))
    if date_from:
        out = out.where(F.col("first_date") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(F.col("last_date") <= F.lit(date_to).cast("date"))
    for c in categories or []:
        out = out.where(F.to_json("categories").ilike(f"%{c}%"))
    return out


def ordered(records: DataFrame, sort_by: str = "title", descending: bool = False) -> DataFrame:
    """By one of the known columns (else the title); nulls last when falling, first when rising; then by id."""
    name = SORTS.get(sort_by, "title")
    key: Column = F.to_json(name) if name == "categories" else F.col(name)
    return records.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id")


def page(records: DataFrame, number: int = 1, size: int = 25, most: int = 10_000) -> DataFrame:
    """One page of ordered records; numbers count from 1."""
    if number < 1 or not 1 <= size <= most:
        raise ValueError(f"page from 1 and size from 1 to {most}")
    return records.offset((number - 1) * size).limit(size)


def page_with_total(records: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """One page of ordered records, each with the total of records and the number of pages (1 if there is none)."""
    counted = records.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int").alias("pages"))
    return page(records, number, size).join(counted, F.lit(True))


def pages(total: int, size: int) -> int:
    return math.ceil(total / size) if total > 0 else 1


def review_queue(records: DataFrame, min_sources: int = 1) -> DataFrame:
    """Records flagged, or merged from several with a confidence under 0.8, the least certain first."""
    doubtful = F.col("needs_review") | F.coalesce((F.col("match_confidence") < 0.8) & (F.col("source_count") > 1), F.lit(False))
    return records.where(doubtful & (F.col("source_count") >= min_sources)).orderBy(F.desc("needs_review"), F.coalesce("match_confidence", F.lit(0.0)), "id")


def detail(records: DataFrame, links: DataFrame, events: DataFrame, key: int) -> DataFrame:
    """One record with its source records, each with its dates; empty if there is none."""
    own = records.where(F.col("id") == key)
    sources = links.where(F.col("canonical_event_id") == key).select("source_event_id").distinct().join(one_per_id(events).select(F.col("id").alias("source_event_id"), "title", "source_code", "dates"), "source_event_id")
    packed = sources.agg(F.array_sort(F.collect_list(F.struct("source_event_id", "title", "source_code", "dates"))).alias("sources"))
    return own.join(packed, F.lit(True))


def distinct_categories(records: DataFrame) -> DataFrame:
    return records.select(F.explode("categories").alias("category")).where("category is not null").distinct().orderBy("category")


def distinct_cities(records: DataFrame) -> DataFrame:
    return records.where("location_city is not null").select(F.col("location_city").alias("city")).distinct().orderBy("city")


def inner_decisions(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """(canonical_event_id, decision id): decisions both of whose events are linked to one record with two or more events."""
    pairs = links.select("canonical_event_id", "source_event_id").distinct()
    many = pairs.groupBy("canonical_event_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("canonical_event_id")
    own = pairs.join(many, "canonical_event_id")
    left = own.select("canonical_event_id", F.col("source_event_id").alias("source_event_id_a"))
    right = own.select("canonical_event_id", F.col("source_event_id").alias("source_event_id_b"))
    return decisions.join(left, "source_event_id_a").join(right, ["canonical_event_id", "source_event_id_b"]).select("canonical_event_id", F.col("id").alias("decision_id"))
