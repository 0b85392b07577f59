"""JSON listing files: scan, validation, flattening, idempotent intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindwurm.functions import scores
from lindwurm.functions.text import CITY_PARTS, SYNONYMS, normalize_city, normalize_text, normalize_title

EVENT = """
id string, title string, short_description string, description string, highlights array<string>,
event_dates array<struct<date:string,start_time:string,end_time:string,end_date:string>>,
location struct<name:string,city:string,district:string,street:string,street_no:string,zipcode:string,
  _sanitizeResult:struct<city:string,district:string,confidence:double>,
  geo:struct<longitude:double,latitude:double,confidence:double,country:string>>,
source_type string, categories array<string>, is_family_event boolean, is_child_focused boolean, admission_free boolean,
registration_required boolean, registration_contact string, confidence_score double, _batch_index int, _extracted_at string
"""


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, file_hash, source_code, content) of every ``*.json`` in a folder, in one job.

    The hash is the SHA-256 of the bytes; the source code is the name up to the
    first underscore, or all of it.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return described(raw)


def described(raw: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        "path", name.alias("filename"), F.sha2("content", 256).alias("file_hash"), F.substring_index(F.regexp_replace(name, r"\.json$", ""), "_", 1).alias("source_code"),
        F.decode("content", "UTF-8").alias("content"),
    )


def parsed(files: DataFrame) -> DataFrame:
    """Files with their document and an error (null if every event is valid).

    A file is valid as a whole or not at all: broken JSON, no list of events,
    an event without id, title or source_type, a date entry without a date, or
    an id that comes twice make it invalid.
    """
    doc = F.from_json("content", _document_type(), {"mode": "PERMISSIVE"})
    out = files.withColumn("doc", doc)
    events = F.col("doc.events")
    lacking = lambda field: F.exists(events, lambda e: e[field].isNull())
    undated = F.exists(events, lambda e: F.exists(F.coalesce(e["event_dates"], F.array().cast("array<struct<date:string,start_time:string,end_time:string,end_date:string>>")), lambda d: d["date"].isNull()))
    twice = F.size(F.array_distinct(F.transform(events, lambda e: e["id"]))) < F.size(events)
    error = (
        F.when(F.col("doc").isNull() | events.isNull(), "not a listing document").when(lacking("id"), "missing field: id").when(lacking("title"), "missing field: title")
        .when(lacking("source_type"), "missing field: source_type").when(undated, "missing field: date").when(twice, "repeated event id")
    )
    return out.withColumn("error", error)


def _document_type() -> str:
    event = " ".join(EVENT.split())
    fields = [f.strip() for f in _top_level(event)]
    inner = ",".join(f.replace(" ", ":", 1) for f in fields)
    return f"events array<struct<{inner}>>, rejected array<string>, metadata map<string,string>"


def _top_level(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, letter in enumerate(text):
        depth += (letter == "<") - (letter == ">")
        if letter == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def flattened(files: DataFrame) -> DataFrame:
    """One row per event of the valid files, with normalised fields and blocking keys."""
    each = files.where("error is null").select("filename", "file_hash", "source_code", F.explode("doc.events").alias("e"))
    place = F.col("e.location")
    prefer = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    city: Column = prefer(place["_sanitizeResult"]["city"], place["city"])
    district = prefer(place["_sanitizeResult"]["district"], place["district"])
    dates = F.transform(F.coalesce("e.event_dates", F.array().cast("array<struct<date:string,start_time:string,end_time:string,end_date:string>>")), lambda d: F.struct(
        d["date"].alias("date"), scores.parse_time(d["start_time"]).alias("start_time"), scores.parse_time(d["end_time"]).alias("end_time"), d["end_date"].alias("end_date")))
    flat = each.select(
        F.col("e.id").alias("id"), "filename", "file_hash", "source_code", "e.title", "e.short_description", "e.description", "e.highlights",
        place["name"].alias("location_name"), city.alias("location_city"), district.alias("location_district"), place["street"].alias("location_street"),
        place["street_no"].alias("location_street_no"), place["zipcode"].alias("location_zipcode"),
        place["geo"]["latitude"].alias("geo_latitude"), place["geo"]["longitude"].alias("geo_longitude"), place["geo"]["confidence"].alias("geo_confidence"), place["geo"]["country"].alias("geo_country"),
        "e.source_type", "e.categories", "e.is_family_event", "e.is_child_focused", "e.admission_free", "e.registration_required", "e.registration_contact",
        "e.confidence_score", F.col("e._batch_index").alias("batch_index"), F.col("e._extracted_at").alias("extracted_at"), dates.alias("dates"),
    )
    named = flat.withColumns({
        "title_normalized": normalize_title(F.col("title")), "short_description_normalized": normalize_text(F.col("short_description"), SYNONYMS),
        "location_name_normalized": normalize_text(F.col("location_name")), "location_city_normalized": normalize_city(F.col("location_city"), CITY_PARTS),
    })
    return named.withColumn("blocking_keys", scores.blocking_keys(F.col("dates"), F.col("location_city_normalized"), F.col("geo_latitude"), F.col("geo_longitude"), F.col("geo_confidence")))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is not known yet, whatever became of it; of equal files of a batch the first by name."""
    first = files.groupBy("file_hash").agg(F.min("path").alias("path"))
    return files.join(first, ["file_hash", "path"], "left_semi").join(known.select("file_hash").distinct(), "file_hash", "left_anti")


def ingestions(files: DataFrame) -> DataFrame:
    """The log rows of parsed files: completed with their number of events, or failed with the error."""
    return files.select("filename", "file_hash", "source_code", F.when(F.col("error").isNull(), F.size("doc.events")).otherwise(0).alias("event_count"), F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), F.col("error").alias("error_message"))


def events_with_dates(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Events with the date entries of a child table nested in order; none gives an empty list."""
    packed = entries.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("date", "start_time", "end_time", "end_date"))).alias("nested"))
    joined = events.join(packed, events["id"] == packed["event_id"], "left").drop("event_id")
    return joined.withColumn("dates", F.coalesce("nested", F.array().cast(packed.schema["nested"].dataType))).drop("nested")
