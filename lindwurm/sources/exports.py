"""Export of merged records in the input format, in parts of a fixed size."""

from __future__ import annotations

import argparse
import io
import json
import zipfile
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART_SIZE = 200


def selected(records: DataFrame, created_after: str | None = None, modified_after: str | None = None) -> DataFrame:
    """Records created and changed at or after the given times, by id."""
    out = records
    for column, since in (("created_at", created_after), ("updated_at", modified_after)):
        if since:
            out = out.where(F.col(column) >= F.lit(since).cast("timestamp_ntz"))
    return out.orderBy("id")


def as_input(records: DataFrame) -> DataFrame:
    """(id, event): each record as the JSON text of an input event; empty optional fields are left out."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    geo = F.when(F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull(), F.struct(F.col("geo_longitude").alias("longitude"), F.col("geo_latitude").alias("latitude"), F.col("geo_confidence").alias("confidence")))
    place: list[Column] = [text(f"location_{n}").alias(n) for n in ("name", "city", "district", "street", "zipcode")]
    filled = F.coalesce(*[text(f"location_{n}") for n in ("name", "city", "district", "street", "zipcode")]).isNotNull() | geo.isNotNull()
    event = F.struct(
        "title", text("short_description").alias("short_description"), text("description").alias("description"), some("highlights").alias("highlights"),
        F.coalesce("dates", F.array().cast(dict(records.dtypes)["dates"])).alias("event_dates"), F.when(filled, F.struct(*place, geo.alias("geo"))).alias("location"),
        some("categories").alias("categories"), "is_family_event", "is_child_focused", "admission_free",
    )
    return records.select("id", F.to_json(event).alias("event"))


def numbered(records: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """(part, position, id) in order of id, without sorting everything in one task.

    Counts per range partition give every row its global position.
    """
    spark = records.sparkSession
    ordered = records.select("id").orderBy("id").withColumn("chunk", F.spark_partition_id())
    from lindwurm.runtime import Scratch

    kept = Scratch(spark, "export").put(ordered)
    counts = sorted(kept.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["chunk"], total))
        total += row["n"]
    starts = spark.createDataFrame(offsets, "chunk int, before bigint")
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy("id"))
    placed = kept.withColumn("rank", rank).join(F.broadcast(starts), "chunk").withColumn("position", F.col("before") + F.col("rank") - 1)
    return placed.select((F.floor(F.col("position") / part_size) + 1).cast("int").alias("part"), "position", "id")


def parts(records: DataFrame, filters: dict | None = None, part_size: int = PART_SIZE, exported_at: str | None = None) -> DataFrame:
    """(part, content): each part a complete JSON document; no record gives one empty document."""
    stamp = exported_at or datetime.now(timezone.utc).isoformat()
    told = json.dumps(filters)
    placed = numbered(records, part_size).join(as_input(records), "id")
    total = placed.agg(F.max("part")).first()[0]
    if total is None:
        empty = {"events": [], "metadata": {"exportedAt": stamp, "eventCount": 0, "part": 1, "totalParts": 1, "filters": filters}}
        return records.sparkSession.createDataFrame([(1, json.dumps(empty))], "part int, content string")
    listed = placed.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "event"))), lambda x: x["event"]).alias("events"))  # part_size rows each
    head = F.format_string('], "metadata": {"exportedAt": "%s", "eventCount": %d, "part": %d, "totalParts": %d, "filters": %s}}', F.lit(stamp), F.size("events"), F.col("part"), F.lit(total), F.lit(told))
    return listed.select("part", F.concat(F.lit('{"events": ['), F.array_join("events", ", "), head).alias("content"))


def bundle(files: list[tuple[str, str]]) -> tuple[str, bytes]:
    """One file as JSON, several as a ZIP archive: (media type, bytes)."""
    if len(files) == 1:
        return "application/json", files[0][1].encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in files:
            archive.writestr(name, content)
    return "application/zip", out.getvalue()


def main(arguments: list[str] | None = None) -> None:
    """``python -m lindwurm.sources.exports TABLE --output-dir DIR [--created-after T] [--modified-after T]``."""
    cli = argparse.ArgumentParser()
    cli.add_argument("table")
    cli.add_argument("--output-dir", required=True)
    cli.add_argument("--created-after")
    cli.add_argument("--modified-after")
    given = cli.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    filters = {k: v for k, v in (("created_after", given.created_after), ("modified_after", given.modified_after)) if v}
    found = parts(selected(spark.read.parquet(given.table), given.created_after, given.modified_after), filters)
    found.select("content").write.mode("overwrite").text(given.output_dir)


if __name__ == "__main__":
    main()
