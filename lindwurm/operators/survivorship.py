"""One merged record per cluster by fixed strategies, in order of source id.

All strategies are grouped aggregates (``max_by``, ``min_by``, ``bool_or``), so
clusters are merged by partial aggregation; only the unions of lists collect,
and what they collect is the merged record's own content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindwurm.operators.pairs import one_per_id
from lindwurm.runtime import Scratch

LONGEST = ["short_description", "description", "location_name", "location_district", "location_street", "location_zipcode"]
FLAGS = ["is_family_event", "is_child_focused", "admission_free"]
NEVER = "\U0010ffff"


def longest(field: str, least: int = 0) -> Column:
    """Struct (value, id) of the longest value; values of ``least`` letters come before shorter ones."""
    filled = F.coalesce(F.col(field), F.lit("")) != ""
    size = F.length(F.col(field))
    preferred = F.when(size >= least, 1).otherwise(0)
    order = F.when(filled, F.struct(-preferred, -size, F.col("id")))
    return F.min_by(F.when(filled, F.struct(F.col(field).alias("value"), F.col("id").alias("id"))), order)


def synthesize(members: DataFrame) -> DataFrame:
    """One record per ``cluster`` from rows of source records with that column.

    Ties go to the smallest source id. An all-empty field is null (the title
    '') with the first id as provenance; rows without id or cluster drop out.
    """
    own = members.where("cluster is not null and id is not null").dropDuplicates(["cluster", "id"])
    complete = F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull() & F.col("geo_confidence").isNotNull() & (F.col("geo_confidence") > -1)
    geo = F.struct("geo_latitude", "geo_longitude", "geo_confidence", "id")
    lists = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce(F.col(c), F.array().cast(dict(own.dtypes)[c])).alias("items")))), lambda x: x["items"])))
    cities = own.where("coalesce(location_city, '') <> ''").groupBy("cluster", "location_city").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    city = cities.groupBy("cluster").agg(F.min_by(F.struct(F.col("location_city").alias("value"), F.col("first").alias("id")), F.struct(-F.col("n"), F.col("first"))).alias("city"))
    grouped = own.groupBy("cluster").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("source_count"), longest("title", 10).alias("title"),
        *[longest(f).alias(f) for f in LONGEST],
        F.min_by(F.when(complete, geo), F.when(complete, F.struct(-F.col("geo_confidence"), F.col("id")))).alias("geo"),
        *[lists(c).alias(c) for c in ("highlights", "categories", "dates")],
        *[F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in FLAGS],
        *[F.min(F.when(F.col(f), F.col("id"))).alias(f"{f}_from") for f in FLAGS],
    ).join(city, "cluster", "left")
    days = F.filter(F.concat(F.transform("dates", lambda d: d["date"]), F.transform("dates", lambda d: d["end_date"])), lambda d: d.isNotNull() & (d != ""))
    from_ = lambda c: F.coalesce(F.col(c)["id"], F.col("first_id"))
    provenance = [("title", from_("title")), *[(f, from_(f)) for f in LONGEST], ("location_city", from_("city")), ("geo", from_("geo")), *[(f, F.coalesce(F.col(f"{f}_from"), F.col("first_id"))) for f in FLAGS]]
    provenance += [(f, F.lit("union_all_sources")) for f in ("highlights", "categories", "dates")]
    return grouped.select(
        "cluster", F.coalesce(F.col("title")["value"], F.lit("")).alias("title"), *[F.col(f)["value"].alias(f) for f in LONGEST], F.col("city")["value"].alias("location_city"),
        F.col("geo")["geo_latitude"].alias("geo_latitude"), F.col("geo")["geo_longitude"].alias("geo_longitude"), F.col("geo")["geo_confidence"].alias("geo_confidence"),
        "highlights", "categories", "dates", F.array_min(days).alias("first_date"), F.array_max(days).alias("last_date"), *FLAGS,
        F.create_map(*[x for k, v in provenance for x in (F.lit(k), v)]).alias("field_provenance"), F.col("source_count").cast("int").alias("source_count"),
    )


def enrich(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = ("title", "short_description", "description")) -> DataFrame:
    """New records, but longer texts of the old ones (with their provenance) stay; version + 1.

    ``old`` has cluster, the fields, field_provenance and version.
    """
    kept = old.select("cluster", *[F.col(f).alias(f"old_{f}") for f in fields], F.col("field_provenance").alias("old_provenance"), F.col("version").alias("old_version"))
    both = new.join(kept, "cluster", "left")
    stays = {f: F.length(F.coalesce(F.col(f"old_{f}"), F.lit(""))) > F.length(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    changed = F.map_concat(
        F.map_filter("field_provenance", lambda k, v: ~k.isin(*fields)),
        *[F.create_map(F.lit(f), F.when(stays[f], F.coalesce(F.try_element_at("old_provenance", F.lit(f)), F.lit("unknown"))).otherwise(F.element_at("field_provenance", F.lit(f)))) for f in fields],
    )
    out = both.withColumn("field_provenance", changed)
    for f in fields:
        out = out.withColumn(f, F.when(stays[f], F.col(f"old_{f}")).otherwise(F.col(f)))
    return out.withColumn("version", (F.coalesce("old_version", F.lit(0)) + 1).cast("int")).select(*new.columns, "version")


def members_of(events: DataFrame, links: DataFrame) -> DataFrame:
    """Source records with the canonical record they are linked to as ``cluster``."""
    pairs = links.select(F.col("canonical_event_id").alias("cluster"), F.col("source_event_id").alias("id")).distinct()
    return pairs.join(one_per_id(events), "id")


def store(spark, records: DataFrame, label: str = "canonical") -> DataFrame:
    """The records written once to the shared folder and read back."""
    return Scratch(spark, label).put(records)
