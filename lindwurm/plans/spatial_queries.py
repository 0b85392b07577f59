"""Queries on positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lindwurm.operators.spatial import neighbours, zones_of_points
from lindwurm.runtime import load


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, zone_id): every zone that holds the position of a source event."""
    return zones_of_points(load(spark, sf_dir, "source_events"), load(spark, sf_dir, "geo_zones"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lat, lon, rows, near): per position of source events, how many rows lie at other positions within 800 m."""
    return neighbours(load(spark, sf_dir, "source_events"), 800.0)


QUERIES = {"p7_found": p7_found, "p7_near": p7_near}

SQL = {
    "p7_near": """
WITH p AS (SELECT geo_latitude AS lat, geo_longitude AS lon, count(*) AS rows FROM source_events WHERE geo_latitude BETWEEN -90 AND 90 AND geo_longitude BETWEEN -180 AND 180 GROUP BY 1, 2)
SELECT a.lat, a.lon, a.rows, coalesce(sum(b.rows), 0)::BIGINT AS near FROM p a LEFT JOIN p b ON (a.lat <> b.lat OR a.lon <> b.lon)
  AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 800
GROUP BY ALL
""",
    "p7_found": """
WITH p AS (
  SELECT DISTINCT id, geo_latitude AS la, geo_longitude AS lo FROM source_events
  WHERE geo_latitude BETWEEN -90 AND 90 AND geo_longitude BETWEEN -180 AND 180
), corner AS (
  SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM geo_zones WHERE kind = 'polygon'
), edge AS (
  SELECT zone_id, ring[i].lon AS x1, ring[i].lat AS y1,
         ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END].lon AS x2,
         ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END].lat AS y2
  FROM corner
), inside AS (
  SELECT p.id, p.la, p.lo, e.zone_id FROM p JOIN edge e
    ON (e.y1 <= p.la) <> (e.y2 <= p.la) AND p.lo < e.x1 + (p.la - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY ALL HAVING count(*) % 2 = 1
), near AS (
  SELECT p.id, z.zone_id FROM p JOIN geo_zones z ON z.kind = 'circle'
    AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(z.centre_lat - p.la) / 2), 2)
        + cos(radians(p.la)) * cos(radians(z.centre_lat)) * pow(sin(radians(z.centre_lon - p.lo) / 2), 2))) <= z.radius_m
)
SELECT DISTINCT id, zone_id FROM (SELECT id, zone_id FROM inside UNION ALL SELECT id, zone_id FROM near)
""",
}
