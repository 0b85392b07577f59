"""Queries of the reference's own operators over the event tables, each with its SQL.

Names start with the section they belong to: fn (scalar functions), scan,
filter, join, agg, merge (survivorship), sort, graph, edit (review).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindwurm.config import DEFAULTS, DEPLOYED, merged
from lindwurm.functions import scores, text
from lindwurm.operators import evaluation, graph, pairs, reports, review, search, survivorship
from lindwurm.plans import pipeline
from lindwurm.runtime import load
from lindwurm.sources import exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_events")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return pairs.one_per_id(_events(spark, d))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "match_decisions")


def _canonicals(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "canonical_events")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "canonical_event_sources")


def _normal_sql(column: str, synonyms: list[tuple[str, str]] = ()) -> str:
    out = f"nfc_normalize(lower(coalesce({column}, '')))"
    for a, b in [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]:
        out = f"replace({out}, '{a}', '{b}')"
    strip = lambda x: f"regexp_replace({x}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')"
    out = strip(f"regexp_replace({out}, '[\\s\\x{{00a0}}]+', ' ', 'g')")
    for a, b in synonyms:
        out = f"replace({out}, '{a}', '{b}')"
    return strip(f"regexp_replace({out}, '[\"''!?,.:;()\\[\\]{{}}]', '', 'g')")


def _prefix_sql(column: str) -> str:
    patterns = [p + x for p in text.DASH_PREFIXES for x in text.DASHES] + [p + ": " for p in text.COLON_PREFIXES] + [p + x for p in text.GENERIC_PREFIXES for x in text.DASHES]
    cases = " ".join(f"WHEN starts_with(lower({column}), '{p.lower()}') THEN trim(substr({column}, {len(p) + 1}))" for p in patterns)
    return f"CASE {cases} ELSE {column} END"


TIME = "regexp_matches(trim({0}), '^\\d{{1,2}}:\\d{{1,2}}(:\\d{{1,2}})?$')"
SECONDS = "CASE WHEN " + TIME + " THEN split_part({0}, ':', 1)::INT * 3600 + split_part({0}, ':', 2)::INT * 60 + coalesce(try_cast(split_part({0}, ':', 3) AS INT), 0) END"
KM = "6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h}))"
HAVERSINE = "least(1.0, pow(sin(radians({1}.geo_latitude - {0}.geo_latitude) / 2), 2) + cos(radians({0}.geo_latitude)) * cos(radians({1}.geo_latitude)) * pow(sin(radians({1}.geo_longitude - {0}.geo_longitude) / 2), 2))"
ONE = "(SELECT DISTINCT ON (id) * FROM source_events ORDER BY id, file_ingestion_id)"
PAIRS = """
k AS (SELECT DISTINCT id, source_code, unnest(blocking_keys) AS key FROM source_events WHERE id IS NOT NULL),
pairs AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id)
"""


# scalar functions
@query("fn_normalize_text", f"SELECT DISTINCT id, {_normal_sql('title')} AS plain, {_normal_sql('short_description', text.SYNONYMS)} AS with_synonyms FROM source_events")
def fn_normalize_text(spark, d):
    return _events(spark, d).select("id", text.normalize_text(F.col("title")).alias("plain"), text.normalize_text(F.col("short_description"), text.SYNONYMS).alias("with_synonyms")).distinct()


@query("fn_normalize_city", f"""
WITH n AS (SELECT DISTINCT location_city, {_normal_sql('location_city')} AS name FROM source_events)
SELECT location_city, CASE name {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in text.CITY_PARTS.items())} ELSE name END AS city FROM n""")
def fn_normalize_city(spark, d):
    return _events(spark, d).select("location_city", text.normalize_city(F.col("location_city"), text.CITY_PARTS).alias("city")).distinct()


@query("fn_strip_prefixes", f"SELECT DISTINCT title, {_prefix_sql('title')} AS rest FROM source_events")
def fn_strip_prefixes(spark, d):
    return _events(spark, d).select("title", text.strip_prefixes(F.col("title")).alias("rest")).distinct()


@query("fn_normalize_title", f"SELECT DISTINCT title, {_normal_sql('(' + _prefix_sql('title') + ')', text.SYNONYMS)} AS normal FROM source_events")
def fn_normalize_title(spark, d):
    return _events(spark, d).select("title", text.normalize_title(F.col("title")).alias("normal")).distinct()


@query("fn_parse_time", f"""
WITH t AS (SELECT DISTINCT unnest(dates).start_time AS raw FROM source_events), s AS (SELECT raw, {SECONDS.format('raw')} AS n FROM t)
SELECT raw, CASE WHEN n IS NOT NULL THEN lpad((n // 3600)::VARCHAR, 2, '0') || ':' || lpad((n % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((n % 60)::VARCHAR, 2, '0') END AS time, coalesce(n, -1)::INT AS seconds FROM s""")
def fn_parse_time(spark, d):
    raw = _events(spark, d).select(F.explode("dates.start_time").alias("raw")).distinct()
    return raw.select("raw", scores.parse_time(F.col("raw")).alias("time"), F.coalesce(scores.seconds(F.col("raw")), F.lit(-1)).alias("seconds"))


@query("fn_geo_grid", """
SELECT DISTINCT id, printf('%.2f|%.2f', round_even(geo_latitude / 0.09, 0) * 0.09, round_even(geo_longitude / 0.13, 0) * 0.13) AS cell
FROM source_events WHERE geo_confidence >= 0.85 AND geo_latitude BETWEEN 47.5 AND 48.5 AND geo_longitude BETWEEN 7.3 AND 8.5""")
def fn_geo_grid(spark, d):
    lat, lon = F.col("geo_latitude"), F.col("geo_longitude")
    return _events(spark, d).where(scores.trusted_position(lat, lon, F.col("geo_confidence"))).select("id", scores.geo_grid_key(lat, lon).alias("cell")).distinct()


@query("fn_blocking_keys", """
WITH e AS (SELECT DISTINCT id, location_city_normalized AS city, geo_latitude AS la, geo_longitude AS lo, geo_confidence AS gc, unnest(dates).date AS day FROM source_events)
SELECT DISTINCT id, 'dc|' || day || '|' || city AS key FROM e WHERE coalesce(city, '') <> '' AND day IS NOT NULL
UNION
SELECT DISTINCT id, 'dg|' || day || '|' || printf('%.2f|%.2f', round_even(la / 0.09, 0) * 0.09, round_even(lo / 0.13, 0) * 0.13) FROM e
WHERE day IS NOT NULL AND gc >= 0.85 AND la BETWEEN 47.5 AND 48.5 AND lo BETWEEN 7.3 AND 8.5""")
def fn_blocking_keys(spark, d):
    keys = scores.blocking_keys(F.col("dates"), F.col("location_city_normalized"), F.col("geo_latitude"), F.col("geo_longitude"), F.col("geo_confidence"))
    return _events(spark, d).select("id", F.explode(keys).alias("key")).distinct()


@query("fn_day_range", """
WITH e AS (SELECT DISTINCT id, unnest(dates) AS x FROM source_events), r AS (SELECT id, try_cast(x.date AS DATE) AS a, try_cast(x.end_date AS DATE) AS b FROM e)
SELECT DISTINCT id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE::VARCHAR AS day FROM r WHERE a <= b""")
def fn_day_range(spark, d):
    entries = _events(spark, d).select("id", F.explode("dates").alias("x"))
    return entries.select("id", F.explode(scores.day_range(F.col("x.date"), F.col("x.end_date"))).alias("day")).select("id", F.col("day").cast("string")).distinct()


def _paired(spark, d):
    own = _ids(spark, d).select("id", "title", "geo_latitude", "geo_longitude", "geo_confidence", "categories", "dates")
    return pairs.with_records(pairs.candidate_pairs(_events(spark, d)), own)


@query("fn_haversine", f"""
WITH {PAIRS} SELECT id_a, id_b, round({KM.format(h=HAVERSINE.format('a', 'b'))}, 6) AS km FROM pairs JOIN {ONE} a ON a.id = id_a JOIN {ONE} b ON b.id = id_b
WHERE abs(a.geo_latitude) <= 90 AND abs(b.geo_latitude) <= 90""")
def fn_haversine(spark, d):
    a, b = F.col("a"), F.col("b")
    near = _paired(spark, d).where((F.abs(a["geo_latitude"]) <= 90) & (F.abs(b["geo_latitude"]) <= 90))
    return near.select("id_a", "id_b", F.round(scores.haversine_km(a["geo_latitude"], a["geo_longitude"], b["geo_latitude"], b["geo_longitude"]), 6).alias("km"))


@query("fn_geo_score", f"""
WITH {PAIRS}, g AS (
  SELECT id_a, id_b, a.geo_latitude AS la, a.geo_longitude AS lo, b.geo_latitude AS lb, b.geo_longitude AS lp, a.geo_confidence AS ca, b.geo_confidence AS cb,
         {KM.format(h=HAVERSINE.format('a', 'b'))} AS km
  FROM pairs JOIN {ONE} a ON a.id = id_a JOIN {ONE} b ON b.id = id_b)
SELECT id_a, id_b, round(CASE WHEN la IS NULL OR lo IS NULL OR lb IS NULL OR lp IS NULL THEN 0.5
  WHEN NOT (abs(la - lb) < 1e-6 AND abs(lo - lp) < 1e-6) AND (coalesce(ca < 0.85, false) OR coalesce(cb < 0.85, false)) THEN 0.5
  ELSE greatest(0.0, 1 - km / 10.0) END, 6) AS score FROM g""")
def fn_geo_score(spark, d):
    return _paired(spark, d).select("id_a", "id_b", F.round(scores.geo_score(F.col("a"), F.col("b")), 6).alias("score"))


@query("fn_date_score", f"""
WITH {PAIRS}, x AS (SELECT id, unnest(dates) AS t, unnest(range(1, len(dates) + 1)) AS i FROM {ONE}),
f AS (SELECT id, t.date AS day, arg_min(struct_pack(s := {SECONDS.format('t.start_time')}), i).s AS s FROM x WHERE t.date IS NOT NULL GROUP BY id, t.date),
n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
j AS (SELECT id_a, id_b, count(*) AS k, avg(CASE WHEN a.s IS NULL OR b.s IS NULL OR abs(a.s - b.s) / 60.0 <= 30 THEN 1.0 WHEN abs(a.s - b.s) / 60.0 <= 90 THEN 0.1 ELSE 0.0 END) AS f
      FROM pairs JOIN f a ON a.id = id_a JOIN f b ON b.id = id_b AND a.day = b.day GROUP BY id_a, id_b)
SELECT p.id_a, p.id_b, round(coalesce(k * 1.0 / (na.n + nb.n - k) * f, 0.0), 6) AS score
FROM pairs p LEFT JOIN j USING (id_a, id_b) LEFT JOIN n na ON na.id = p.id_a LEFT JOIN n nb ON nb.id = p.id_b""")
def fn_date_score(spark, d):
    own = _ids(spark, d).select("id", scores.starts(F.col("dates")).alias("starts"))
    met = pairs.candidates_with_records(_events(spark, d), own)
    return met.select("id_a", "id_b", F.round(scores.start_score(F.col("a.starts"), F.col("b.starts")), 6).alias("score"))


@query("fn_weights", f"""
WITH {PAIRS} SELECT id_a, id_b, CASE
  WHEN list_contains(a.categories, 'fasnacht') AND list_contains(b.categories, 'fasnacht') THEN 0.25
  WHEN list_contains(a.categories, 'versammlung') AND list_contains(b.categories, 'versammlung') THEN 0.4 ELSE 0.3 END::DOUBLE AS title_weight
FROM pairs JOIN {ONE} a ON a.id = id_a JOIN {ONE} b ON b.id = id_b""")
def fn_weights(spark, d):
    by = scores.weights(F.col("a"), F.col("b"), merged(DEFAULTS, DEPLOYED))
    return _paired(spark, d).select("id_a", "id_b", by["title"].alias("title_weight"))


@query("fn_combine_decide", """
WITH s AS (SELECT id, title_score, (0.30 * date_score + 0.25 * geo_score + 0.30 * title_score + 0.15 * description_score) / (0.30 + 0.25 + 0.30 + 0.15) AS score FROM match_decisions)
SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.75 AND title_score < 0.45 THEN 'ambiguous' WHEN score >= 0.75 THEN 'match' WHEN score <= 0.35 THEN 'no_match' ELSE 'ambiguous' END AS decided FROM s""")
def fn_combine_decide(spark, d):
    by = {s: F.lit(float(w)) for s, w in DEFAULTS["scoring"].items()}
    score = scores.combined({s: F.col(f"{s}_score") for s in by}, by)
    return _decisions(spark, d).withColumn("score", score).select("id", F.round("score", 6).alias("score"), scores.decide(F.col("score"), F.col("title_score")).alias("decided"))


@query("fn_scored_pairs")
def fn_scored_pairs(spark, d):
    return pairs.score_candidates(_events(spark, d), merged(DEFAULTS, DEPLOYED))


@query("fn_confidence_bands", "SELECT id, coalesce(round(match_confidence * 100), -1)::INT AS percent, CASE WHEN match_confidence >= 0.8 THEN 'high' WHEN match_confidence >= 0.5 THEN 'medium' WHEN match_confidence IS NOT NULL THEN 'low' END AS band FROM canonical_events")
def fn_confidence_bands(spark, d):
    return reports.confidence_bands(_canonicals(spark, d)).fillna(-1, ["percent"])


# scans, sources, sinks
@query("scan_source_codes", "SELECT id, split_part(regexp_replace(filename, '\\.json$', ''), '_', 1) AS code FROM file_ingestions")
def scan_source_codes(spark, d):
    return load(spark, d, "file_ingestions").select("id", F.substring_index(F.regexp_replace("filename", r"\.json$", ""), "_", 1).alias("code"))


@query("scan_first_by_hash", """
SELECT id, filename FROM (SELECT id, filename, row_number() OVER (PARTITION BY lower(trim(file_hash)) ORDER BY filename, id) AS k FROM file_ingestions WHERE file_hash IS NOT NULL) WHERE k = 1""")
def scan_first_by_hash(spark, d):
    files = load(spark, d, "file_ingestions").where("file_hash is not null")
    first = files.groupBy(F.lower(F.trim("file_hash")).alias("hash")).agg(F.min(F.struct("filename", "id")).alias("x"))
    return first.select("x.id", "x.filename")


@query("scan_export_rows", "SELECT id FROM canonical_events WHERE updated_at >= TIMESTAMP '2012-02-01' AND created_at >= TIMESTAMP '2012-01-01'")
def scan_export_rows(spark, d):
    return exports.selected(_canonicals(spark, d), "2012-01-01 00:00:00", "2012-02-01 00:00:00").select("id")


@query("scan_export_parts", """
WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM canonical_events)
SELECT (i // 200 + 1)::INT AS part, count(*) AS records, min(id) AS first_id, max(id) AS last_id FROM n GROUP BY 1""")
def scan_export_parts(spark, d):
    return exports.numbered(_canonicals(spark, d)).groupBy("part").agg(F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("scan_export_documents")
def scan_export_documents(spark, d):
    return exports.parts(_canonicals(spark, d), exported_at="2012-03-01T00:00:00+00:00")


@query("scan_flatten_dates", "SELECT DISTINCT id, x.date AS day, x.start_time AS start_time, x.end_date AS end_date FROM (SELECT id, unnest(dates) AS x FROM source_events)")
def scan_flatten_dates(spark, d):
    return _events(spark, d).select("id", F.explode("dates").alias("x")).select("id", F.col("x.date").alias("day"), "x.start_time", "x.end_date").distinct()


# filters
@query("filter_title", "SELECT id, title FROM canonical_events WHERE title ILIKE '%vortrag%'")
def filter_title(spark, d):
    return search.filtered(_canonicals(spark, d), q="vortrag").select("id", "title")


@query("filter_cities", "SELECT id, location_city FROM canonical_events WHERE location_city ILIKE '%tindorf%' OR location_city ILIKE '%weiler%'")
def filter_cities(spark, d):
    return search.filtered(_canonicals(spark, d), cities=["tindorf", "weiler"]).select("id", "location_city")


@query("filter_dates", "SELECT id, first_date::VARCHAR AS first_date, last_date::VARCHAR AS last_date FROM canonical_events WHERE first_date >= DATE '2012-01-10' AND last_date <= DATE '2012-01-31'")
def filter_dates(spark, d):
    return search.filtered(_canonicals(spark, d), date_from="2012-01-10", date_to="2012-01-31").select("id", F.col("first_date").cast("string"), F.col("last_date").cast("string"))


@query("filter_categories", "SELECT id FROM canonical_events WHERE to_json(categories)::VARCHAR ILIKE '%vortrag%' AND categories IS NOT NULL")
def filter_categories(spark, d):
    return search.filtered(_canonicals(spark, d), categories=["vortrag"]).select("id")


@query("filter_review", "SELECT id FROM canonical_events WHERE (needs_review OR (match_confidence < 0.8 AND source_count > 1)) AND source_count >= 2")
def filter_review(spark, d):
    return search.review_queue(_canonicals(spark, d), 2).select("id")


@query("filter_trusted_position", "SELECT DISTINCT id FROM source_events WHERE geo_confidence >= 0.85 AND geo_latitude BETWEEN 47.5 AND 48.5 AND geo_longitude BETWEEN 7.3 AND 8.5")
def filter_trusted_position(spark, d):
    return _events(spark, d).where(scores.trusted_position(F.col("geo_latitude"), F.col("geo_longitude"), F.col("geo_confidence"))).select("id").distinct()


@query("filter_pairs_by_category", """
WITH h AS (SELECT DISTINCT id FROM source_events WHERE list_contains(categories, 'vortrag')),
p AS (SELECT DISTINCT least(source_event_id_a, source_event_id_b) AS id_a, greatest(source_event_id_a, source_event_id_b) AS id_b FROM match_decisions)
SELECT id_a, id_b FROM p WHERE id_a IN (SELECT id FROM h) OR id_b IN (SELECT id FROM h)""")
def filter_pairs_by_category(spark, d):
    both = evaluation.unordered(_decisions(spark, d)).select("id_a", "id_b").distinct()
    return evaluation.with_category(both, _events(spark, d), "vortrag")


# joins
@query("join_blocking", f"WITH {PAIRS} SELECT id_a, id_b FROM pairs")
def join_blocking(spark, d):
    return pairs.candidate_pairs(_events(spark, d))


@query("join_blocking_cross_source", """
WITH k AS (SELECT DISTINCT id, source_code, unnest(blocking_keys) AS key FROM source_events WHERE id IS NOT NULL)
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id AND a.source_code <> b.source_code""")
def join_blocking_cross_source(spark, d):
    return pairs.candidate_pairs(_events(spark, d), cross_source=True)


@query("join_record_dates", """
SELECT DISTINCT c.canonical_event_id, s.id AS source_event_id, s.source_code, x.x.date AS day
FROM (SELECT DISTINCT canonical_event_id, source_event_id FROM canonical_event_sources) c
JOIN (SELECT DISTINCT ON (id) id, source_code, dates FROM source_events ORDER BY id, file_ingestion_id) s ON s.id = c.source_event_id, LATERAL (SELECT unnest(s.dates) AS x) x""")
def join_record_dates(spark, d):
    members = survivorship.members_of(_ids(spark, d), _links(spark, d))
    return members.select(F.col("cluster").alias("canonical_event_id"), F.col("id").alias("source_event_id"), "source_code", F.explode("dates.date").alias("day")).distinct()


@query("join_inner_decisions", """
WITH l AS (SELECT DISTINCT canonical_event_id AS c, source_event_id AS s FROM canonical_event_sources), m AS (SELECT c FROM l GROUP BY c HAVING count(*) >= 2)
SELECT a.c AS canonical_event_id, d.id AS decision_id FROM match_decisions d JOIN l a ON a.s = d.source_event_id_a JOIN l b ON b.s = d.source_event_id_b AND a.c = b.c WHERE a.c IN (SELECT c FROM m)""")
def join_inner_decisions(spark, d):
    return search.inner_decisions(_links(spark, d), _decisions(spark, d))


@query("join_undecided_candidates", f"""
WITH {PAIRS} SELECT id_a, id_b FROM pairs WHERE (id_a, id_b) NOT IN (
  SELECT least(source_event_id_a, source_event_id_b), greatest(source_event_id_a, source_event_id_b) FROM match_decisions)""")
def join_undecided_candidates(spark, d):
    known = evaluation.unordered(_decisions(spark, d)).select("id_a", "id_b")
    return evaluation.unlabelled(pairs.candidate_pairs(_events(spark, d)), known)


# aggregates
@query("agg_blocking_stats", f"""
WITH {PAIRS}, n AS (SELECT count(DISTINCT id) AS events FROM source_events), b AS (SELECT count(*) AS blocked_pairs FROM pairs)
SELECT events, events * (events - 1) // 2 AS possible_pairs, blocked_pairs,
  CASE WHEN events > 1 THEN round(100.0 * (1 - blocked_pairs / (events * (events - 1) / 2.0)), 6) ELSE 0.0 END AS reduction_pct FROM n, b""")
def agg_blocking_stats(spark, d):
    return pairs.blocking_stats(_events(spark, d))


@query("agg_file_stats", """
SELECT count(*) AS total_files, coalesce(sum(event_count), 0)::BIGINT AS total_events, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'error')::BIGINT AS errors, count_if(status = 'failed')::BIGINT AS failed
FROM file_ingestions WHERE ingested_at >= TIMESTAMP '2012-01-15'""")
def agg_file_stats(spark, d):
    return reports.file_stats(load(spark, d, "file_ingestions"), "2012-01-15 00:00:00")


@query("agg_daily_history", """
SELECT ingested_at::DATE::VARCHAR AS day, count(*) AS files_processed, coalesce(sum(event_count), 0)::BIGINT AS events_ingested, count_if(status = 'error')::BIGINT AS errors
FROM file_ingestions WHERE ingested_at >= TIMESTAMP '2012-01-15' GROUP BY 1""")
def agg_daily_history(spark, d):
    return reports.daily_history(load(spark, d, "file_ingestions"), "2012-01-15 00:00:00").withColumn("day", F.col("day").cast("string"))


@query("agg_decision_counts", """
SELECT x.decision, count(m.id) AS n FROM (VALUES ('match'), ('no_match'), ('ambiguous')) x(decision) LEFT JOIN match_decisions m ON m.decision = x.decision GROUP BY 1""")
def agg_decision_counts(spark, d):
    return reports.decision_counts(_decisions(spark, d))


@query("agg_canonical_stats", "SELECT count(*) AS total, count_if(needs_review)::BIGINT AS needs_review, nullif(round(avg(match_confidence), 4), 0.0) AS avg_confidence FROM canonical_events")
def agg_canonical_stats(spark, d):
    return reports.canonical_stats(_canonicals(spark, d))


@query("agg_categories", "SELECT DISTINCT c AS category FROM (SELECT unnest(categories) AS c FROM canonical_events) WHERE c IS NOT NULL")
def agg_categories(spark, d):
    return search.distinct_categories(_canonicals(spark, d))


@query("agg_cities", "SELECT DISTINCT location_city AS city FROM canonical_events WHERE location_city IS NOT NULL")
def agg_cities(spark, d):
    return search.distinct_cities(_canonicals(spark, d))


LABELS = """
l AS (SELECT DISTINCT least(source_event_id_a, source_event_id_b) AS id_a, greatest(source_event_id_a, source_event_id_b) AS id_b,
      CASE decision WHEN 'match' THEN 'same' ELSE 'different' END AS label FROM match_decisions WHERE decision IN ('match', 'no_match') AND tier = 'deterministic')
"""


def _labels(spark, d):
    told = evaluation.unordered(_decisions(spark, d).where("decision in ('match', 'no_match') and tier = 'deterministic'"))
    return told.select("id_a", "id_b", F.when(F.col("decision") == "match", "same").otherwise("different").alias("label")).distinct()


@query("agg_metrics", f"""
WITH {LABELS}, c AS (SELECT DISTINCT canonical_event_id AS c, source_event_id AS s FROM canonical_event_sources),
p AS (SELECT DISTINCT a.s AS id_a, b.s AS id_b FROM c a JOIN c b ON a.c = b.c AND a.s < b.s),
x AS (SELECT label = 'same' AS same, p.id_a IS NOT NULL AS hit FROM l LEFT JOIN p USING (id_a, id_b)),
n AS (SELECT count_if(same AND hit)::BIGINT AS tp, count_if(NOT same AND hit)::BIGINT AS fp, count_if(same AND NOT hit)::BIGINT AS fn, count_if(NOT same AND NOT hit)::BIGINT AS tn FROM x),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM n)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")
def agg_metrics(spark, d):
    own = _links(spark, d).select("canonical_event_id", "source_event_id").distinct()
    both = own.alias("a").join(own.alias("b"), "canonical_event_id").where("a.source_event_id < b.source_event_id").select(F.col("a.source_event_id").alias("id_a"), F.col("b.source_event_id").alias("id_b"))
    return evaluation.metrics(both, _labels(spark, d))


@query("agg_sweep", f"""
WITH {LABELS}, s AS (SELECT least(source_event_id_a, source_event_id_b) AS id_a, greatest(source_event_id_a, source_event_id_b) AS id_b, max(title_score) AS score FROM match_decisions GROUP BY 1, 2),
t AS (SELECT unnest([0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85])::DOUBLE AS threshold),
x AS (SELECT threshold, label = 'same' AS same, coalesce(score >= threshold, false) AS hit FROM l LEFT JOIN s USING (id_a, id_b), t),
n AS (SELECT threshold, count_if(same AND hit)::BIGINT AS tp, count_if(NOT same AND hit)::BIGINT AS fp, count_if(same AND NOT hit)::BIGINT AS fn, count_if(NOT same AND NOT hit)::BIGINT AS tn FROM x GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM n)
SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")
def agg_sweep(spark, d):
    scored = evaluation.unordered(_decisions(spark, d)).select("id_a", "id_b", F.col("title_score").alias("score"))
    return evaluation.sweep(scored, _labels(spark, d))


@query("agg_label_stats", f"WITH {LABELS} SELECT count(*) AS total, count_if(label = 'same')::BIGINT AS same, count_if(label = 'different')::BIGINT AS different FROM l")
def agg_label_stats(spark, d):
    return evaluation.label_stats(_labels(spark, d))


# survivorship over the stored links, in order of source id
def _merged(spark, d):
    return survivorship.synthesize(survivorship.members_of(_ids(spark, d), _links(spark, d)))


MEMBERS = """
m AS (SELECT l.c, e.* FROM (SELECT DISTINCT canonical_event_id AS c, source_event_id AS s FROM canonical_event_sources) l
      JOIN (SELECT DISTINCT ON (id) * FROM source_events ORDER BY id, file_ingestion_id) e ON e.id = l.s)
"""


def _longest_sql(field: str, least: int = 0) -> str:
    order = f"(CASE WHEN length({field}) >= {least} THEN 0 ELSE 1 END, -length({field}), id)"
    return f"arg_min({field}, {order}) FILTER (WHERE coalesce({field}, '') <> '') AS {field}, coalesce(arg_min(id, {order}) FILTER (WHERE coalesce({field}, '') <> ''), min(id)) AS {field}_from"


@query("merge_texts", f"""
WITH {MEMBERS}, g AS (SELECT c AS cluster, {_longest_sql('title', 10)}, {', '.join(_longest_sql(f) for f in ('short_description', 'description', 'location_name', 'location_street'))} FROM m GROUP BY c)
SELECT * REPLACE (coalesce(title, '') AS title) FROM g""")
def merge_texts(spark, d):
    fields = ["title", "short_description", "description", "location_name", "location_street"]
    return _merged(spark, d).select("cluster", *fields, *[F.element_at("field_provenance", f).alias(f"{f}_from") for f in fields])


@query("merge_city", f"""
WITH {MEMBERS}, n AS (SELECT c, location_city AS v, count(*) AS k, min(id) AS f FROM m WHERE coalesce(location_city, '') <> '' GROUP BY 1, 2),
b AS (SELECT c, arg_min(v, (-k, f)) AS v, arg_min(f, (-k, f)) AS f FROM n GROUP BY 1), a AS (SELECT c, min(id) AS first FROM m GROUP BY 1)
SELECT a.c AS cluster, b.v AS location_city, coalesce(b.f, a.first) AS location_city_from FROM a LEFT JOIN b USING (c)""")
def merge_city(spark, d):
    return _merged(spark, d).select("cluster", "location_city", F.element_at("field_provenance", "location_city").alias("location_city_from"))


@query("merge_geo", f"""
WITH {MEMBERS}, a AS (SELECT c, min(id) AS first FROM m GROUP BY 1),
g AS (SELECT c, arg_min(id, (-geo_confidence, id)) AS f FROM m WHERE geo_latitude IS NOT NULL AND geo_longitude IS NOT NULL AND geo_confidence IS NOT NULL GROUP BY 1)
SELECT a.c AS cluster, m.geo_latitude, m.geo_longitude, m.geo_confidence, coalesce(g.f, a.first) AS geo_from FROM a LEFT JOIN g USING (c) LEFT JOIN m ON m.c = g.c AND m.id = g.f""")
def merge_geo(spark, d):
    return _merged(spark, d).select("cluster", "geo_latitude", "geo_longitude", "geo_confidence", F.element_at("field_provenance", "geo").alias("geo_from"))


@query("merge_lists", f"""
WITH {MEMBERS}, x AS (SELECT c, id, unnest(categories) AS v, unnest(range(1, len(categories) + 1)) AS i FROM m),
u AS (SELECT c, v, min((id, i)) AS o FROM x GROUP BY 1, 2), k AS (SELECT c, string_agg(v, '|' ORDER BY o) AS categories FROM u GROUP BY 1),
y AS (SELECT c, unnest(dates) AS t FROM m), z AS (SELECT c, count(DISTINCT t) AS n, min(least(t.date, coalesce(nullif(t.end_date, ''), t.date))) AS a, max(greatest(t.date, coalesce(nullif(t.end_date, ''), t.date))) AS b FROM y GROUP BY 1)
SELECT m.c AS cluster, coalesce(any_value(k.categories), '') AS categories, coalesce(any_value(z.n), 0)::INT AS n_dates, any_value(z.a) AS first_date, any_value(z.b) AS last_date
FROM m LEFT JOIN k USING (c) LEFT JOIN z USING (c) GROUP BY 1""")
def merge_lists(spark, d):
    return _merged(spark, d).select("cluster", F.array_join("categories", "|").alias("categories"), F.size("dates").alias("n_dates"), "first_date", "last_date")


@query("merge_flags", f"""
WITH {MEMBERS} SELECT c AS cluster, bool_or(coalesce(is_family_event, false)) AS is_family_event, coalesce(min(CASE WHEN is_family_event THEN id END), min(id)) AS is_family_event_from,
  bool_or(coalesce(admission_free, false)) AS admission_free, count(*)::INT AS source_count FROM m GROUP BY 1""")
def merge_flags(spark, d):
    return _merged(spark, d).select("cluster", "is_family_event", F.element_at("field_provenance", "is_family_event").alias("is_family_event_from"), "admission_free", "source_count")


@query("merge_enriched", f"""
WITH {MEMBERS}, n AS (SELECT c, coalesce(arg_min(description, (-length(description), id)) FILTER (WHERE coalesce(description, '') <> ''), '') AS v FROM m GROUP BY 1)
SELECT n.c AS cluster, nullif(CASE WHEN length(coalesce(o.description, '')) > length(n.v) THEN o.description ELSE n.v END, '') AS description, (coalesce(o.version, 0) + 1)::INT AS version
FROM n LEFT JOIN canonical_events o ON o.id = n.c""")
def merge_enriched(spark, d):
    old = _canonicals(spark, d).withColumnRenamed("id", "cluster")
    return survivorship.enrich(old, _merged(spark, d)).select("cluster", F.nullif("description", F.lit("")).alias("description"), "version")


# sorting and paging
@query("sort_page_by_confidence", "SELECT id, match_confidence FROM canonical_events ORDER BY match_confidence DESC NULLS LAST, id LIMIT 25 OFFSET 25")
def sort_page_by_confidence(spark, d):
    return search.page(search.ordered(_canonicals(spark, d), "confidence", True), 2, 25).select("id", "match_confidence")


@query("sort_page_by_city", "SELECT id, location_city FROM canonical_events ORDER BY location_city ASC NULLS FIRST, id LIMIT 40")
def sort_page_by_city(spark, d):
    return search.page(search.ordered(_canonicals(spark, d), "city"), 1, 40).select("id", "location_city")


@query("sort_review_queue", """
SELECT id FROM canonical_events WHERE (needs_review OR (match_confidence < 0.8 AND source_count > 1)) AND source_count >= 1
ORDER BY needs_review DESC, coalesce(match_confidence, 0), id LIMIT 20""")
def sort_review_queue(spark, d):
    return search.page(search.review_queue(_canonicals(spark, d)), 1, 20, 100).select("id")


@query("sort_hard_negatives")
def sort_hard_negatives(spark, d):
    scored = evaluation.unordered(_decisions(spark, d)).select("id_a", "id_b", F.col("title_score").alias("score"))
    return evaluation.hard_negatives(scored, 0.4, 0.2, 7)


@query("sort_renormalized", f"""
WITH r AS (SELECT DISTINCT id, title_normalized AS old, {_normal_sql('(' + _prefix_sql('title') + ')', text.SYNONYMS)} AS fresh FROM source_events)
SELECT id, old, fresh FROM r WHERE old IS DISTINCT FROM fresh""")
def sort_renormalized(spark, d):
    fresh = _events(spark, d).select("id", F.col("title_normalized").alias("old"), text.normalize_title(F.col("title")).alias("fresh"))
    return fresh.where(~F.col("old").eqNullSafe(F.col("fresh"))).distinct()


# graph
LINKED = """
e AS (SELECT source_event_id_a AS u, source_event_id_b AS v FROM match_decisions WHERE decision = 'match' AND source_event_id_a <> source_event_id_b),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach(u, v) AS (SELECT u, v FROM s UNION SELECT r.u, s.v FROM reach r JOIN s ON r.v = s.u),
c AS (SELECT n.id, coalesce(least(n.id, min(reach.v)), n.id) AS cluster FROM (SELECT DISTINCT id FROM source_events) n LEFT JOIN reach ON reach.u = n.id GROUP BY n.id)
"""


def _label(spark, d):
    links = _decisions(spark, d).where("decision = 'match'").select(F.col("source_event_id_a").alias("id_a"), F.col("source_event_id_b").alias("id_b"))
    return graph.components(links, _events(spark, d))


@query("graph_components", f"WITH RECURSIVE {LINKED} SELECT id, cluster FROM c")
def graph_components(spark, d):
    return _label(spark, d)


@query("graph_cluster_counts", f"WITH RECURSIVE {LINKED}, z AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS clusters, count_if(n = 1)::BIGINT AS singletons FROM z")
def graph_cluster_counts(spark, d):
    return reports.cluster_counts(_label(spark, d))


@query("graph_coherence", f"""
WITH RECURSIVE {LINKED}, z AS (SELECT cluster, count(*) AS size FROM c GROUP BY 1),
i AS (SELECT a.cluster, count_if(m.decision = 'match')::BIGINT AS edges, avg(CASE WHEN m.decision = 'match' THEN m.combined_score END) AS confidence, bool_or(coalesce(starts_with(m.tier, 'ai'), false)) AS ai
      FROM match_decisions m JOIN c a ON a.id = m.source_event_id_a JOIN c b ON b.id = m.source_event_id_b AND a.cluster = b.cluster GROUP BY 1),
d AS (SELECT cluster, count(DISTINCT x.x.date) AS days FROM (SELECT DISTINCT id, dates FROM source_events) e JOIN c ON c.id = e.id, LATERAL (SELECT unnest(e.dates) AS x) x GROUP BY 1)
SELECT z.cluster, z.size, coalesce(edges, 0) AS edges, round(confidence, 6) AS confidence, coalesce(days, 0) AS days, coalesce(ai, false) AS ai_assisted,
  z.size > 1 AND (z.size > 15 OR coalesce(confidence < 0.40, false) OR coalesce(days, 0) > 3) AS flagged FROM z LEFT JOIN i USING (cluster) LEFT JOIN d USING (cluster)""")
def graph_coherence(spark, d):
    decided = _decisions(spark, d).select(F.col("source_event_id_a").alias("id_a"), F.col("source_event_id_b").alias("id_b"), F.col("combined_score").alias("score"), "decision", "tier")
    days = _events(spark, d).select("id", F.explode("dates.date").alias("day"))
    return graph.cluster_report(_label(spark, d), decided, days).withColumn("confidence", F.round("confidence", 6))


@query("graph_pipeline")
def graph_pipeline(spark, d):
    return pipeline.run(_events(spark, d), merged(DEFAULTS, DEPLOYED)).records


# review
@query("edit_merge", """
WITH mv AS (SELECT id AS donor, id - id % 7 AS target FROM canonical_events WHERE id % 7 = 3)
SELECT DISTINCT coalesce(mv.target, l.canonical_event_id) AS canonical_event_id, l.source_event_id FROM canonical_event_sources l LEFT JOIN mv ON mv.donor = l.canonical_event_id""")
def edit_merge(spark, d):
    moves = _canonicals(spark, d).where("id % 7 = 3").select(F.col("id").alias("donor"), F.expr("id - id % 7").alias("target"))
    return review.merge_many(_links(spark, d), moves)


@query("edit_auto_labels", """
WITH m AS (SELECT id, title_score AS t, description_score AS d, a.location_city_normalized AS ca, b.location_city_normalized AS cb FROM match_decisions m
  JOIN (SELECT DISTINCT id AS i, location_city_normalized FROM source_events) a ON a.i = m.source_event_id_a JOIN (SELECT DISTINCT id AS i, location_city_normalized FROM source_events) b ON b.i = m.source_event_id_b),
x AS (SELECT id, t, coalesce(d, 0) AS d, coalesce(ca, '') <> '' AND coalesce(cb, '') <> '' AND ca = cb AS same, coalesce(ca, '') <> '' AND coalesce(cb, '') <> '' AND ca <> cb AS other FROM m)
SELECT id, CASE WHEN t >= 0.90 AND same OR t >= 0.70 AND same AND d >= 0.80 THEN 'same' WHEN t < 0.40 OR other AND t < 0.70 THEN 'different' END AS label FROM x""")
def edit_auto_labels(spark, d):
    own = _events(spark, d).select("id", "location_city_normalized").distinct()
    both = _decisions(spark, d).join(own.select(F.col("id").alias("source_event_id_a"), F.col("location_city_normalized").alias("city_a")), "source_event_id_a").join(own.select(F.col("id").alias("source_event_id_b"), F.col("location_city_normalized").alias("city_b")), "source_event_id_b")
    told = both.select("id", F.col("title_score").alias("title_sim"), F.col("description_score").alias("desc_sim"), "city_a", "city_b")
    return evaluation.auto_label(told).select("id", "label")
