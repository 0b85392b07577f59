"""Queries of intake, review, second opinions and evaluation through the library's operators, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindwurm.config import DEFAULTS, DEPLOYED, merged
from lindwurm.operators import evaluation, reports, resolver, review, search, survivorship
from lindwurm.plans import pipeline
from lindwurm.plans.table_queries import LABELS, LINKED, MEMBERS, _canonicals, _decisions, _events, _ids, _labels, _links, _longest_sql, _normal_sql
from lindwurm.runtime import load
from lindwurm.sources import exports, listing_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


# intake: the delivered files, rebuilt as JSON documents
def _raw_files(spark, d) -> DataFrame:
    """(path, content) of each completed file: the document that would bring its rows."""
    location = F.struct(
        F.col("location_name").alias("name"), F.col("location_city").alias("city"), F.col("location_district").alias("district"), F.col("location_street").alias("street"),
        F.col("location_street_no").alias("street_no"), F.col("location_zipcode").alias("zipcode"),
        F.struct(F.col("geo_longitude").alias("longitude"), F.col("geo_latitude").alias("latitude"), F.col("geo_confidence").alias("confidence"), F.col("geo_country").alias("country")).alias("geo"),
    )
    event = F.struct("id", "title", "short_description", "description", F.col("dates").alias("event_dates"), location.alias("location"), "source_type", "categories")
    documents = _events(spark, d).groupBy("file_ingestion_id").agg(F.collect_list(event).alias("events"))  # a file's own content
    files = load(spark, d, "file_ingestions").select(F.col("id").alias("file_ingestion_id"), "filename")
    return documents.join(files, "file_ingestion_id").select(F.concat_ws("/", F.lit("in"), "file_ingestion_id", "filename").alias("path"), F.to_json(F.struct("events")).cast("binary").alias("content"))


def _parsed(spark, d) -> DataFrame:
    return listing_files.parsed(listing_files.described(_raw_files(spark, d)))


FILES = """
e AS (SELECT f.filename, s.* FROM source_events s JOIN file_ingestions f ON f.id = s.file_ingestion_id),
v AS (SELECT file_ingestion_id, any_value(filename) AS filename, count(*) AS n, CASE
  WHEN count_if(id IS NULL) > 0 THEN 'missing field: id' WHEN count_if(title IS NULL) > 0 THEN 'missing field: title' WHEN count_if(source_type IS NULL) > 0 THEN 'missing field: source_type'
  WHEN count_if(len(list_filter(coalesce(dates, []), lambda x: x.date IS NULL)) > 0) > 0 THEN 'missing field: date' WHEN count(DISTINCT id) < count(*) THEN 'repeated event id' END AS error
  FROM e GROUP BY file_ingestion_id)
"""
CODE = "CASE WHEN contains({0}, '_') THEN split_part({0}, '_', 1) ELSE regexp_replace({0}, '\\.json$', '') END"


@query("scan_intake_log", f"""
WITH {FILES} SELECT filename, {CODE.format('filename')} AS source_code, CASE WHEN error IS NULL THEN n ELSE 0 END::INT AS event_count, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error AS error_message FROM v""")
def scan_intake_log(spark, d):
    return listing_files.ingestions(_parsed(spark, d)).drop("file_hash")


@query("scan_intake_events", f"""
WITH {FILES} SELECT e.id, e.filename, {CODE.format('e.filename')} AS source_code, title, location_name, location_city, location_zipcode, geo_latitude, geo_confidence, {_normal_sql('location_name')} AS location_name_normalized, len(dates)::INT AS n_dates
FROM e JOIN v ON v.file_ingestion_id = e.file_ingestion_id WHERE error IS NULL""")
def scan_intake_events(spark, d):
    flat = listing_files.flattened(_parsed(spark, d))
    return flat.select("id", "filename", "source_code", "title", "location_name", F.col("location_city"), "location_zipcode", "geo_latitude", "geo_confidence", "location_name_normalized", F.size("dates").alias("n_dates"))


@query("scan_intake_dates", f"""
WITH {FILES}, x AS (SELECT e.id, e.filename, unnest(dates) AS t FROM e JOIN v ON v.file_ingestion_id = e.file_ingestion_id WHERE error IS NULL)
SELECT id, filename, t.date AS day, t.end_date AS end_date FROM x""")
def scan_intake_dates(spark, d):
    return listing_files.flattened(_parsed(spark, d)).select("id", "filename", F.explode("dates").alias("x")).select("id", "filename", F.col("x.date").alias("day"), "x.end_date")


@query("scan_new_files", """
WITH f AS (SELECT id, filename || '#' || id AS path, file_hash, ingested_at FROM file_ingestions),
k AS (SELECT DISTINCT file_hash FROM f WHERE ingested_at < TIMESTAMP '2012-01-05'), n AS (SELECT * FROM f WHERE ingested_at IS NULL OR ingested_at >= TIMESTAMP '2012-01-05')
SELECT file_hash, min(path) AS path FROM n WHERE file_hash IS NOT NULL AND file_hash NOT IN (SELECT file_hash FROM k WHERE file_hash IS NOT NULL) GROUP BY 1""")
def scan_new_files(spark, d):
    files = load(spark, d, "file_ingestions").select(F.concat_ws("#", "filename", "id").alias("path"), "file_hash", "ingested_at")
    since = F.lit("2012-01-05").cast("timestamp_ntz")
    fresh = listing_files.new_files(files.where(F.col("ingested_at").isNull() | (F.col("ingested_at") >= since)), files.where(F.col("ingested_at") < since))
    return fresh.select("file_hash", "path")


@query("join_events_with_dates", """
WITH o AS (SELECT DISTINCT ON (id) id, dates FROM source_events ORDER BY id, file_ingestion_id), x AS (SELECT id, unnest(dates) AS t FROM o)
SELECT o.id, count(t)::INT AS entries, string_agg(t.date, ',' ORDER BY t.date) AS days FROM o LEFT JOIN x USING (id) GROUP BY o.id""")
def join_events_with_dates(spark, d):
    own = _ids(spark, d).select("id", "dates")
    entries = own.select(F.col("id").alias("event_id"), F.explode("dates").alias("x")).select("event_id", "x.*")
    nested = listing_files.events_with_dates(own.select("id"), entries)
    days = F.array_join(F.transform("dates", lambda x: x["date"]), ",")
    return nested.select("id", F.size("dates").alias("entries"), F.when(F.exists("dates", lambda x: x["date"].isNotNull()), days).alias("days"))


@query("scan_export_reshape", """
SELECT id, title, nullif(description, '') AS description, nullif(location_city, '') AS city, CASE WHEN geo_longitude IS NOT NULL THEN geo_latitude END AS latitude,
  CASE WHEN len(categories) > 0 THEN len(categories)::INT END AS categories, len(coalesce(dates, []))::INT AS dates FROM canonical_events""")
def scan_export_reshape(spark, d):
    shape = "title string, description string, categories array<string>, event_dates array<struct<date:string>>, location struct<city:string,geo:struct<latitude:double>>"
    back = exports.as_input(_canonicals(spark, d)).select("id", F.from_json("event", shape).alias("e"))
    return back.select("id", "e.title", "e.description", F.col("e.location.city").alias("city"), F.col("e.location.geo.latitude").alias("latitude"), F.when(F.col("e.categories").isNotNull(), F.size("e.categories")).alias("categories"), F.size("e.event_dates").alias("dates"))


# records: detail, pages, audit
@query("filter_record_detail", """
WITH r AS (SELECT min(id) AS id FROM canonical_events), s AS (SELECT DISTINCT l.source_event_id AS s FROM canonical_event_sources l JOIN r ON l.canonical_event_id = r.id WHERE l.source_event_id IN (SELECT id FROM source_events))
SELECT c.id, c.title, (SELECT string_agg(s, ',' ORDER BY s) FROM s) AS sources
FROM canonical_events c JOIN r ON r.id = c.id""")
def filter_record_detail(spark, d):
    key = _canonicals(spark, d).agg(F.min("id")).first()[0]
    found = search.detail(_canonicals(spark, d), _links(spark, d), _events(spark, d), -1 if key is None else key)
    return found.select("id", "title", F.array_join(F.transform("sources", lambda s: s["source_event_id"]), ",").alias("sources"))


@query("sort_page_with_total", "SELECT id, location_city, (SELECT count(*) FROM canonical_events) AS total, greatest(1, ceil((SELECT count(*) FROM canonical_events) / 30.0))::INT AS pages FROM canonical_events ORDER BY location_city DESC NULLS LAST, id LIMIT 30 OFFSET 60")
def sort_page_with_total(spark, d):
    return search.page_with_total(search.ordered(_canonicals(spark, d), "city", descending=True), 3, 30).select("id", "location_city", "total", "pages")


for _column, _field in (("title", "title"), ("date", "first_date"), ("source_count", "source_count"), ("review", "needs_review")):
    def _page(spark, d, sort=_column, field=_field):
        return search.page(search.ordered(_canonicals(spark, d), sort, descending=True), 2, 20).select("id", F.col(field).cast("string").alias("value"))

    query(f"sort_page_by_{_column}", f"SELECT id, {_field}::VARCHAR AS value FROM canonical_events ORDER BY {_field} DESC NULLS LAST, id LIMIT 20 OFFSET 20")(_page)


# review: split and merge with the records they change
SPLIT = """
l AS (SELECT DISTINCT canonical_event_id AS c, source_event_id AS s FROM canonical_event_sources), mv AS (SELECT c, max(s) AS s, c + 10000000 AS target FROM l WHERE c % 5 = 2 GROUP BY c),
a AS (SELECT DISTINCT coalesce(mv.target, l.c) AS c, l.s FROM l LEFT JOIN mv ON mv.c = l.c AND mv.s = l.s)
"""
MERGE = """
l AS (SELECT DISTINCT canonical_event_id AS c, source_event_id AS s FROM canonical_event_sources), mv AS (SELECT id AS donor, id - id % 7 AS target FROM canonical_events WHERE id % 7 = 3),
a AS (SELECT DISTINCT coalesce(mv.target, l.c) AS c, l.s FROM l LEFT JOIN mv ON mv.donor = l.c)
"""
CHANGED = f"""
ch AS (SELECT DISTINCT c FROM ((SELECT * FROM l EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM l))),
m AS (SELECT a.c, e.* FROM a JOIN ch USING (c) JOIN (SELECT DISTINCT ON (id) * FROM source_events ORDER BY id, file_ingestion_id) e ON e.id = a.s),
g AS (SELECT c AS cluster, count(*)::INT AS source_count, {_longest_sql('title', 10)}, {_longest_sql('description')} FROM m GROUP BY c)
"""
AUDIT = """
b AS (SELECT c, count(*) AS n, string_agg(s, ',' ORDER BY s) AS k FROM l GROUP BY c), f AS (SELECT c, count(*) AS n, string_agg(s, ',' ORDER BY s) AS k FROM a GROUP BY c)
"""


def _split(spark, d):
    own = _links(spark, d)
    moves = own.where("canonical_event_id % 5 = 2").groupBy("canonical_event_id").agg(F.max("source_event_id").alias("source_event_id")).withColumn("target", F.col("canonical_event_id") + 10000000)
    return own, review.split_many(own, moves)


def _moves(spark, d):
    return _canonicals(spark, d).where("id % 7 = 3").select(F.col("id").alias("donor"), F.expr("id - id % 7").alias("target"))


def _merge(spark, d):
    own = _links(spark, d)
    return own, review.merge_many(own, _moves(spark, d))


@query("edit_split", f"WITH {SPLIT} SELECT c AS canonical_event_id, s AS source_event_id FROM a")
def edit_split(spark, d):
    return _split(spark, d)[1]


def _texts(records):
    from_ = lambda f: F.element_at("field_provenance", F.lit(f)).alias(f"{f}_from")
    return records.select("cluster", "source_count", "title", from_("title"), "description", from_("description"))


@query("edit_split_records", f"WITH {SPLIT}, {CHANGED} SELECT * REPLACE (coalesce(title, '') AS title) FROM g")
def edit_split_records(spark, d):
    return _texts(review.resynthesized(_events(spark, d), *_split(spark, d)))


@query("edit_merge_records", f"WITH {MERGE}, {CHANGED} SELECT * REPLACE (coalesce(title, '') AS title) FROM g")
def edit_merge_records(spark, d):
    return _texts(review.resynthesized(_events(spark, d), *_merge(spark, d)))


@query("edit_emptied", f"WITH {SPLIT} SELECT DISTINCT c AS canonical_event_id FROM l WHERE c NOT IN (SELECT c FROM a)")
def edit_emptied(spark, d):
    return review.emptied(*_split(spark, d))


@query("edit_audit", f"""
WITH {MERGE}, {AUDIT} SELECT coalesce(b.c, f.c) AS canonical_event_id, 'merge' AS action, coalesce(b.n, 0) AS links_before, coalesce(f.n, 0) AS links_after
FROM b FULL JOIN f ON b.c = f.c WHERE b.k IS DISTINCT FROM f.k ORDER BY 1""")
def edit_audit(spark, d):
    log = review.audit_rows(*_merge(spark, d), "merge", "2012-03-01 00:00:00").withColumn("id", F.col("canonical_event_id"))
    return review.audited(log, action="merge").select("canonical_event_id", "action", "links_before", "links_after")


@query("join_added_links", f"""
WITH {MERGE} SELECT DISTINCT mv.target AS canonical_event_id, l.s AS source_event_id FROM l JOIN mv ON mv.donor = l.c WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.c = mv.target AND x.s = l.s)""")
def join_added_links(spark, d):
    return review.added_many(_links(spark, d), _moves(spark, d))


# second opinions: cache, judge, verdicts, usage
CACHE = "k AS (SELECT DISTINCT ON (h, tier) least(source_event_id_a, source_event_id_b) || '~' || greatest(source_event_id_a, source_event_id_b) AS h, tier, title_score > 0.5 AS same, geo_score AS confidence FROM match_decisions WHERE tier IS NOT NULL ORDER BY h, tier, id)"


def _hashed(spark, d) -> DataFrame:
    return _decisions(spark, d).withColumn("pair_hash", F.concat_ws("~", F.least("source_event_id_a", "source_event_id_b"), F.greatest("source_event_id_a", "source_event_id_b")))


def _cache(spark, d) -> DataFrame:
    rows = _hashed(spark, d).where("tier is not null")
    first = rows.groupBy("pair_hash", F.col("tier").alias("model")).agg(F.min_by(F.struct((F.col("title_score") > 0.5).alias("same"), F.col("geo_score").alias("confidence")), "id").alias("x"))
    return first.select("pair_hash", "model", "x.same", "x.confidence")


@query("join_cached_verdicts", f"""
WITH {CACHE} SELECT m.id, k.same AS cached_same, k.confidence AS cached_confidence FROM match_decisions m LEFT JOIN k ON k.tier = 'ai' AND k.h = least(m.source_event_id_a, m.source_event_id_b) || '~' || greatest(m.source_event_id_a, m.source_event_id_b)""")
def join_cached_verdicts(spark, d):
    return resolver.cached(_hashed(spark, d), _cache(spark, d), "ai").select("id", "cached_same", "cached_confidence")


@query("join_remembered", f"""
WITH {CACHE}, ai AS (SELECT * FROM k WHERE tier = 'ai'), fresh AS (SELECT h, 'ai' AS tier, same, confidence FROM k WHERE tier = 'deterministic' AND same IS NOT NULL AND h NOT IN (SELECT h FROM ai))
SELECT h AS pair_hash, tier AS model, same, confidence FROM ai UNION ALL SELECT * FROM fresh""")
def join_remembered(spark, d):
    cache = _cache(spark, d)
    return resolver.remember(cache.where("model = 'ai'"), cache.where("model = 'deterministic'").select("pair_hash", "same", "confidence"), "ai").select("pair_hash", "model", "same", "confidence")


def rule_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """A judge that goes by the title score; what the titles leave open has no confidence."""
    title = batch["title_score"]
    return pd.DataFrame({"same": (title > 0.5).astype(object).where(title.notna(), None), "confidence": title.abs(), "reason": "title"})


@query("fn_judged", """
WITH j AS (SELECT id, decision, CASE WHEN title_score BETWEEN 0 AND 1 THEN title_score > 0.5 END AS same, CASE WHEN title_score BETWEEN 0 AND 1 THEN title_score END AS conf FROM match_decisions)
SELECT id, CASE WHEN conf IS NULL THEN decision WHEN conf < 0.6 THEN 'ambiguous' WHEN same THEN 'match' ELSE 'no_match' END AS decision, CASE WHEN conf IS NULL THEN 'deterministic' WHEN conf < 0.6 THEN 'ai_low_confidence' ELSE 'ai' END AS tier FROM j""")
def fn_judged(spark, d):
    told = resolver.judge(_decisions(spark, d).select("id", "decision", "title_score"), rule_judge)
    by = resolver.applied(F.col("decision"), F.col("same"), F.col("confidence"))
    return told.select("id", by["decision"].alias("decision"), by["tier"].alias("tier"))


@query("fn_applied_verdicts", """
SELECT id, CASE WHEN verdict IS NULL OR geo_score IS NULL THEN decision WHEN geo_score < 0.6 AND verdict IN ('same', 'different') THEN 'ambiguous' WHEN geo_score < 0.6 THEN decision WHEN verdict = 'same' THEN 'match' WHEN verdict = 'different' THEN 'no_match' ELSE 'ambiguous' END AS decided,
  CASE WHEN verdict IS NULL OR geo_score IS NULL THEN 'deterministic' WHEN geo_score < 0.6 AND verdict IN ('same', 'different') THEN 'ai_low_confidence' WHEN geo_score < 0.6 THEN 'deterministic' WHEN verdict IN ('same', 'different') THEN 'ai' ELSE 'ai_unexpected' END AS tier
FROM (SELECT *, CASE WHEN title_score > 0.6 THEN 'same' WHEN title_score < 0.4 THEN 'different' WHEN title_score < 0.5 THEN 'unsure' END AS verdict FROM match_decisions)""")
def fn_applied_verdicts(spark, d):
    t = F.col("title_score")
    verdict = F.when(t > 0.6, "same").when(t < 0.4, "different").when(t < 0.5, "unsure")
    by = resolver.applied_verdict(F.col("decision"), verdict, F.col("geo_score"))
    return _decisions(spark, d).select("id", by["decision"].alias("decided"), by["tier"].alias("tier"))


@query("fn_pair_hash", """
WITH o AS (SELECT DISTINCT ON (id) id FROM source_events) SELECT m.id, true AS either_way, 64 AS letters FROM match_decisions m JOIN o a ON a.id = m.source_event_id_a JOIN o b ON b.id = m.source_event_id_b""")
def fn_pair_hash(spark, d):
    own = _ids(spark, d).select("id", *resolver.HASHED)
    pairs = _decisions(spark, d).select(F.col("id").alias("decision_id"), "source_event_id_a", "source_event_id_b")
    both = pairs.join(own.select(F.col("id").alias("source_event_id_a"), F.struct(*own.columns).alias("a")), "source_event_id_a").join(own.select(F.col("id").alias("source_event_id_b"), F.struct(*own.columns).alias("b")), "source_event_id_b")
    one, two = (resolver.pair_hash(F.col(x), F.col(y), F.col(f"{x}.id"), F.col(f"{y}.id")) for x, y in (("a", "b"), ("b", "a")))
    return both.select(F.col("decision_id").alias("id"), (one == two).alias("either_way"), F.length(one).alias("letters"))


def _usage(spark, d) -> DataFrame:
    return _decisions(spark, d).select(F.col("tier").alias("batch_id"), (F.col("geo_score") > 0.5).alias("cached"), F.length("source_event_id_a").cast("bigint").alias("input_tokens"), F.length("source_event_id_b").cast("bigint").alias("output_tokens"), F.col("decided_at").alias("created_at"))


USAGE = "SELECT count(DISTINCT tier) AS batches, count(*) AS requests, count_if(geo_score > 0.5)::BIGINT AS cached, coalesce(sum(length(source_event_id_a)), 0)::BIGINT AS input_tokens, coalesce(sum(length(source_event_id_b)), 0)::BIGINT AS output_tokens FROM match_decisions"


@query("agg_usage", USAGE)
def agg_usage(spark, d):
    return reports.usage_summary(_usage(spark, d))


@query("agg_usage_since", USAGE + " WHERE decided_at >= TIMESTAMP '2012-01-10'")
def agg_usage_since(spark, d):
    return reports.usage_summary(_usage(spark, d), "2012-01-10")


# evaluation
def _counts_sql(predicted: str, labels: str = "l") -> str:
    return f"""
x AS (SELECT label = 'same' AS same, p.id_a IS NOT NULL AS hit FROM {labels} LEFT JOIN ({predicted}) p USING (id_a, id_b)),
n AS (SELECT count_if(same AND hit)::BIGINT AS tp, count_if(NOT same AND hit)::BIGINT AS fp, count_if(same AND NOT hit)::BIGINT AS fn, count_if(NOT same AND NOT hit)::BIGINT AS tn FROM x),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM n),
z AS (SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r)"""


def _predicted_sql(condition: str) -> str:
    return f"SELECT DISTINCT least(source_event_id_a, source_event_id_b) AS id_a, greatest(source_event_id_a, source_event_id_b) AS id_b FROM match_decisions WHERE {condition}"


def _predicted(spark, d, condition: str) -> DataFrame:
    return evaluation.unordered(_decisions(spark, d).where(condition)).select("id_a", "id_b")


@query("agg_category_metrics", f"""
WITH {LABELS}, has AS (SELECT DISTINCT id FROM source_events WHERE list_contains(categories, 'familie')), lc AS (SELECT * FROM l WHERE id_a IN (SELECT id FROM has) OR id_b IN (SELECT id FROM has)),
{_counts_sql(_predicted_sql('title_score >= 0.6'), 'lc')} SELECT * FROM z""")
def agg_category_metrics(spark, d):
    own = evaluation.with_category(_labels(spark, d), _events(spark, d), "familie")
    return evaluation.metrics(_predicted(spark, d, "title_score >= 0.6"), own)


@query("agg_compared", f"""
WITH {LABELS}, f AS (WITH {_counts_sql(_predicted_sql('title_score >= 0.6'))} SELECT * FROM z), s AS (WITH {_counts_sql(_predicted_sql('combined_score >= 0.6'))} SELECT * FROM z)
SELECT f.precision AS precision_first, f.recall AS recall_first, f.f1 AS f1_first, s.precision AS precision_second, s.recall AS recall_second, s.f1 AS f1_second,
  round(s.precision - f.precision, 6) AS precision_change, round(s.recall - f.recall, 6) AS recall_change, round(s.f1 - f.f1, 6) AS f1_change FROM f, s""")
def agg_compared(spark, d):
    return evaluation.compared(_predicted(spark, d, "title_score >= 0.6"), _predicted(spark, d, "combined_score >= 0.6"), _labels(spark, d))


@query("sort_candidates", f"""
WITH s AS (SELECT least(source_event_id_a, source_event_id_b) AS id_a, greatest(source_event_id_a, source_event_id_b) AS id_b, max(title_score) AS score FROM match_decisions GROUP BY 1, 2)
SELECT count_if(NOT hard)::BIGINT AS likely, count_if(hard)::BIGINT AS hard_negatives, max(score) AS best FROM (
  SELECT false AS hard, score FROM s WHERE score >= 0.5 UNION ALL SELECT true, NULL FROM range((SELECT greatest(1, floor(count(*) * 0.2))::BIGINT FROM s WHERE score < 0.5)))""")
def sort_candidates(spark, d):
    scored = evaluation.unordered(_decisions(spark, d)).groupBy("id_a", "id_b").agg(F.max("title_score").alias("score"))
    found = evaluation.labelling_candidates(scored, 0.5, 0.2, 7)
    return found.agg(F.count_if(~F.col("hard_negative")).alias("likely"), F.count_if("hard_negative").alias("hard_negatives"), F.max("score").alias("best"))


@query("sort_candidates_likely", """
SELECT least(source_event_id_a, source_event_id_b) AS id_a, greatest(source_event_id_a, source_event_id_b) AS id_b, max(title_score) AS score FROM match_decisions GROUP BY 1, 2 HAVING max(title_score) >= 0.5 ORDER BY score DESC, id_a, id_b""")
def sort_candidates_likely(spark, d):
    scored = evaluation.unordered(_decisions(spark, d)).groupBy("id_a", "id_b").agg(F.max("title_score").alias("score"))
    return evaluation.labelling_candidates(scored, 0.5, 0.2, 7).where("not hard_negative").select("id_a", "id_b", "score")


# the rebuild from decisions: clusters, flags and records of one plan
@query("graph_rebuilt_records", f"""
WITH RECURSIVE {LINKED}, z AS (SELECT cluster, count(*)::INT AS source_count FROM c GROUP BY 1),
i AS (SELECT a.cluster, avg(CASE WHEN m.decision = 'match' THEN m.combined_score END) AS confidence, bool_or(coalesce(starts_with(m.tier, 'ai'), false)) AS ai
      FROM match_decisions m JOIN c a ON a.id = m.source_event_id_a JOIN c b ON b.id = m.source_event_id_b AND a.cluster = b.cluster GROUP BY 1),
d AS (SELECT cluster, count(DISTINCT x.x.date) AS days FROM (SELECT DISTINCT id, dates FROM source_events) e JOIN c ON c.id = e.id, LATERAL (SELECT unnest(e.dates) AS x) x GROUP BY 1),
m AS (SELECT c.cluster AS c, e.* FROM c JOIN (SELECT DISTINCT ON (id) * FROM source_events ORDER BY id, file_ingestion_id) e ON e.id = c.id), g AS (SELECT c AS cluster, {_longest_sql('title', 10)} FROM m GROUP BY c)
SELECT z.cluster, source_count, coalesce(g.title, '') AS title, g.title_from, round(confidence, 6) AS match_confidence, coalesce(ai, false) AS ai_assisted,
  z.source_count > 1 AND (z.source_count > 15 OR coalesce(confidence < 0.40, false) OR coalesce(days, 0) > 3) AS needs_review FROM z JOIN g USING (cluster) LEFT JOIN i USING (cluster) LEFT JOIN d USING (cluster)""")
def graph_rebuilt_records(spark, d):
    decided = _decisions(spark, d).select(F.col("source_event_id_a").alias("id_a"), F.col("source_event_id_b").alias("id_b"), "combined_score", "decision", "tier")
    found = pipeline.from_decisions(_events(spark, d), decided, merged(DEFAULTS, DEPLOYED)).records
    return found.select("cluster", "source_count", "title", F.element_at("field_provenance", F.lit("title")).alias("title_from"), F.round("match_confidence", 6).alias("match_confidence"), "ai_assisted", "needs_review")


@query("merge_kept_provenance", f"""
WITH {MEMBERS}, g AS (SELECT c AS cluster, {_longest_sql('title', 10)}, {_longest_sql('description')} FROM m GROUP BY c)
SELECT g.cluster, CASE WHEN length(coalesce(o.description, '')) > length(coalesce(g.description, '')) THEN coalesce(o.field_provenance['description'], 'unknown') ELSE g.description_from END AS description_from,
  CASE WHEN length(coalesce(o.title, '')) > length(coalesce(g.title, '')) THEN coalesce(o.field_provenance['title'], 'unknown') ELSE g.title_from END AS title_from, (o.version + 1)::INT AS version FROM g JOIN canonical_events o ON o.id = g.cluster""")
def merge_kept_provenance(spark, d):
    old = _canonicals(spark, d).select(F.col("id").alias("cluster"), "title", "short_description", "description", "field_provenance", "version")
    fresh = survivorship.synthesize(survivorship.members_of(_events(spark, d), _links(spark, d)))
    out = survivorship.enrich(old, fresh).join(old.select("cluster"), "cluster", "left_semi")
    from_ = lambda f: F.element_at("field_provenance", F.lit(f)).alias(f"{f}_from")
    return out.select("cluster", from_("description"), from_("title"), "version")
