import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lindwurm.operators import evaluation, graph, pairs, reports, resolver, review, search, survivorship
from lindwurm.plans import pipeline
from lindwurm.sources import exports, listing_files
from lindwurm.streaming import intake

DATES = "array<struct<date:string,start_time:string,end_time:string,end_date:string>>"
EVENT = f"""id string, title string, short_description string, description string, highlights array<string>, location_name string, location_city string,
location_district string, location_street string, location_zipcode string, geo_latitude double, geo_longitude double, geo_confidence double, source_code string,
source_type string, blocking_keys array<string>, categories array<string>, is_family_event boolean, is_child_focused boolean, admission_free boolean, dates {DATES}"""
NAMES = [f.split()[0] for f in EVENT.replace("\n", " ").split(", ") if " " in f.strip()]


def event(id, **values):
    own = {n: None for n in ["id", "title", "short_description", "description", "highlights", "location_name", "location_city", "location_district", "location_street", "location_zipcode", "geo_latitude", "geo_longitude", "geo_confidence", "source_code", "source_type", "blocking_keys", "categories", "is_family_event", "is_child_focused", "admission_free", "dates"]}
    own.update(id=id, **values)
    return tuple(own.values())


def test_candidate_pairs(spark):
    rows = [event("a", blocking_keys=["k", "k", None, "m"], source_code="1"), event("b", blocking_keys=["k", "m"], source_code="1"), event("c", blocking_keys=None, source_code="2"), event("d", blocking_keys=[], source_code="2"), event("e", blocking_keys=["m"], source_code="2"), event(None, blocking_keys=["k"])]
    events = spark.createDataFrame(rows, EVENT)
    assert sorted(tuple(r) for r in pairs.candidate_pairs(events).collect()) == [("a", "b"), ("a", "e"), ("b", "e")]
    assert sorted(tuple(r) for r in pairs.candidate_pairs(events, cross_source=True).collect()) == [("a", "e"), ("b", "e")]
    assert pairs.blocking_stats(events).first().asDict() == {"events": 5, "possible_pairs": 10, "blocked_pairs": 3, "reduction_pct": 70.0}
    assert pairs.blocking_stats(events.limit(0)).first()["reduction_pct"] == 0.0


def test_components_of_chain_star_and_isolated(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [("z0", f"z{i}") for i in range(1, 30)]
    links = spark.createDataFrame([*chain, *star, ("x", "x"), ("n000", "n001")], "id_a string, id_b string")
    nodes = spark.createDataFrame([("x",), ("n000",), (None,)], "id string")
    label = {r["id"]: r["cluster"] for r in graph.components(links).collect()}
    assert {label[f"n{i:03d}"] for i in range(61)} == {"n000"} and label["z7"] == "z0" and "x" not in label
    assert {tuple(r) for r in graph.components(links, nodes).collect()} == {("x", "x"), ("n000", "n000")}
    assert graph.components(links.limit(0)).count() == 0


def test_coherence(spark):
    label = spark.createDataFrame([(f"a{i:02d}", "a00") for i in range(16)] + [(f"b{i:02d}", "b00") for i in range(15)] + [("c1", "c1"), ("c2", "c1")], "id string, cluster string")
    decided = spark.createDataFrame([("c1", "c2", 0.3, "match", "ai"), ("b00", "b01", 0.9, "match", "deterministic"), ("b00", "c1", 0.9, "match", "ai")], "id_a string, id_b string, score double, decision string, tier string")
    days = spark.createDataFrame([("c1", "d")], "id string, day string")
    got = {r["cluster"]: r for r in graph.cluster_report(label, decided, days).collect()}
    assert got["a00"]["flagged"] and not got["b00"]["flagged"] and got["c1"]["flagged"] and got["c1"]["ai_assisted"] and not got["b00"]["ai_assisted"]


def test_synthesize(spark):
    rows = [
        event("b", title="Ein langer Titel", location_city="X", geo_latitude=1.0, geo_longitude=1.0, geo_confidence=0.5, categories=["q", "p"], is_family_event=None, dates=[("2026-01-02", None, None, "2026-01-04")]),
        event("a", title="Kurz", location_city="Y", geo_latitude=2.0, geo_longitude=None, geo_confidence=0.9, categories=["p"], is_family_event=True, dates=[("2026-01-01", None, None, None)]),
        event("c", title="Ein langer Titeln"[:16], location_city="X", geo_latitude=3.0, geo_longitude=3.0, geo_confidence=0.5, dates=[("2026-01-02", None, None, "2026-01-04")]),
    ]
    members = spark.createDataFrame(rows, EVENT).withColumn("cluster", F.lit(1))
    got = survivorship.synthesize(members.unionByName(members)).first()
    assert got["title"] == "Ein langer Titel" and got["field_provenance"]["title"] == "b" and got["location_city"] == "X" and got["field_provenance"]["location_city"] == "b"
    assert got["geo_latitude"] == 1.0 and got["categories"] == ["p", "q"] and len(got["dates"]) == 2 and got["first_date"] == "2026-01-01" and got["last_date"] == "2026-01-04"
    assert got["is_family_event"] is True and got["field_provenance"]["is_family_event"] == "a" and got["is_child_focused"] is False and got["source_count"] == 3 and got["description"] is None
    empty = survivorship.synthesize(spark.createDataFrame([event("a")], EVENT).withColumn("cluster", F.lit(1))).first()
    assert empty["title"] == "" and empty["field_provenance"]["geo"] == "a"


def test_enrich_keeps_longer_texts(spark):
    new = survivorship.synthesize(spark.createDataFrame([event("a", title="Neuer Titel", description="kurz")], EVENT).withColumn("cluster", F.lit(1)))
    old = spark.createDataFrame([(1, "Alt", None, "eine lange Beschreibung", {"description": "z"}, 4)], "cluster int, title string, short_description string, description string, field_provenance map<string,string>, version int")
    got = survivorship.enrich(old, new).first()
    assert (got["title"], got["description"], got["field_provenance"]["description"], got["version"]) == ("Neuer Titel", "eine lange Beschreibung", "z", 5)


def test_pipeline_puts_every_id_into_one_cluster(spark):
    day = [("2026-03-01", "10:00", None, None)]
    near = dict(geo_latitude=48.0, geo_longitude=8.0, geo_confidence=0.9, dates=day, blocking_keys=["k"])
    rows = [event("a", title="Sommerfest im Park", **near), event("b", title="Sommerfest im Park", **near), event("c", title="Orgelkonzert", **near), event("d", title="Allein")]
    out = pipeline.run(spark.createDataFrame(rows, EVENT))
    assert {tuple(r) for r in out.clusters.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    assert out.records.count() == 3
    assert pipeline.run(spark.createDataFrame([], EVENT)).records.count() == 0


def test_search_and_paging(spark):
    rows = spark.createDataFrame([(1, "Konzert", "Köln", ["Musik"], 0.5, 2, False), (2, "Lesung", None, None, None, 1, True), (3, "konzertabend", "Bonn", ["x"], 0.9, 3, False)], "id int, title string, location_city string, categories array<string>, match_confidence double, source_count int, needs_review boolean")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert sorted(ids(search.filtered(rows, q="KONZERT"))) == [1, 3] and ids(search.filtered(rows, categories=["usi"])) == [1]
    assert ids(search.ordered(rows, "confidence", True)) == [3, 1, 2] and ids(search.ordered(rows, "confidence")) == [2, 1, 3]
    assert ids(search.review_queue(rows)) == [2, 1] and ids(search.page(search.ordered(rows, "nonsense"), 2, 2)) == [3]
    assert search.pages(0, 10) == 1 and search.pages(11, 10) == 2
    with pytest.raises(ValueError):
        search.page(rows, 0)


def test_metrics_with_zero_guards(spark):
    labels = spark.createDataFrame([("a", "b", "same"), ("a", "c", "different"), ("b", "c", "same")], "id_a string, id_b string, label string")
    guess = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y")], "id_a string, id_b string")
    got = evaluation.metrics(guess, labels).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["precision"]) == (1, 1, 1, 0, 0.5)
    none = evaluation.metrics(guess.limit(0), labels).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    assert evaluation.unlabelled(guess, labels).count() == 1 and evaluation.label_stats(labels).first()["same"] == 2


def test_reports_of_empty_tables(spark):
    files = spark.createDataFrame([], "event_count int, status string, ingested_at timestamp_ntz")
    assert reports.file_stats(files).first()["total_events"] == 0
    assert {r["n"] for r in reports.decision_counts(spark.createDataFrame([], "decision string")).collect()} == {0}
    assert reports.canonical_stats(spark.createDataFrame([], "needs_review boolean, match_confidence double")).first()["avg_confidence"] is None


def test_review_edits(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "canonical_event_id bigint, source_event_id string")
    assert {tuple(r) for r in review.split(links, 1, ["a"], 9).collect()} == {(9, "a"), (1, "b"), (2, "b"), (2, "c")}
    assert {tuple(r) for r in review.merge(links, 1, 2).collect()} == {(2, "a"), (2, "b"), (2, "c")}
    assert [r[0] for r in review.added_links(links, 1, 2).collect()] == ["a"]
    with pytest.raises(ValueError):
        review.merge(links, 1, 1)
    with pytest.raises(ValueError):
        review.split(links, 1, ["zz"], 9)


def test_judge_failures_stay_undecided(spark):
    both = spark.createDataFrame([("h1", 1), ("h2", 2)], "pair_hash string, n int")

    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("no answer")

    def sure(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"same": [True] * len(batch), "confidence": [0.9 if n == 1 else 7.0 for n in batch["n"]], "reason": "r"})

    assert all(r["same"] is None for r in resolver.judge(both, broken).collect())
    told = resolver.judge(both, sure)
    by = resolver.applied(F.lit("ambiguous"), F.col("same"), F.col("confidence"))
    assert {r["n"]: (r["d"], r["t"]) for r in told.select("n", by["decision"].alias("d"), by["tier"].alias("t")).collect()} == {1: ("match", "ai"), 2: ("ambiguous", "deterministic")}
    cache = spark.createDataFrame([("h9", "m", True, 0.8)], "pair_hash string, model string, same boolean, confidence double")
    assert resolver.remember(cache, told, "m").count() == 2


def _document(*events):
    return json.dumps({"events": list(events), "rejected": [], "metadata": {}})


def test_intake_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = {"id": "e1", "title": "Fasnet", "source_type": "artikel", "event_dates": [{"date": "2026-02-01", "start_time": "9:30"}], "location": {"city": "alt", "_sanitizeResult": {"city": "Kollnau"}}, "extra": 1}
    (folder / "bwb_1.json").write_text(_document(good))
    (folder / "bwb_2.json").write_text(_document(good))
    (folder / "rek_1.json").write_text(_document({"id": "e2", "source_type": "artikel"}))
    (folder / "rek_2.json").write_text("{ broken")
    (folder / "note.txt").write_text("no")
    where = [str(tmp_path / n) for n in ("events", "log", "state")]
    intake.watch(spark, str(folder), *where, once=True).awaitTermination()
    log = {r["filename"]: r for r in spark.read.parquet(where[1]).collect()}
    assert set(log) == {"bwb_1.json", "rek_1.json", "rek_2.json"}
    assert log["rek_1.json"]["error_message"] == "missing field: title" and log["rek_2.json"]["status"] == "failed" and log["bwb_1.json"]["source_code"] == "bwb"
    row = spark.read.parquet(where[0]).first()
    assert row["location_city_normalized"] == "waldkirch" and row["title_normalized"] == "fastnacht" and row["dates"][0]["start_time"] == "09:30:00" and row["blocking_keys"] == ["dc|2026-02-01|waldkirch"]
    (folder / "bwb_3.json").write_text(_document({**good, "id": "e3"}))
    intake.watch(spark, str(folder), *where, once=True).awaitTermination()
    assert spark.read.parquet(where[0]).count() == 2


def test_repeated_event_id_fails_the_file(spark):
    twice = {"id": "e", "title": "t", "source_type": "artikel"}
    files = spark.createDataFrame([("f.json", "h", "s", _document(twice, twice))], "filename string, file_hash string, source_code string, content string")
    assert listing_files.parsed(files).first()["error"] == "repeated event id"


def test_export_parts(spark):
    columns = f"id bigint, title string, short_description string, description string, highlights array<string>, dates {DATES}, location_name string, location_city string, location_district string, location_street string, location_zipcode string, geo_latitude double, geo_longitude double, geo_confidence double, categories array<string>, is_family_event boolean, is_child_focused boolean, admission_free boolean"
    rows = [(i, f't "{i}"', "", None, [], None, None, "Köln", None, None, None, 1.0, None, None, ["c"], None, True, None) for i in range(450)]
    found = {r["part"]: json.loads(r["content"]) for r in exports.parts(spark.createDataFrame(rows, columns), {"x": 1}).collect()}
    assert sorted(found) == [1, 2, 3] and [len(found[k]["events"]) for k in (1, 2, 3)] == [200, 200, 50]
    assert found[1]["events"][0] == {"title": 't "0"', "event_dates": [], "location": {"city": "Köln"}, "categories": ["c"], "is_child_focused": True}
    assert found[3]["metadata"]["totalParts"] == 3
    empty = exports.parts(spark.createDataFrame([], columns)).collect()
    assert json.loads(empty[0]["content"])["metadata"]["eventCount"] == 0
    assert exports.bundle([("a", "{}")])[0] == "application/json" and exports.bundle([("a", "{}"), ("b", "{}")])[0] == "application/zip"


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from lindwurm import runtime

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_one_per_id_takes_the_smallest_file_whatever_the_order(spark):
    rows = [("a", 2, "late"), ("a", 1, "x"), ("a", 1, "y"), ("b", 3, None), (None, 1, "z")]
    pick = lambda r: {tuple(x) for x in pairs.one_per_id(spark.createDataFrame(r, "id string, file_ingestion_id bigint, title string")).collect()}
    assert pick(rows) == pick(rows[::-1]) and {x[:2] for x in pick(rows)} == {("a", 1), ("b", 3)}


def test_hot_vertices_and_roots_are_split_without_changing_groups(spark):
    edges = [(f"n{i:03d}", "a") for i in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    df = spark.createDataFrame(edges, "a string, b string")
    plain = {tuple(r) for r in graph.connected_components(df, max_levels=1).collect()}
    assert plain == {tuple(r) for r in graph.connected_components(df, hot_degree=5, max_levels=1).collect()} and len({c for _, c in plain}) == 2


def test_split_many_audit_and_emptied(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "canonical_event_id bigint, source_event_id string")
    moves = spark.createDataFrame([(1, "b", 9), (2, "c", 1), (5, "x", 6)], "canonical_event_id bigint, source_event_id string, target bigint")
    after = review.split_many(links, moves)
    assert {tuple(r) for r in after.collect()} == {(1, "a"), (9, "b"), (1, "c")}
    assert [r[0] for r in review.emptied(links, after).collect()] == [2]
    log = {r["canonical_event_id"]: (r["links_before"], r["links_after"]) for r in review.audit_rows(links, after, "split", "2012-01-01").collect()}
    assert log == {1: (2, 2), 2: (1, 0), 9: (0, 1)}


def test_replace_all_swaps_tables_and_keeps_the_old_ones_on_failure(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "x int")
    pipeline.replace_all(pipeline.Outcome(one, one, one, one), str(tmp_path))
    two = spark.createDataFrame([(2,)], "x int")
    with pytest.raises(Exception):
        pipeline.replace_all(pipeline.Outcome(two, two, two, two.selectExpr("raise_error('no') as x")), str(tmp_path))
    assert [spark.read.parquet(f"{tmp_path}/{n}").first()[0] for n in ("decisions", "clusters", "records")] == [1, 1, 1]
    pipeline.replace_all(pipeline.Outcome(two, two, two, two), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/records").first()[0] == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["clusters", "decisions", "records"]
