"""Cases that an operator on listings once left out."""

import random

from lindwurm.llm import history, linkage, survivors
from lindwurm.runtime import Scratch
from test_listings import day, event, table

LONG = "Lesung mit Kuno Drebborwetter"


def repeats(spark, rows, files=2):
    times = spark.createDataFrame([(i, "completed", f"2012-01-{i:02d} 00:00:00") for i in range(1, files + 1)], "id bigint, status string, ingested_at string")
    return {tuple(r) for r in history.repeats(table(spark, *rows), times).collect()}


def test_every_pair_that_the_points_accept_meets(spark):
    base = dict(source_code="s", dates=day("2012-02-01", "19:00"))
    full = {**base, "location_name": "Kino Varstann", "location_city": "Oberlutztal", "location_zipcode": "77001", "location_street": "Glockenweg", "description": "Es liest Kuno."}
    late = {
        "street": dict(location_street="Glockenweg", dates=day("2012-02-01", "20:00")),
        "town and start": dict(location_city="Oberlutztal"),
        "town and postcode": dict(location_city="Oberlutztal", location_zipcode="77001", location_name="Kino Holmtal", dates=day("2012-02-01", "20:00")),
        "postcode and start": dict(location_zipcode="77001"),
        "place": dict(location_name="Kino Varstann", dates=day("2012-02-01", "20:00")),
        "text": dict(description="Es liest Kuno.", dates=day("2012-02-01", "20:00")),
    }
    rows = [event("a", file_ingestion_id=1, title=LONG, **full)] + [event(k, file_ingestion_id=2, title=LONG, **{**base, **v}) for k, v in late.items()]
    assert repeats(spark, rows) == {(2, k, "a") for k in late}
    for k, v in late.items():
        assert repeats(spark, [rows[0], event(k, file_ingestion_id=2, title=LONG, **{**base, **v})]) == {(2, k, "a")}, k


def test_paired_and_probed_scopes_find_the_same(spark):
    base = "lesungmitkunodrebborwetter"
    swap = lambda t, i: t[:i] + t[i + 1] + t[i] + t[i + 2 :]
    words = {base, base[1:], "x" + base, "markt", "makrt", "konzrte", "konzert"} | {swap(base, i) for i in range(25)} | {swap(swap(swap(base, i), i + 6), i + 12) for i in range(12)}
    df = spark.createDataFrame([(1, w, i) for i, w in enumerate(sorted(words))], "scope int, text string, ref int")
    probed = {(min(r["ref"], r["hit"]), max(r["ref"], r["hit"])) for r in history.probe(df, history.segments(df), longer=False).collect()}
    assert probed == {(r["ref"], r["hit"]) for r in history.paired(df).collect()}


def test_a_long_chain_is_one_occasion(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(8)], "x bigint, y bigint")
    assert {tuple(r) for r in linkage.occasions(df).collect()} == {(i, 0) for i in range(9)}


def test_no_rated_pair_of_a_long_chain_is_lost_and_all_have_a_confidence(spark, monkeypatch):
    told = spark.createDataFrame([(i, f"e{i}", f"s{i % 3}", [(f"2012-01-{i + k:02d}",) for k in (1, 2, 3)]) for i in range(9)], "no bigint, id string, source string, days array<struct<day:string>>")
    monkeypatch.setattr(linkage, "features", lambda events, reference, scratch: told)
    monkeypatch.setattr(linkage, "candidates", lambda told: spark.createDataFrame([(i, i + 1) for i in range(8)], "x bigint, y bigint"))
    monkeypatch.setattr(linkage, "voted", lambda told, pairs: pairs.selectExpr("x", "y", *[f"if(y - x = 1, 1, -1) as {v}" for v in linkage.VOTES]))
    table = spark.createDataFrame([(*[1] * 7, 0.9), (*[-1] * 7, 0.1)], ", ".join(f"{v} int" for v in linkage.VOTES) + ", confidence double")
    monkeypatch.setattr(linkage, "posteriors", lambda votes: table)
    got = {tuple(r) for r in linkage.matches(told, told).collect()}
    assert got == {(f"e{i}", f"e{i + k}", 0.9 if k == 1 else 0.1) for i in range(9) for k in (1, 2) if i + k < 9}


def test_correlated_functions_are_found(spark):
    rnd = random.Random(6)
    counts: dict = {}
    for _ in range(6000):
        true = rnd.random() < 0.4
        vote = lambda right: (1 if true else -1) if rnd.random() < right else (-1 if true else 1)  # noqa: E731,B023
        twin = vote(0.8)
        v = (twin, twin if rnd.random() < 0.95 else -twin, vote(0.9), vote(0.85), vote(0.9))
        counts[v] = counts.get(v, 0) + 1
    groups = linkage.correlated_groups(list(counts), list(counts.values()))
    assert (0, 1) in groups and sorted(i for g in groups for i in g) == [0, 1, 2, 3, 4] and max(map(len, groups)) <= linkage.TOGETHER


def test_titles_are_generic_by_their_text_not_by_their_number(spark):
    base = dict(source_code="s", location_city="Oberlutztal", location_zipcode="77001", dates=day("2012-02-01", "19:00"))
    copies = [event(f"c{i:02d}", file_ingestion_id=1, title=LONG, location_name="Kino Varstann", **base) for i in range(14)]
    vague = [event(f"v{i}", file_ingestion_id=1 + i, title="Versammlung (Details siehe Aushang am Rathaus)", location_name=name, **base) for i, name in enumerate(("Kino Holmtal", "Halle Querfelden"))]
    assert repeats(spark, [*copies, event("late", file_ingestion_id=2, title=LONG, **base), *vague]) == {(2, "late", "c00")}


def test_generic_titles(spark):
    titles = ["Titel folgt", "[ohne Titel]", "Abgesagt: Markt", "Konzert (Details siehe Aushang am Rathaus)", "Orgelvesper mit…", "Termin", "Familiengottesdienst...", LONG, "Lesung mit Kuno", "Trio Grapensroth"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    assert [r[0] for r in df.select(history.generic_title(df.title)).collect()] == [True] * 7 + [False] * 3


def test_a_drifting_title_stays_one_listing(spark):
    base = "lesungmitkunodrebborwetter"
    titles = [("x" * 3 * i + base[3 * i :]) for i in range(8)]
    at = dict(source_code="s", location_name="Kino Varstann", location_city="Oberlutztal", location_zipcode="77001", dates=day("2012-02-01", "19:00"))
    rows = [event(f"a{i}", file_ingestion_id=i + 1, title=t, **at) for i, t in enumerate(titles)]
    assert repeats(spark, rows, files=8) == {(i + 1, f"a{i}", "a0") for i in range(1, 8)}


def slips(spark, words, **options):
    rows = spark.createDataFrame([(1, f"{i:02d}", "title", [w]) for i, w in enumerate(words)], "grp int, id string, field string, words array<string>")
    return {words[int(r["id"])] for r in survivors._slips(rows, Scratch(spark, "slips"), **options).collect()}


def test_slips_are_found_however_often_and_wherever_they_stand(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    words = ["drebborwetter"] * 40 + ["drebborwettter"] * 4 + ["dxebborwettexr", "rdebborwettre", "drebborw", "drxbbxrwxtter"] + [long] * 2 + ["x" + long[1:-1] + "y", "xyz" + long[3:]]
    wrong = {"drebborwettter", "dxebborwettexr", "rdebborwettre", "drebborw", "x" + long[1:-1] + "y"}
    assert slips(spark, words) == slips(spark, words, paired_words=0) == wrong
