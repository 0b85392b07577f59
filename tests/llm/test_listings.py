"""Small tables through the operators on listings: places, addresses, linkage, history, survivors."""

import random

import pytest

from lindwurm.llm import addresses, canonical, edits, history, linkage, survivors
from lindwurm.runtime import Scratch

DATES = "array<struct<date:string,start_time:string,end_time:string,end_date:string>>"
EVENT = f"""file_ingestion_id bigint, id string, title string, short_description string, description string, location_name string, location_city string,
location_district string, location_street string, location_street_no string, location_zipcode string, geo_latitude double, geo_longitude double,
geo_confidence double, source_code string, created_at timestamp_ntz, dates {DATES}"""
FIELDS = ["file_ingestion_id", "id", "title", "short_description", "description", "location_name", "location_city", "location_district", "location_street", "location_street_no", "location_zipcode", "geo_latitude", "geo_longitude", "geo_confidence", "source_code", "created_at", "dates"]
PLACE = "place_id int, name string, kind string, parent_place_id int, zipcodes array<string>, aliases array<string>, centre_lat double, centre_lon double"
PLACES = [
    (1, "Oberlutztal", "city", None, ["77001"], ["OBTAL"], 48.0, 8.0), (2, "Unterlutztal", "city", None, ["77002"], None, 48.1, 8.1), (3, "Bad Querfelden", "city", None, ["77003"], [], 48.2, 8.2),
    (11, "Altstadt", "district", 1, ["77001"], None, 48.0, 8.01), (12, "Altstadt", "district", 2, ["77002"], None, 48.1, 8.11), (13, "Mornhalde", "district", 1, ["77001"], None, 48.01, 8.0),
]


def event(id, **values):
    return tuple({**dict.fromkeys(FIELDS), "id": id, **values}[f] for f in FIELDS)


def table(spark, *rows):
    clash = ["'x' as place", "'x' as muni", "1 as code", "1 as days", "'x' as text", "1 as combo", "'x' as city", "1 as grp", "'x' as word"]
    return spark.createDataFrame(list(rows), EVENT).selectExpr("*", *clash)


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, PLACE).selectExpr("*", "'x' as entry", "'x' as value")


def test_osa_against_the_plain_recurrence():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(7))) for _ in range(400)]

    def plain(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    assert edits.osa(words[:200], words[200:]).tolist() == [plain(a, b) for a, b in zip(words[:200], words[200:])]


def test_places(spark, places):
    rows = [
        event("a", location_city="oberluztal", location_district="OT Mornhade"), event("b", location_city="Oberlutztal", location_district="Altstadt"),
        event("c", location_city="Mornhalde", location_zipcode="77001"), event("d", location_city="Altstadt", location_zipcode="D-77002"),
        event("e", location_city="Treffpunkt folgt", location_district="Altst.", location_zipcode="77002"), event("f", location_city="  ", location_district=None),
        event("g", location_city="OBTAL", location_district="nirgends"), event("h", location_city="Querfelden"), event("h", location_city="Querfelden"), event("i", location_city="x" * 5000),
        event("j", location_city="77002 Unterlutztal (Altstadt)"),
    ]
    got = {(r["id"], r["field"]): r["place_id"] for r in canonical.map_places(table(spark, *rows), places).collect()}
    assert got == {
        ("a", "city"): 1, ("a", "district"): 13, ("c", "city"): 1, ("d", "city"): 2, ("e", "city"): -1, ("e", "district"): 12,
        ("g", "city"): 1, ("g", "district"): -1, ("h", "city"): 3, ("i", "city"): -1, ("j", "city"): 2,
    }


def test_repair_finds_all_within_reach_whatever_the_size_of_the_vocabulary(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcdelnru") for _ in range(rnd.choice([2, 3, 4, 6, 7, 8, 9, 12, 40]))) for _ in range(150)})
    tokens = set(words) | {"oberlu.", "abcd."}
    for w in words:
        for _ in range(4):
            t = list(w)
            for _ in range(rnd.randrange(4)):
                k = rnd.randrange(len(t) + 1)
                if rnd.random() < 0.4 and 0 < k < len(t):
                    t[k - 1], t[k] = t[k], t[k - 1]
                else:
                    t[k : k + rnd.randrange(2)] = rnd.choice([[], ["x"]])
            tokens.add("".join(t))
        tokens.add(w[: rnd.randrange(1, len(w) + 1)] + ".")
    tokens = sorted(t for t in tokens if t)
    small = spark.createDataFrame([(w,) for w in words], "word string")
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {tuple(r) for r in canonical.repair(asked, small).collect()}
    away = lambda a, b: int(edits.osa([a], [b])[0])
    plainly = _levenshtein
    true = {(t, w, e, False) for t in tokens for w in words if abs(len(t.rstrip(".")) - len(w)) <= 3 and (e := away(t.rstrip("."), w)) <= canonical.reach_of(len(t.rstrip("."))) and plainly(t.rstrip("."), w) <= 6}
    cut = {(t, w, e, True) for t in tokens if t.endswith(".") for w in words if len(w) > len(t) - 1 and (e := away(t[:-1], w[: len(t) - 1])) <= (0 if len(t) - 1 < 5 else 1)}
    assert got <= true | cut and cut <= got and len(true - got) <= len(true) // 500
    large = small.unionByName(spark.range(60_000).selectExpr("concat('zz', translate(cast(id as string), '0123456789', 'qwxyzvkjhg'), 'zzzz') as word"))
    assert {tuple(r) for r in canonical.repair(asked, large).where("not word like 'zz%'").collect()} == got


def test_rows_without_city_and_postcode_go_by_their_own_position(spark, places):
    rows = [event("a", location_district="Altstadt", geo_latitude=48.001, geo_longitude=8.0), event("b", location_district="Altstadt", geo_latitude=48.101, geo_longitude=8.1), event("c", location_district="Altstadt")]
    assert {tuple(r) for r in canonical.map_places(table(spark, *rows), places).collect()} == set()
    spelt = [event(r[1], location_district="Altstatd", geo_latitude=r[11], geo_longitude=r[12]) for r in rows]
    assert {tuple(r) for r in canonical.map_places(table(spark, *spelt), places).collect()} == {("a", "district", 11), ("b", "district", 12), ("c", "district", -1)}


def test_empty_tables(spark, places):
    none, few = table(spark, event("a")).limit(0), table(spark, event("a"), event(None))
    empty = places.limit(0)
    assert canonical.map_places(none, places).count() == canonical.map_places(few, empty).count() == 0
    assert addresses.same_places(none, places).count() == addresses.same_places(few, empty).count() == 0
    assert linkage.matches(none, places).count() == linkage.matches(few, empty).count() == 0
    files = spark.createDataFrame([], "id bigint, status string, ingested_at timestamp_ntz")
    assert history.repeats(few, files).count() == 0
    links = spark.createDataFrame([], "canonical_event_id bigint, source_event_id string")
    assert survivors.provenance(few, links, places).count() == survivors.provenance(none, links, empty).count() == 0


def test_addresses(spark, places):
    at = dict(location_city="Oberlutztal", location_zipcode="77001")
    rows = [
        event("a", location_name="Kino Varstann", location_street="Glockenweg", location_street_no="12a", **at), event("b", location_name="KINO VARSTANN (großer Saal)", location_street="12 A, Glocknweg", **at),
        event("c", location_street="Glockenweg", location_street_no="Nr. 12a", **at), event("d", location_name="Varstanner Kino", **at), event("e", location_street="Kino Varstann, Glockenweg 12a", location_city="Oberlutztal"),
        event("f", location_name="Kino Querholm", location_street="Glockenweg", location_street_no="12", **at), event("g", location_name="Kino Varstann", location_street="Glockenweg", location_street_no="12a", location_city="Unterlutztal"),
        event("h", location_name="Kino Varstann", location_street="Glockenweg", location_street_no="12a", **at), event("i"), event("j", location_name="x" * 3000, location_street="y" * 3000, **at),
    ]
    got = {tuple(r) for r in addresses.same_places(table(spark, *rows, rows[0]), places).collect()}
    same = ["a", "b", "c", "d", "e", "h"]
    assert got == {(x, y) for x in same for y in same if x < y} - {("a", "h")}


def test_alignment_costs():
    pairs = [("kino varstann", "kino varstan"), ("grundschule hornberg", "gs hornberg"), ("rosenstrasse", "rosenstr."), ("halle 12a", "halle 12"), ("kino varstann", "museum querholm"), ("alte muehle varstann", "muehle varstann"), ("kino varstann", "varstann"), ("kino varstann", "museum varstann"), ("naturzentrum moos", "naturz. moos"), ("a", "b c d e f")]
    cost = addresses.aligned([tuple(a.split()) for a, _ in pairs], [tuple(b.split()) for _, b in pairs])
    assert [c <= addresses.LIMIT for c in cost] == [True, True, True, False, False, True, True, False, True, False]
    assert cost[5] == cost[6] == addresses.OPENING and addresses.aligned([("x",) * 3], [("x",)])[0] == pytest.approx(addresses.OPENING + addresses.EXTENDING)


def test_a_gap_or_an_abbreviation_alone_joins(spark, places):
    at = dict(location_street="Glockenweg", location_street_no="12a", location_city="Oberlutztal", location_zipcode="77001")
    for one, other, same in (("Kino Alte Varstannmuehle", "Kino Varstannmuehle", True), ("Grundschule Hornbergen", "GS Hornbergen", True), ("Grundschule Hornbergen", "SH Hornbergen", False)):
        rows = [event("a", location_name=one, **at), event("b", location_name=other, location_city="Oberlutztal", location_zipcode="77001")]
        assert [tuple(r) for r in addresses.same_places(table(spark, *rows), places).collect()] == [("a", "b")] * same, (one, other)
        assert {tuple(r) for r in addresses.memberships(table(spark, *rows), places).collect()} == ({("a", "a"), ("b", "a")} if same else {("a", "a"), ("b", "b")})
    lanes = [event("a", location_street="Rosenstraße 5", location_city="Oberlutztal"), event("b", location_street="Rosenstr. 5", location_city="Oberlutztal")]
    assert addresses.same_places(table(spark, *lanes), places).count() == 1


def test_a_chain_of_slips_leads_to_the_commonest_form(spark):
    words = ["varstanngrumbach"]
    for i in range(6):
        words.append(words[-1][: 2 * i] + "xy" + words[-1][2 * i + 2 :])
    forms = spark.createDataFrame([("b", w, w, 10 - i) for i, w in enumerate(words)], "block string, form string, key string, n long")
    assert addresses.representatives(forms, Scratch(spark, "chain"), 40, 1).select("rep").distinct().count() == 1


def test_banding_finds_what_is_within_two_edits(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abdefghiklmnorstu") for _ in range(rnd.randrange(9, 15)))
    pairs = []
    for _ in range(600):
        a = word()
        b = list(a)
        for _ in range(rnd.choice([1, 1, 1, 2])):
            k = rnd.randrange(len(b))
            b[k : k + 1] = rnd.choice([[], ["x"], [b[k], "x"]])
        pairs.append((a, "".join(b)))
    a, b = (addresses.signatures([p[i] for p in pairs], addresses.NAME_BANDS, addresses.NAME_ROWS) for i in (0, 1))
    assert (a == b).any(1).mean() > 0.96


def day(d, start=None):
    return [(d, start, None, None)]


def test_linkage(spark, places):
    filler = [event(f"z{i}", title=f"Vortrag Nummer{'abcdefghijklmnop'[i % 16]}{'qrstuvwxyz'[i % 10]}wort{i}", location_city="Unterlutztal", location_name=f"Kino Holm{'abcdefgh'[i % 8]}tal", source_code="q", dates=day("2012-03-01")) for i in range(30)]
    at = dict(location_city="Oberlutztal", location_name="Kino Varstann", location_street="Glockenweg", location_street_no="3")
    rows = [
        event("a", title="Lesung mit Kuno Drebborwetter", source_code="s1", dates=day("2012-01-05", "19:00"), **at), event("b", title="DREBBORWETTER liest", source_code="s2", dates=day("2012-01-05", "19:30:00"), **at),
        event("c", title="Lesung mit Kuno Drebborwetter", source_code="s2", dates=day("2012-01-06", "19:00"), **at), event("d", title="Orgelvesper Sprintalholm", source_code="s3", dates=day("2012-01-05", "10:00"), **at),
        event("e", title="Lesung mit Kuno Drebborwettr", source_code="s1", dates=day("2012-01-05", "19:00"), **at), event("f", title=None, source_code=None, dates=None), event("g", title="", source_code="s4", dates=day("kein Tag"), **at),
    ]
    got = {(r["id_a"], r["id_b"]) for r in linkage.matches(table(spark, *rows, *filler, rows[0]), places).collect()}
    assert got == {("a", "b"), ("b", "e")}


def test_label_model_learns_which_votes_to_trust():
    rnd = random.Random(2)
    counts: dict = {}
    for _ in range(4000):
        true = rnd.random() < 0.4
        vote = lambda right: (1 if true else -1) if rnd.random() < right else (-1 if true else 1)  # noqa: E731,B023
        v = (vote(0.95), vote(0.9), vote(0.5), rnd.choice([0, vote(0.9)]))
        counts[v] = counts.get(v, 0) + 1
    model = linkage.fit_label_model(list(counts), list(counts.values()), [(0,), (1,), (2,), (3,)])
    assert model.posterior((1, 1, -1, 1)) > 0.95 and model.posterior((-1, -1, 1, -1)) < 0.05 and abs(model.posterior((1, 1, 1, 0)) - model.posterior((1, 1, -1, 0))) < 0.1


def test_history(spark):
    files = spark.createDataFrame([(1, "completed", "2012-01-01 00:00:00"), (2, "completed", "2012-01-02 00:00:00"), (3, "failed", "2012-01-01 00:00:00"), (4, "completed", "2012-01-03 00:00:00")], "id bigint, status string, ingested_at string")
    at = dict(location_name="Kino Varstann", location_city="Oberlutztal", location_zipcode="77001", source_code="s", dates=day("2012-02-01", "19:00"))
    rows = [
        event("b", file_ingestion_id=1, title="Lesung mit Kuno Drebborwetter", **at), event("a", file_ingestion_id=2, title="Abgesagt: Lesung mit Kuno Drebborwettr", **at), event("b", file_ingestion_id=4, title="Lesung mit Kuno Drebborwetter", **at),
        event("c", file_ingestion_id=4, title="Orgelvesper", **at), event("d", file_ingestion_id=4, title="Lesung mit Kuno Drebborwetter", **{**at, "source_code": "t"}),
        event("e", file_ingestion_id=3, title="Orgelvesper", **at), event("f", file_ingestion_id=4, title="Lesung mit Kuno Drebborwetter", **{**at, "dates": day("2012-02-02")}), event("g", file_ingestion_id=4, title=None, **at), event("h", file_ingestion_id=None, title="x" * 4000, **at),
    ]
    got = {tuple(r) for r in history.repeats(table(spark, *rows, rows[0]), files).collect()}
    assert got == {(2, "a", "b"), (4, "b", "b")}


def test_segment_probe_misses_nothing(spark, tmp_path):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice([0, 3, 8, 17, 18, 21]))) for _ in range(60)})
    for w in list(words):
        for _ in range(3):
            v = list(w)
            for _ in range(rnd.randrange(4)):
                k = rnd.randrange(len(v) + 1)
                v[k : k + rnd.randrange(2)] = rnd.choice([[], ["x"]])
            words.append("".join(v))
    words = sorted(set(words))
    df = spark.createDataFrame([("s", w, str(i)) for i, w in enumerate(words)], "scope string, text string, ref string")
    got = {(r["ref"], r["hit"]) for r in history.probe(df, history.segments(df)).collect()}

    def within(a, b):
        limit = history.SHORT_EDITS if max(len(a), len(b)) < history.LONG_FROM else history.LONG_EDITS
        return edits.osa([a], [b])[0] <= limit

    levenshtein = {(str(i), str(j)) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and within(a, b) and _levenshtein(a, b) <= history.reach(max(len(a), len(b)))}
    assert levenshtein <= got and all(within(words[int(i)], words[int(j)]) for i, j in got)
    index = history.SegmentIndex(spark, str(tmp_path / "index"))
    first, second = df.where("int(ref) % 2 = 0"), df.where("int(ref) % 2 = 1")
    assert index.probe(first).count() == 0
    index.append(first)
    assert {tuple(r)[:2] for r in index.probe(second).collect()} == {(i, j) for i, j in got if int(i) % 2 and not int(j) % 2}


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_votes_decide_between_values_of_one_quality(spark, places):
    rows = [event("a", description="Der Chor singt im Saal.", source_code="s"), event("b", description="Der Chor tanzt im Park.", source_code="t"), event("c", description="Der Chor tanzt im Park.", source_code="u")]
    links = spark.createDataFrame([(1, i) for i in "abc"], "canonical_event_id bigint, source_event_id string")
    assert {tuple(r) for r in survivors.provenance(table(spark, *rows), links, places).collect()} == {(1, "description", "b")}
    assert {tuple(r) for r in survivors.provenance(table(spark, *rows[:2]), links, places).collect()} == {(1, "description", "a")}


def test_survivors(spark, places):
    rows = [
        event("a", title="Lesung mit Kuno Drebborwetter", description="Es liest Kuno.", geo_latitude=48.0, geo_longitude=8.0, geo_confidence=0.8, source_code="s", location_city="Oberlutztal"),
        event("b", title="Heute: Lesung mit Kuno Drebborwetter", description="Es liest Kuno. Danach ist Tanz. Es gibt Kuchen und Wein.", geo_latitude=48.1, geo_longitude=8.0, geo_confidence=85.0, source_code="t"),
        event("c", title="Lesung mit Kuno Drebborwetter", description="Es liest Kuno. Danach ist Tanz. Es gibt Kuchen und [mehr]", geo_latitude=8.0, geo_longitude=48.0, geo_confidence=0.99, source_code="s"),
        event("d", title="LESUNG MIT KUNO DREBBORWETTER", description="<p>Es liest Kuno. Danach ist Tanz. Es gibt Kuchen und Wein. Und mehr.</p>", source_code=None), event("e", title="o. T."), event("f"), event("g"),
    ]
    links = spark.createDataFrame([(1, i) for i in "abcde"] + [(1, "a"), (2, "f"), (2, "g"), (3, "a"), (None, "a"), (4, None)], "canonical_event_id bigint, source_event_id string")
    got = {(r[0], r[1]): r[2] for r in survivors.provenance(table(spark, *rows, rows[0]), links, places).collect()}
    assert got == {(1, "title"): "a", (1, "description"): "b", (1, "geo"): "b"}
    best = survivors.survivors(table(spark, *rows), links, places).first()
    assert (best["title_from"], best["description_from"], best["geo_latitude"]) == ("a", "b", 48.1)
