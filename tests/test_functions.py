import pytest
from pyspark.sql import functions as F

from lindwurm.config import DEFAULTS, DEPLOYED, load_config, merged
from lindwurm.functions import scores, similarity, text


def one(spark, column, schema, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_normalize_text(spark):
    got = one(spark, text.normalize_text(F.col("x"), text.SYNONYMS), "x string", None, "", "Fasnetsumzug  in Köln!", "u\u0308ber-Land (neu)", "Große\u00a0Straße")
    assert got == ["", "", "fastnachtumzug in koeln", "ueber-land neu", "grosse strasse"]


def test_city_parts(spark):
    assert one(spark, text.normalize_city(F.col("x"), text.CITY_PARTS), "x string", "Kollnau", "Waldkirch", None) == ["waldkirch", "waldkirch", ""]


def test_prefixes_only_the_first(spark):
    got = one(spark, text.strip_prefixes(F.col("x")), "x string", "Vortrag: Vortrag: Bienen", "KOMMUNALES KINO – Film", "Vortragsabend", None)
    assert got == ["Vortrag: Bienen", "Film", "Vortragsabend", None]


def test_times(spark):
    assert one(spark, scores.parse_time(F.col("x")), "x string", "9:5", "19:30:15", "19", "a:b", "25:00", None) == ["09:05:00", "19:30:15", None, None, None, None]


def test_grid_rounds_half_to_even(spark):
    assert spark.createDataFrame([(48.19, 7.81)], "a double, b double").select(scores.geo_grid_key(F.col("a"), F.col("b"))).first()[0] == "48.15|7.80"


def test_blocking_keys_skip_blank_city_and_untrusted_positions(spark):
    schema = "dates array<struct<date:string,start_time:string,end_time:string,end_date:string>>, city string, la double, lo double, c double"
    rows = [([("2026-03-01", None, None, None)] * 2, "kenzingen", 48.19, 7.81, 0.9), ([("2026-03-01", None, None, None)], "", 48.19, 7.81, 0.8), (None, "x", 48.0, 8.0, 0.9)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(scores.blocking_keys(F.col("dates"), F.col("city"), F.col("la"), F.col("lo"), F.col("c"))).collect()]
    assert got == [["dc|2026-03-01|kenzingen", "dg|2026-03-01|48.15|7.80"], [], []]


def record(spark, **values):
    fields = {"title": None, "short_description": None, "description": None, "geo_latitude": None, "geo_longitude": None, "geo_confidence": None, "source_type": None, "categories": None, "dates": None, **values}
    kinds = {"geo_latitude": "double", "geo_longitude": "double", "geo_confidence": "double", "categories": "array<string>", "dates": "array<struct<date:string,start_time:string,end_time:string,end_date:string>>"}
    return fields, "struct<" + ",".join(f"{k}:{kinds.get(k, 'string')}" for k in fields) + ">"


def score(spark, how, a, b):
    (x, shape), (y, _) = record(spark, **a), record(spark, **b)
    return spark.createDataFrame([(tuple(x.values()), tuple(y.values()))], f"a {shape}, b {shape}").select(how(F.col("a"), F.col("b"))).first()[0]


def test_date_score(spark):
    day = lambda d, t=None: (d, t, None, None)
    how = lambda a, b: scores.date_score(a["dates"], b["dates"])
    assert score(spark, how, {"dates": [day("2026-03-01", "10:00")]}, {"dates": [day("2026-03-01", "10:30")]}) == 1.0
    assert score(spark, how, {"dates": [day("2026-03-01", "10:00")]}, {"dates": [day("2026-03-01", "11:00")]}) == pytest.approx(0.1)
    assert score(spark, how, {"dates": [day("2026-03-01")]}, {"dates": [day("2026-03-01"), day("2026-03-02")]}) == 0.5
    assert score(spark, how, {"dates": [day("2026-03-01")]}, {"dates": None}) == 0.0


def test_geo_score(spark):
    here = {"geo_latitude": 48.0, "geo_longitude": 8.0, "geo_confidence": 0.9}
    assert score(spark, scores.geo_score, here, {}) == 0.5
    assert score(spark, scores.geo_score, here, {**here, "geo_confidence": 0.2}) == 1.0
    assert score(spark, scores.geo_score, here, {**here, "geo_latitude": 48.01, "geo_confidence": 0.2}) == 0.5
    assert score(spark, scores.geo_score, here, {**here, "geo_latitude": 49.0}) == 0.0


def test_title_and_description_score(spark):
    assert score(spark, scores.title_score, {"title": "WOODWALKERS 2"}, {"title": "Woodwalkers 2"}) == 1.0
    assert score(spark, scores.title_score, {"title": " "}, {"title": "x"}) == 0.0
    assert score(spark, scores.description_score, {}, {}) == 0.5
    assert score(spark, scores.description_score, {"short_description": "a"}, {}) == 0.4


def test_ratios_against_plain_definitions():
    assert similarity.token_sort("b a", "a b") == 100 and similarity.token_set("a b", "a b c") == 100 and similarity.token_set("", "a") == 0
    assert similarity.ratio("", "") == 100 and similarity.ratio("abc", "abd") == pytest.approx(200 * 2 / 6)


def test_weights_by_priority(spark):
    config = merged(DEFAULTS, DEPLOYED)
    how = lambda a, b: scores.weights(a, b, config)["title"]
    assert score(spark, how, {"categories": ["versammlung", "fasnacht"]}, {"categories": ["fasnacht", "versammlung"]}) == 0.25
    assert score(spark, how, {"categories": ["versammlung"]}, {"categories": None}) == 0.3


def test_decide_at_the_borders(spark):
    rows = spark.createDataFrame([(0.75, 0.9), (0.75, 0.44), (0.75, 0.45), (0.35, 0.9), (0.5, 0.9)], "s double, t double")
    assert [r[0] for r in rows.select(scores.decide(F.col("s"), F.col("t"))).collect()] == ["match", "ambiguous", "match", "no_match", "ambiguous"]


def test_config_merge():
    assert load_config(changes={"geo": {"max_distance_km": 5.0}})["geo"] == {**DEFAULTS["geo"], "max_distance_km": 5.0}
    with pytest.raises(ValueError):
        load_config(changes={"nonsense": {}})
