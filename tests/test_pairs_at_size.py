"""Pairs take their records along to the key: none is shuffled, and texts that come again are compared together."""

import random

from pyspark.sql import functions as F

from lindwurm.functions import scores, similarity
from lindwurm.operators import pairs

EVENTS = "id string, file_ingestion_id bigint, title string, short_description string, description string, location_name string, geo_latitude double, geo_longitude double, geo_confidence double, source_code string, source_type string, categories array<string>, dates array<struct<date:string,start_time:string>>, blocking_keys array<string>"


def events_of(spark, n=60):
    rnd = random.Random(2)
    text = lambda: rnd.choice([None, "", " ".join(rnd.choice(["markt", "am", "see", "fest", "see"]) for _ in range(rnd.randrange(1, 6)))])
    days = lambda: rnd.choice([None, [], *[[(rnd.choice(["2012-01-01", "2012-01-02", None]), rnd.choice(["10:00", "11:10", "12:xx", None])) for _ in range(k)] for k in (1, 1, 2, 3)]])
    rows = [(
        rnd.choice([None, *[f"e{k}" for k in range(n)]]), rnd.randrange(4), text(), text(), text(), text(), rnd.choice([None, 48.0, 48.004]), 7.9, rnd.choice([0.9, 0.5]), "s", rnd.choice(["artikel", "terminliste"]),
        ["fasnacht"], days(), rnd.choice([None, [], [rnd.choice("pqrs"), rnd.choice(["p", "q", "r", None])], [rnd.choice("pqrs")]]),
    ) for _ in range(2 * n)]
    return spark.createDataFrame(rows, EVENTS)


def test_scores_of_candidates_are_those_of_their_pairs(spark):
    events = events_of(spark).cache()
    found, wanted = pairs.score_candidates(events), pairs.score_pairs(pairs.candidate_pairs(events), events)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and wanted.count() > 300


def test_no_pair_is_shuffled(spark):
    found = pairs.score_candidates(events_of(spark))
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    meets = next(i for i, line in enumerate(plan) if "SortMergeJoin [key" in line)
    assert not any("Exchange" in line or "Aggregate" in line for line in plan[:meets])


def test_dates_score_as_their_starts(spark):
    rows = [r["dates"] for r in events_of(spark).select("dates").collect()]
    df = spark.createDataFrame([(a, b) for a in rows[:40] for b in rows[40:80]], "a array<struct<date:string,start_time:string>>, b array<struct<date:string,start_time:string>>")
    seconds = lambda t: {"10:00": 36000, "11:10": 40200}.get(t)

    def score(a, b):
        first = [{d: t for d, t in reversed(x or []) if d is not None} for x in (a, b)]
        shared = [d for d in first[0] if d in first[1]]
        if not shared:
            return 0.0
        gaps = [None if None in s else abs(s[0] - s[1]) / 60 for s in ([seconds(x[d]) for x in first] for d in shared)]
        factors = [1.0 if g is None or g <= 30 else 0.1 if g <= 90 else 0.0 for g in gaps]
        return len(shared) / len(first[0].keys() | first[1].keys()) * sum(factors) / len(factors)

    for r in df.select("a", "b", scores.date_score(F.col("a"), F.col("b")).alias("s")).collect():
        assert abs(r["s"] - score(r["a"], r["b"])) < 1e-12


def test_texts_are_compared_together_with_the_result_of_each():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab cäß") for _ in range(rnd.randrange(40))) for _ in range(150)]
    first, second = [a for a in texts[:30] for _ in texts], texts * 30
    assert similarity.token_sorts(first, second) == [similarity.token_sort(a, b) for a, b in zip(first, second)]
    assert similarity.token_sets(first, second) == [similarity.token_set(a, b) for a, b in zip(first, second)]
    assert similarity.common_subsequences(texts[0], texts[1:]) == [similarity.common_subsequence(texts[0], b) for b in texts[1:]]
