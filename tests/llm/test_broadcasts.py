"""Rows that an explode makes are joined by shuffles: the engine takes them for as few as the rows they come from and would send them all to the driver."""

import pytest

from lindwurm.llm import addresses, canonical, linkage
from lindwurm.runtime import Scratch


def exploded_broadcasts(df) -> int:
    """Broadcasts over an explode in the plan that ran."""
    df.collect()
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n"), 0
    for i, line in enumerate(lines):
        if (at := line.find("BroadcastExchange")) >= 0:
            below = next((k for k in range(i + 1, len(lines)) if not lines[k][: at + 1].strip(" :+-") == ""), len(lines))
            found += any("Generate explode" in x for x in lines[i + 1 : below])
    return found


def test_the_plan_tells_such_a_broadcast(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [2])], "n int, keys array<int>").selectExpr("n", "explode(keys) key")
    assert exploded_broadcasts(df.alias("a").join(df.alias("b").hint("broadcast"), "key")) == 1


def test_keys_of_names_are_not_broadcast(spark):
    plans = []

    class Seen(Scratch):
        def put(self, df):
            plans.append(exploded_broadcasts(df))
            return super().put(df)

    words = [f"{a}{b}{c}" for a in ("varst", "querh", "lindm") for b in ("ann", "olm", "esk") for c in ("en", "orf", "ald")]
    forms = spark.createDataFrame([("m", f"kino {w}", w, n) for n, w in enumerate(words)], "block string, form string, key string, n long")
    addresses.representatives(forms, Seen(spark, "keys")).collect()
    assert len(plans) > 1 and sum(plans) == 0


def test_keys_of_words_are_not_broadcast(spark):
    tokens, words = spark.createDataFrame([("freibrug",), ("emmend.",)], "token string"), spark.createDataFrame([("freiburg",), ("emmendingen",)], "word string")
    found = canonical.repair(tokens, words)
    assert exploded_broadcasts(found) == 0
    assert {(r["token"], r["word"]) for r in found.collect()} == {("freibrug", "freiburg"), ("emmend.", "emmendingen")}


@pytest.mark.parametrize("place", [7, None])
def test_keys_of_listings_are_not_broadcast(spark, place):
    told = spark.createDataFrame([(i, "m", place, ["varstann"], [("2012-01-01", 60)]) for i in range(3)], "no bigint, muni string, place bigint, title_words array<string>, days array<struct<day:string,start:int>>")
    assert exploded_broadcasts(linkage.candidates(Scratch(spark, "told").put(told))) == 0
