"""Matching entities across sources without keys: a label model over heuristic votes.

Candidates share a day and a place, or a day, a municipality and a telling word
of the title. Heuristic functions vote on each (match, no match, abstain); a
generative model learns from the agreement of the votes, over the counts of all
vote patterns, how accurate each function is and which functions hang
together, and gives every pattern its posterior. No labelled row is needed.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lindwurm.llm.components import connected_components
from lindwurm.llm.edits import osa
from lindwurm.llm.listings import features, parted
from lindwurm.runtime import Scratch

VOTES = ["v_title", "v_words", "v_many", "v_start", "v_place", "v_near", "v_days"]
THRESHOLD = 0.5
#: Functions whose votes hang together more than this among matches or among others are modelled jointly, TOGETHER at most.
CORRELATION, TOGETHER = 0.3, 3


@dataclass
class LabelModel:
    """Class-conditional distributions of groups of votes, and the share of matches."""

    prior: float
    tables: list[tuple[tuple[int, ...], dict[tuple[int, ...], tuple[float, float]]]]

    def posterior(self, votes: tuple[int, ...]) -> float:
        score = math.log(self.prior) - math.log(1 - self.prior)
        for columns, table in self.tables:
            match, other = table.get(tuple(votes[c] for c in columns), (1.0, 1.0))
            score += math.log(match) - math.log(other)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))


def fit_label_model(patterns: list[tuple[int, ...]], counts: list[int], groups: list[tuple[int, ...]], rounds: int = 60) -> LabelModel:
    """Expectation maximisation over vote patterns, started from the majority of votes.

    ``groups`` partition the functions; those of one group are modelled by
    their joint table, which is how correlations are learned.
    """
    votes, weight = np.array(patterns, int).reshape(len(patterns), -1), np.array(counts, float)
    total = votes.sum(1)
    belief = 1 / (1 + np.exp(-1.2 * (total - 0.5)))
    tables: list = []
    prior = 0.5
    for _ in range(rounds):
        prior = float(np.clip((belief * weight).sum() / max(weight.sum(), 1e-9), 0.02, 0.98))
        tables, score = [], np.full(len(votes), math.log(prior / (1 - prior)))
        for columns in groups:
            keys = [tuple(v[list(columns)]) for v in votes]
            match: dict = {}
            other: dict = {}
            for key, b, w in zip(keys, belief, weight):
                match[key] = match.get(key, 0.0) + b * w
                other[key] = other.get(key, 0.0) + (1 - b) * w
            smooth = 0.5
            m, o = sum(match.values()) + smooth * len(match), sum(other.values()) + smooth * len(other)
            table = {k: ((match[k] + smooth) / m, (other[k] + smooth) / o) for k in match}
            tables.append((columns, table))
            score += np.array([math.log(table[k][0]) - math.log(table[k][1]) for k in keys])
        fresh = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(fresh - belief).max() < 1e-5:
            break
        belief = fresh
    return LabelModel(prior, tables)


def correlated_groups(patterns: list[tuple[int, ...]], counts: list[int]) -> list[tuple[int, ...]]:
    """A partition of the functions into groups whose votes hang together beyond what match or no match explains.

    A model that takes the functions for independent is fitted first; pairs
    are then joined by falling correlation within its classes. Groups stay
    small, as one joint table of all functions would explain anything.
    """
    width = len(patterns[0])
    model = fit_label_model(patterns, counts, [(i,) for i in range(width)])
    votes, weight = np.array(patterns, float), np.array(counts, float)
    belief = np.array([model.posterior(p) for p in patterns])
    strength = np.zeros((width, width))
    for share in (belief * weight, (1 - belief) * weight):
        if share.sum() > 0:
            centred = votes - (votes * share[:, None]).sum(0) / share.sum()
            together = (centred * share[:, None]).T @ centred / share.sum()
            spread = np.sqrt(np.outer(together.diagonal(), together.diagonal()))
            # less what chance alone makes of so few pairs
            strength = np.maximum(strength, np.abs(np.divide(together, spread, out=np.zeros_like(together), where=spread > 1e-9)) - 3 / math.sqrt(share.sum() + 1))
    groups = [{i} for i in range(width)]
    for _, i, j in sorted(((-strength[i, j], i, j) for i in range(width) for j in range(i) if strength[i, j] >= CORRELATION)):
        p, q = (next(g for g in groups if k in g) for k in (i, j))
        if p is not q and len(p) + len(q) <= TOGETHER:
            groups.remove(q)
            p |= q
    return [tuple(sorted(g)) for g in groups]


@F.pandas_udf(IntegerType())
def fuzzy_shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many words of one list have a slip of themselves in the other."""
    left, right, owner = [], [], []
    for k, (p, q) in enumerate(zip(a, b)):
        if p is None or q is None:
            continue
        for x in p:
            for y in q:
                if abs(len(x) - len(y)) <= 2 and min(len(x), len(y)) >= 7 and (x[0] == y[0] or x[-3:] == y[-3:] or x[1:4] == y[1:4]):
                    left.append(x), right.append(y), owner.append(k)
                elif min(len(x), len(y)) >= 6 and (x.startswith(y) or y.startswith(x)):
                    left.append(x), right.append(x), owner.append(k)
    out = np.zeros(len(a), np.int32)
    if left:
        close = osa(left, right) <= 2
        np.add.at(out, np.array(owner)[close], 1)
    return pd.Series(out)


def candidates(told: DataFrame) -> DataFrame:
    """(x, y), numbers of listings that share a day and a place, or a day, town and title word."""
    day = told.where("muni is not null or place is not null").select("no", "muni", "place", "title_words", F.explode(F.array_distinct("days.day")).alias("day"))
    at_place = day.where("place is not null").select(F.xxhash64(F.lit("p"), "day", "place").alias("key"), "no")
    by_word = day.select(F.explode(F.transform(F.array_distinct("title_words"), lambda w: F.xxhash64(F.lit("w"), "day", "muni", w))).alias("key"), "no")
    keyed = at_place.unionByName(by_word)  # a day and a word come once in a listing, so its keys do
    # the estimate takes a listing's keys for one row, so the engine might broadcast them all
    return keyed.alias("a").join(keyed.alias("b").hint("merge"), "key").where("a.no < b.no").select(F.col("a.no").alias("x"), F.col("b.no").alias("y")).distinct()


def voted(told: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, votes...) of each pair (x, y)."""
    # words travel as one text each, which takes much less room than an array
    own = told.select("no", F.struct("place", "number", F.array_join("title_words", " ").alias("title_words"), F.array_join("words", " ").alias("words"), "lat", "lon", "days").alias("own"))
    pairs = pairs.join(own.select(F.col("no").alias("x"), F.col("own").alias("a")), "x").join(own.select(F.col("no").alias("y"), F.col("own").alias("b")), "y")
    pairs = pairs.select("x", "y", "a", "b", *[parted(F.col(f"{side}.{c}")).alias(f"{side}_{c}") for side in "ab" for c in ("title_words", "words")])
    shared_title = F.size(F.array_intersect("a_title_words", "b_title_words"))
    shared = F.size(F.array_intersect("a_words", "b_words"))
    titled = (F.size("a_title_words") > 0) & (F.size("b_title_words") > 0)
    worded = (F.size("a_words") > 0) & (F.size("b_words") > 0)
    blank = F.lit(None).cast("array<string>")
    # the least difference of the starts on a common day
    gap = F.array_min(F.flatten(F.transform("a.days", lambda p: F.transform(F.filter("b.days", lambda q: q["day"] == p["day"]), lambda q: F.abs(p["start"] - q["start"])))))
    apart = 111.2 * F.sqrt(F.pow(F.col("a.lat") - F.col("b.lat"), 2) + F.pow((F.col("a.lon") - F.col("b.lon")) * F.cos(F.radians("a.lat")), 2))
    same_place, other_place = F.col("a.place") == F.col("b.place"), F.col("a.place") != F.col("b.place")
    numbered = (F.col("a.number") != "") & (F.col("b.number") != "") & (F.col("a.number") != F.col("b.number"))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    pairs = pairs.withColumn("st", shared_title).withColumn("sw", shared).select(
        "x", "y", "st", "sw", titled.alias("titled"), worded.alias("worded"), ((F.size("a_words") > 2) & (F.size("b_words") > 2)).alias("several"),
        vote(gap <= 35, gap > 65).alias("v_start"), vote(same_place, other_place & numbered).alias("v_place"), vote(apart < 2.5, (apart > 6) & (apart < 60)).alias("v_near"),
        vote(F.size("a.days") == F.size("b.days"), F.abs(F.size("a.days") - F.size("b.days")) > 1).alias("v_days"),
        # only words that may still be slips of each other go to the workers
        *[F.when((F.col(n) == 0) & there, F.col(f"{side}_{c}")).otherwise(blank).alias(f"{side}_{n}") for n, there, c in (("st", titled, "title_words"), ("sw", worded, "words")) for side in "ab"],
    )
    pairs = pairs.withColumn("ft", fuzzy_shared("a_st", "b_st")).withColumn("fw", fuzzy_shared("a_sw", "b_sw"))
    return pairs.select(
        "x", "y", vote((F.col("st") > 0) | (F.col("ft") > 0), F.col("titled")).alias("v_title"), vote((F.col("sw") > 0) | (F.col("fw") > 0), F.col("worded")).alias("v_words"),
        vote(F.col("sw") + F.col("fw") >= 2, F.col("worded") & (F.col("sw") + F.col("fw") == 0) & F.col("several")).alias("v_many"), "v_start", "v_place", "v_near", "v_days",
    )


def posteriors(votes: DataFrame) -> DataFrame | None:
    """(votes..., confidence) of every pattern there can be (3 ** len(VOTES)), by a model learned from the given votes; null without any."""
    counts = votes.groupBy(*VOTES).count().collect()  # at most as many patterns
    if not counts:
        return None
    patterns, uses = [tuple(r[v] for v in VOTES) for r in counts], [r["count"] for r in counts]
    model = fit_label_model(patterns, uses, correlated_groups(patterns, uses))
    return votes.sparkSession.createDataFrame([(*p, model.posterior(p)) for p in itertools.product((-1, 0, 1), repeat=len(VOTES))], ", ".join(f"{v} int" for v in VOTES) + ", confidence double")


def occasions(pairs: DataFrame) -> DataFrame:
    """(no, occasion) of the listings of pairs (x, y): one label for all that a chain of pairs reaches, however long.

    Each listing takes the least of itself and those paired with it. Where all
    are paired with one, as most are, that is their label; only labels that
    pairs still tie to others go through the components.
    """
    scratch = Scratch(pairs.sparkSession, "occasions")
    pairs = pairs.where("x <> y").select("x", "y")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = scratch.put(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("no"), F.least("x", "y").alias("label")))
    open_ = pairs.join(least.select(F.col("no").alias("x"), F.col("label").alias("a")), "x").join(least.select(F.col("no").alias("y"), F.col("label").alias("b")), "y").where("a <> b").select("a", "b").distinct()
    tied = connected_components(scratch.put(open_), prefix="occasions").select(F.col("node").alias("label"), "component")
    return least.join(tied, "label", "left").select("no", F.coalesce("component", "label").alias("occasion"))


def matches(events: DataFrame, reference: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b, confidence) of ids of different sources that announce one occasion.

    A pair has a day in common. Besides pairs whose posterior reaches the
    threshold, those come out that a chain of such pairs ties together on a
    common day, with the posterior of their own votes, however low. Listings
    without a date, a municipality and a place match nothing.
    """
    scratch = Scratch(events.sparkSession, "linkage")
    told = features(events, reference, scratch)
    votes = scratch.put(voted(told, candidates(told)))
    scratch.settle()
    table = posteriors(votes)
    if table is None:
        return events.sparkSession.createDataFrame([], "id_a string, id_b string, confidence double")
    rated = scratch.put(votes.join(F.broadcast(table), VOTES).where(F.col("confidence") >= threshold).select("x", "y", "confidence"))
    scratch.drop(votes)
    scratch.settle()
    label = occasions(rated)  # both ends of a rated pair share it, so no such pair is lost below
    scratch.settle()
    days = told.select("no", "id", "source", F.array_distinct("days.day").alias("days"))
    dated = label.join(days, "no").select("no", "id", "source", "occasion", F.when(F.size("days") > 1, F.col("days")).alias("days"), F.explode("days").alias("day"))
    # days, too, are more rows than the estimate has
    tied = dated.alias("a").join(dated.alias("b").hint("merge"), ["occasion", "day"]).where("a.no < b.no and a.source <> b.source")
    # a pair comes out on the first of its common days only
    tied = tied.where(F.coalesce(F.col("day") == F.array_min(F.array_intersect("a.days", "b.days")), F.lit(True)))
    tied = tied.select(F.col("a.no").alias("x"), F.col("b.no").alias("y"), F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))
    tied = scratch.put(tied.join(rated, ["x", "y"], "left"))
    # few pairs are tied by a chain only; just their listings are read again
    chained = scratch.put(tied.where("confidence is null").drop("confidence"))
    ends = chained.select(F.col("x").alias("no")).unionByName(chained.select(F.col("y").alias("no")))
    own = voted(scratch.put(told.join(ends, "no", "left_semi")), chained.select("x", "y")).join(F.broadcast(table), VOTES).select("x", "y", "confidence")
    return tied.where("confidence is not null").select("id_a", "id_b", "confidence").unionByName(chained.join(own, ["x", "y"], "left").select("id_a", "id_b", "confidence"))
