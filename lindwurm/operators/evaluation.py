"""Labels against predictions: metrics, sweeps, labelling rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85]


def unordered(pairs: DataFrame, a: str = "source_event_id_a", b: str = "source_event_id_b") -> DataFrame:
    """Pairs with the smaller id first, as id_a and id_b."""
    return pairs.withColumn("id_a", F.least(a, b)).withColumn("id_b", F.greatest(a, b))


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1")]


def metrics(predicted: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of predicted pairs against labels same/different.

    ``predicted`` has id_a, id_b (and the columns of ``by``); pairs without a
    label don't count. Rates of nothing are 0.
    """
    by = by or []
    hits = predicted.select(*by, "id_a", "id_b").distinct().withColumn("hit", F.lit(True))
    truth = labels.select("id_a", "id_b", "label").distinct()
    grid = truth.join(predicted.select(*by).distinct(), F.lit(True)) if by else truth
    both = grid.join(hits, [*by, "id_a", "id_b"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    same = F.col("label") == "same"
    counts = both.groupBy(*by).agg(
        F.count_if(same & F.col("hit")).alias("tp"), F.count_if(~same & F.col("hit")).alias("fp"),
        F.count_if(same & ~F.col("hit")).alias("fn"), F.count_if(~same & ~F.col("hit")).alias("tn"),
    )
    return counts.select(*by, "tp", "fp", "fn", "tn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def sweep(scored: DataFrame, labels: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Metrics at each threshold of a score, in one pass over the labelled pairs.

    ``scored`` has id_a, id_b, score; a pair counts as predicted at every
    threshold it reaches.
    """
    best = scored.groupBy("id_a", "id_b").agg(F.max("score").alias("score"))
    both = labels.select("id_a", "id_b", "label").distinct().join(best, ["id_a", "id_b"], "left")
    each = both.select("label", "score", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    hit, same = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)), F.col("label") == "same"
    counts = each.groupBy("threshold").agg(
        F.count_if(same & hit).alias("tp"), F.count_if(~same & hit).alias("fp"), F.count_if(same & ~hit).alias("fn"), F.count_if(~same & ~hit).alias("tn")
    )
    return counts.select("threshold", "tp", "fp", "fn", "tn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def with_category(pairs: DataFrame, events: DataFrame, category: str) -> DataFrame:
    """Pairs of which either side has the category."""
    has = events.where(F.array_contains("categories", category)).select("id").distinct()
    left = pairs.join(has.withColumnRenamed("id", "id_a"), "id_a", "left_semi")
    right = pairs.join(has.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    return left.unionByName(right).distinct()


def hard_negatives(scored: DataFrame, below: float, share: float, seed: int = 0) -> DataFrame:
    """A seeded share (at least one row) of the pairs scored below a threshold."""
    low = scored.where(F.col("score") < below)
    k = max(1, int(low.count() * share))
    return low.orderBy(F.xxhash64(F.lit(seed), "id_a", "id_b"), "id_a", "id_b").limit(k)


def labelling_candidates(scored: DataFrame, threshold: float, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Pairs from a score on, and a seeded share of those below as hard negatives, the likeliest first."""
    near = scored.where(F.col("score") >= threshold).withColumn("hard_negative", F.lit(False))
    both = near.unionByName(hard_negatives(scored, threshold, share, seed).withColumn("hard_negative", F.lit(True)))
    return both.orderBy(F.desc("score"), "id_a", "id_b")


def auto_label(pairs: DataFrame) -> DataFrame:
    """label, confidence and reason by title and description likeness and town; null where unsure.

    ``pairs`` has title_sim, desc_sim (missing counts as 0), city_a, city_b.
    """
    t, d = F.col("title_sim"), F.coalesce("desc_sim", F.lit(0.0))
    filled = (F.coalesce("city_a", F.lit("")) != "") & (F.coalesce("city_b", F.lit("")) != "")
    same, other = filled & (F.col("city_a") == F.col("city_b")), filled & (F.col("city_a") != F.col("city_b"))
    rule = (
        F.when((t >= 0.90) & same, F.struct(F.lit("same").alias("label"), F.lit("high").alias("confidence"), F.lit("title, city").alias("reason")))
        .when((t >= 0.70) & same & (d >= 0.80), F.struct(F.lit("same").alias("label"), F.lit("medium").alias("confidence"), F.lit("title, city, description").alias("reason")))
        .when(t < 0.40, F.struct(F.lit("different").alias("label"), F.lit("high").alias("confidence"), F.lit("title").alias("reason")))
        .when(other & (t < 0.70), F.struct(F.lit("different").alias("label"), F.lit("high").alias("confidence"), F.lit("city, title").alias("reason")))
    )
    return pairs.withColumn("rule", rule).select(*pairs.columns, "rule.label", "rule.confidence", "rule.reason")


def label_stats(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "same").alias("same"), F.count_if(F.col("label") == "different").alias("different"))


def unlabelled(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    return candidates.join(labels.select("id_a", "id_b").distinct(), ["id_a", "id_b"], "left_anti")


def compared(first: DataFrame, second: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics of two sets of predictions side by side, with the differences of the rates."""
    a, b = metrics(first, labels), metrics(second, labels)
    names = ["precision", "recall", "f1"]
    left = a.select(*[F.col(n).alias(f"{n}_first") for n in names])
    right = b.select(*[F.col(n).alias(f"{n}_second") for n in names])
    return left.join(right, F.lit(True)).select("*", *[F.round(F.col(f"{n}_second") - F.col(f"{n}_first"), 6).alias(f"{n}_change") for n in names])
