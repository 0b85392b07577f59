"""Second opinions on undecided pairs by an injected judge, with a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICT = "same boolean, confidence double, reason string"
HASHED = ["title", "description", "short_description", "location_name", "location_city", "dates", "categories"]


def pair_hash(a: Column, b: Column, a_id: Column, b_id: Column, fields: list[str] = HASHED, lists: tuple[str, ...] = ("dates", "categories")) -> Column:
    """SHA-256 of both records' fields, the same in either order; lists are sorted."""
    def packed(x: Column) -> Column:
        return F.to_json(F.struct(*[(F.array_sort(x[f]) if f in lists else x[f]).alias(f) for f in fields]), {"ignoreNullFields": "false"})

    one, two = packed(a), packed(b)
    return F.sha2(F.when(a_id <= b_id, F.concat_ws("\u0001", one, two)).otherwise(F.concat_ws("\u0001", two, one)), 256)


def cached(pairs: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Pairs with the verdict the cache holds for their hash and model, else null."""
    own = cache.where(F.col("model") == model).dropDuplicates(["pair_hash"]).select("pair_hash", F.col("same").alias("cached_same"), F.col("confidence").alias("cached_confidence"))
    return pairs.join(own, "pair_hash", "left")


def judge(pairs: DataFrame, judge_batch: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Pairs with same, confidence, reason from a function over batches of them.

    A batch the function fails on keeps null verdicts, so its pairs stay
    undecided; confidences outside 0 to 1 count as no verdict.
    """
    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = judge_batch(batch)[["same", "confidence", "reason"]].reset_index(drop=True)
            except Exception as error:
                found = pd.DataFrame({"same": None, "confidence": None, "reason": [str(error)] * len(batch)})
            found.loc[~found["confidence"].astype("float64").between(0, 1), ["same", "confidence"]] = None
            yield pd.concat([batch.reset_index(drop=True), found], axis=1)

    shape = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.mapInPandas(judged, f"{shape}, {VERDICT}")


def applied(decision: Column, same: Column, confidence: Column, threshold: float = 0.6) -> dict[str, Column]:
    """Decision and tier after a verdict: sure ones decide, unsure ones stay undecided."""
    unsure, none = confidence < threshold, same.isNull() | confidence.isNull()
    return {
        "decision": F.when(none, decision).when(unsure, "ambiguous").when(same, "match").otherwise("no_match"),
        "tier": F.when(none, "deterministic").when(unsure, "ai_low_confidence").otherwise("ai"),
    }


def applied_verdict(decision: Column, verdict: Column, confidence: Column, threshold: float = 0.6) -> dict[str, Column]:
    """The same for verdicts in words: 'same' and 'different' decide, any other word is kept as unexpected."""
    same = F.when(verdict == "same", True).when(verdict == "different", False)
    by = applied(decision, same, confidence, threshold)
    odd = verdict.isNotNull() & same.isNull() & confidence.isNotNull() & (confidence >= threshold)
    return {"decision": F.when(odd, "ambiguous").otherwise(by["decision"]), "tier": F.when(odd, "ai_unexpected").otherwise(by["tier"])}


def remember(cache: DataFrame, verdicts: DataFrame, model: str) -> DataFrame:
    """The cache with new verdicts; a hash already there keeps its first one."""
    fresh = verdicts.where("same is not null").select("pair_hash", F.lit(model).alias("model"), "same", "confidence").dropDuplicates(["pair_hash"])
    return cache.unionByName(fresh.join(cache.select("pair_hash", "model"), ["pair_hash", "model"], "left_anti").select("pair_hash", "model", "same", "confidence"))
