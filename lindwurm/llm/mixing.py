"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of target sources they
belong to). A min-cost flow routes each pattern's token capacity to the source
quotas, the k-th use of a document costing k, so repetitions are spread evenly
and rarely used; it runs over patterns and sources only, never over documents.
Documents are then drawn in a seeded order until the routed tokens are met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Patterns the driver may hold; 2 ** sources bounds them for the few sources of a mixture.
MAX_PATTERNS = 200_000
#: Documents that a part of the seeded order holds on average; running sums are taken over parts side by side.
PART_ROWS = 100_000


@dataclass
class Routes:
    """Tokens routed from pattern to source, and what each quota still lacks."""

    flow: dict[tuple[int, int], float]
    lacking: list[float]


def route(capacity: list[float], members: list[list[int]], quotas: list[float], repeats: list[int]) -> Routes:
    """Min-cost flow by successive shortest paths.

    Pattern p can be used at most ``max(repeats of its sources)`` times in all
    and ``repeats[s]`` times for source s; use k of a pattern costs k.
    """
    flow = {(p, s): 0.0 for p, own in enumerate(members) for s in own}
    used = [0.0] * len(capacity)
    lacking = [max(0.0, q) for q in quotas]
    limit = [capacity[p] * max((repeats[s] for s in own), default=0) for p, own in enumerate(members)]
    arc_limit = {(p, s): capacity[p] * repeats[s] for p, s in flow}
    holders = [[] for _ in quotas]
    for p, s in flow:
        holders[s].append(p)

    def next_use(p: int) -> tuple[float, float]:
        """Cost of one more token of a pattern and how many there are at that cost."""
        left = limit[p] - used[p]
        if left <= 0 or capacity[p] <= 0:
            return float("inf"), 0.0
        level = int(used[p] // capacity[p]) + 1
        return float(level), min(left, level * capacity[p] - used[p])

    while True:
        # cheapest way from any pattern with room to any source that lacks, over swaps of patterns between sources
        cost = [next_use(p)[0] for p in range(len(capacity))]
        come: list[tuple[str, int, int] | None] = [None] * len(capacity)
        at_source, by = [float("inf")] * len(quotas), [-1] * len(quotas)
        changed = True
        while changed:
            changed = False
            for (p, s), f in flow.items():
                if cost[p] < at_source[s] and arc_limit[p, s] - f > 0:
                    at_source[s], by[s], changed = cost[p], p, True
            for (p, s), f in flow.items():
                if f > 0 and at_source[s] < cost[p] and by[s] != p:
                    cost[p], come[p], changed = at_source[s], ("back", s, by[s]), True
        open_ = [s for s in range(len(quotas)) if lacking[s] > 0 and at_source[s] < float("inf")]
        if not open_:
            return Routes(flow, lacking)
        goal = min(open_, key=lambda s: (at_source[s], s))
        steps, s, room = [], goal, lacking[goal]
        while True:
            p = by[s]
            steps.append((p, s, 1.0))
            room = min(room, arc_limit[p, s] - flow[p, s])
            if come[p] is None:
                room = min(room, next_use(p)[1])
                used[p] += room
                break
            _, back, _ = come[p]
            steps.append((p, back, -1.0))
            room = min(room, flow[p, back])
            s = back
        for p, s, sign in steps:
            flow[p, s] += sign * room
        lacking[goal] -= room


def mixture(documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", members: str = "members", tokens: str = "tokens", source: str = "source", weight: str = "weight", max_repeats: str = "max_repeats", size: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of a mixture of ``size`` tokens, by default as large as the corpus.

    ``documents`` holds the key, an array of sources and a token count; the key
    must be unique. Sources outside ``targets``, null arrays and null tokens
    (taken as 0) join no pattern but count in the corpus. ``uses`` is (key,
    source, repeats) for documents drawn at least once; ``shares`` has one row
    per target: source, weight, tokens_available, tokens_wanted, tokens_routed,
    tokens_used, share, reached. Targets with a null weight or limit want 0 or
    allow 0 uses.
    """
    spark = documents.sparkSession
    goals = targets.where(F.col(source).isNotNull()).orderBy(source).collect()  # bounded by the mixture's recipe
    names = [g[source] for g in goals]
    wanted = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    own = documents.select(
        F.col(key), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"),
        F.array_sort(F.array_intersect(F.coalesce(F.col(members), F.array().cast("array<string>")), wanted)).alias("pattern"),
    )
    patterns = own.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    parts_wanted = 1 + sum(p["documents"] for p in patterns) // PART_ROWS
    total = float(sum(p["tokens"] for p in patterns)) if size is None else float(size)
    patterns = sorted((p for p in patterns if p["pattern"]), key=lambda p: p["pattern"])
    number = {n: i for i, n in enumerate(names)}
    capacity = [float(p["tokens"]) for p in patterns]
    within = [[number[n] for n in p["pattern"]] for p in patterns]
    quotas = [(g[weight] or 0.0) * total for g in goals]
    routed = route(capacity, within, quotas, [g[max_repeats] or 0 for g in goals])

    rows = [(p["pattern"], names[s], int(f // capacity[i]), f - (f // capacity[i]) * capacity[i]) for i, p in enumerate(patterns) for s in within[i] if (f := routed.flow[i, s]) > 0]
    plan = spark.createDataFrame(rows, "pattern array<string>, source string, whole int, rest double")
    hashed = own.where(F.size("pattern") > 0).withColumn("turn", F.xxhash64(F.lit(seed), F.col(key)))
    hashed = hashed.withColumn("part", F.pmod(F.shiftright("turn", 20), F.lit(parts_wanted)).cast("bigint"))
    parts = hashed.groupBy("pattern", "part").agg(F.sum("tokens").alias("sum"))
    before = parts.select("pattern", "part", (F.sum("sum").over(Window.partitionBy("pattern").orderBy("part")) - F.col("sum")).alias("before"))
    running = F.sum("tokens").over(Window.partitionBy("pattern", "part").orderBy("turn", key).rowsBetween(Window.unboundedPreceding, 0))
    placed = hashed.withColumn("running", running).join(before, ["pattern", "part"]).withColumn("upto", F.col("before") + F.col("running"))
    uses = (
        placed.join(F.broadcast(plan), "pattern")
        .select(F.col(key), "source", "tokens", (F.col("whole") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("repeats"))
        .where("repeats > 0")
    )
    available = [sum(c for c, w in zip(capacity, within) if s in w) for s in range(len(names))]
    stated = spark.createDataFrame(
        [(n, g[weight], int(available[i]), quotas[i], quotas[i] - routed.lacking[i], not routed.lacking[i] > 0) for i, (n, g) in enumerate(zip(names, goals))],
        T.StructType.fromDDL("source string, weight double, tokens_available bigint, tokens_wanted double, tokens_routed double, reached boolean"),
    )
    drawn = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"))
    shares = stated.join(drawn, "source", "left").fillna(0, ["tokens_used"])
    whole = F.sum("tokens_used").over(Window.partitionBy())  # one row per target
    shares = shares.withColumn("share", F.when(whole > 0, F.col("tokens_used") / whole).otherwise(0.0))
    return uses.select(key, "source", "repeats"), shares
