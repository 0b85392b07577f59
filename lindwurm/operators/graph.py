"""Clusters of matched pairs: components, coherence and confidence.

The component of the highest-degree vertex is peeled off by frontier
breadth-first joins and anti-joined away; the small components that remain are
labelled by propagation of the least id, in rounds that contract every local
basin, so that chains need a logarithmic number of rounds. A frontier that is
still moving after ``max_levels`` levels is handed over contracted to one
vertex, so long chains inside the peeled component stay exact and cheap.

Vertices of very high degree, and roots of very many vertices, are salted in
every join on them: one side carries a salt, the other one copy per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindwurm.config import DEFAULTS
from lindwurm.runtime import Scratch

#: Edges of one vertex from which its rows are spread over SALTS keys.
HOT_DEGREE = 100_000
SALTS = 32
MAX_LEVELS = 12


def components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, cluster): the least id of each node's component; isolated nodes stand alone.

    ``pairs`` has id_a and id_b; without ``nodes`` only ids of pairs come out.
    """
    label = connected_components(pairs, a="id_a", b="id_b", prefix="clusters").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    if nodes is None:
        return label
    return nodes.where("id is not null").select("id").distinct().join(label, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def connected_components(links: DataFrame, *, a: str = "a", b: str = "b", hot_degree: int = HOT_DEGREE, max_levels: int = MAX_LEVELS, prefix: str = "components") -> DataFrame:
    """(node, component): every node of a link and the least node of its component.

    Links are undirected and may repeat; links with a null end or with both
    ends equal are dropped, so a node that has only these does not come out.
    An empty input gives an empty result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, prefix)
    clean = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    once = scratch.put(clean)
    edges = scratch.put(once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    scratch.drop(once)
    degrees = scratch.put(edges.groupBy("u").agg(F.count(F.lit(1)).alias("degree")))
    top = degrees.orderBy(F.desc("degree"), "u").first()
    if top is None:
        return degrees.select(F.col("u").alias("node"), F.col("u").alias("component"))
    hot = degrees.where(F.col("degree") >= hot_degree).select(F.col("u").alias("hot"))
    if hot.isEmpty():
        hot = None

    # breadth first from the vertex of highest degree
    visited = scratch.put(degrees.where(F.col("u") == F.lit(top["u"])).select("u"))
    frontier, open_frontier = visited, True
    for _ in range(max_levels):
        fresh = scratch.put(_step(edges, frontier, hot).join(visited, "u", "left_anti"))
        if fresh.isEmpty():
            open_frontier = False
            break
        grown = scratch.put(visited.unionByName(fresh))
        scratch.drop(visited)
        if frontier is not visited:
            scratch.drop(frontier)
        visited, frontier = grown, fresh
    least = visited.agg(F.min("u")).first()[0]
    peeled = visited.select(F.col("u").alias("node"), F.lit(least).alias("component"))

    rest = _without(edges, visited, hot, outside_only=True)
    if open_frontier:
        # what hangs on the unfinished frontier goes on as edges of one vertex
        border = _without(edges, visited, hot, outside_only=False)
        joint = border.select(F.lit(least).alias("u"), "v").distinct()
        rest = rest.unionByName(joint).unionByName(joint.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = _propagate(scratch, scratch.put(rest), hot_degree)
    if open_frontier:
        # the shared vertex may have found a smaller label than its own
        joined = labels.where(F.col("node") == F.lit(least)).first()
        final = joined["component"] if joined else least
        peeled = visited.select(F.col("u").alias("node"), F.lit(final).alias("component"))
        labels = labels.where(F.col("node") != F.lit(least))
    return peeled.unionByName(labels)


def _hot(rows: DataFrame, column: str, hot_degree: int) -> DataFrame | None:
    """Values that ``hot_degree`` rows or more share, at most rows / hot_degree; null if there are none."""
    if rows.count() < hot_degree:
        return None
    hot = rows.groupBy(column).count().where(F.col("count") >= hot_degree).select(F.col(column).alias("hot"))
    return None if hot.isEmpty() else hot


def _salt(vertex: str, other: str, hot: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Edges with a salt that is 0 unless ``vertex`` is hot."""
    if hot is None:
        return edges.withColumn("salt", F.lit(0))
    marked = edges.join(F.broadcast(hot), F.col(vertex) == F.col("hot"), "left")
    return marked.withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))).drop("hot")


def _copies(vertices: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Vertices with one row per salt their edges may carry. Column u."""
    if hot is None:
        return vertices.withColumn("salt", F.lit(0))
    marked = vertices.join(F.broadcast(hot), F.col("u") == F.col("hot"), "left")
    return marked.withColumn("salt", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1))))).drop("hot")


def _step(edges: DataFrame, frontier: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Neighbours of the frontier, each once. Column u."""
    return _salt("u", "v", hot, edges).join(_copies(frontier, hot), ["u", "salt"], "left_semi").select(F.col("v").alias("u")).distinct()


def _without(edges: DataFrame, visited: DataFrame, hot: DataFrame | None, outside_only: bool) -> DataFrame:
    """Edges wholly outside the visited vertices, or those leading out of them."""
    inside = _copies(visited, hot)
    kept = _salt("u", "v", hot, edges).join(inside, ["u", "salt"], "left_anti" if outside_only else "left_semi").select("u", "v")
    ends = inside.select(F.col("u").alias("v"), "salt")
    return _salt("v", "u", hot, kept).join(ends, ["v", "salt"], "left_anti").select("u", "v")


def _propagate(scratch: Scratch, edges: DataFrame, hot_degree: int) -> DataFrame:
    """(node, component) by least-id propagation with contraction."""
    labels = scratch.put(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    while not edges.isEmpty():
        parents = scratch.put(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("p"), F.count(F.lit(1)).alias("degree")))
        hot = parents.where(F.col("degree") >= hot_degree).select(F.col("u").alias("hot"))
        if hot.isEmpty():
            hot = None
        roots = scratch.put(parents.select("u", "p"))
        while True:  # every vertex down to the root of its basin
            hot_roots = _hot(roots, "p", hot_degree)
            up = _copies(roots.select("u", "p"), hot_roots).select(F.col("u").alias("p"), F.col("p").alias("pp"), "salt")
            down = _salt("p", "u", hot_roots, roots.select("u", "p"))
            jumped = scratch.put(down.join(up, ["p", "salt"]).select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            scratch.drop(roots)
            roots = jumped
            if jumped.where("moved").isEmpty():
                break
        roots = roots.select("u", "p")
        half = _salt("u", "v", hot, edges).join(_copies(roots, hot), ["u", "salt"]).select(F.col("p").alias("pu"), "v")
        ends = _copies(roots, hot).select(F.col("u").alias("v"), "salt", F.col("p").alias("pv"))
        both = _salt("v", "pu", hot, half).join(ends, ["v", "salt"])
        shrunk = scratch.put(both.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        renamed = roots.select(F.col("u").alias("component"), F.col("p").alias("root"))
        moved = scratch.put(labels.join(renamed, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        for old in (edges, labels, parents):
            scratch.drop(old)
        edges, labels = shrunk, moved
    return labels


def cluster_report(label: DataFrame, decisions: DataFrame, days: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """Per cluster: size, match edges, their average score, distinct days, AI use and coherence.

    ``decisions`` has id_a, id_b, score, decision, tier; ``days`` has id, day.
    A cluster of two or more is flagged if it is too large, its match edges are
    too weak on average, or it spans too many days.
    """
    c = config["cluster"]
    sizes = label.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    inside = (
        decisions.join(label.select(F.col("id").alias("id_a"), F.col("cluster")), "id_a")
        .join(label.select(F.col("id").alias("id_b"), F.col("cluster").alias("other")), "id_b").where("cluster = other")
    )
    edges = inside.groupBy("cluster").agg(
        F.count_if(F.col("decision") == "match").alias("edges"), F.avg(F.when(F.col("decision") == "match", F.col("score"))).alias("confidence"),
        F.bool_or(F.coalesce(F.startswith("tier", F.lit("ai")), F.lit(False))).alias("ai_assisted"),
    )
    spans = days.join(label, "id").groupBy("cluster").agg(F.count_distinct("day").alias("days"))
    out = sizes.join(edges, "cluster", "left").join(spans, "cluster", "left").fillna(0, ["edges", "days"]).fillna(False, ["ai_assisted"])
    weak = F.coalesce(F.col("confidence") < c["min_internal_similarity"], F.lit(False))
    flagged = (F.col("size") > 1) & ((F.col("size") > c["max_cluster_size"]) | weak | (F.col("days") > c["max_distinct_dates"]))
    return out.select("cluster", "size", "edges", "confidence", "days", "ai_assisted", flagged.alias("flagged"))
