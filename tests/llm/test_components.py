import random

from lindwurm.llm import components

TYPES = "id bigint, source_event_id_a string, source_event_id_b string, decision string, decided_at timestamp_ntz"


def brute(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def labels(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1] for r in rows}


def test_random_chain_star_equal_brute_force(spark):
    rnd = random.Random(3)
    links = [(f"r{rnd.randrange(300)}", f"r{rnd.randrange(300)}") for _ in range(180)]
    links += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("s500", f"s{i}") for i in range(100)] + [("r1", "r1"), ("c001", "c000")]
    df = spark.createDataFrame(links, "a string, b string")
    want = brute([(a, b) for a, b in links if a != b])
    assert labels(components.connected_components(df)) == want
    # a frontier that is handed over after one level, and salted hot vertices
    assert labels(components.connected_components(df, max_levels=1, hot_degree=20)) == want


def test_long_chain_is_handed_over(spark):
    links = [(f"v{i:04d}", f"v{i + 1:04d}") for i in range(90)] + [("a", "v0050"), ("v0050", "b")]
    assert set(labels(components.connected_components(spark.createDataFrame(links, "a string, b string"), max_levels=2)).values()) == {"a"}


def test_latest_decision_counts(spark):
    rows = [
        (1, "a", "b", "match", "2012-01-01 00:00:00"), (2, "b", "a", "no match", "2012-01-02 00:00:00"),
        (3, "c", "d", "no_match", "2012-01-01 00:00:00"), (4, "d", "c", " MATCH", "2012-01-02 00:00:00"), (5, "c", "d", None, "2012-01-03 00:00:00"),
        (6, "e", "e", "match", "2012-01-01 00:00:00"), (7, None, "f", "match", "2012-01-01 00:00:00"),
        (8, "g", "h", "match", None), (9, "g", "h", "match", None), (10, "i", "j", "no-match", "2012-01-01 00:00:00"), (11, "j", "i", "match", "2012-01-01 00:00:00"),
    ]
    df = spark.createDataFrame(rows, TYPES.replace("timestamp_ntz", "string")).selectExpr("*", "'clash' as component", "1 as u")
    assert labels(components.groups_of_decisions(df)) == {"c": "c", "d": "c", "g": "g", "h": "g", "i": "i", "j": "i"}


def test_empty(spark):
    assert components.groups_of_decisions(spark.createDataFrame([], TYPES)).count() == 0
