"""What linkage spares: rounds over pairs, rows that move, texts read twice. The results stay those of brute force."""

import random

from lindwurm.llm import addresses, linkage, listings
from lindwurm.runtime import Scratch


def test_occasions_that_one_listing_ties_need_no_rounds(spark, monkeypatch):
    seen = []
    whole = linkage.connected_components
    monkeypatch.setattr(linkage, "connected_components", lambda links, **o: (seen.append(links.count()), whole(links, **o))[1])
    cliques = [(10 * g + i, 10 * g + k) for g in range(6) for i in range(4) for k in range(i + 1, 4)]
    df = spark.createDataFrame([*cliques, (100, 101), (101, 102), (102, 103)], "x bigint, y bigint")
    assert {tuple(r) for r in linkage.occasions(df).collect()} == {(10 * g + i, 10 * g) for g in range(6) for i in range(4)} | {(n, 100) for n in range(100, 104)}
    assert seen == [2]  # of 39 pairs, what is left of the chain's


def test_occasions_of_any_graph(spark):
    rnd = random.Random(8)
    pairs = [tuple(sorted(rnd.sample(range(120), 2))) for _ in range(75)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {tuple(r) for r in linkage.occasions(spark.createDataFrame(pairs, "x bigint, y bigint")).collect()} == set(root.items())


def test_small_blocks_are_paired_with_the_result_of_keys(spark):
    rnd = random.Random(4)
    rows = []
    for block in range(12):
        stems = ["".join(rnd.choice("abdeiklmnorst") for _ in range(rnd.randrange(5, 11))) for _ in range(3)]
        words = {s for s in stems} | {s[:k] + s[k + 1 :] for s in stems for k in (1, 3)} | {stems[0][:5] + "."}
        rows += [(f"m{block}", f"{kind} {w}", w, rnd.randrange(1, 50)) for w in sorted(words) for kind in ("kino", "gh")]
    forms = spark.createDataFrame(rows, "block string, form string, key string, n long")
    found = [sorted(map(tuple, addresses.representatives(forms, Scratch(spark, "few"), paired_texts=most).collect())) for most in (0, 16)]
    assert found[0] == found[1] and len({r[2] for r in found[0]}) < len(found[0])


def test_texts_are_read_once_with_their_counts(spark):
    df = spark.createDataFrame([(1, "Markt im Garten", None, "<b>Garten</b> voller Blumen"), (2, None, "", "Blumen"), (3, None, None, None)], "id int, title string, short string, long string")
    got = listings.worded(df, ["title", "short", "long"]).collect()
    assert {(r["id"], r["title"], r["rest"]) for r in got if r["id"]} == {(1, "markt garten", "voller blumen"), (2, "", "blumen"), (3, "", "")}
    uses = {}
    for r in got:
        if r["word"]:
            uses[r["word"]] = uses.get(r["word"], 0) + r["uses"]
    assert uses == {"markt": 1, "garten": 1, "voller": 1, "blumen": 2}
