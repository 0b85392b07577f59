"""Forms of places meet wherever an alignment may join them, and hardly where it can't."""

import itertools
import random
import re

from lindwurm.llm import addresses
from lindwurm.runtime import Scratch


def test_pairs_that_banding_missed_are_one_place(spark):
    pairs = [("mrefaodgb", "mrxfaoygb"), ("tfofgettu", "tfxfgeytu")]
    assert not (addresses.signatures([a for a, _ in pairs], 12, 2) == addresses.signatures([b for _, b in pairs], 12, 2)).any()
    rows = [("m", f"kino {w}", w, n) for a, b in [*pairs, ("querholmen", "quer.")] for w, n in ((a, 5), (b, 1))]
    forms = spark.createDataFrame([*rows, ("m", "kino varstann", "varstann", 9)], "block string, form string, key string, n long")
    found = {r["form"]: r["rep"] for r in addresses.representatives(forms, Scratch(spark, "meeting")).collect()}
    assert [len({found[f"kino {w}"] for w in p}) for p in [*pairs, ("querholmen", "quer.")]] == [1, 1, 1] and len(set(found.values())) == 4


def test_keys_miss_nothing_within_the_limit():
    rnd = random.Random(5)
    word = lambda: rnd.choice([*addresses.SHORT, "".join(rnd.choice("abcst") for _ in range(rnd.randrange(1, 13)))]) + rnd.choice(["", "", "str", "pl"])

    def slip(w):
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(w) + 1)
            w = w[:k] + rnd.choice(["", "x", w[k + 1 : k + 2] + w[k : k + 1]]) + w[k + rnd.randrange(3) :]
        w = w or "a"
        return w[: rnd.randrange(1, len(w) + 1)] + "." if rnd.random() < 0.4 else w

    pairs = []
    for _ in range(4000):
        a = [word() for _ in range(rnd.randrange(1, 4))]
        b = [slip(w) for w in a[rnd.randrange(2) :] or a] + [word()] * rnd.randrange(2)
        pairs.append((" ".join(a), " ".join(b)))
    cost = addresses.aligned([tuple(a.split()) for a, _ in pairs], [tuple(b.split()) for _, b in pairs])
    good = [p for p, c in zip(pairs, cost) if c <= addresses.LIMIT]
    cut = [any(re.search(addresses.CUT_SHORT.pattern, t) for t in p) for p in good]
    told = [[{(k >> 2, k & 3) for k in map(int, x)} for x in addresses.meeting_keys([p[i] for p in good], cut)] for i in (0, 1)]
    meets = lambda p, q: any(r == 0 and (k, 0) in q or r == 1 and (k, 2) in q for k, r in p)
    assert len(good) > 800 and all(meets(p, q) or meets(q, p) for p, q in zip(*told))


def test_names_of_a_dense_block_hardly_meet_by_chance():
    rnd = random.Random(7)
    parts = ["".join(rnd.choice("abdefghiklmnorstu") for _ in range(4)) for _ in range(40)]
    names = list({"".join(rnd.choice(parts) for _ in range(3)) for _ in range(600)})
    pairs = list(itertools.combinations(range(len(names)), 2))
    keys, bands = [set(map(int, x)) for x in addresses.meeting_keys(names, [False] * len(names))], addresses.signatures(names, 12, 2).tolist()
    assert 10 * sum(bool(keys[i] & keys[k]) for i, k in pairs) < sum(bool({*bands[i]} & {*bands[k]}) for i, k in pairs)
