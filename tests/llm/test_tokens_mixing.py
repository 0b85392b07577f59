import random

import pytest

from lindwurm.llm import mixing, tokens

public = pytest.importorskip("public_tokenizers")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library():
    rnd = random.Random(5)
    texts = ["", " ", "Hello world", "<|endoftext|>", "a<|endoftext|>b", "Übergrößenträger " * 50, "aaaa" * 3000, "\n\n  x\t", "日本語のテキスト🙂👨‍👩‍👧", "it's 12,5 %"]
    texts += ["".join(rnd.choice("aabc ") for _ in range(rnd.randrange(80))) for _ in range(400)]
    texts += ["".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(40)) for _ in range(150)]
    own = tokens.Encoder(tokens.Vocabulary.read(tokens.vocabulary_path())).encode(texts)
    assert own == [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]


def test_greedy_proposals_are_checked():
    v = tokens.Vocabulary.read(tokens.vocabulary_path())
    words = [" Krögunhausen", " Ziegelei", "aaaaaaa", "xqzxqz"]
    assert any(v.greedy(w.encode()) != v.merged(w.encode()) for w in words)
    assert all(v.encode_words([w])[w] == tuple(v.merged(w.encode())) for w in words)


def test_encode_texts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (None, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as tokens")
    got = [(r["doc_id"], len(r["ids"])) for r in tokens.encode_texts(df).collect()]
    assert sorted(got, key=str)[:4] == sorted([(1, 0), (2, 0), (3, got[2][1]), (3, got[2][1])], key=str) and len(got) == 5
    assert [r["tokens"] for r in tokens.encode_texts(df, counts_only=True).collect()][:2] == [0, 0]
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_flow_spreads_repetitions_and_swaps_overlaps():
    got = mixing.route([10.0, 10.0], [[0, 1], [0]], [10.0, 10.0], [2, 1])
    assert got.lacking == [0.0, 0.0] and got.flow[0, 1] == 10.0 and got.flow[1, 0] == 10.0
    short = mixing.route([5.0], [[0]], [100.0], [3])
    assert short.lacking == [85.0]
    assert mixing.route([], [], [5.0], [1]).lacking == [5.0]


DOCS = "doc_id bigint, members array<string>, tokens bigint"
TARGETS = "source string, weight double, max_repeats int"


def test_mixture(spark):
    docs = spark.createDataFrame([(i, ["a"], 10) for i in range(100)] + [(1000 + i, ["b"], 10) for i in range(5)] + [(2000, None, 10), (2001, ["zz"], 40), (2002, ["a"], None)], DOCS).selectExpr("*", "'x' as source", "0 as turn")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, 2), ("c", 0.1, 9), (None, 0.1, 1)], TARGETS)
    uses, shares = mixing.mixture(docs, targets, seed=1)
    told = {r["source"]: r for r in shares.collect()}
    assert [told[s]["reached"] for s in "abc"] == [True, False, False]
    assert told["b"]["tokens_used"] == 100 and told["c"]["tokens_available"] == 0
    assert 530 <= told["a"]["tokens_used"] <= 550
    assert uses.where("repeats > 3").count() == 0 and abs(sum(r["share"] for r in told.values()) - 1) < 1e-9
    assert {tuple(r) for r in uses.collect()} == {tuple(r) for r in mixing.mixture(docs.repartition(7), targets, seed=1)[0].collect()}


def test_mixture_of_nothing(spark):
    uses, shares = mixing.mixture(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", None, None)], TARGETS))
    assert uses.count() == 0 and shares.first()["tokens_used"] == 0
    uses, shares = mixing.mixture(spark.createDataFrame([(1, ["a"], 3)], DOCS), spark.createDataFrame([], TARGETS))
    assert uses.count() == 0 and shares.count() == 0
