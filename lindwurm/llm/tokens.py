"""Encoding with a public byte-level BPE vocabulary.

Speculate and verify: each distinct word of a batch is cut greedily into the
longest vocabulary entries; a proposal is the exact encoding if and only if
every adjacent pair of tokens is compatible, i.e. no merge across their border
would have come before the merges that built them. That test runs vectorised
over all distinct pairs of the batch; only words that fail it are merged
exactly, rank by rank.

The vocabulary's files are read once on the driver and sent to the executors
(some 2 MB whatever the corpus); their path is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a worker remembers between batches; beyond it the memory starts anew.
MEMORY_WORDS = 400_000
#: Words longer than this (in bytes) go straight to exact merging in a heap.
LONG_WORD = 4096


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the splitting pattern of a byte-level BPE."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        size = max(tokens.values()) + 1
        self.base = size
        # by rank: the pair and what it becomes; order of merges = order of precedence
        self.rank_of = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.made_of = {(a, b): c for a, b, c in merges}
        left, right = np.arange(size), np.full(size, -1)
        rank = np.full(size, -1)
        for r, (a, b, c) in enumerate(merges):
            left[c], right[c], rank[c] = a, b, r
        self.left, self.right, self.rank = left, right, rank
        keys = np.array([a * size + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.longest = max(map(len, tokens))

    @classmethod
    def read(cls, path: str, pattern: str | None = None) -> "Vocabulary":
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        bytes_of = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {c for _, _, c in merges}
        # entries no merge leads to, such as special tokens, can't come from ordinary text
        tokens = {raw: vocab[t] for t, raw in bytes_of.items() if vocab[t] in made or len(raw) == 1}
        return cls(tokens, merges, pattern)

    def greedy(self, word: bytes) -> list[int]:
        """Longest vocabulary entries from left to right."""
        found, at, end = [], 0, len(word)
        tokens = self.tokens
        while at < end:
            stop = min(end, at + self.longest)
            while (token := tokens.get(word[at:stop])) is None:
                stop -= 1
            found.append(token)
            at = stop
        return found

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging leaves their border standing.

        The merges that built the two tokens are undone from the latest to the
        earliest. Whenever two parts meet at the border, a merge of that very
        pair must not rank before the merge that (later in time) covered
        either part.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        never = len(self.rank_of) + 1
        covered = np.full(len(a), never, np.int64)  # doubled ranks: odd steps tell left from right
        covered *= 2
        good = np.ones(len(a), bool)
        rows = np.arange(len(a))
        while len(rows):
            x, y = a[rows], b[rows]
            keys = x * self.base + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[at] == keys
            clash = known & (2 * self.pair_ranks[at] < covered[rows])
            good[rows[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            open_ = ~clash & ((rx >= 0) | (ry >= 0))
            rows, x, y, rx, ry = rows[open_], x[open_], y[open_], rx[open_], ry[open_]
            undo_left = rx > ry
            same = (rx == ry) & (rx >= 0)  # equal tokens: merging goes from left to right, so the right one is undone first
            undo_left &= ~same
            a[rows[undo_left]] = self.right[x[undo_left]]
            covered[rows[undo_left]] = 2 * rx[undo_left]
            take = ~undo_left
            b[rows[take]] = self.left[y[take]]
            covered[rows[take]] = 2 * ry[take] + 1
        return good

    def merged(self, word: bytes) -> list[int]:
        """Exact encoding of one word: the earliest merge first, leftmost first."""
        import heapq

        parts = [self.tokens[word[i : i + 1]] for i in range(len(word))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.rank_of
        heap = [(rank_of[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in rank_of]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i] = self.made_of[pair]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (parts[i], parts[after[i]])) in rank_of:
                    heapq.heappush(heap, (rank_of[p], i, p))
            if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in rank_of:
                heapq.heappush(heap, (rank_of[p], h, p))
        return [parts[i] for i in range(n) if alive[i]]

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words by speculation, verification and repair."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        done: dict[str, tuple[int, ...]] = {}
        proposals, owners = [], []
        for word, data in zip(words, raw):
            if (token := self.tokens.get(data)) is not None:
                done[word] = (token,)
            elif len(data) > LONG_WORD:
                done[word] = tuple(self.merged(data))
            else:
                proposals.append(self.greedy(data))
                owners.append((word, data))
        if proposals:
            sizes = np.array([len(p) for p in proposals])
            flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(proposals)), sizes)
            inner = owner[1:] == owner[:-1]
            pairs, where = np.unique(flat[:-1][inner] * self.base + flat[1:][inner], return_inverse=True)
            good = self.compatible(pairs // self.base, pairs % self.base)[where]
            failed = np.zeros(len(proposals), bool)
            failed[owner[1:][inner][~good]] = True
            for (word, data), proposal, bad in zip(owners, proposals, failed):
                done[word] = tuple(self.merged(data) if bad else proposal)
        return done


class Encoder:
    """A vocabulary with a bounded memory of words already encoded."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.split = vocabulary, regex.compile(vocabulary.pattern).findall
        self.memory: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split(t) if t else () for t in texts]
        memory = self.memory
        new = {w for own in words for w in own if w not in memory}
        if new:
            if len(memory) + len(new) > MEMORY_WORDS:
                memory.clear()
                new = {w for own in words for w in own}
            memory.update(self.vocabulary.encode_words(list(new)))
        get = memory.__getitem__
        return [[t for w in own for t in get(w)] for own in words]


def encode_texts(documents: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, counts_only: bool = False) -> DataFrame:
    """(key, ids) with the token ids of every text; with ``counts_only`` (key, tokens).

    Without special tokens: their strings are ordinary text. Null and empty
    texts give an empty list (0 tokens); white space is encoded as it stands.
    Rows with equal keys stay separate rows.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(Vocabulary.read(path or vocabulary_path(), pattern))

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = sent.value
        encoder = vocabulary.__dict__.get("encoder")
        if encoder is None:
            encoder = vocabulary.encoder = Encoder(vocabulary)
        for batch in batches:
            found = encoder.encode([t if isinstance(t, str) else None for t in batch])
            yield pd.Series([len(ids) for ids in found], dtype="int64") if counts_only else pd.Series(found, dtype=object)

    if counts_only:
        count = F.pandas_udf(encoded, "bigint")
        return documents.select(F.col(key), count(F.col(text)).alias("tokens"))
    ids = F.pandas_udf(encoded, "array<int>")
    return documents.select(F.col(key), ids(F.col(text)).alias("ids"))
