"""Token ratios as Arrow UDFs: Indel similarity by bit-parallel longest common subsequence."""

from __future__ import annotations

from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if a == b:
        return len(a)
    where: dict[str, int] = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & where.get(letter, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


#: Texts whose rows of bits are advanced together, as one number.
TOGETHER = 64


@lru_cache(4096)
def _letters(text: str) -> tuple[int, dict[str, int]]:
    """Bytes that a text's row of bits and eight for what is carried take, and the places of each letter."""
    where: dict[str, int] = {}
    for i, letter in enumerate(text):
        where[letter] = where.get(letter, 0) | 1 << i
    return (len(text) + 15) // 8, where


def common_subsequences(one: str, others: list[str]) -> list[int]:
    """``common_subsequence`` of a text with each of some others.

    Their rows of bits lie side by side in one number; what additions carry over
    the end of a row, one bit more each time, is struck out after every eighth,
    before it reaches the next.
    """
    found: list[int] = []
    rest = iter(others)
    while group := list(islice(rest, TOGETHER)):
        ends, places = [0], {}
        for text in group:
            width, where = _letters(text)
            for letter, bits in where.items():
                places.setdefault(letter, []).append((ends[-1], width, bits))
            ends.append(ends[-1] + width)
        masks = {}
        for letter in set(one) & places.keys():
            mask = bytearray(ends[-1])
            for at, width, bits in places[letter]:
                mask[at : at + width] = bits.to_bytes(width, "little")
            masks[letter] = int.from_bytes(mask, "little")
        full = row = int.from_bytes(b"".join(((1 << len(t)) - 1).to_bytes(n - m, "little") for t, m, n in zip(group, ends, ends[1:])), "little")
        steps = [masks[letter] for letter in one if letter in masks]
        for k in range(0, len(steps), 8):
            for mask in steps[k : k + 8]:
                hit = row & mask
                row = row + hit | row ^ hit
            row &= full
        left = row.to_bytes(ends[-1], "little")
        found += [len(t) - int.from_bytes(left[m:n], "little").bit_count() for t, m, n in zip(group, ends, ends[1:])]
    return found


def common_of_pairs(first: list[str], second: list[str]) -> list[int]:
    """``common_subsequence`` of each pair; texts that come again are compared with all their partners at once."""
    partners: dict[str, dict[str, int]] = {}
    for a, b in zip(first, second):
        partners.setdefault(a, {})[b] = 0
    for a, own in partners.items():
        own.update(zip(own, common_subsequences(a, list(own))))
    return [partners[a][b] for a, b in zip(first, second)]


@lru_cache(65_536)
def _in_order(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sorts(first: list[str], second: list[str]) -> list[float]:
    """``token_sort`` of each pair."""
    left, right = [_in_order(a) for a in first], [_in_order(b) for b in second]
    return [200.0 * n / (len(a) + len(b)) if a or b else 100.0 for a, b, n in zip(left, right, common_of_pairs(left, right))]


def token_sets(first: list[str], second: list[str]) -> list[float]:
    """``token_set`` of each pair."""
    parts, left, right = [], [], []
    for a, b in zip(first, second):
        p, q = _distinct(a), _distinct(b)
        shared = p & q
        x, y = (" ".join(sorted(p - q)), " ".join(sorted(q - p))) if shared else (_distinct_in_order(a), _distinct_in_order(b))
        parts.append((len(" ".join(shared)), bool(p and q)))
        left.append(x), right.append(y)
    return [_set_ratio(size, len(x), len(y), n) if there else 0.0 for (size, there), x, y, n in zip(parts, left, right, common_of_pairs(left, right))]


@lru_cache(65_536)
def _distinct(text: str) -> frozenset[str]:
    return frozenset(text.split())


@lru_cache(65_536)
def _distinct_in_order(text: str) -> str:
    return " ".join(sorted(_distinct(text)))


def ratio(a: str, b: str) -> float:
    """100 times the share of letters in common order; 100 for two empty texts."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best ratio of the shared words against each side, or of the two sides."""
    first, second = set(a.split()), set(b.split())
    if not first or not second:
        return 0.0
    shared = " ".join(sorted(first & second))
    left, right = " ".join(sorted(first - second)), " ".join(sorted(second - first))
    return _set_ratio(len(shared), len(left), len(right), common_subsequence(left, right))


def _set_ratio(shared: int, left: int, right: int, common: int) -> float:
    """``token_set`` by the lengths of the shared words, of the others of each side and of what these have in common."""
    if shared and (not left or not right):
        return 100.0
    gap = 1 if shared else 0
    size_l, size_r = shared + gap + left, shared + gap + right
    apart = left + right - 2 * common
    best = 100.0 * (1 - apart / (size_l + size_r)) if size_l + size_r else 100.0
    if not shared:
        return best
    return max(best, 100.0 * (1 - (gap + left) / (shared + size_l)), 100.0 * (1 - (gap + right) / (shared + size_r)))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token-sort similarity from 0 to 100; null against anything is null."""
    there = (a.notna() & b.notna()).to_numpy(bool)
    out = pd.Series(float("nan"), index=a.index, dtype="float64")
    out[there] = token_sorts(a[there].tolist(), b[there].tolist())
    return out


@F.pandas_udf(StructType([StructField("sort", DoubleType()), StructField("set", DoubleType())]))
def token_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Both token ratios at once, so that texts cross to Python only once."""
    first, second = a.fillna("").tolist(), b.fillna("").tolist()
    return pd.DataFrame({"sort": token_sorts(first, second), "set": token_sets(first, second)})
