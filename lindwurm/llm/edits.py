"""Edit distances for the workers: exact, bounded, over whole arrays of pairs."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np


def as_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words in rows padded with 0, and the lengths."""
    lengths = np.fromiter((len(w) for w in words), np.int32, len(words))
    width = max(1, int(lengths.max()) if len(words) else 1)
    joined = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    return joined, lengths


def osa(first: list[str], second: list[str]) -> np.ndarray:
    """Optimal string alignment distance of each pair: edits and swaps of neighbours."""
    if not first:
        return np.empty(0, np.int32)
    a, la = as_codes(first)
    b, lb = as_codes(second)
    n, wa, wb = len(first), a.shape[1], b.shape[1]
    result = np.zeros(n, np.int32)
    before = None
    row = np.broadcast_to(np.arange(wb + 1, dtype=np.int16), (n, wb + 1)).copy()
    result[la == 0] = lb[la == 0]
    rows = np.arange(n)
    for i in range(1, wa + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        differs = (b != a[:, i - 1 : i]).astype(np.int16)
        base = np.minimum(row[:, 1:] + 1, row[:, :-1] + differs)
        if i > 1:
            swap = (b[:, :-1] == a[:, i - 1 : i]) & (b[:, 1:] == a[:, i - 2 : i - 1])
            base[:, 1:] = np.where(swap, np.minimum(base[:, 1:], before[:, : wb - 1] + 1), base[:, 1:])
        # insertions run along the row: a running minimum of base - position
        steps = np.arange(1, wb + 1, dtype=np.int16)
        low = np.minimum.accumulate(np.concatenate([new[:, :1], base - steps], axis=1), axis=1)
        new[:, 1:] = low[:, 1:] + steps
        ends = la == i
        if ends.any():
            result[ends] = new[rows[ends], lb[ends]]
        before, row = row, new
    return result


def letter_counts(words: list[str]) -> np.ndarray:
    """Occurrences of each letter class, for a lower bound of the distance."""
    codes, _ = as_codes(words)
    out = np.zeros((len(words), 32), np.int8)
    rows = np.repeat(np.arange(len(words)), codes.shape[1])
    flat = codes.ravel()
    used = flat > 0
    np.add.at(out, (rows[used], flat[used] % 32), 1)
    return out


def borders(length: int, parts: int) -> list[tuple[int, int]]:
    """Starts and sizes of the segments of a string; the later ones are the longer."""
    small, more = divmod(length, parts)
    starts, at = [], 0
    for i in range(parts):
        size = small + (i >= parts - more)
        starts.append((at, size))
        at += size
    return starts


def piece_key(text: str, *where: int) -> int:
    """A number for a piece of text at a place (a few small numbers)."""
    raw = text.encode("utf-8", "surrogatepass")
    key = (zlib.crc32(raw) << 31) ^ (zlib.adler32(raw) << 11)
    for at in where:
        key = (key * 1_000_003 ^ at) & 0x7FFFFFFFFFFFFFFF
    return key


def kept_keys(word: str, reach: Callable[[int], int], most: int) -> list[int]:
    """Keys under which a word is found by ``sought_keys`` of every token within reach of it.

    ``reach`` gives the edits allowed to a token of a length, at most ``most``.
    For k edits a word is cut into k + 1 segments, one of which is whole in the
    token; for none it is kept as it is.
    """
    length, found = len(word), set()
    for k in {reach(n) for n in range(max(0, length - most), length + most + 1)}:
        found |= {piece_key(word[at : at + size], k, length, i) for i, (at, size) in enumerate(borders(length, k + 1))}
    return list(found)


def sought_keys(token: str, reach: Callable[[int], int]) -> list[int]:
    """Keys of the substrings of a token that may be a segment of a word within reach of it."""
    own, found = len(token), set()
    k = reach(own)
    for length in range(max(0, own - k), own + k + 1):
        delta = own - length
        for i, (at, size) in enumerate(borders(length, k + 1)):
            for start in range(max(0, at - i, at + delta - (k - i)), min(own - size, at + i, at + delta + (k - i)) + 1):
                found.add(piece_key(token[start : start + size], k, length, i))
                if start and size:  # neighbours swapped across the border before it
                    found.add(piece_key(token[start - 1] + token[start + 1 : start + size], k, length, i))
    return list(found)
