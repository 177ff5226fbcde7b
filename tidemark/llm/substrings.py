"""Kernels for repeated byte strings: rolling identifiers of strings and content-chosen positions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

GRAM = 48  # bytes of an initial bucket's name
BASE = 0x9E3779B97F4A7C15 | 5
PLACE_BITS = 24
BATCH = 1 << 20


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A fixed pseudo-random odd number per byte value."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


@lru_cache(4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n at least."""
    size = 1 << max(20, (n + 1).bit_length())
    return _powers(size, BASE), _powers(size, pow(BASE, -1, 1 << 64))


class Rolling:
    """Identifier (64 bits) of any substring of `data` from two prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * self.up[:len(data)], out=self.sums[1:])

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        """Identifiers of all substrings of that size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:-(width - size)], values[width - size:]) if width > size else values


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of every `width` neighbours, compared without their low PLACE_BITS bits, which hold
    places. Those count from the start of a window, and windows overlap by width - 1, so any length is exact."""
    size = 1 << PLACE_BITS
    if width > size:
        raise ValueError(f"{width} neighbours are more than the {size} places of a window")
    place = np.uint64(size - 1)
    out = np.empty(len(values) - width + 1, np.int64)
    for i in range(0, len(out), size - width + 1):
        part = values[i:i + size]
        least = sliding_least((part & ~place) | np.arange(len(part), dtype=np.uint64), width)
        out[i:i + len(least)] = (least & place).astype(np.int64) + i
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts [start, end) in `data`: (text, anchor, low, high, gram, range) of every content-chosen position.

    Each string of `length` bytes inside a text chooses the leftmost of its least grams. An anchor answers for the strings that
    start `low` to `high` bytes before it; `range` names all bytes that those strings cover. The choice depends on the
    string alone, so equal strings choose anchors at equal distance, with equal grams, wherever they stand.
    """
    if not (ends - starts >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(data)
    grams = rolling.grams(GRAM)
    chosen_at = least_places(grams, length - GRAM + 1)
    ok = ends - starts >= length
    which = np.flatnonzero(ok)
    counts = ends[ok] - starts[ok] - length + 1
    text = np.repeat(which, counts)
    first = np.repeat(starts[ok] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts) + np.arange(counts.sum())
    chosen = chosen_at[first]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(chosen)) - 1
    a, one, two, owner = chosen[new], first[new], first[last], text[new]
    low, high = a - two, a - one
    span = rolling.name(one, two + length) ^ mix((low * 1024 + high).astype(np.uint64) * np.uint64(BASE))
    return owner, a - starts[owner], low, high, grams[a], span


def merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals per text; intervals sorted by (text, start)."""
    if not len(start):
        return text, start, end
    far = np.maximum.accumulate(end + text * (1 << 40)) - text * (1 << 40)  # ends never reach into the next text
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > far[:-1])]))
    return text[new], start[new], far[np.append(new[1:], len(start)) - 1]
