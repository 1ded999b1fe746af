"""Words of many texts at once as 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

from screenforge.llm.common import mixed

BASE = 0x9E3779B97F4A7C15
# A-Z in lower case, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


@functools.lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base, and of its inverse, modulo 2**64."""
    steps = np.full(size, BASE, np.uint64)
    back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    steps[0] = back[0] = 1
    return np.cumprod(steps), np.cumprod(back)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any run of bytes follows in one step, and the factors for it."""
    up, down = powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that aren't ``between``, and how many each text has."""
    word = ~between[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = word[edge]
    last[edge[1:] - 1] = word[edge[1:] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.diff(np.searchsorted(begin, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, with A-Z in lower case, and how many each text has."""
    low = np.frombuffer(LOWER, np.uint8)[data]
    begin, end, number = word_spans(low, offsets)
    sums, down = prefix_sums(low)
    return mixed((sums[end] - sums[begin]) * down[begin]), number
