"""Suffixes of an array of symbols in order, by a difference cover modulo three."""

from __future__ import annotations

import numpy as np


def _bits(x: int) -> int:
    return max(1, int(x).bit_length())


def _names(parts: list[np.ndarray], bits: list[int]) -> tuple[np.ndarray, int]:
    """Numbers from 0, in order, of tuples given by their parts and how many bits each takes; and how many there are."""
    key, width = parts[0].astype(np.int64), bits[0]
    for part, more in zip(parts[1:], bits[1:]):
        if width + more > 63:
            key, n = _names([key], [width])
            width = _bits(n)
        key, width = (key << more) | part, width + more
    if width <= 24 and len(key) > 1 << 18:
        there = np.zeros(1 << width, dtype=bool)
        there[key] = True
        number = np.cumsum(there, dtype=np.int64) - 1
        return number[key], int(number[-1]) + 1
    distinct, number = np.unique(key, return_inverse=True)
    return number.astype(np.int64), len(distinct)


def _by_rank(key: np.ndarray) -> np.ndarray:
    return np.argsort(key, kind="stable")


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``s`` (whole numbers from 1) in the order of the suffixes that start there.

    Suffixes whose first ``depth`` symbols are equal stand next to each other, in any order.

    The positions 1 and 2 modulo 3 are the sample.  Their triples of symbols are sorted
    and named; while names repeat and triples are shorter than ``depth``, the order of the sample comes
    from the same function over the string of names.  The remaining suffixes are a symbol followed by a
    sampled suffix; they are sorted as such and merged in, compared with a
    sampled suffix after the one or two symbols that bring both into the sample.
    """
    n = len(s)
    if n < 4:
        tail = s.tolist()
        return np.array(sorted(range(n), key=lambda i: tail[i:]), dtype=np.int64)
    symbol = _bits(s.max())
    t = np.concatenate([s.astype(np.int64), np.zeros(4, dtype=np.int64)])
    # With one more triple of zeros where the first half would else end in a full one.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, count = _names([t[sample], t[sample + 1], t[sample + 2]], [symbol] * 3)
    if count < len(sample) and depth > 3:
        order = suffix_order(names + 1, -(-depth // 3))
        place = np.empty(len(sample), dtype=np.int64)
        place[order] = np.arange(len(sample))
    else:
        order, place = _by_rank(names), names
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = place + 1
    rank[n] = 0
    width = _bits(len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]

    rest = np.arange(0, n, 3)
    # The remaining ones against those 1 modulo 3: a symbol, then a sampled suffix.
    after_one, after_two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    key, _ = _names([np.concatenate([t[rest], t[after_one]]), np.concatenate([rank[rest + 1], rank[after_one + 1]])], [symbol, width])
    rest = rest[_by_rank(key[: len(rest)])]
    first = np.searchsorted(np.maximum.accumulate(key[-len(after_one) :]), np.sort(key[: len(rest)]))
    # Against those 2 modulo 3: two symbols, then a sampled suffix.
    second = np.zeros(len(rest), dtype=np.int64)
    if len(after_two):
        both = np.concatenate([rest, after_two])
        key, _ = _names([t[both], t[both + 1], rank[both + 2]], [symbol, symbol, width])
        second = np.searchsorted(np.maximum.accumulate(key[len(rest) :]), key[: len(rest)])
    # Only suffixes that are equal to the depth can disagree in the two comparisons.
    at = np.arange(len(rest)) + np.maximum.accumulate(first + second)
    out = np.empty(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[at] = rest
    out[free] = sampled
    return out


def equal_neighbours(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each position of ``order`` but the first starts the same ``length`` bytes (8 or more) as the one before it."""
    words = np.ndarray((max(0, len(text) - 7),), "<u8", np.ascontiguousarray(text).tobytes(), strides=(1,))
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for offset in [*range(0, length - 8, 8), length - 8]:
        word = words[order + offset]
        same &= word[1:] == word[:-1]
    return same
