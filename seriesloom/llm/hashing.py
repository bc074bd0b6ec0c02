"""Hashes of words in numpy, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_P, _A, _B = np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_table(separators: list[int]) -> np.ndarray:
    """For each byte: 0 if it separates words, else one more than the byte made small."""
    out = np.arange(1, 257, dtype=np.uint16)
    out[65:91] += 32
    out[separators] = 0
    return out


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by a line end, and where each begins; a last number tells the end."""
    own = [(t or "").encode() for t in texts]
    start = np.cumsum([0] + [len(x) + 1 for x in own])
    return np.frombuffer(b"\n".join([*own, b""]), dtype=np.uint8), start


def word_hashes(data: np.ndarray, start: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the words in joined texts: 64-bit hashes, the text each is in, first byte and length. The table makes line ends separators."""
    small = table[data]
    inside = small != 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(first):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    length = end - first
    powers = np.ones(int(length.max()) + 1, dtype=np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _P))
    at = np.flatnonzero(inside).astype(np.int32)  # of a slice of a few MB
    within = at - np.repeat(first.astype(np.int32), length)
    value = powers[within]
    del within
    value *= small[at]
    total = np.add.reduceat(value, np.cumsum(length) - length)
    return mix(total + length.astype(np.uint64)), np.searchsorted(start, first, side="right") - 1, first, length
