"""Word shingles of whole texts as sorted sets of 64-bit hashes, batch by batch with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space between words: the blank and the characters 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random odd number for each byte, and the base of the words' polynomial.
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in turn, and how many words each text has."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= word[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    until = np.append(starts[1:], len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, until - starts)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
        tail = data[starts[0]:]
        values = np.where(word[starts[0]:], _BYTE[_LOWER[tail]] * powers[place], np.uint64(0))
        hashes = mixed(np.add.reduceat(values, starts - starts[0]))
    ends = np.searchsorted(starts, offsets)
    return hashes, np.diff(ends)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its distinct ``words``-word shingles.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for k in range(1, words):
            if len(rolled) < 2:
                break
            rolled = mixed(rolled[:-1] + np.uint64(k)) + hashes[k:]
        rolled = mixed(rolled)
        for end, count in zip(ends.tolist(), counts.tolist()):
            start = end - count
            if count >= words:
                yield np.unique(rolled[start: end - words + 1])
            elif count:
                whole = hashes[start]
                for k in range(1, count):
                    whole = mixed(np.array([whole + np.uint64(k)]))[0] + hashes[start + k]
                yield mixed(np.array([whole + np.uint64(count)]))
            else:
                yield np.empty(0, dtype=np.uint64)
