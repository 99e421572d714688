"""64-bit hashes of all words of a run of texts, in numpy; no word becomes an object."""

from __future__ import annotations

import functools

import numpy as np

from .common import splitmix64

BASE = 0xD1342543DE82EF95
#: Bytes at once; a chunk takes up to fifty times its size of memory.
CHUNK = 1 << 18


@functools.lru_cache(1)
def _values() -> np.ndarray:
    return splitmix64(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE)) | np.uint64(1)


@functools.lru_cache(4)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, BASE, np.uint64))), dtype=np.uint64)


def hashed_words(data: np.ndarray, outside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the words of texts that begin at the ascending ``starts`` in the bytes ``data`` and follow each other.

    ``outside`` says of each of the 256 byte values whether it separates words. Bytes are taken in chunks that end where
    a word begins, so memory is bounded but for a word longer than a chunk.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    places, hashes, low = [], [], 0
    while low < len(data):
        high = min(len(data), low + CHUNK)
        while True:
            inside = ~outside[data[low:high]]
            first = np.flatnonzero(inside & (edge[low:high] | ~np.concatenate(([False], inside[:-1]))))
            if high == len(data) or len(first) > 1 or not len(first):
                break
            high = min(len(data), high + CHUNK)
        if high < len(data) and len(first):  # the last word may go on
            high = low + int(first[-1])
            first, inside = first[:-1], inside[: high - low]
        if len(first):
            at = np.flatnonzero(inside)
            bounds = np.searchsorted(at, first)
            within = at - np.repeat(first, np.diff(np.append(bounds, len(at))))
            longest = 1 << int(within.max()).bit_length()
            with np.errstate(over="ignore"):
                hashes.append(splitmix64(np.add.reduceat(_values()[data[low:high][at]] * _powers(longest)[within], bounds)))
            places.append(first + low)
        low = high
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)
