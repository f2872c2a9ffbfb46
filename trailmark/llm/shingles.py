"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import re

import numpy as np

#: Classes that a task remembers at once.
HELD = 200_000
#: Bytes that are hashed at once, and places in a word that have numbers of their own.
BLOCK = 1_000_000
PLACES = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = ~np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A number for each byte at each place of a word.
_NUMBERS = mixed(mixed(np.arange(1, 256 * PLACES + 1, dtype=np.uint64)))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of ``raw``, which is looked at in blocks of about ``BLOCK`` bytes that end between words.

    A word's hash sums the numbers of its bytes at their places; after every ``PLACES`` places they come with another factor.
    """
    data, begin = np.frombuffer(raw, np.uint8), 0
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while begin < len(data):
        found = _SPACE.search(raw, begin + BLOCK)
        end = found.start() if found else len(data)
        part = data[begin:end]
        at = np.flatnonzero(_IN_WORD[part])
        if len(at):
            first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            sizes = np.diff(np.r_[first, len(at)])
            place = np.arange(len(at)) - np.repeat(first, sizes)
            numbers = _NUMBERS[(place % PLACES) * 256 + part[at]]
            if sizes.max() > PLACES:
                far = np.flatnonzero(place >= PLACES)
                numbers[far] *= mixed((place[far] // PLACES).astype(np.uint64)) | np.uint64(1)
            starts.append(begin + at[first])
            hashes.append(mixed(np.add.reduceat(numbers, first) + sizes.astype(np.uint64)))
        begin = end
    return np.concatenate(starts), np.concatenate(hashes)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` words (at most five); of all words at once if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(width, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total) + hashes[i : n - k + 1 + i] * _FACTORS[i]
    return mixed(total)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
