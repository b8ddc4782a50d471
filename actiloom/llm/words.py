"""Words of whole texts as 64-bit hashes, for a batch of texts at a time.

A word is a longest run of word bytes. All separators used here are ASCII, so
cutting the UTF-8 bytes is the same as cutting the characters. The hash of a
word is the difference of two prefix sums of a rolling polynomial modulo 2**64,
which numpy computes for all words of a segment at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from actiloom.llm.frames import utf8

SEGMENT = 1 << 19
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: All but space and the control characters from tab to carriage return.
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters and everything beyond ASCII.
LETTERED = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_UP = _powers(BASE, SEGMENT)
_DOWN = _powers(pow(BASE, -1, 1 << 64), SEGMENT)


@dataclass
class Words:
    """``starts``, ``ends``: byte positions; ``first``: n + 1 places of each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def _segment(data: np.ndarray, low: int, high: int, cuts: np.ndarray, is_word: np.ndarray):
    """The words that lie in [low, high); ``cuts`` are places in it where a text starts."""
    inside = is_word[data[low:high]]
    before = np.concatenate([[False], inside[:-1]])
    before[cuts - low] = False
    after = np.concatenate([inside[1:], [False]])
    after[cuts[cuts > low] - low - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    values = _VALUES[data[low:high]]
    if high - low <= SEGMENT:
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values * _UP[: high - low], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _DOWN[starts]
    else:  # one word longer than a segment
        hashes = np.array([_long(values[s:e]) for s, e in zip(starts, ends, strict=True)], np.uint64)
    return starts + low, ends + low, mixed(hashes)


def _long(values: np.ndarray) -> int:
    """The same polynomial for a word of any length."""
    total, scale = 0, 1
    for at in range(0, len(values), SEGMENT):
        part = values[at : at + SEGMENT]
        total += int(np.sum(part * _UP[: len(part)], dtype=np.uint64)) * scale
        scale = scale * int(_UP[SEGMENT]) % (1 << 64)
    return total % (1 << 64)


def words_of(column: pa.Array, is_word: np.ndarray) -> Words:
    """All words of a column of texts, letters A-Z lower-cased; null has none."""
    data, offsets = utf8(column)
    low, end = int(offsets[0]), int(offsets[-1])
    parts = []
    while low < end:
        high = min(low + SEGMENT, end)
        if high < end and is_word[data[high]] and is_word[data[high - 1]]:
            gap = np.flatnonzero(~is_word[data[low:high]])
            cut = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            back = max(low + int(gap[-1]) + 1 if len(gap) else low, cut)
            if back > low:
                high = back
            else:  # the word goes on beyond the segment
                while high < end and is_word[data[high]] and offsets[np.searchsorted(offsets, high)] != high:
                    high += 1
        a, b = np.searchsorted(offsets, [low, high])
        parts.append(_segment(data, low, high, np.unique(offsets[a:b]), is_word))
        low = high
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts, ends, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, wherever texts begin or end."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _UP[2 * k + 1]
    return mixed(total ^ np.uint64(width * BASE % (1 << 64)))
