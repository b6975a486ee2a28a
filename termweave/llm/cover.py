"""A content-defined cover of text positions: equal byte strings have the sample at the same places.

A difference cover samples fixed residues, so that any two positions have a common distance to samples. Local minima of
hashes give the same guarantee for equal strings from 1.2 % of the positions instead of 8 %: of the `width` windows of
`gram` bytes inside a string of `length`, the least hash is at the same offset wherever the string starts.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
GRAM = 32
#: Positions a pass handles at once; the low bits of a key hold the place inside the pass.
_PLACE_BITS = 20
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position; data: at least GRAM bytes, C order."""
    n = len(data) - 7
    words = np.lib.stride_tricks.as_strided(data, (n, 8), (1, 1)).copy().view(np.uint64).ravel()
    step = 8
    while step < GRAM:
        left, right = words[: len(words) - step], words[step:]
        words = left * _MIX
        words ^= words >> np.uint64(31)
        words += right
        step *= 2
    words *= _MIX
    words ^= words >> np.uint64(32)
    words *= np.uint64(0xD6E8FEB86659FD93)
    return words


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For strings of `length` bytes: anchor places, first and last string starts that have this anchor, and gram hashes."""
    places, lows, highs, hashes = [], [], [], []
    span = (1 << _PLACE_BITS) - length
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(data) - length + 1, span):
        part = whole[start : start + span + length - 1]
        grams = gram_hashes(part)
        width = length - GRAM + 1
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_least(keys, width) & _PLACE).astype(np.int64)
        edges = np.flatnonzero(np.diff(at)) + 1
        low = np.concatenate([[0], edges])
        places.append(at[low] + start)
        lows.append(low + start)
        highs.append(np.concatenate([edges - 1, [len(at) - 1]]) + start)
        hashes.append(grams[at[low]])
    if not places:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    place, low, high, found = map(np.concatenate, (places, lows, highs, hashes))
    # An anchor that serves starts on both sides of a pass border is one.
    changed = place[1:] != place[:-1]
    first, last = np.concatenate([[True], changed]), np.concatenate([changed, [True]])
    return place[first], low[first], high[last], found[first]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima inside blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
