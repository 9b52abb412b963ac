"""Words of a text as numpy arrays: hashes and places, without a Python object for each word."""

from __future__ import annotations

import numpy as np

_SEPARATES = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def alnum_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of each word (A-Z in lower case), and the text's bytes.

    A word is a run of ASCII letters and digits and of characters beyond ASCII.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    apart = _SEPARATES[raw]
    edge = np.diff(np.r_[True, apart, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, raw
    length = end - start
    inside = np.arange(len(raw)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(raw)]))
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        value = np.where(apart, np.uint64(0), (low + np.uint64(1)) * powers[np.minimum(inside, len(powers) - 1)])
        return mix(np.add.reduceat(value, start, dtype=np.uint64) + length.astype(np.uint64)), start, end, raw


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        found = np.full(n, width, np.uint64)
        for i in range(width):
            found = found * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n + i]
        return mix(found)


def char_places(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code point offsets of byte offsets."""
    before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return before[places]
