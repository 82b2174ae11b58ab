"""Hashes of words and word runs of whole batches of texts, computed in numpy."""

from __future__ import annotations

import sys

import numpy as np

_tables: list[np.ndarray] = []


def _alnum() -> np.ndarray:
    if not _tables:
        table = np.zeros(sys.maxunicode + 1, bool)
        table[[c for c in range(0x40000) if chr(c).isalnum()]] = True
        _tables.append(table)
    return _tables[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, in order, and the bounds of each text's words among them.

    Words are the longest runs of letters and digits of the lower-cased text.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    inside = _alnum()[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    place = np.flatnonzero(inside)
    owner = np.cumsum(first[place]) - 1
    power = (place - starts[owner]).astype(np.uint64)
    value = mix(codes[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(power + np.uint64(1)))
    return mix(np.add.reduceat(value, np.searchsorted(place, starts))), bounds


def runs(word: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of ``n`` consecutive words within each text, and the bounds of each text's runs."""
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += mix(word[at + k] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    return mix(total), out
