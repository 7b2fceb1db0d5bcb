"""Content-defined anchors: every string of ``length`` bytes has one, at the same place in each of its copies.

A string's anchor is the ``KMER``-byte piece of it with the least hash (the leftmost of
equals).  Consecutive strings share the place of their anchor over a run of starts, so a
text has about one run for every (length - KMER) / 2 bytes.  Equal strings lie in
different runs with equal anchors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

KMER = 24
BASE = 0x9E3779B97F4A7C15
BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of each ``size`` bytes, by doubling and one overlapping or adjoining join."""
    h, n = BYTE[data], 1
    while n < size:
        step = min(n, size - n)
        h = h[: len(h) - step] * powers(step) + h[step:]
        n += step
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolled(data: np.ndarray) -> np.ndarray:
    """``rolling`` of each row of a matrix, over its whole width."""
    size = data.shape[1]
    weights = np.ones(1, np.uint64)
    while len(weights) < size:
        step = min(len(weights), size - len(weights))
        none = np.zeros(step, np.uint64)
        weights = np.concatenate((weights * powers(step), none)) + np.concatenate((none, weights))
    return BYTE[data] @ weights


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    out, n = values, 1
    while n < size:
        step = min(n, size - n)
        out = np.minimum(out[: len(out) - step], out[step:])
        n += step
    return out


class Runs(NamedTuple):
    """Runs of starts with one anchor: its hash, the run's first start and number of starts."""

    anchor: np.ndarray
    start: np.ndarray
    count: np.ndarray


def runs(data: np.ndarray, length: int) -> Runs:
    """The runs of one text (uint8); none if it is shorter than ``length``."""
    n = len(data) - length + 1
    if n <= 0:
        return Runs(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    piece = mixed(rolling(data, KMER))
    least = sliding_min(piece, length - KMER + 1)
    # the anchor moves when the least hash changes, or when its leftmost place is left behind
    change = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (piece[: n - 1] == least[:-1]))))
    return Runs(least[change], change, np.diff(np.append(change, n)))
