"""A logarithmic family of suffix arrays over batches of byte strings.

A batch gets a suffix array: the offsets of its suffixes in the order of their first
``length`` bytes, so that equal ones are neighbours.  It is merge-scanned against every
level that is there for matches of ``length`` bytes, and what no level has becomes a level.
Levels of a similar size are merged, so there are at most log2(batches) + 1 of them and
every suffix moves a logarithmic number of times.  Levels hold text and offsets; heads of
suffixes are cut out block by block while two arrays are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from quillbin.llm.anchors import mixed, rolled, rolling

#: Suffixes whose heads are in memory at once, for each of two arrays.
BLOCK = 1 << 16
#: Suffixes of a batch, about.
BATCH = 1 << 18
#: Bytes that are hashed at once.
HASHED = 1 << 18


class Level(NamedTuple):
    """text, and a suffix array of some of its suffixes."""

    text: np.ndarray
    at: np.ndarray

    def heads(self, first: int, n: int, length: int) -> np.ndarray:
        return heads(self.text, self.at[first : first + n], length)


def heads(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes at each offset; as long as each other, so padding says nothing."""
    if not len(at):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at]).view(f"S{length}").ravel()


def merge_scan(level: Level, own: Level, length: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of own, in order: its place among the level's, and whether one there has the same first bytes.

    Both arrays are walked once from front to back.
    """
    n, m = len(level.at), len(own.at)
    place, same = np.full(m, n, np.int64), np.zeros(m, bool)
    i, theirs = 0, level.heads(0, block, length)
    for j in range(0, m, block):
        mine, done = own.heads(j, block, length), 0
        while done < len(mine) and i < n:
            k = done + int(np.searchsorted(mine[done:], theirs[-1], "right"))
            p = np.searchsorted(theirs, mine[done:k])
            place[j + done : j + k] = i + p
            same[j + done : j + k] = theirs[p] == mine[done:k]
            done = k
            if done < len(mine):
                i += len(theirs)
                theirs = level.heads(i, block, length)
    return place, same


def merged(level: Level, own: Level, length: int) -> Level:
    """One level of the suffixes of both; own has none that the level has."""
    place, _ = merge_scan(level, own, length)
    return Level(np.concatenate((level.text, own.text)), np.insert(level.at, place, own.at + len(level.text)))


class SuffixLevels:
    """``add(texts, counts)`` in corpus order; says which suffixes begin with bytes that began a suffix before."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []

    def add(self, texts: list[bytes], counts: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """The first counts[i] suffixes of texts[i], all at least ``length`` long; a boolean for each, False for those that are not ``wanted``."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum([0, *map(len, texts[:-1])])
        starts = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        own_places = np.arange(len(starts)) if wanted is None else np.flatnonzero(wanted)
        out = np.zeros(len(starts), bool)
        starts = starts[own_places]
        own = heads(data, starts, self.length)
        order = np.argsort(own, kind="stable")  # equal heads keep the corpus order
        own = own[order]
        array = starts[order]
        seen = np.concatenate(([False], own[1:] == own[:-1]))[: len(own)]
        for level in self.levels:
            left = np.flatnonzero(~seen)
            seen[left] = merge_scan(level, Level(data, array[left]), self.length)[1]
        if not seen.all():
            self.levels.append(Level(data, array[~seen]))
            while len(self.levels) > 1 and len(self.levels[-2].at) < 2 * len(self.levels[-1].at):
                b, a = self.levels.pop(), self.levels.pop()
                self.levels.append(merged(a, b, self.length))
        out[own_places[order]] = seen
        return out


def head_hashes(texts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each of the first counts[i] offsets of texts[i]; equal bytes have equal ones."""
    out = np.empty(int(counts.sum()), np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(counts) - counts
    single = sizes == length
    for alone in (True, False):
        own = np.flatnonzero(single == alone)
        upto = np.cumsum(sizes[own])
        i = 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(upto, (int(upto[i - 1]) if i else 0) + HASHED, "right")))
            some = own[i:j]
            data = np.frombuffer(b"".join([texts[k] for k in some.tolist()]), np.uint8)
            n = counts[some]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if alone:
                h = rolled(data.reshape(-1, length))
            else:
                h = rolling(data, length)[np.repeat(np.cumsum(sizes[some]) - sizes[some], n) + places]
            out[np.repeat(first[some], n) + places] = h
            i = j
    return mixed(out)


def not_alone(h: np.ndarray) -> np.ndarray:
    """Which of the values are there twice or more."""
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(h), bool)
    k = np.searchsorted(twice, h)
    k[k == len(twice)] = 0
    return twice[k] == h


def repeated(texts: list[bytes], counts: np.ndarray, length: int, batch: int = BATCH) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each batch of texts in corpus order: its first text, the one after its last, and which of its suffixes are repeats.

    A suffix whose first bytes' hash no other one has is no repeat and is not compared.
    """
    index = SuffixLevels(length)
    upto = np.cumsum(counts)
    wanted = not_alone(head_hashes(texts, counts, length))
    i = 0
    while i < len(texts):
        before = int(upto[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + batch, "right")))
        yield i, j, index.add(texts[i:j], counts[i:j], wanted[before : int(upto[j - 1])])
        i = j
