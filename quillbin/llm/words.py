"""Words of whole texts as numbers: the pieces between ASCII white space."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

SPACES = " \t\n\x0b\x0c\r"


def split(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]+`` in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Words:
    """Words of many texts: ``code[i]`` is the place in ``distinct``; text k has words ``edges[k]:edges[k + 1]``."""

    def __init__(self, texts: list[str | None]):
        each = [split(t) for t in texts]
        self.edges = np.cumsum([0, *map(len, each)])
        flat = pa.array([w for own in each for w in own], pa.large_binary()).dictionary_encode()
        self.code = np.asarray(flat.indices).astype(np.int64)
        self.distinct: list[bytes] = flat.dictionary.to_pylist()
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.edges))

    def each(self, of: Callable[[bytes], int]) -> np.ndarray:
        """of(word) for every word, computed once for each distinct one."""
        return np.array([of(w) for w in self.distinct], np.uint64)[self.code] if self.distinct else np.zeros(0, np.uint64)

    def windows(self, n: int) -> np.ndarray:
        """First places of all windows of n words within one text."""
        if len(self.code) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[n - 1 :] == self.text[: len(self.text) - n + 1])

    def repeated(self, n: int = 3) -> np.ndarray:
        """For each text: its words in windows of n words that it holds twice or more."""
        at = self.windows(n)
        key = self.text[at].astype(np.uint64)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + self.code[at + k].astype(np.uint64)
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = np.concatenate(([False], s[1:] == s[:-1])) if len(s) else np.zeros(0, bool)
        again = same | np.append(same[1:], False)[: len(same)]
        mark = np.zeros(len(self.code), bool)
        for k in range(n):
            mark[at[order[again]] + k] = True
        return np.add.reduceat(np.append(mark, False).astype(np.int64), self.edges[:-1]) * (np.diff(self.edges) > 0) if len(self.edges) > 1 else np.zeros(0, np.int64)
