"""Grammar inference: strings of one format to a probabilistic automaton.

The strings make a prefix tree whose nodes count how often they are passed, left by each
symbol and ended in.  From the root on, a node is merged into the automaton's state that is
nearest to it among those from which it does not differ by the bound of Hoeffding, all the
way down, and becomes a state of its own if there is none.  Symbols are classes of letters;
the letters of a class are equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

#: Classes of letters that a credential may have, each a symbol.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
SYMBOL = {ord(letter): chr(i) for i, own in enumerate(CLASSES) for letter in own}
END = len(CLASSES)
#: Chance of keeping two states apart that are the same, and what is added to each count.
RISK, ADDED = 0.05, 0.25


class Tree:
    """Nodes of a prefix tree: passed, ended, and children by symbol."""

    def __init__(self, strings: Iterable[str]):
        self.passed, self.ended, self.to = [0], [0], [{}]
        for s in strings:
            at = 0
            self.passed[0] += 1
            for c in map(ord, s.translate(SYMBOL)):
                if c not in self.to[at]:
                    self.to[at][c] = len(self.to)
                    self.passed.append(0)
                    self.ended.append(0)
                    self.to.append({})
                at = self.to[at][c]
                self.passed[at] += 1
            self.ended[at] += 1

    def shares(self, node: int) -> dict[int, float]:
        """How often a node is left by each symbol; END: how often a string ends there.

        A state's count is that of all strings that pass it, as often as they do.
        """
        n = self.passed[node]
        return {END: self.ended[node] / n, **{c: self.left[node].get(c, 0) / n for c in self.to[node]}}

    def counted(self) -> Tree:
        """Remembers how often each edge is passed, as merged nodes are entered by others too."""
        self.left = [{c: self.passed[child] for c, child in own.items()} for own in self.to]
        return self

    def differ(self, a: int, b: int, risk: float) -> bool:
        """Whether two nodes, or two that the same symbols lead to, differ by more than chance."""
        width = math.sqrt(math.log(2 / risk) / 2)
        left = [(a, b)]
        while left:
            a, b = left.pop()
            bound = width * (1 / math.sqrt(self.passed[a]) + 1 / math.sqrt(self.passed[b]))
            if bound >= 1:
                continue  # too few to tell, and fewer below
            p, q = self.shares(a), self.shares(b)
            if any(abs(p.get(c, 0) - q.get(c, 0)) > bound for c in p.keys() | q.keys()):
                return True
            left += [(child, self.to[b][c]) for c, child in self.to[a].items() if c in self.to[b]]
        return False

    def distance(self, a: int, b: int) -> float:
        p, q = self.shares(a), self.shares(b)
        return sum(abs(p.get(c, 0) - q.get(c, 0)) for c in p.keys() | q.keys())

    def fold(self, into: int, node: int) -> None:
        """Adds a node and the tree below it to a state."""
        left = [(into, node)]
        while left:
            a, b = left.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for c, child in self.to[b].items():
                self.left[a][c] = self.left[a].get(c, 0) + self.left[b][c]
                if c in self.to[a]:
                    left.append((self.to[a][c], child))
                else:
                    self.to[a][c] = child


class Automaton(NamedTuple):
    """Of each state and symbol the next state and the logarithm of the probability of a letter, END last; the last state is where unknown strings go."""

    to: np.ndarray
    logs: np.ndarray

    def likelihood(self, text: str) -> float:
        """The logarithm of a string's probability; letters outside the classes make it impossible."""
        at, total = 0, 0.0
        to, logs = self.to, self.logs
        for c in map(ord, text.translate(SYMBOL)):
            if c >= END:
                return -math.inf
            total += logs[at, c]
            at = to[at, c]
        return float(total + logs[at, END])

    def rate(self, text: str) -> float:
        """The mean over a string's letters of the logarithm of their classes' probability, without its end."""
        at, total = 0, 0.0
        for c in map(ord, text.translate(SYMBOL)):
            if c >= END:
                return -math.inf
            total += self.logs[at, c] + math.log(len(CLASSES[c]))
            at = self.to[at, c]
        return float(total / max(1, len(text)))


def inferred(strings: Iterable[str], risk: float = RISK) -> Automaton | None:
    """The automaton of some strings, the same for any order of them; None without strings."""
    own = sorted(strings)
    if not own:
        return None
    tree = Tree(own).counted()
    states, edges = [0], {}
    while True:
        blue = [(-tree.left[s][c], states.index(s), c, child) for s in states for c, child in tree.to[s].items() if (s, c) not in edges]
        if not blue:
            break
        _, i, c, node = min(blue)
        s = states[i]
        fits = [(tree.distance(r, node), k, r) for k, r in enumerate(states) if not tree.differ(r, node, risk)]
        if fits:
            r = min(fits)[2]
            edges[s, c] = r
            tree.to[s][c] = r
            tree.fold(r, node)
        else:
            states.append(node)
            edges[s, c] = node
    place = {s: i for i, s in enumerate(states)}
    size = np.array([len(x) for x in CLASSES] + [1])
    to = np.full((len(states) + 1, END), len(states), np.int32)
    count = np.full((len(states) + 1, END + 1), ADDED)
    count[-1] = size  # every letter and the end alike
    for (s, c), r in edges.items():
        to[place[s], c] = place[r]
        count[place[s], c] += tree.left[s][c]
    for s, i in place.items():
        count[i, END] += tree.ended[s]
    return Automaton(to, np.log(count / count.sum(1, keepdims=True)) - np.log(size))
