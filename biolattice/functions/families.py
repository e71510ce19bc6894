"""Families of sets, held compressed: zero-suppressed decision diagrams.

A node asks for one element: its low branch has the sets without it, its high branch those with it (the element left out).  Equal nodes are one, and a node whose high branch is empty is its low
branch, so a family has one diagram and products of alternatives take as many nodes as there are elements, however many sets they stand for.
"""

from __future__ import annotations

import sys
from collections.abc import Hashable, Iterator

#: The family without a set, and the family of the empty set alone.
EMPTY, UNIT = 0, 1


class Families:
    """Families over elements; a family is a number.  Elements named later stand nearer the root, so that a growing product or sum gets new nodes above those it has."""

    def __init__(self):
        self.elements: list[Hashable] = []
        self._place: dict[Hashable, int] = {}
        self._nodes: list[tuple[int, int, int]] = [(sys.maxsize, 0, 0), (sys.maxsize, 0, 0)]
        self._known: dict[tuple[int, int, int], int] = {}
        self._done: dict[tuple, int] = {}

    def _node(self, place: int, low: int, high: int) -> int:
        if high == EMPTY:
            return low
        key = (place, low, high)
        if key not in self._known:
            self._known[key] = len(self._nodes)
            self._nodes.append(key)
        return self._known[key]

    def single(self, element: Hashable) -> int:
        """The family of one set of this element alone."""
        if element not in self._place:
            self._place[element] = -len(self.elements)
            self.elements.append(element)
            # every operation goes down one element at a time, a few calls deep for each
            sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 8 * len(self.elements)))
        return self._node(self._place[element], EMPTY, UNIT)

    def _both(self, f: int, g: int) -> tuple[int, int, int, int, int]:
        """The first element of both, and the branches of each for it."""
        (p, f0, f1), (q, g0, g1) = self._nodes[f], self._nodes[g]
        if p < q:
            return p, f0, f1, g, EMPTY
        if q < p:
            return q, f, EMPTY, g0, g1
        return p, f0, f1, g0, g1

    def union(self, f: int, g: int) -> int:
        """The sets of either."""
        if f == g or g == EMPTY:
            return f
        if f == EMPTY:
            return g
        key = ("union", *sorted((f, g)))
        if key not in self._done:
            p, f0, f1, g0, g1 = self._both(f, g)
            self._done[key] = self._node(p, self.union(f0, g0), self.union(f1, g1)) if p < sys.maxsize else UNIT
        return self._done[key]

    def join(self, f: int, g: int) -> int:
        """The unions of a set of one and a set of the other."""
        if EMPTY in (f, g):
            return EMPTY
        if f == UNIT:
            return g
        if g == UNIT:
            return f
        key = ("join", *sorted((f, g)))
        if key not in self._done:
            p, f0, f1, g0, g1 = self._both(f, g)
            high = self.union(self.union(self.join(f1, g1), self.join(f1, g0)), self.join(f0, g1))
            self._done[key] = self._node(p, self.join(f0, g0), high)
        return self._done[key]

    def without_supersets(self, f: int, g: int) -> int:
        """The sets of f that have no set of g inside them."""
        if g == EMPTY or f == EMPTY:
            return f
        if g == UNIT or f == g:
            return EMPTY
        key = ("rest", f, g)
        if key not in self._done:
            p, f0, f1, g0, g1 = self._both(f, g)
            self._done[key] = UNIT if p == sys.maxsize else self._node(p, self.without_supersets(f0, g0), self.without_supersets(self.without_supersets(f1, g0), g1))
        return self._done[key]

    def minimal(self, f: int) -> int:
        """Absorption: the sets that have no other set of the family inside them."""
        if f in (EMPTY, UNIT):
            return f
        key = ("minimal", f)
        if key not in self._done:
            p, f0, f1 = self._nodes[f]
            low = self.minimal(f0)
            self._done[key] = self._node(p, low, self.without_supersets(self.minimal(f1), low))
        return self._done[key]

    def _below(self, f: int) -> set[int]:
        """The nodes of the diagram."""
        seen, open_ = set(), [f]
        while open_:
            n = open_.pop()
            if n > UNIT and n not in seen:
                seen.add(n)
                open_ += self._nodes[n][1:]
        return seen

    def _fold(self, f: int, empty, unit, step):
        """A value for f from the values of its branches, each node once; branches have lower numbers than their node."""
        value = {EMPTY: empty, UNIT: unit}
        for n in sorted(self._below(f)):
            p, low, high = self._nodes[n]
            value[n] = step(p, value[low], value[high])
        return value[f]

    def count(self, f: int) -> int:
        """How many sets, exactly."""
        return self._fold(f, 0, 1, lambda p, low, high: low + high)

    def smallest(self, f: int) -> int | None:
        """Elements of the smallest set; None without a set."""
        return self._fold(f, None, 0, lambda p, low, high: min((x for x in (low, None if high is None else high + 1) if x is not None), default=None))

    def nodes(self, f: int) -> int:
        """Nodes of the diagram."""
        return len(self._below(f))

    def within(self, f: int, present: set) -> bool:
        """Whether a set has present elements only."""
        return self._fold(f, False, True, lambda p, low, high: low or high and self.elements[-p] in present)

    def sets(self, f: int) -> Iterator[list]:
        """The sets, one after another; elements in the order in which they were named."""
        open_: list[tuple[int, tuple]] = [(f, ())]
        while open_:
            n, path = open_.pop()
            if n == UNIT:
                yield list(path)[::-1]
            elif n != EMPTY:
                p, low, high = self._nodes[n]
                open_ += [(low, path), (high, (*path, self.elements[-p]))]
