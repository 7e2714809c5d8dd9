"""Positional prefix arrays (Durbin 2014): haplotypes in the order of their alleles read backwards, and where neighbours in it begin to match.

A walk visits sites one way.  After each, haplotypes with allele 0 come first; the match of two
haplotypes is the shortest among those of neighbours between them, so a sum over all pairs
is a sum of minima over stretches of neighbours, and takes as many steps as haplotypes.
Nothing of the size pairs, or sites x pairs, is held.

A chromosome may be walked in tiles.  A tile's own arrays hold for matches that begin
inside it; ``chained`` puts them together with the state at its border, so that the next tile
starts from what a walk over the whole chromosome would have, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np


@dataclass
class State:
    """What a walk knows after its last site.  Entry i of the arrays is about haplotypes i - 1 and i of ``order``.

    ``age``: sites since their match began, 0 if they differ at the last one.  ``dist``: distance
    from the match's first site to the last; ``gap``: from that site to the one before it,
    which is missing at the data's edge.  ``brk``: sites since the last gap that ends walks, or infinity.
    ``zeros``: haplotypes with allele 0 at the last site.
    """

    order: np.ndarray
    age: np.ndarray
    dist: np.ndarray
    gap: np.ndarray
    brk: float
    zeros: int
    sites: int
    total: float
    first: int
    last: int


FIELDS = "order array<int>, age array<long>, dist array<double>, gap array<double>, brk double, zeros long, sites long, total double, first long, last long"


def as_row(s: State) -> tuple:
    return tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in (getattr(s, f.name) for f in fields(State)))


def from_row(row: dict) -> State:
    kinds = {"order": np.int64, "age": np.int64, "dist": float, "gap": float}
    return State(**{f.name: np.array(row[f.name], dtype=kinds[f.name]) if f.name in kinds else row[f.name] for f in fields(State)})


def pair_sum(x: np.ndarray) -> float:
    """Sum of min(x[i .. j]) over all i <= j."""
    total = here = 0.0
    stack: list[tuple[float, int]] = []
    for v in x.tolist():
        n = 1
        while stack and stack[-1][0] >= v:
            w, k = stack.pop()
            here -= w * k
            n += k
        stack.append((v, n))
        here += v * n
        total += here
    return total


class Walk:
    """A walk over sites ``h`` (sites x haplotypes); ``steps[k]`` is the distance from site k - 1 to k.

    ``steps[0]`` is the distance from the site before the tile, of no meaning without a
    ``state``.  Negative steps are gaps that end walks: nothing is added for them.  With ``reset`` no match goes across
    such a gap.  ``start`` has, for neighbours in ``order``, the place in ``ordinal``, ``place`` and ``before`` of the site
    at which their match begins; places below ``base`` are sites of earlier tiles.
    """

    def __init__(self, h: np.ndarray, steps: np.ndarray, state: State | None = None, reset: bool = False):
        m, n = h.shape
        self.h, self.steps, self.reset = h, steps, reset
        local = np.concatenate([[0.0], np.cumsum(np.maximum(steps[1:], 0))]) if m else np.zeros(0)
        if state is None or not m:
            self.base, self.order, self.start = 0, np.arange(n), np.zeros(n, np.int64)
            older = [np.zeros(0)] * 3
            first, self.brk = np.nan, -np.inf
        else:
            ages, at = np.unique(state.age[1:][state.age[1:] > 0], return_index=True)
            at = np.flatnonzero(state.age[1:] > 0)[at] + 1
            across = max(steps[0], 0.0)
            older = [-ages[::-1].astype(float), -(across + state.dist[at][::-1]), state.gap[at][::-1]]
            self.base, self.order = len(ages), state.order.copy()
            self.start = np.where(state.age > 0, self.base - 1 - np.searchsorted(ages, state.age), self.base)
            first, self.brk = steps[0], 0.0 if steps[0] < 0 else -state.brk
            if reset and steps[0] < 0:
                self.start[:] = self.base
        self.ordinal = np.concatenate([older[0], np.arange(m + 1)])
        self.place = np.concatenate([older[1], local, local[-1:] if m else [0.0]])
        self.before = np.concatenate([older[2], [first], steps[1:], [np.nan]]) if m else older[2]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, where the matches of neighbours with allele 0 at k begin, the same with allele 1), site by site."""
        for k in range(len(self.h)):
            if k and self.steps[k] < 0:
                self.brk = float(k)
                if self.reset:
                    np.maximum(self.start, self.base + k, out=self.start)
            bits = self.h[k][self.order]
            parts, orders = [], []
            for allele in (0, 1):
                at = np.flatnonzero(bits == allele)
                orders.append(self.order[at])
                if len(at):
                    found = np.maximum.reduceat(self.start[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
                    found[0] = self.base + k + 1
                else:
                    found = np.zeros(0, np.int64)
                parts.append(found)
            self.order, self.start = np.concatenate(orders), np.concatenate(parts)
            self.zeros = len(parts[0])
            yield k, parts[0][1:], parts[1][1:]

    def state(self, positions: np.ndarray) -> State:
        """After the last site."""
        m = len(self.h)
        age = (m - self.ordinal[self.start]).astype(np.int64)
        dist, gap = self.place[self.base + m] - self.place[self.start], self.before[self.start]
        return State(self.order, age, dist, gap, m - self.brk, self.zeros, m, float(self.place[self.base + m]), int(positions[0]), int(positions[-1]))


def chained(before: State | None, own: State, step: float, reset: bool = False) -> State:
    """The state after a tile, from that before it and the tile's own; ``step`` is the distance between their sites."""
    if before is None:
        return own  # matches that begin with the tile begin with the data
    m, n = own.sites, len(own.order)
    whole = own.age == m
    whole[0] = False
    group = np.cumsum(~whole)
    rank = np.empty(n, np.int64)
    rank[before.order] = np.arange(n)
    order = own.order[np.lexsort((rank[own.order], group))]
    age, dist, gap = own.age.copy(), own.dist.copy(), own.gap.copy()
    at = np.flatnonzero(whole)
    across = max(step, 0.0)
    if len(at):
        # the youngest match between two ranks, by a table of minima over powers of two
        levels = [np.arange(n)]
        while 2 << len(levels) - 1 <= n:
            a, half = levels[-1], 1 << len(levels) - 1
            b, c = a[:-half], a[half:]
            levels.append(np.where(before.age[b] <= before.age[c], b, c))
        low, high = rank[order[at - 1]] + 1, rank[order[at]]
        level = np.log2(high - low + 1).astype(int)
        b = np.array([levels[v][x] for v, x in zip(level, low, strict=True)])
        c = np.array([levels[v][x - (1 << v) + 1] for v, x in zip(level, high, strict=True)])
        k = np.where(before.age[b] <= before.age[c], b, c)
        older = (before.age[k] > 0) & (not (reset and step < 0))
        age[at] = m + np.where(older, before.age[k], 0)
        dist[at] = own.total + np.where(older, across + before.dist[k], 0.0)
        gap[at] = np.where(older, before.gap[k], step)
    brk = own.brk if np.isfinite(own.brk) else float(m) if step < 0 else before.brk + m
    return State(order, age, dist, gap, brk, own.zeros, before.sites + m, own.total + across + before.total, before.first, own.last)
