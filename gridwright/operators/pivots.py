"""A pivot tree: balls around centres over all columns, for bounds by the triangle inequality.

Rows are grouped by which of their coordinates are missing, as distances between
two rows use the coordinates that both have. Each group has a tree of its own,
grown on a bounded sample: the largest node is split in two by its two centres
until there are enough leaves. A row belongs to the leaf that it reaches by
going to the nearer centre at every node. For every leaf the least and greatest
distance of its rows to its centre are worked out over all rows (``rings``), so
bounds are true whatever the sample was. Rows of a group that the sample didn't
hold, or held too little of, share one leaf without a bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Groups of missing coordinates that get a tree; the rows of all others share a leaf.
MOST_PATTERNS = 64
#: The leaf without a bound.
LOOSE = 0
#: Bounds give way by this share of the distances that they come from, so that rounding never hides a tie.
SLACK = 1e-9


@dataclass
class _Node:
    centre: np.ndarray
    leaf: int = -1
    children: tuple[int, int] | None = None


@dataclass
class PivotTree:
    """``patterns`` are masks of the coordinates that a group's rows have; ``roots`` their trees' first nodes."""

    metric: str
    patterns: list[np.ndarray] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    nodes: list[_Node] = field(default_factory=list)
    leaves: int = 1
    near: np.ndarray | None = None
    far: np.ndarray | None = None

    @classmethod
    def grown(cls, sample: np.ndarray, leaves: int, metric: str) -> PivotTree:
        """A tree with about ``leaves`` leaves from some rows (missing coordinates are NaN)."""
        tree = cls(metric)
        if not len(sample):
            return tree
        masks, group, count = np.unique(~np.isnan(sample), axis=0, return_inverse=True, return_counts=True)
        group = group.ravel()
        for g in np.argsort(-count, kind="stable")[:MOST_PATTERNS]:
            if masks[g].any():
                rows = sample[group == g][:, masks[g]]
                tree._grow(masks[g], rows, max(1, round(leaves * count[g] / len(sample))))
        return tree

    def _grow(self, mask: np.ndarray, rows: np.ndarray, leaves: int) -> None:
        self.patterns.append(mask)
        self.roots.append(len(self.nodes))
        self.nodes.append(_Node(rows.mean(axis=0)))
        waiting = [(-len(rows), self.roots[-1], rows)]
        done: list[int] = []
        while waiting and len(waiting) + len(done) < leaves:
            _, at, mine = heapq.heappop(waiting)
            halves = _halved(mine)
            if halves is None:
                done.append(at)
                continue
            self.nodes[at].children = (len(self.nodes), len(self.nodes) + 1)
            for half in halves:
                heapq.heappush(waiting, (-len(half), len(self.nodes), half))
                self.nodes.append(_Node(half.mean(axis=0)))
        for at in sorted(done + [at for _, at, _ in waiting]):
            self.nodes[at].leaf = self.leaves
            self.leaves += 1

    @property
    def splits(self) -> bool:
        """Whether there is more than one leaf with rows to tell apart."""
        return self.leaves > 2

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row's leaf and its distance to the leaf's centre (0 in the leaf without a bound)."""
        leaf, distance = np.full(len(x), LOOSE, dtype=np.int64), np.zeros(len(x))
        seen = ~np.isnan(x)
        for mask, root in zip(self.patterns, self.roots):
            rows = np.flatnonzero((seen == mask).all(axis=1))
            waiting = [(root, rows)] if len(rows) else []
            while waiting:
                at, rows = waiting.pop()
                node = self.nodes[at]
                mine = x[rows][:, mask]
                if node.children is None:
                    leaf[rows] = node.leaf
                    distance[rows] = _length(mine - node.centre, self.metric)
                    continue
                one, two = (_length(mine - self.nodes[c].centre, self.metric) for c in node.children)
                for child, some in zip(node.children, (rows[one <= two], rows[one > two])):
                    if len(some):
                        waiting.append((child, some))
        return leaf, distance

    def bounded_by(self, near: dict[int, float], far: dict[int, float]) -> PivotTree:
        """With the least and greatest distance to the centre of each leaf's rows."""
        self.near, self.far = np.full(self.leaves, np.inf), np.full(self.leaves, -np.inf)
        for leaf in near:
            self.near[leaf], self.far[leaf] = near[leaf], far[leaf]
        return self

    def _centres(self) -> tuple[np.ndarray, np.ndarray]:
        """The leaves' centres, missing coordinates 0, and which coordinates their rows have."""
        width = len(self.patterns[0]) if self.patterns else 0
        centres, seen = np.zeros((self.leaves, width)), np.zeros((self.leaves, width), dtype=bool)
        ends = [*self.roots[1:], len(self.nodes)]
        for mask, first, last in zip(self.patterns, self.roots, ends):
            for node in self.nodes[first:last]:
                if node.leaf >= 0:
                    centres[node.leaf, mask], seen[node.leaf] = node.centre, mask
        return centres, seen

    def reach(self, x: np.ndarray, cells: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """For every row and leaf: the distance to the centre, and the least distance that a row of the leaf can have.

        Both are over the coordinates that the row and the leaf's rows have, enlarged
        as the metric asks for missing ones; infinite where they share none.
        """
        cells = np.asarray(cells, dtype=np.int64)
        centres, seen = self._centres()
        centres, seen = centres[cells], seen[cells]
        width = x.shape[1]
        mine = ~np.isnan(x)
        total = np.zeros((len(x), len(cells)))
        plain = mine.all() and seen.all()
        for j in range(width):
            gap = np.where(mine[:, j], x[:, j], 0.0)[:, None] - centres[None, :, j]
            gap = np.abs(gap) if self.metric == "manhattan" else gap * gap
            total += gap if plain else gap * (mine[:, j, None] & seen[None, :, j])
        distance = total if self.metric == "manhattan" else np.sqrt(total)
        near, far = self.near[cells][None, :], self.far[cells][None, :]
        # a row's distance to the centre over shared coordinates is at most that over all its own, and equal where all are shared
        shared = mine.astype(np.int64) @ seen.T.astype(np.int64)
        whole = shared == seen.sum(axis=1)[None, :]
        low = np.maximum(distance - far, np.where(whole, near - distance, 0.0))
        low = np.maximum(low - SLACK * (distance + np.where(np.isfinite(far), far, 0.0)), 0.0)
        if self.metric == "nan_euclidean":
            with np.errstate(divide="ignore", invalid="ignore"):
                larger = np.where(shared > 0, np.sqrt(width / shared), np.inf)
                distance = np.where(shared > 0, distance * larger, np.inf)
                low = np.where(shared > 0, low * larger * (1 - SLACK), np.inf)
        loose = cells == LOOSE
        low[:, loose], distance[:, loose] = 0.0, np.inf
        return distance, low


def _length(gaps: np.ndarray, metric: str) -> np.ndarray:
    return np.abs(gaps).sum(axis=1) if metric == "manhattan" else np.sqrt((gaps * gaps).sum(axis=1))


def _halved(rows: np.ndarray, steps: int = 4) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows by the nearer of two centres, found from two far rows; None where all are equal."""
    away = ((rows - rows.mean(axis=0)) ** 2).sum(axis=1)
    one = rows[away.argmax()]
    two = rows[((rows - one) ** 2).sum(axis=1).argmax()]
    side = None
    for _ in range(steps):
        side = ((rows - one) ** 2).sum(axis=1) <= ((rows - two) ** 2).sum(axis=1)
        if side.all() or not side.any():
            return None
        one, two = rows[side].mean(axis=0), rows[~side].mean(axis=0)
    return rows[side], rows[~side]
