"""Decision trees, random forests and extremely randomised trees of any depth.

1. Nodes of many rows are split level by level, all trees together: a pass adds
   up the labels by tree, node, column and bin (quantiles, or values where there
   are few) inside the tasks, the sums of a node meet in one task, which picks its
   split, and the driver gets that split. A node that may not be split any more is
   a leaf at once: neither summed nor dealt. Rows of the same bins go the same way
   here, so they are stored together as a cell, whose sums in each tree are
   stored too where cells hold many rows: a pass reads cells, not rows.
2. A node of at most ``TASK_ROWS`` rows is dealt to a task with its rows, which
   grows the whole subtree below it on the values themselves. So most nodes of a
   deep forest are grown in parallel, never pass through the driver and end as
   rows of a table; a table of up to ``TASK_ROWS`` rows gets exact trees.
3. Forests of few nodes become arrays that go along to the tasks which score. A
   larger one stays a table: rows go down the upper nodes, are dealt to the
   subtree that they reach, and the votes come back by row.

Splits are by the drop of Gini impurity or variance. ``min_samples_split`` and
``max_depth`` (none: unlimited) hold while growing. A forest takes each row as
often in a tree as a Poisson draw by the hash of its number says. Extremely
randomised trees draw one threshold a column between a node's least and greatest
value (in step 1 the next bin's edge). Missing values go right.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.models.base import FittedStage
from gridwright.models.boosting import BINS, CELLS_PER_PASS, MISSING, TIE, bin_edges
from gridwright.models.common import Cells, Problem, gathered, read_cells, score_matrix, with_outputs
from gridwright.session import checkpoint, spread

#: Rows of a node that one task takes whole, and cells (rows by columns) of them at most.
TASK_ROWS, TASK_CELLS = 50_000, 8_000_000
#: Rows that go down a tree at once.
NEAR_ROWS = 8_192
#: Sums of a forest's cells are stored if they take so many times the room of the rows at most; else they are made in each pass.
STORED_SUMS = 4
#: Doubles of sums in a block, and rows that are gathered before they are dealt to subtrees.
SUMS, GATHERED_ROWS = 1 << 20, 262_144
#: Nodes of a forest that go along to every task; beyond, the forest is a table.
SMALL_NODES = 200_000
#: Of a node's own shares: what a split has to gain, as a share of its rows.
_LEAST_GAIN = 1e-12
_NODE = ("feature", "threshold", "left", "right", "value", "gain")


@dataclass(frozen=True)
class Growth:
    """How trees grow: ``classes`` (0: numbers), columns tried at a node, random thresholds, draws of rows."""

    classes: int
    depth: int | None
    least: int
    tries: int
    random_cuts: bool
    draws: bool
    seed: int

    @property
    def width(self) -> int:
        return self.classes or 3

    def sums_of(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What is added up of each row: its class, or rows, labels and their squares."""
        return np.eye(self.classes)[y.astype(int)] * w[:, None] if self.classes else np.column_stack([w, w * y, w * y * y])

    def rows(self, sums: np.ndarray) -> np.ndarray:
        return sums.sum(axis=-1) if self.classes else sums[..., 0]

    def gain(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The drop of impurity times rows; -inf where a side is empty."""
        def score(s: np.ndarray) -> np.ndarray:
            n = np.maximum(self.rows(s), 1e-300)
            return (s * s).sum(axis=-1) / n if self.classes else s[..., 1] ** 2 / n

        right = total - left
        drop = score(left) + score(right) - score(total)
        return np.where((self.rows(left) > 0.5) & (self.rows(right) > 0.5), drop, -np.inf)

    def splits(self, total: np.ndarray, depth: int) -> np.ndarray:
        """Which nodes may be split at all: deep, large and mixed ones."""
        n = self.rows(total)
        if self.classes:
            mixed = total.max(axis=-1) < n - 0.5
        else:
            mixed = total[..., 2] - total[..., 1] ** 2 / np.maximum(n, 1e-300) > 1e-12 * np.maximum(1.0, total[..., 2])
        return mixed & (n >= self.least - 0.5) & (self.depth is None or depth < self.depth)

    def leaf(self, total: np.ndarray) -> np.ndarray:
        return total / np.maximum(total.sum(axis=-1, keepdims=True), 1e-300) if self.classes else total[..., 1:2] / np.maximum(total[..., :1], 1e-300)

    def chosen(self, gains: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The column of each node from gains [node, column]: the best of the first ``tries`` in its order that split, else the next that does; -1 without."""
        drawn = np.take_along_axis(gains, order, axis=1)
        useful = drawn > 0
        looked = (np.arange(gains.shape[1])[None, :] < self.tries) | (np.cumsum(useful, axis=1) <= 1)
        drawn = np.where(useful & looked, drawn, -np.inf)
        most = drawn.max(axis=1, keepdims=True)
        first = (drawn >= most * (1 - TIE)).argmax(axis=1)
        return np.where(np.isfinite(most[:, 0]), np.take_along_axis(order, first[:, None], axis=1)[:, 0], -1)

    def orders(self, nodes: int, columns: int, rng: np.random.Generator) -> np.ndarray:
        """The order in which the columns are tried at each node."""
        every = np.tile(np.arange(columns), (nodes, 1))
        return rng.permuted(every, axis=1) if self.tries < columns else every


def _cuts_exact(growth: Growth, x: np.ndarray, slot: np.ndarray, stats: np.ndarray, total: np.ndarray, orders: list[np.ndarray],
                rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Gain and threshold [node, column] of the best (or the drawn) cut of each column, from the rows of the nodes.

    ``orders`` has the rows of every column by node and value (nothing where thresholds are drawn).
    """
    nodes, columns = len(total), x.shape[1]
    gains, cuts = np.full((nodes, columns), -np.inf), np.zeros((nodes, columns))
    for j in range(columns):
        v = x[:, j]
        if growth.random_cuts:
            seen = ~np.isnan(v)
            low, high = np.full(nodes, np.inf), np.full(nodes, -np.inf)
            np.minimum.at(low, slot[seen], v[seen])
            np.maximum.at(high, slot[seen], v[seen])
            wide = high > low
            cut = np.where(wide, low + rng.random(nodes) * np.where(wide, high - low, 0.0), 0.0)
            cut = np.where(wide & (cut >= high), low, cut)
            left = v <= cut[slot]
            sums = np.column_stack([np.bincount(slot[left], stats[left, k], nodes) for k in range(stats.shape[1])])
            gains[:, j], cuts[:, j] = np.where(wide, growth.gain(sums, total), -np.inf), cut
            continue
        s, u = slot[orders[j]], v[orders[j]]
        edge = np.flatnonzero((s[1:] == s[:-1]) & ((u[1:] > u[:-1]) | (np.isnan(u[1:]) & ~np.isnan(u[:-1]))))
        if not len(edge):
            continue
        added = np.cumsum(stats[orders[j]], axis=0)
        begin = np.searchsorted(s, np.arange(nodes))
        before = np.where(begin[:, None] > 0, added[np.maximum(begin - 1, 0)], 0.0)
        at = s[edge]
        gain = growth.gain(added[edge] - before[at], total[at])
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        most = np.maximum.reduceat(gain, first)
        whose = np.cumsum(np.r_[True, at[1:] != at[:-1]]) - 1
        good = np.flatnonzero(gain >= most[whose] * (1 - TIE))
        _, lead = np.unique(at[good], return_index=True)
        best = good[lead]
        below, above = u[edge[best]], u[edge[best] + 1]
        middle = np.where(np.isnan(above), np.inf, below + (above - below) / 2)
        gains[at[best], j], cuts[at[best], j] = gain[best], np.where(middle < above, middle, below)
        cuts[at[best], j] = np.where(np.isnan(above), np.inf, cuts[at[best], j])
    return gains, cuts


def grow_rows(growth: Growth, x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, key: tuple[int, ...]) -> dict[str, list]:
    """The whole subtree of some rows (``w``: how often each counts) at a depth, level by level, nodes in order."""
    rng = np.random.default_rng([growth.seed, *key])
    out: dict[str, list] = {name: [] for name in _NODE}

    def add(totals: np.ndarray) -> None:
        out["value"] += growth.leaf(totals).tolist()
        for name, blank in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("gain", 0.0)):
            out[name] += [blank] * len(totals)

    stats = growth.sums_of(y, w)
    total = stats.sum(axis=0)[None, :]
    add(total)
    slot, ids = np.zeros(len(x), dtype=np.int64), np.array([0])
    if not growth.splits(total, depth)[0]:
        return out
    # each column is put in order once; from level to level rows only move to their node, keeping that order
    orders = [] if growth.random_cuts else [np.argsort(x[:, j], kind="stable") for j in range(x.shape[1])]

    def kept(keep: np.ndarray) -> None:
        nonlocal x, stats, slot
        if not keep.all():
            place = np.cumsum(keep) - 1
            orders[:] = [place[o[keep[o]]] for o in orders]
            x, stats, slot = x[keep], stats[keep], slot[keep]

    while True:
        on = growth.splits(total, depth)
        kept(on[slot])
        slot = (np.cumsum(on) - 1)[slot]
        ids, total = ids[on], total[on]
        if not len(ids):
            return out
        if len(ids) > 1:
            small = slot.astype(np.uint16) if len(ids) <= 1 << 16 else slot
            orders = [o[np.argsort(small[o], kind="stable")] for o in orders]
        gains, cuts = _cuts_exact(growth, x, slot, stats, total, orders, rng)
        gains = np.where(gains > _LEAST_GAIN * growth.rows(total)[:, None], gains, -np.inf)
        pick = growth.chosen(gains, growth.orders(len(ids), x.shape[1], rng))
        on = pick >= 0
        kept(on[slot])
        slot = (np.cumsum(on) - 1)[slot]
        ids, pick, place = ids[on], pick[on], np.flatnonzero(on)
        if not len(ids):
            return out
        cut = cuts[place, pick]
        right = ~(x[np.arange(len(x)), pick[slot]] <= cut[slot])
        slot = 2 * slot + right
        first = len(out["feature"])
        for i, node in enumerate(ids.tolist()):
            out["feature"][node], out["threshold"][node], out["gain"][node] = int(pick[i]), float(cut[i]), float(gains[place[i], pick[i]])
            out["left"][node], out["right"][node] = first + 2 * i, first + 2 * i + 1
        total = np.column_stack([np.bincount(slot, stats[:, k], 2 * len(ids)) for k in range(stats.shape[1])])
        add(total)
        ids = first + np.arange(2 * len(ids))
        depth += 1


def _cuts_binned(growth: Growth, sums: np.ndarray, total: np.ndarray, edges: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The same from sums [node, column, bin, label sums]; thresholds are edges of bins."""
    gains, cuts = np.full(sums.shape[:2], -np.inf), np.zeros(sums.shape[:2])
    for j, edge in enumerate(edges):
        below = np.cumsum(sums[:, j, :MISSING], axis=1)
        tops = np.append(edge, np.inf)  # behind the last edge only missing values are left
        gain = growth.gain(below[:, : len(tops)], total[:, None, :])
        if growth.random_cuts and len(edge):
            held = growth.rows(sums[:, j, : len(edge) + 1]) > 0.5
            low, high = held.argmax(axis=1), len(edge) - held[:, ::-1].argmax(axis=1)
            start, end = edge[np.minimum(low, len(edge) - 1)], edge[np.maximum(high - 1, 0)]
            drawn = np.searchsorted(edge, start + rng.random(len(total)) * (end - start), side="left")
            drawn = np.clip(drawn, low, np.maximum(high - 1, low))
            gain = np.where((np.arange(len(tops))[None, :] == drawn[:, None]) & (high > low)[:, None], gain, -np.inf)
        most = gain.max(axis=1, keepdims=True)
        place = (gain >= most * (1 - TIE)).argmax(axis=1)
        gains[:, j], cuts[:, j] = gain[np.arange(len(total)), place], tops[place]
    return gains, cuts


def descend(x: np.ndarray, tree: dict) -> np.ndarray:
    """The node in which every row ends, some rows at a time so that they stay near the processor."""
    feature, threshold = tree["feature"], tree["threshold"]
    inner, n = feature >= 0, len(x)
    own = np.arange(len(feature))
    following = np.column_stack([np.where(inner, tree["left"], own), np.where(inner, tree["right"], own)]).ravel()
    column, out = np.where(inner, feature, 0), np.zeros(n, dtype=np.int64)
    if not inner.any():
        return out
    for at in range(0, n, NEAR_ROWS):
        some = np.ascontiguousarray(x[at:at + NEAR_ROWS].T)  # [column, row]
        size = some.shape[1]
        flat, rows, node, level = some.ravel(), np.arange(size), np.zeros(size, dtype=np.int64), 0
        begin = column * size
        while len(rows):
            right = ~(flat[begin[node] + rows] <= threshold[node])
            node = following[2 * node + right]
            level += 1
            if level >= 4:  # a leaf leads to itself
                level, live = 0, inner[node]
                if not live.all():
                    out[at + rows[~live]] = node[~live]
                    rows, node = rows[live], node[live]
    return out


def _arrays(tree: dict) -> dict:
    return {name: np.array(v, dtype=np.int64 if name in ("feature", "left", "right") else float) for name, v in tree.items() if name in _NODE[:4]}


def drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree: Poisson with mean one, by a hash of its number."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0x632BE59BD9B4E019 + seed * 0x85EBCA6B + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z = z ^ (z >> np.uint64(31))
    top = z >> np.uint64(48)
    out = _DRAWS[top]
    open_ = np.flatnonzero(out < 0)  # a limit lies between the shares that begin with these bits
    if len(open_):
        out[open_] = np.searchsorted(_STEPS, (z[open_] >> np.uint64(11)).astype(np.float64) / 2**53, side="right")
    return out


#: The shares below which a Poisson draw is 0, 1, ..., and the draw of each 16 leading bits where they tell it (else -1).
_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_DRAWS = np.searchsorted(_STEPS, np.arange(1 << 16) / 2**16, side="right").astype(np.float64)
_DRAWS[np.searchsorted(_STEPS, (np.arange(1 << 16) + 1) / 2**16, side="right") != _DRAWS] = -1


class _Upper:
    """The nodes of one tree that the driver holds; ``root`` numbers those dealt to tasks."""

    def __init__(self):
        self.tree: dict[str, list] = {name: [v] for name, v in zip(_NODE, (-1, 0.0, -1, -1, None, 0.0))}
        self.root: dict[int, int] = {}

    def divide(self, node: int, feature: int, threshold: float, gain: float) -> list[int]:
        first = len(self.tree["feature"])
        self.tree["feature"][node], self.tree["threshold"][node], self.tree["gain"][node] = feature, threshold, gain
        self.tree["left"][node], self.tree["right"][node] = first, first + 1
        for name, blank in zip(_NODE, (-1, 0.0, -1, -1, None, 0.0)):
            self.tree[name] += [blank, blank]
        return [first, first + 1]


def _tops(edges: list[np.ndarray]) -> list[np.ndarray]:
    """A value of every bin that goes the way of all values of its bin at a threshold between bins."""
    return [np.append(edge, [np.inf, np.nan]) for edge in edges]


def _cell_sums(growth: Growth, trees: int, n: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sums [tree, cell, label sums] of a block; one tree stands for all if no rows are drawn."""
    start = np.cumsum(n) - n
    out = np.empty((trees if growth.draws else 1, len(n), growth.width))
    powers = None if growth.classes else (y, y * y)
    for t in range(len(out)):
        w = drawn(ids, t, growth.seed) if growth.draws else np.ones(len(y))
        stats = growth.sums_of(y, w).T if growth.classes else (w, *(w * z for z in powers))
        for k, s in enumerate(stats):
            out[t, :, k] = np.add.reduceat(s, start)
    return out


def _summed_cells(cells: Cells, growth: Growth, trees: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """A frame and how its batches are read as bins [column, cell] and sums [tree, cell, label sums].

    The sums are stored where cells hold many rows. Else a pass makes them anew from the rows of the cells.
    """
    p, kept, width, several = cells.columns, cells.kept, growth.width, trees if growth.draws else 1

    def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for codes, n, v in read_cells(batch, p, kept):
            yield codes, _cell_sums(growth, trees, n, v[p], v[p + 1].view(np.int64))

    sizes = cells.data.agg(F.sum(F.octet_length("n")).alias("cells"), F.sum(F.octet_length("v")).alias("rows")).first()
    if sizes["cells"] * several * width > STORED_SUMS * sizes["rows"]:
        return cells.data, make
    most = max(1, SUMS // (several * width))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            joined = np.concatenate([c for c, _ in waiting], axis=1), np.concatenate([s for _, s in waiting], axis=1)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in joined], ["b", "s"])

        for b in batches:
            for one in make(b):
                waiting.append(one)
                if sum(c.shape[1] for c, _ in waiting) >= most:
                    yield block()
                    waiting.clear()
        if waiting:
            yield block()

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b, s in zip(batch.column("b"), batch.column("s")):
            codes = np.frombuffer(b.as_buffer(), dtype=np.uint16).reshape(p, -1)
            yield codes, np.frombuffer(s.as_buffer()).reshape(several, codes.shape[1], width)

    return checkpoint(cells.data.mapInArrow(stored, "b binary, s binary")), read


def _upper_levels(cells: Cells, growth: Growth, edges: list[np.ndarray], trees: int, task_rows: int) -> list[_Upper]:
    """Split the large nodes of all trees level by level."""
    uppers, p = [_Upper() for _ in range(trees)], len(edges)
    width = growth.width
    widths = [len(e) + 2 for e in edges]  # the bins that a column has, and the one of missing values
    begin = np.concatenate([[0], np.cumsum(widths)]).astype(int)
    per_pass = max(1, CELLS_PER_PASS // (int(begin[-1]) * width))
    data, read = _summed_cells(cells, growth, trees)
    tops = _tops(edges)

    def best(asked: list[tuple[int, int]], depth: int) -> dict[int, dict]:
        """For each request its total and, if it is to be split, the column, threshold, gain and left side."""
        places: dict[int, np.ndarray] = {}
        for place, (t, node) in enumerate(asked):  # requests of a tree stand together
            places.setdefault(t, np.full(len(uppers[t].tree["feature"]), -1))[node] = place
        frozen = []
        for t, place in places.items():
            first = int(place[place >= 0].min())
            frozen.append((t, _arrays(uppers[t].tree), np.where(place >= 0, place - first, -1), first, int(place.max()) + 1 - first))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(asked), int(begin[-1]), width))
            for b in batches:
                for codes, sums in read(b):
                    x = np.column_stack([top[c] for top, c in zip(tops, codes)])
                    for t, tree, place, first, nodes in frozen:
                        slot, stats = place[descend(x, tree)], sums[t if growth.draws else 0]
                        live = np.flatnonzero(slot >= 0)
                        stats, slot = stats[live], slot[live]
                        for j, wide in enumerate(widths):
                            cell = slot * wide + codes[j][live]
                            for k in range(width):
                                out[first: first + nodes, begin[j]: begin[j + 1], k] += np.bincount(cell, stats[:, k], nodes * wide).reshape(nodes, wide)
            for place in np.flatnonzero(out.any(axis=(1, 2))):
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([out[place].tobytes()], pa.binary())], ["place", "v"])

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                for place, v in zip(b.column("place").to_pylist(), b.column("v")):
                    part = np.frombuffer(v.as_buffer()).reshape(-1, width)
                    found[place] = found[place] + part if place in found else part
            for place, cells in found.items():
                sums = np.zeros((1, p, BINS + 1, width))
                for j, wide in enumerate(widths):
                    sums[0, j, : wide - 1], sums[0, j, MISSING] = cells[begin[j]: begin[j + 1] - 1], cells[begin[j + 1] - 1]
                total, rng = sums[:, 0].sum(axis=1), np.random.default_rng([growth.seed, 1, *asked[place]])
                gains, cuts = _cuts_binned(growth, sums, total, edges, rng)
                gains = np.where(gains > _LEAST_GAIN * growth.rows(total)[:, None], gains, -np.inf)
                pick = np.where(growth.splits(total, depth), growth.chosen(gains, growth.orders(1, p, rng)), -1)
                j = int(pick[0])
                below = np.searchsorted(edges[j], cuts[0, j], side="left") if np.isfinite(cuts[0, j]) else BINS - 1
                left = sums[0, j, : below + 1].sum(axis=0)
                values = (place, j, float(cuts[0, j]), float(gains[0, j]), total[0].tolist(), left.tolist())
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, (
                    pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())))],
                    ["place", "feature", "threshold", "gain", "total", "left"])

        few = max(1, min(len(asked), data.sparkSession.sparkContext.defaultParallelism))
        met = data.mapInArrow(partial, "place int, v binary").repartition(few, "place")
        split = met.mapInArrow(picked, "place int, feature int, threshold double, gain double, total array<double>, left array<double>")
        return {r["place"]: r for r in split.toArrow().to_pylist()}  # a short row a node

    waiting, depth = [(t, 0) for t in range(trees)], 0
    while waiting:
        following: list[tuple[int, int]] = []
        for at in range(0, len(waiting), per_pass):
            some = waiting[at: at + per_pass]
            splits = best(some, depth)
            for place, (t, node) in enumerate(some):
                upper, found = uppers[t], splits.get(place)
                total = np.array(found["total"]) if found else np.zeros(width)  # none: no row was drawn
                upper.tree["value"][node] = growth.leaf(total).tolist()
                if growth.rows(total) <= task_rows:
                    upper.root[node] = len(upper.root)
                elif found["feature"] >= 0:
                    kids = upper.divide(node, found["feature"], found["threshold"], found["gain"])
                    left = np.array(found["left"])
                    for kid, s in zip(kids, (left, total - left)):
                        upper.tree["value"][kid] = growth.leaf(s).tolist()
                        if not growth.splits(s, depth + 1):
                            continue
                        if growth.rows(s) <= task_rows:  # what a task takes needs no sums
                            upper.root[kid] = len(upper.root)
                        else:
                            following.append((t, kid))
        waiting, depth = following, depth + 1
    return uppers


def _depths(tree: dict[str, list]) -> list[int]:
    depth = [0] * len(tree["feature"])
    for node, (left, right) in enumerate(zip(tree["left"], tree["right"])):
        if left >= 0:
            depth[left] = depth[right] = depth[node] + 1
    return depth


def _subtrees(data: DataFrame, cells: Cells | None, edges: list[np.ndarray], growth: Growth, p: int, uppers: list[_Upper]) -> DataFrame:
    """tree, root, number and the parts of a node: the nodes below those dealt to tasks.

    The nodes' rows (drawn number, number of the row, label, columns) travel in blobs, one a tree, node and many rows.
    """
    frozen, rooted = [], False
    for u in uppers:
        place = np.full(len(u.tree["feature"]), -1)
        for node, number in u.root.items():
            place[node] = number
        rooted = rooted or bool(u.root)
        deep = {number: d for node, d in enumerate(_depths(u.tree)) if (number := int(place[node])) >= 0}
        frozen.append((_arrays(u.tree), place, deep))
    tops, source = _tops(edges), cells.data if cells else data
    if not rooted:  # every node is known
        source = source.limit(0)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A value of each bin [cell, column], rows of each cell and the rows [column, row]: columns, label, number."""
        if not cells_held:
            for t in gathered(batches, GATHERED_ROWS):
                v = np.stack([t.column(c).to_numpy().view(np.float64) for c in _kept(p)])
                yield v[:p].T, np.ones(v.shape[1], dtype=np.int64), v
        else:
            for b in batches:
                for codes, n, v in read_cells(b, p, p + 2):
                    yield np.column_stack([top[c] for top, c in zip(tops, codes)]), n, v

    cells_held = cells is not None

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, n, v in pieces(batches):
            begin = np.cumsum(n) - n
            for t, (arrays, place, deep) in enumerate(frozen):
                root = place[descend(x, arrays)]
                live = np.argsort(root, kind="stable")
                live = live[np.searchsorted(root[live], 0):]  # the cells to deal, by root
                if not len(live):
                    continue
                some = n[live]
                rows = np.repeat(begin[live] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                root = np.repeat(root[live], some)
                w = drawn(v[p + 1][rows].view(np.int64), t, growth.seed) if growth.draws else np.ones(len(rows))
                if growth.draws:
                    took = np.flatnonzero(w)
                    rows, w, root = rows[took], w[took], root[took]
                if not len(w):
                    continue
                mine = np.stack([w, *(c[rows] for c in v)])
                start = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
                ends, numbers = np.append(start[1:], len(root)), root[start].tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([t] * len(start), pa.int32()), pa.array(numbers, pa.int32()), pa.array([deep[r] for r in numbers], pa.int32()),
                    pa.array([mine[:, a:b].tobytes() for a, b in zip(start, ends)], pa.binary())], ["tree", "root", "depth", "v"])

    kinds = {"feature": pa.int32(), "threshold": pa.float64(), "left": pa.int32(), "right": pa.int32(), "value": pa.list_(pa.float64()), "gain": pa.float64()}

    def grown(found: pa.Table) -> pa.Table:
        t, root, depth = (found.column(c)[0].as_py() for c in ("tree", "root", "depth"))
        rows = np.concatenate([np.frombuffer(v.as_buffer()).reshape(p + 3, -1) for v in found.column("v")], axis=1)
        rows = rows[:, np.argsort(rows[p + 2].view(np.int64), kind="stable")]  # the order in which rows arrive changes nothing
        tree = grow_rows(growth, np.ascontiguousarray(rows[1: p + 1].T), rows[p + 1], rows[0], depth, (2, t, root))
        n = len(tree["feature"])
        head = [pa.array([v] * n, pa.int32()) for v in (t, root)] + [pa.array(range(n), pa.int32())]
        return pa.table([*head, *(pa.array(tree[c], kinds[c]) for c in _NODE)], ["tree", "root", "number", *_NODE])

    return source.mapInArrow(dealt, "tree int, root int, depth int, v binary").groupBy("tree", "root").applyInArrow(
        grown, "tree int, root int, number int, feature int, threshold double, left int, right int, value array<double>, gain double")


def _kept(p: int) -> list[str]:
    return [*(f"x{j}" for j in range(p)), "y", "id"]


class ArrayForest(FittedStage):
    """A forest of few nodes, as arrays."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        trees = [(_arrays(t), np.array(t["value"])) for t in s["trees"]]

        def score(x: np.ndarray) -> np.ndarray:
            return sum(value[descend(x, tree)] for tree, value in trees) / len(trees)

        return with_outputs(df, score_matrix(df, s["features"], score), s["classification"])


class TableForest(FittedStage):
    """A forest whose nodes below the upper ones are a table."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        uppers = [(_arrays(t), np.array(t["place"]), np.array(t["value"])) for t in s["uppers"]]
        p, width = len(s["features"]), s["width"]
        names = [f"x{j}" for j in range(p)]
        # fixed row numbers: the frame is written once before its rows are dealt out
        rows = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
        narrow = rows.select("_row", *[col(c).cast("double").alias(n) for c, n in zip(s["features"], names)])
        votes = "_row long, vote array<double>"

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names])
                for t, (tree, place, value) in enumerate(uppers):
                    node = descend(x, tree)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(place[node].astype(np.int32)), b.column("_row"),
                        *(b.column(n) for n in names), pa.array(list(value[node]), pa.list_(pa.float64()))], ["tree", "root", "_row", *names, "vote"])

        fields = ", ".join(["tree int, root int, _row long", *(f"{n} double" for n in names), "vote array<double>"])
        down = narrow.mapInArrow(dealt, fields)

        def voted(mine: pa.Table, nodes: pa.Table) -> pa.Table:
            if not mine.num_rows or not nodes.num_rows:
                return mine.select(["_row", "vote"])
            nodes = nodes.sort_by("number")
            tree = {c: nodes.column(c).to_numpy() for c in _NODE[:4]}
            value = nodes.column("value").combine_chunks().flatten().to_numpy().reshape(-1, width)
            x = np.column_stack([mine.column(n).to_numpy() for n in names])
            return pa.table([mine.column("_row"), pa.array(list(value[descend(x, tree)]), pa.list_(pa.float64()))], ["_row", "vote"])

        # a subtree that many rows reach is split by their numbers, and its nodes go to every part
        parts = F.lit(s["parts"])
        left = down.withColumn("part", F.pmod(F.xxhash64("_row"), parts).cast("int"))
        right = self.tables["nodes"].withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        key = ["tree", "root", "part"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(voted, votes)
        mean = F.array(*[F.avg(F.col("vote")[k]) for k in range(width)])
        out = found.groupBy("_row").agg(mean.alias("_votes"))
        joined = rows.join(out, "_row")
        scored = with_outputs(joined, F.col("_votes"), s["classification"])
        return scored.select(*[col(c) for c in df.columns], *[c for c in ("prediction", "probability") if c in scored.columns])


def grow_forest(df: DataFrame, problem: Problem, growth: Growth, trees: int) -> ArrayForest | TableForest:
    p = len(problem.features)
    narrow = df.select(*[col(c).cast("double").alias(f"x{j}") for j, c in enumerate(problem.features)],
                       col(problem.label).cast("double").alias("y"))
    # numbers of rows are fixed by the checkpoint
    data = checkpoint(spread(narrow).withColumn("id", F.monotonically_increasing_id()))
    rows = data.count()
    task_rows = max(1, min(TASK_ROWS, TASK_CELLS // max(1, p)))
    if rows > task_rows:
        edges = bin_edges(data, [f"x{j}" for j in range(p)])
        cells = Cells(data, [f"x{j}" for j in range(p)], edges, _kept(p), rows, missing=True)
        uppers = _upper_levels(cells, growth, edges, trees, task_rows)
    else:
        edges, cells, uppers = [], None, [_Upper() for _ in range(trees)]
        for u in uppers:
            u.root[0] = 0
    nodes = checkpoint(_subtrees(data, cells, edges, growth, p, uppers))
    gains = np.zeros((trees, p))
    for t, u in enumerate(uppers):
        np.add.at(gains[t], [f for f in u.tree["feature"] if f >= 0], [g for f, g in zip(u.tree["feature"], u.tree["gain"]) if f >= 0])
    for r in nodes.filter("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():  # a row a tree and column
        gains[r["tree"], r["feature"]] += r["gain"]
    sums = gains.sum(axis=1, keepdims=True)
    mean = np.divide(gains, sums, out=np.zeros_like(gains), where=sums > 0).mean(axis=0)
    state = {"features": problem.features, "classification": problem.is_classification,
             "importances": (mean / mean.sum() if mean.sum() > 0 else mean).tolist()}
    if nodes.count() + sum(len(u.tree["feature"]) for u in uppers) <= SMALL_NODES:
        found: dict[tuple[int, int], list] = {}
        for r in nodes.collect():  # SMALL_NODES at most
            found.setdefault((r["tree"], r["root"]), []).append(r)
        return ArrayForest(state | {"trees": [_joined(t, u, found, growth) for t, u in enumerate(uppers)]})
    for u in uppers:
        u.tree["place"] = [u.root.get(n, -1) for n in range(len(u.tree["feature"]))]
        u.tree["value"] = [v or [0.0] * (growth.classes or 1) for v in u.tree["value"]]
    most = max(1, math.ceil(rows / max(1, task_rows)))
    return TableForest(state | {"uppers": [u.tree for u in uppers], "width": growth.classes or 1, "parts": min(most, 64)}, {"nodes": nodes})


def _joined(t: int, upper: _Upper, found: dict[tuple[int, int], list], growth: Growth) -> dict[str, list]:
    """One tree from its upper nodes and subtrees; a subtree's root takes the place of the upper node."""
    out = {name: list(upper.tree[name]) for name in _NODE}
    for node, root in upper.root.items():
        rows = sorted(found.get((t, root), []), key=lambda r: r["number"])
        first = len(out["feature"]) - 1  # its number 1 is the next one
        for r in rows:
            values = [r["feature"], r["threshold"], *(first + r[s] if r[s] >= 0 else -1 for s in ("left", "right")), r["value"], r["gain"]]
            for name, v in zip(_NODE, values):
                if r["number"]:
                    out[name].append(v)
                else:
                    out[name][node] = v
    out["value"] = [v if v is not None else [0.0] * (growth.classes or 1) for v in out["value"]]
    return out


def _growth(problem: Problem, params: dict, tries: int, random_cuts: bool = False, draws: bool = False) -> Growth:
    depth = params.get("max_depth")
    return Growth(problem.n_classes if problem.is_classification else 0, None if depth is None else int(depth),
                  int(params.get("min_samples_split", 2)), tries, random_cuts, draws, problem.seed)


def _some(problem: Problem) -> int:
    """Columns tried at a node of a forest: the root of their number for classes, all for numbers."""
    p = len(problem.features)
    return max(1, int(math.sqrt(p))) if problem.is_classification else p


def decision_tree(df: DataFrame, problem: Problem, params: dict) -> ArrayForest | TableForest:
    return grow_forest(df, problem, _growth(problem, params, len(problem.features)), 1)


def random_forest(df: DataFrame, problem: Problem, params: dict) -> ArrayForest | TableForest:
    return grow_forest(df, problem, _growth(problem, params, _some(problem), draws=True), int(params.get("n_estimators", 100)))


def extra_trees(df: DataFrame, problem: Problem, params: dict) -> ArrayForest | TableForest:
    return grow_forest(df, problem, _growth(problem, params, _some(problem), random_cuts=True), int(params.get("n_estimators", 100)))
