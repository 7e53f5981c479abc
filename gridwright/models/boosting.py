"""Gradient boosting on binned columns, all trees of a round grown together.

Columns become bins once: one a value where there are few, else quantiles, and
one for missing values, which go to the side of a split where they help more. A
round has one tree (numbers, two classes) or one a class, all on the gradients
of the same shared margins (softmax). A pass over the rows adds up gradient,
second derivative and rows by tree, node, column and bin inside the tasks; a few
tasks add those sums up, and the driver picks splits from one table of sums.

Growth is best first up to a number of leaves, or level by level with a largest
depth. A pass asks for all nodes that the growth may need next, so a tree of 31
leaves takes about as many passes as it is deep, and still is the tree that
splitting one leaf at a time gives. Of two siblings only the smaller is added up;
the other is the difference to their parent.

Rows of the same bins (classes: and the same label) have the same margins, so they
are combined once to a cell with its rows, mean label and squares around it, which
give the same sums. Cells travel in blocks, a row of the table each: a pass reads
arrays, not rows.

Margins are a part of the blocks. Tasks add the trees since the blocks were written,
which are renewed by a reliable checkpoint every ``RENEWED`` rounds, so a round costs
the same early and late.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.models.base import FittedStage
from gridwright.models.common import FEW_TASKS, Problem, added_up, score_matrix, with_outputs
from gridwright.session import checkpoint

#: Bins of a column, and the one of missing values behind them.
BINS, MISSING = 255, 255
#: Sums (doubles) that a pass may hold; more nodes take more passes.
CELLS_PER_PASS = 4_000_000
#: Rounds between two writings of the margins.
RENEWED = 5
#: Gains that differ by less than this share are ties, as sums of doubles depend on their order.
TIE = 1e-9
#: Cells of a block, bytes of a block and of a task's blocks, and cells that are worth a task.
BLOCK_CELLS, BLOCK_BYTES, TASK_BYTES, LEAST_CELLS = 32_768, 8_000_000, 64_000_000, 4_096
#: What a block holds: arrays of bins (column by column), labels, rows, squares, validation marks and margins.
BLOCK = {"b": np.uint8, "y": np.float64, "n": np.float64, "ss": np.float64, "held": np.bool_, "m": np.float64}


@dataclass(frozen=True)
class Rules:
    """When a tree stops, and what a split is judged by: second derivatives or rows below the squared gradients."""

    leaves: int = 31
    depth: int | None = None
    least_rows: int = 20
    least_hessian: float = 1e-3
    by_hessian: bool = True


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: np.ndarray
    right: np.ndarray


def best_split(sums: np.ndarray, edges: Sequence[np.ndarray], rules: Rules) -> Split | None:
    """The split of the largest gain from sums [column, bin, (gradient, second derivative, rows)]; ties to the first column and bin."""
    total = sums[0].sum(axis=0)
    missing = sums[:, MISSING, None, :]
    below = np.cumsum(sums[:, :MISSING], axis=1)
    left = np.stack([below, below + missing], axis=2)  # missing values to the right, to the left
    right = total - left
    weight = 1 if rules.by_hessian else 2
    bottom = [np.maximum(s[..., weight], 1e-300) for s in (left, right, total)]
    gain = left[..., 0] ** 2 / bottom[0] + right[..., 0] ** 2 / bottom[1] - total[0] ** 2 / bottom[2]
    few = np.minimum(left[..., 2], right[..., 2]) < max(1, rules.least_rows) - 0.5
    flat = np.minimum(left[..., 1], right[..., 1]) < rules.least_hessian
    gain[few | flat] = -np.inf
    places = np.arange(MISSING)[None, :]
    last = np.array([len(e) for e in edges])[:, None]
    gain[:, :, 0][places > last] = -np.inf  # behind the last bin only missing values are left
    gain[:, :, 1][places >= last] = -np.inf
    most = gain.max()
    if not most > 1e-12 * max(1.0, total[0] ** 2 / bottom[2]):
        return None
    j, cut, side = np.unravel_index(np.flatnonzero(gain.ravel() >= most * (1 - TIE))[0], gain.shape)
    if not sums[j, MISSING, 2]:  # none seen: they follow the larger part
        side = int(left[j, cut, 0, 2] >= right[j, cut, 0, 2])
    return Split(float(most), int(j), int(cut), bool(side), left[j, cut, side], right[j, cut, side])


@dataclass
class Growing:
    """A tree while it grows: nodes with their sums, best splits and, once asked for, children."""

    split: list[Split | None] = field(default_factory=lambda: [None])
    sums: list[np.ndarray | None] = field(default_factory=lambda: [None])
    total: list[np.ndarray | None] = field(default_factory=lambda: [None])
    children: list[tuple[int, int] | None] = field(default_factory=lambda: [None])
    depth: list[int] = field(default_factory=lambda: [0])

    def walk(self, rules: Rules) -> tuple[set[int], list[int]]:
        """The nodes that best-first growth splits as far as they are known, and the leaves to split next."""
        leaves, inner = [0], set()
        while len(leaves) < rules.leaves:
            open_ = [n for n in leaves if self.split[n] and (rules.depth is None or self.depth[n] < rules.depth)]
            if not open_:
                return inner, []
            most = max(self.split[n].gain for n in open_)
            node = min(n for n in open_ if self.split[n].gain >= most * (1 - TIE))
            if self.children[node] is None:
                room = rules.leaves - len(leaves)
                return inner, sorted((n for n in open_ if self.children[n] is None), key=lambda n: -self.split[n].gain)[:room]
            leaves.remove(node)
            leaves += self.children[node]
            inner.add(node)
        return inner, []

    def divide(self, node: int) -> tuple[int, int]:
        """Children of a node: the smaller one, whose sums are to be added up, and the other one."""
        found = self.split[node]
        pair = (len(self.split), len(self.split) + 1)
        self.children[node] = pair
        for total in (found.left, found.right):
            self.split.append(None), self.sums.append(None), self.total.append(total)
            self.children.append(None), self.depth.append(self.depth[node] + 1)
        return pair if found.left[2] <= found.right[2] else pair[::-1]

    def arrays(self, inner: set[int], value: Callable[[np.ndarray], float], edges: Sequence[np.ndarray]) -> dict:
        """The grown tree: nodes in order of their parents."""
        number, order = {0: 0}, [0]
        for node in order:
            if node in inner:
                for child in self.children[node]:
                    number[child] = len(order)
                    order.append(child)
        out: dict[str, list] = {n: [] for n in ("feature", "cut", "threshold", "missing_left", "left", "right", "value", "gain", "rows")}
        for node in order:
            s = self.split[node] if node in inner else None
            values = (s.feature, s.cut, _threshold(edges[s.feature], s.cut), s.missing_left, *(number[c] for c in self.children[node])) if s else (
                -1, 0, 0.0, False, -1, -1)
            for name, v in zip(out, (*values, value(self.total[node]), s.gain if s else 0.0, float(self.total[node][2]))):
                out[name].append(v)
        return out


def _threshold(edges: np.ndarray, cut: int) -> float:
    return float(edges[cut]) if cut < len(edges) else math.inf


def reached(tree: dict, goes_left: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    """The node in which every row ends; ``goes_left`` (rows, nodes) says who goes left."""
    node = np.zeros(rows, dtype=np.int64)
    live = np.arange(rows)
    while len(live):
        live = live[tree["feature"][node[live]] >= 0]
        at = node[live]
        node[live] = np.where(goes_left(live, at), tree["left"][at], tree["right"][at])
    return node


def by_bin(tree: dict, codes: np.ndarray) -> np.ndarray:
    """The node in which every row ends, by a table of each node's next one for every bin; leaves lead to themselves."""
    inner = tree["feature"] >= 0
    left = np.arange(MISSING + 1)[None, :] <= np.asarray(tree["cut"])[:, None]
    left[:, MISSING] = tree["missing_left"]
    own = np.arange(len(inner))[:, None]
    following = np.where(inner[:, None], np.where(left, tree["left"][:, None], tree["right"][:, None]), own).ravel()
    start = np.where(inner, tree["feature"], 0) * len(codes)
    flat, rows = codes.T.reshape(-1), np.arange(len(codes))
    node = np.zeros(len(codes), dtype=np.int64)
    level = np.array([0])
    while inner[level].any():
        node = following[node * (MISSING + 1) + flat[start[node] + rows]]
        level = level[inner[level]]
        level = np.concatenate([tree["left"][level], tree["right"][level]])
    return node


def by_value(tree: dict, x: np.ndarray) -> np.ndarray:
    def left(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        value = x[rows, tree["feature"][at]]
        return np.where(np.isnan(value), tree["missing_left"][at], value <= tree["threshold"][at])

    return reached(tree, left, len(x))


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """The upper edges of each column's bins but the last: between neighbouring values where there are up to ``bins``, else quantiles."""
    values = [F.nullif(col(c).cast("double"), F.lit(float("nan"))) for c in features]
    about = df.agg(*[F.approx_count_distinct(v).alias(str(i)) for i, v in enumerate(values)]).first()
    few = [about[i] <= 2 * bins for i in range(len(features))]
    grid = [i / bins for i in range(1, bins)]
    row = df.agg(*[  # a list of bounded length a column
        (F.sort_array(F.collect_set(v)) if few[i] else F.percentile_approx(v, grid, 50 * bins)).alias(str(i)) for i, v in enumerate(values)
    ]).first()
    out = []
    for i, some in enumerate(few):
        found = np.unique(np.array(row[i] or [], dtype=np.float64))
        if some and len(found) > bins:
            found = np.unique(np.quantile(found, grid, method="inverted_cdf"))
            some = False
        out.append((found[:-1] + found[1:]) / 2 if some else found)
    return out


def binned(df: DataFrame, features: Sequence[str], label: str, edges: Sequence[np.ndarray], validation: float, seed: int) -> DataFrame:
    """b (a byte a column), y, held (a row of the validation part, by the hash of its values)."""
    narrow = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)], col(label).cast("double").alias("y"))
    mark = F.pmod(F.xxhash64(F.lit(seed), *narrow.columns), F.lit(1_000_000)) < int(validation * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.empty((b.num_rows, len(edges)), dtype=np.uint8)
            for j, edge in enumerate(edges):
                x = b.column(j).to_numpy(zero_copy_only=False)
                codes[:, j] = np.where(np.isnan(x), MISSING, np.searchsorted(edge, x, side="left"))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(edges)), b.num_rows, [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([raw.cast(pa.binary()), b.column("y"), b.column("held")], ["b", "y", "held"])

    return narrow.withColumn("held", mark).mapInArrow(run, "b binary, y double, held boolean")


def combined(rows: DataFrame, classes: int) -> DataFrame:
    """b, y, n, ss, held: rows of the same bins, validation mark and class as one cell (numbers: their mean and the squares around it)."""
    if classes:
        return rows.groupBy("b", "y", "held").agg(F.count("*").cast("double").alias("n")).select("b", "y", "n", F.lit(0.0).alias("ss"), "held")
    return rows.groupBy("b", "held").agg(F.avg("y").alias("mean"), F.count("*").cast("double").alias("n"), F.var_pop("y").alias("v")).select(
        "b", F.col("mean").alias("y"), "n", (F.col("v") * F.col("n")).alias("ss"), "held")


def blocks(cells: DataFrame, columns: int, base: np.ndarray) -> DataFrame:
    """The cells as blocks of bounded size with the first margins."""
    cells = checkpoint(cells)
    n, wide = cells.count(), columns + 8 * (3 + len(base)) + 1
    least = min(LEAST_CELLS, max(1, BLOCK_BYTES // wide))
    parts = min(n // least + 1, max(cells.sparkSession.sparkContext.defaultParallelism, n * wide // TASK_BYTES))
    most = max(1, min(BLOCK_CELLS, BLOCK_BYTES // wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting)
            codes = np.frombuffer(b"".join(t.column("b").to_pylist()), dtype=np.uint8).reshape(t.num_rows, columns)
            arrays = {c: t.column(c).to_numpy().astype(BLOCK[c]) for c in ("y", "n", "ss", "held")}
            arrays |= {"b": np.ascontiguousarray(codes.T), "m": np.tile(base, (t.num_rows, 1))}
            return pa.RecordBatch.from_arrays([pa.array([arrays[c].tobytes()], pa.binary()) for c in BLOCK], list(BLOCK))

        for b in batches:
            for at in range(0, b.num_rows, most):
                some = b.slice(at, most)
                if waiting and sum(w.num_rows for w in waiting) + some.num_rows > most:
                    yield block()
                    waiting.clear()
                waiting.append(some)
        if waiting:
            yield block()

    return checkpoint(cells.repartition(parts).mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK)))


@dataclass(frozen=True)
class Loss:
    """Margins to gradients and second derivatives [row, tree], and to the loss of each row."""

    kind: str
    classes: int = 0

    def slopes(self, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "squared":
            return m - y[:, None], np.ones_like(m)
        p = self.shares(m)
        own = y[:, None] == (np.arange(self.classes) if self.kind == "softmax" else 1)
        return p - own, p * (1 - p)

    def shares(self, m: np.ndarray) -> np.ndarray:
        if self.kind == "logistic":
            return 1 / (1 + np.exp(-np.clip(m, -700, 700)))
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def losses(self, m: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.kind == "squared":
            return (m[:, 0] - y) ** 2 / 2
        if self.kind == "logistic":
            return np.logaddexp(0, m[:, 0]) - y * m[:, 0]
        top = m.max(axis=1)
        return top + np.log(np.exp(m - top[:, None]).sum(axis=1)) - m[np.arange(len(y)), y.astype(int)]


def _arrays(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins, labels, rows, squares, validation marks and margins of each block."""
    for i in range(batch.num_rows):
        codes, y, n, ss, held, m = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind) for c, kind in BLOCK.items())
        yield codes.reshape(columns, len(y)).T, y, n, ss, held, m.reshape(len(y), -1)


class Booster:
    """One fit: the blocks of cells, the trees so far and the passes over them."""

    def __init__(self, data: DataFrame, edges: list[np.ndarray], loss: Loss, rules: Rules, trees: int):
        self.data, self.edges, self.loss, self.rules, self.trees = data, edges, loss, rules, trees
        self.recent: list[dict] = []  # trees that the margins in the table lack, each with its place ``k``
        self.rows, self.held_loss = 0.0, math.nan
        self.tasks = data.rdd.getNumPartitions()

    def _margins(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        recent = [{n: np.array(v) if isinstance(v, list) else v for n, v in t.items()} for t in self.recent]

        def margins(codes: np.ndarray, m: np.ndarray) -> np.ndarray:
            m = m.copy()
            for tree in recent:
                m[:, tree["k"]] += tree["value"][by_bin(tree, codes)]
            return m

        return margins

    def renew(self) -> None:
        """Write the margins with the trees since the last time."""
        margins, p = self._margins(), len(self.edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    renewed = pa.array([margins(codes, m).tobytes() for codes, *_, m in _arrays(b, p)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], renewed], list(BLOCK))

        self.data = checkpoint(self.data.mapInArrow(run, self.data.schema))
        self.recent = []

    def add_up(self, grown: list[Growing], asked: list[tuple[int, int]]) -> np.ndarray:
        """Sums [request, column, bin, 3] of some (tree, node); the loss of the validation rows goes along."""
        margins, loss, p = self._margins(), self.loss, len(self.edges)
        frozen = []
        for k, tree in enumerate(grown):
            inner = {n for n, c in enumerate(tree.children) if c}
            number = np.full(len(tree.split), -1)
            for place, (t, node) in enumerate(asked):
                if t == k:
                    number[node] = place
            arrays = {name: np.array([getattr(tree.split[n], name) if n in inner else 0 for n in range(len(tree.split))], dtype=np.int64)
                      for name in ("feature", "cut", "missing_left")}
            arrays["feature"][[n for n in range(len(tree.split)) if n not in inner]] = -1
            arrays |= {side: np.array([c[i] if c else -1 for c in tree.children]) for i, side in enumerate(("left", "right"))}
            mine = number[number >= 0]
            if len(mine):  # requests of a tree stand together
                first = int(mine.min())
                frozen.append((k, arrays, np.where(number >= 0, number - first, -1), first, int(mine.max()) + 1 - first))
        # a column's bins, with one for missing values behind them, stand together; bins that a column lacks take no room
        widths = [len(e) + 2 for e in self.edges]
        begin = np.concatenate([[0], np.cumsum(widths)]).astype(int)
        size = len(asked) * int(begin[-1])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, held_loss, held_rows, rows = np.zeros((3, len(asked), int(begin[-1]))), 0.0, 0.0, 0.0
            for b in batches:
                for codes, y, n, ss, held, m in _arrays(b, p):
                    m = margins(codes, m)
                    if held.any():
                        held_loss += (loss.losses(m[held], y[held]) * n[held] + ss[held] / 2).sum()
                        held_rows += n[held].sum()
                        codes, y, n, m = codes[~held], y[~held], n[~held], m[~held]
                    rows += n.sum()
                    g, h = (s * n[:, None] for s in loss.slopes(m, y))
                    for k, arrays, number, first, nodes in frozen:
                        slot = number[by_bin(arrays, codes)]
                        live = np.flatnonzero(slot >= 0)
                        slot = slot[live]
                        for j in range(p if len(live) else 0):
                            wide = widths[j]
                            cell = slot * wide + np.minimum(codes[live, j], wide - 1)  # the last: missing
                            for i, values in enumerate((g[live, k], h[live, k], n[live])):
                                out[i, first: first + nodes, begin[j]: begin[j + 1]] += np.bincount(cell, values, nodes * wide).reshape(nodes, wide)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([out.ravel(), [held_loss, held_rows, rows]])])], names=["v"])

        partials = self.data.mapInArrow(partial, "v array<double>")
        if self.tasks > FEW_TASKS:
            partials = added_up(partials, 3 * size + 3)
        parts = partials.toArrow().column("v").combine_chunks()  # a few rows
        whole = parts.flatten().to_numpy().reshape(-1, 3 * size + 3).sum(axis=0)
        held_loss, held_rows, self.rows = whole[-3:]
        self.held_loss = held_loss / held_rows if held_rows else math.nan
        found = whole[:-3].reshape(3, len(asked), int(begin[-1])).transpose(1, 2, 0)
        sums = np.zeros((len(asked), p, BINS + 1, 3))
        for j, wide in enumerate(widths):
            sums[:, j, : wide - 1], sums[:, j, MISSING] = found[:, begin[j]: begin[j + 1] - 1], found[:, begin[j + 1] - 1]
        return sums

    def round(self, value: Callable[[np.ndarray], float]) -> list[dict]:
        """The next trees, one a margin."""
        grown = [Growing() for _ in range(self.trees)]
        per_pass = max(1, CELLS_PER_PASS // (3 * (BINS + 1) * max(1, len(self.edges))))
        asked = [(k, 0) for k in range(self.trees)]
        others: dict[tuple[int, int], tuple[int, int]] = {}
        while asked:
            for at in range(0, len(asked), per_pass):
                some = asked[at: at + per_pass]
                for (k, node), sums in zip(some, self.add_up(grown, some)):
                    tree = grown[k]
                    tree.sums[node] = sums
                    if (k, node) in others:
                        other, parent = others[k, node]
                        tree.sums[other] = tree.sums[parent] - sums
                        tree.sums[other][..., 1:] = np.maximum(tree.sums[other][..., 1:], 0.0)
                        tree.sums[parent] = None
                    for n in (node, others.get((k, node), (node,))[0]):
                        tree.total[n] = tree.sums[n][0].sum(axis=0) if tree.total[n] is None else tree.total[n]
                        tree.split[n] = best_split(tree.sums[n], self.edges, self.rules)
            asked, others = [], {}
            for k, tree in enumerate(grown):
                following = [tree.walk(self.rules)[1]]
                while following[-1]:
                    for node in following[-1]:
                        small, large = tree.divide(node)
                        if tree.depth[small] != self.rules.depth:  # the deepest nodes are leaves, whose totals are known
                            asked.append((k, small))
                            others[k, small] = (large, node)
                    following.append([] if any(t == k for t, _ in asked) else tree.walk(self.rules)[1])
        made = [tree.arrays(tree.walk(self.rules)[0], value, self.edges) | {"k": k} for k, tree in enumerate(grown)]
        self.recent += made
        return made


class BoostedTrees(FittedStage):
    """Margins from added trees: a number, or class shares by the logistic or softmax function."""

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        trees = [{n: np.array(v) if isinstance(v, list) else v for n, v in t.items()} for t in s["trees"]]
        base, loss = np.array(s["base"]), Loss(s["loss"], s["classes"])

        def score(x: np.ndarray) -> np.ndarray:
            m = np.tile(base, (len(x), 1))
            for t in trees:
                m[:, t["k"]] += t["value"][by_value(t, x)]
            if loss.kind == "squared":
                return m
            p = loss.shares(m)
            return np.column_stack([1 - p, p]) if loss.kind == "logistic" else p

        return with_outputs(df, score_matrix(df, s["features"], score), loss.kind != "squared")


def boost(df: DataFrame, problem: Problem, rules: Rules, rounds: int, rate: float, rows_below: str = "hessian",
          early_stopping: bool | str = False, validation: float = 0.1, patience: int = 10, tolerance: float = 1e-7) -> BoostedTrees:
    """``rounds`` rounds at learning rate ``rate``.

    With ``early_stopping`` a part ``validation`` of the rows, marked by their hash,
    is kept from the trees, and boosting ends when its loss hasn't fallen for
    ``patience`` rounds; "auto" does so above 10,000 rows.
    """
    classes = problem.n_classes if problem.is_classification else 0
    counts = df.groupBy(col(problem.label).cast("double").alias("y")).count().collect() if classes else []  # a row a class
    if classes:
        n = sum(r["count"] for r in counts)
        share = np.zeros(classes)
        for r in counts:
            share[int(r["y"])] = max(r["count"], 1e-9) / max(n, 1)
        share = np.clip(share, 1e-12, 1.0)
        loss = Loss("logistic", 2) if classes == 2 else Loss("softmax", classes)
        base = np.array([math.log(share[1] / share[0])]) if classes == 2 else np.log(share) - np.log(share).mean()
    else:
        row = df.agg(F.avg(col(problem.label).cast("double")).alias("mean"), F.count("*").alias("n")).first()
        loss, base, n = Loss("squared"), np.array([row["mean"] or 0.0]), row["n"]
    stops = n > 10_000 if early_stopping == "auto" else bool(early_stopping)
    edges = bin_edges(df, problem.features)
    rows = binned(df, problem.features, problem.label, edges, validation if stops else 0.0, problem.seed)
    data = blocks(combined(rows, classes), len(edges), base)
    booster = Booster(data, edges, loss, rules, len(base))
    scale = rate * ((classes - 1) / classes if rows_below == "rows" and classes > 2 else 1.0)

    def value(total: np.ndarray) -> float:
        return float(-scale * total[0] / total[1]) if total[1] > 1e-300 else 0.0

    trees: list[dict] = []
    losses: list[float] = []
    for number in range(rounds):
        made = booster.round(value)
        losses.append(booster.held_loss)  # before this round
        if stops and len(losses) > patience and not any(x < losses[-patience - 1] - tolerance for x in losses[-patience:]):
            break
        trees += made
        if (number + 1) % RENEWED == 0 and number + 1 < rounds:
            booster.renew()
    gains = np.zeros(len(problem.features))
    for t in trees:
        np.add.at(gains, [f for f in t["feature"] if f >= 0], [g for f, g in zip(t["feature"], t["gain"]) if f >= 0])
    return BoostedTrees({"features": problem.features, "trees": trees, "base": base.tolist(), "loss": loss.kind, "classes": classes,
                         "importances": (gains / gains.sum() if gains.sum() > 0 else gains).tolist()})


def gradient_boosting(df: DataFrame, problem: Problem, params: dict) -> BoostedTrees:
    """Trees of depth three, splits by the drop of the squared error of the gradients, leaves by a Newton step."""
    rules = Rules(leaves=2 ** int(params.get("max_depth", 3)), depth=int(params.get("max_depth", 3)), least_rows=1, least_hessian=0.0, by_hessian=False)
    return boost(df, problem, rules, int(params.get("n_estimators", 100)), float(params.get("learning_rate", 0.1)), "rows")


def histogram_boosting(df: DataFrame, problem: Problem, params: dict) -> BoostedTrees:
    """Trees of up to 31 leaves, the best leaf first, missing values in a bin of their own, early end by a validation part."""
    rules = Rules(leaves=int(params.get("max_leaf_nodes", 31)), depth=params.get("max_depth"), least_rows=int(params.get("min_samples_leaf", 20)))
    return boost(df, problem, rules, int(params.get("max_iter", 100)), float(params.get("learning_rate", 0.1)),
                 early_stopping=params.get("early_stopping", "auto"), validation=float(params.get("validation_fraction", 0.1)),
                 patience=int(params.get("n_iter_no_change", 10)), tolerance=float(params.get("tol", 1e-7)))
