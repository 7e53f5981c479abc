"""Exact k-nearest-neighbour join without comparing every pair.

Donor rows are cut into cells: up to three coordinates by their quantile bins,
more by the balls of a pivot tree over all coordinates. A query
first visits part of its own cell, and of the nearest others until it has met k
donors, which bounds its k-th distance; afterwards it visits only the cells whose
nearest possible point lies within that bound. Big
cells are cut into chunks and busy ones serve their queries in several groups,
so no group grows with a hot value. The result is exact: cells are skipped only
by a true lower bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.operators.pivots import PivotTree
from gridwright.session import checkpoint

#: Up to so many columns, quantile cells bound every one; beyond, balls do.
BOXED_COLUMNS = 3
#: Rows that a pivot tree is grown on: so many a leaf, and in all at most.
SAMPLE_A_LEAF, SAMPLE_ROWS = 32, 50_000
#: Numbers of exact distances worked out at once; from so many columns on rough distances come first, for so many queries at once,
#: in tiles of so many donors, below a size that squares and single precision hold; queries with more possible neighbours go the exact way.
EXACT_NUMBERS, ROUGH_COLUMNS, ROUGH_ROWS, TILE, MOST_ROUGH, MOST_MAYBE = 1 << 17, 8, 64, 4096, 1e30, 256
#: Blocks of queries that a search makes for every core, of so many queries at least.
BLOCKS_A_CORE, LEAST_QUERIES = 4, 256
METRICS = ("euclidean", "manhattan", "nan_euclidean")
OUT = "qid string, did string, distance double, v double"


def distances(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Distance matrix, features added left to right."""
    total = np.zeros((len(q), len(d)))
    shared = np.zeros((len(q), len(d))) if metric == "nan_euclidean" else None
    for j in range(q.shape[1]):
        gap = q[:, j, None] - d[None, :, j]
        if metric == "manhattan":
            total += np.abs(gap)
        elif metric == "euclidean":
            total += gap * gap
        else:
            seen = ~np.isnan(gap)
            shared += seen
            total += np.where(seen, gap * gap, 0.0)
    if metric == "manhattan":
        return total
    if metric == "euclidean":
        return np.sqrt(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total * (q.shape[1] / shared)), np.nan)


def _pair_distances(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``q`` to that of ``d`` at its place, features added left to right as in ``distances``."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        gap = q[:, j] - d[:, j]
        total += np.abs(gap) if metric == "manhattan" else gap * gap
    return total if metric == "manhattan" else np.sqrt(total)


def _kth(m: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest number of every row, infinite where there are fewer (NaN don't count)."""
    if m.shape[1] <= k:
        return np.full(len(m), np.inf)
    kth = np.partition(m, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(kth), np.inf, kth)


def _first(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of every row's k smallest numbers, ties by column; NaN left out."""
    kth = _kth(m, k)[:, None]
    keep = m <= kth
    for i in np.flatnonzero(keep.sum(axis=1) > k):
        tied = np.flatnonzero(m[i] == kth[i])
        keep[i, tied[k - int((m[i] < kth[i]).sum()):]] = False
    return np.nonzero(keep)


class _Donors:
    """Donor rows and a cheap distance that is off by a known amount at most.

    Squared distances come from one matrix product, sums of absolute gaps from
    single precision. Both are about the donors' mean. What may be among the k
    nearest by them is compared again exactly; tables of few columns, missing
    or huge values take exact distances at once.
    """

    def __init__(self, x: np.ndarray, metric: str):
        self.x, self.metric, self.rough = x, metric, False
        if metric == "nan_euclidean" or x.shape[1] < ROUGH_COLUMNS:
            return
        with np.errstate(over="ignore", invalid="ignore"):
            self.mean = x.mean(axis=0)
            near = x - self.mean
            self.size = np.abs(near).sum(axis=1) if metric == "manhattan" else (near * near).sum(axis=1)
        self.largest = float(self.size.max())
        self.rough = bool(self.largest < MOST_ROUGH)  # false where it is NaN
        if self.rough:
            self.turned = np.ascontiguousarray(near.T, dtype=np.float32 if metric == "manhattan" else np.float64)

    def _rough(self, q: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rough distances (squared ones but for ``manhattan``) and by how much they may be off."""
        wide = q.shape[1] + 8
        if self.metric == "euclidean":
            return size[:, None] + self.size[None, :] - 2.0 * (q @ self.turned), wide * 2.0 ** -50 * (size + self.largest)
        out = np.zeros((len(q), self.turned.shape[1]), dtype=np.float32)
        q = q.astype(np.float32)
        for at in range(0, out.shape[1], TILE):
            total = out[:, at:at + TILE]
            gap = np.empty_like(total)
            for j, row in enumerate(self.turned[:, at:at + TILE]):
                np.subtract(q[:, j, None], row[None, :], out=gap)
                np.abs(gap, out=gap)
                total += gap
        return out, wide * 2.0 ** -22 * (size + self.largest)

    def _exact(self, q: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, EXACT_NUMBERS // len(self.x))
        for start in range(0, len(rows), step):
            some = rows[start:start + step]
            m = distances(q[some], self.x, self.metric)
            qi, di = _first(m, k)
            yield some[qi], di, m[qi, di]

    def nearest(self, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of queries and donors and their distances: the k nearest of every query, ties by donor number."""
        if not self.rough:
            yield from self._exact(q, np.arange(len(q)), k)
            return
        for start in range(0, len(q), ROUGH_ROWS):
            part = q[start:start + ROUGH_ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                near = part - self.mean
                size = np.abs(near).sum(axis=1) if self.metric == "manhattan" else (near * near).sum(axis=1)
            plain = ~(size < MOST_ROUGH)
            rough, off = self._rough(np.where(plain[:, None], 0.0, near), np.where(plain, 0.0, size))
            maybe = rough <= (_kth(rough, k) + 2.0 * off)[:, None]
            plain |= maybe.sum(axis=1) > MOST_MAYBE + k  # many ties
            maybe[plain] = False
            qi, di = np.nonzero(maybe)
            distance = _pair_distances(part[qi], self.x[di], self.metric)
            order = np.lexsort((di, distance, qi))
            qi, di, distance = qi[order], di[order], distance[order]
            first = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
            yield start + qi[first], di[first], distance[first]
            if plain.any():
                yield from self._exact(q, start + np.flatnonzero(plain), k)


def _nearest(q: pd.DataFrame, d: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """Top k donors of every query row of one block, ties by donor id."""
    parts = [pd.DataFrame({"qid": [], "did": [], "distance": [], "v": []}).astype(
        {"qid": str, "did": str, "distance": float, "v": float})]
    if not len(q) or not len(d):
        return parts[0]
    d = d.sort_values("did", kind="stable")
    donors = _Donors(np.stack(d["x"].to_numpy()).astype("float64"), metric)
    ids, payload = d["did"].to_numpy(), d["v"].to_numpy()
    qx = np.stack(q["x"].to_numpy()).astype("float64")
    qids = q["qid"].to_numpy()
    found = [pd.DataFrame({"qid": qids[qi], "did": ids[di], "distance": distance, "v": payload[di]})
             for qi, di, distance in donors.nearest(qx, k)]
    return pd.concat([f for f in found if len(f)] or parts, ignore_index=True)


class CellGrid:
    """Quantile cells over a few coordinates and the bounds between them."""

    def __init__(self, axes: list[int], cuts: list[np.ndarray], metric: str = "euclidean"):
        self.axes, self.cuts, self.metric = axes, cuts, metric
        self.size = int(np.prod([len(c) + 2 for c in cuts])) if cuts else 1

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Cell number of every row; bin 0 of an axis takes the missing values."""
        out = np.zeros(len(x), dtype="int64")
        for axis, cut in zip(self.axes, self.cuts):
            v = x[:, axis]
            slot = np.where(np.isnan(v), 0, np.searchsorted(cut, v, side="right") + 1)
            out = out * (len(cut) + 2) + slot
        return out

    @property
    def splits(self) -> bool:
        return bool(self.axes)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cell(x), np.zeros(len(x))

    def bounded_by(self, near: dict[int, float], far: dict[int, float]) -> CellGrid:
        return self  # a cell is its own bound

    def reach(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every row and cell: the rank by which cells are opened (a row's own first), and the least possible distance."""
        low = self.lower_bounds(x, cells, self.metric)
        return np.where(cells[None, :] == self.cell(x)[:, None], -1.0, low), low

    def lower_bounds(self, x: np.ndarray, cells: np.ndarray, metric: str) -> np.ndarray:
        """Smallest distance any point of a cell can have to each row."""
        total = np.zeros((len(x), len(cells)))
        rest = cells.copy()
        for axis, cut in reversed(list(zip(self.axes, self.cuts))):
            slot = rest % (len(cut) + 2)
            rest = rest // (len(cut) + 2)
            edges = np.concatenate([[-np.inf], cut, [np.inf]])
            lo = np.where(slot == 0, -np.inf, edges[np.maximum(slot - 1, 0)])
            hi = np.where(slot == 0, np.inf, edges[np.maximum(slot, 1)])
            v = x[:, axis, None]
            gap = np.maximum(np.maximum(lo[None, :] - v, v - hi[None, :]), 0.0)
            gap = np.where(np.isnan(gap), 0.0, gap)
            total += gap if metric == "manhattan" else gap * gap
        # a hair below the true bound, so that rounding never hides a tie
        return (total if metric == "manhattan" else np.sqrt(total)) * (1 - 1e-9)


def build_grid(donors: DataFrame, n: int, width: int, metric: str, rows_per_cell: int, max_cells: int) -> CellGrid:
    cells = min(max_cells, n // max(1, rows_per_cell))
    if cells < 2 or width == 0:
        return CellGrid([], [])
    spread = donors.agg(*[
        F.stddev_pop(F.nullif(F.col("x")[j], F.lit(float("nan")))).alias(str(j)) for j in range(width)
    ]).first()
    ranked = sorted(range(width), key=lambda j: -(spread[j] or 0.0))
    axes = ranked[: max(1, min(3, width, int(math.log2(cells))))]
    bins = max(2, round(cells ** (1 / len(axes))))
    grid = [i / bins for i in range(1, bins)]
    row = donors.agg(*[
        F.percentile_approx(F.nullif(F.col("x")[j], F.lit(float("nan"))), grid, 50 * bins).alias(str(j))
        for j in axes
    ]).first()
    cuts = [np.array(sorted(set(row[i] or []))) for i in range(len(axes))]
    return CellGrid(axes, cuts, metric)


def build_tree(donors: DataFrame, n: int, metric: str, rows_per_cell: int, max_cells: int) -> PivotTree:
    """A pivot tree grown on the donors with the lowest hashes, ``SAMPLE_ROWS`` at most."""
    leaves = min(max_cells, n // max(1, rows_per_cell))
    if leaves < 2:
        return PivotTree(metric)
    wanted = min(SAMPLE_ROWS, SAMPLE_A_LEAF * leaves)
    sample = donors.orderBy(F.xxhash64("did"), "did").limit(wanted).select("x").toPandas()["x"]
    return PivotTree.grown(np.stack(sample.to_numpy()).astype("float64"), leaves, metric)


def _with_cell(df: DataFrame, grid: CellGrid | PivotTree) -> DataFrame:
    """With the ``cell`` of every row, and how ``far`` it is from the cell's centre."""
    if not grid.splits:
        return df.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(0.0)})

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, far = grid.place(np.stack(b["x"].to_numpy()).astype("float64"))
                yield b.assign(cell=cell, far=far)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(tag, f"{fields}, cell bigint, far double")


def knn_join(
    queries: DataFrame,
    donors: DataFrame,
    k: int,
    metric: str = "euclidean",
    rows_per_cell: int = 20_000,
    max_cells: int = 4096,
    chunk_rows: int = 20_000,
    query_rows: int = 20_000,
    visits: dict[str, int] | None = None,
) -> DataFrame:
    """The k nearest donors of every query: (qid, rank, did, distance, v).

    ``queries`` has (qid string, x array<double>), ``donors`` (did string,
    x array<double>, v double: a value to carry along); missing coordinates are NaN and allowed with
    ``nan_euclidean`` only. Ties are broken by donor id. ``visits`` is given the
    number of donor blocks, of queries and of the blocks that queries visited.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    queries = queries.select("qid", "x")
    donors = donors.select("did", "x", "v")
    n = donors.count()
    head = donors.select(F.size("x")).first()
    width = head[0] if head else 0
    if width <= BOXED_COLUMNS:
        grid: CellGrid | PivotTree = build_grid(donors, n, width, metric, rows_per_cell, max_cells)
    else:
        grid = build_tree(donors, n, metric, rows_per_cell, max_cells)
    donors = _with_cell(donors, grid)
    if grid.splits:
        donors = checkpoint(donors)
        sizes = donors.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()
        counts = {r["cell"]: r["n"] for r in sizes}
        grid = grid.bounded_by({r["cell"]: r["near"] for r in sizes}, {r["cell"]: r["far"] for r in sizes})
    else:
        counts = {0: n}
    donors = donors.drop("far")
    chunks = {c: max(1, math.ceil(m / chunk_rows)) for c, m in counts.items()}
    if grid.splits:
        donors = donors.join(_lookup(donors.sparkSession, chunks, "n_chunks"), "cell")
    else:
        donors = donors.withColumn("n_chunks", F.lit(chunks[0]))
    donors = donors.withColumn("chunk", F.pmod(F.xxhash64("did"), F.col("n_chunks")).cast("int")).drop("n_chunks")
    cells = np.array(sorted(counts), dtype="int64")
    parts = {c: chunks[c] for c in counts}
    # donors in the first chunk of each cell
    opening = np.array([counts[c] / parts[c] for c in cells])

    def reach(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which cells a query visits first: its own, then the nearest ones, until they hold k donors; and the bounds of all."""
        rank, lower = grid.reach(x, cells)
        order = np.argsort(rank, axis=1, kind="stable")
        held = np.cumsum(opening[order], axis=1)
        wanted = held - opening[order] < k
        out = np.zeros(rank.shape, dtype=bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out, lower

    home = queries
    if grid.splits:
        home = checkpoint(home)

        def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s in range(0, len(b), 1024):
                    part = b.iloc[s:s + 1024]
                    x = np.stack(part["x"].to_numpy()).astype("float64")
                    qi, ci = np.nonzero(reach(x)[0])
                    yield pd.DataFrame({"qid": part["qid"].to_numpy()[qi], "x": part["x"].to_numpy()[qi], "cell": cells[ci]})

        opened = home.mapInPandas(begin, "qid string, x array<double>, cell bigint")
    else:
        opened = home.withColumn("cell", F.lit(0).cast("long"))
    # 1. the nearest cells bound the k-th distance
    opened = checkpoint(opened.withColumn("chunk", F.lit(0)))
    first = _search(opened, donors, k, metric, query_rows)
    if visits is not None:
        visits |= {"blocks": sum(chunks.values()), "queries": queries.count(), "visited": opened.count()}
    only_one = len(counts) == 1 and sum(chunks.values()) == 1 and not grid.splits
    if only_one:
        found = first
    else:
        first = checkpoint(first)
        # the k-th of what was found; several cells give up to k each
        found_so_far = F.array_sort(F.collect_list("distance"))
        bound = first.groupBy("qid").agg(found_so_far.alias("found"))
        bounded = home.join(bound, "qid", "left").select(
            "qid", "x",
            F.when(F.size("found") >= k, F.get("found", F.lit(k - 1))).otherwise(float("inf")).alias("far"),
        )

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s in range(0, len(b), 1024):
                    part = b.iloc[s:s + 1024]
                    x = np.stack(part["x"].to_numpy()).astype("float64")
                    seen, lower = reach(x) if grid.splits else (np.ones((len(x), 1), dtype=bool), np.zeros((len(x), 1)))
                    qi, ci = np.nonzero(lower <= part["far"].to_numpy()[:, None])
                    if not len(qi):
                        continue
                    reps = np.array([parts[c] for c in cells[ci]])
                    visited = np.repeat(seen[qi, ci], reps)
                    qi, cell = np.repeat(qi, reps), np.repeat(cells[ci], reps)
                    chunk = np.concatenate([np.arange(m) for m in reps])
                    new = ~(visited & (chunk == 0))
                    rows = part.iloc[qi[new]]
                    yield pd.DataFrame({
                        "qid": rows["qid"].to_numpy(), "x": rows["x"].to_numpy(),
                        "cell": cell[new], "chunk": chunk[new].astype("int32"),
                    })

        routed = bounded.mapInPandas(route, "qid string, x array<double>, cell bigint, chunk int")
        routed = checkpoint(routed)
        second = _search(routed, donors, k, metric, query_rows)
        if visits is not None:
            visits["visited"] += routed.count()
        found = first.unionByName(second)
    w = Window.partitionBy("qid").orderBy("distance", "did")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _lookup(spark, values: dict[int, int], name: str) -> DataFrame:
    """Per-cell numbers as a frame; at most ``max_cells``-many rows, so broadcast."""
    rows = [(int(c), int(v)) for c, v in values.items()]
    return F.broadcast(spark.createDataFrame(rows, f"cell bigint, {name} int"))


def _search(queries: DataFrame, donors: DataFrame, k: int, metric: str, query_rows: int) -> DataFrame:
    """Compare checkpointed queries with donors block by block and keep k per query and block."""
    # blocks are few bytes and much work: a few for every core, in as many tasks as named (Spark would join those of few bytes)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    query_rows = min(query_rows, max(LEAST_QUERIES, math.ceil(queries.count() / (BLOCKS_A_CORE * cores))))
    busy = queries.groupBy("cell", "chunk").count()
    splits = checkpoint(busy.select(
        "cell", "chunk", F.ceil(F.col("count") / query_rows).cast("int").alias("splits")
    ))  # at most one row per donor block
    blocks = splits.agg(F.sum("splits")).first()[0] or 1
    shuffled = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(blocks, max(BLOCKS_A_CORE * cores, shuffled))
    q = queries.join(splits, ["cell", "chunk"]).withColumn(
        "part", F.pmod(F.xxhash64("qid"), F.col("splits")).cast("int")
    )
    d = donors.join(splits, ["cell", "chunk"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
    )
    block = ["cell", "chunk", "part"]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k, metric)

    q, d = q.repartition(tasks, *block), d.repartition(tasks, *block)
    return q.groupBy(*block).cogroup(d.groupBy(*block)).applyInPandas(nearest, OUT)


def feature_array(df: DataFrame, features: Sequence[str]):
    """Features as one array of doubles, missing values as NaN."""
    return F.array(*[
        F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in features
    ])


def impute_nearest(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    k: int = 5,
    donors: DataFrame | None = None,
    means: dict[str, float] | None = None,
    **limits,
) -> DataFrame:
    """Fill gaps with the mean of the k nearest rows that have the value.

    Distances use the coordinates two rows share, scaled up to all columns.
    Columns are filled from the original values, so their order is irrelevant.
    """
    columns = list(columns)
    donors = df if donors is None else donors
    if means is None:
        row = donors.agg(*[F.avg(col(c).cast("double")).alias(str(i)) for i, c in enumerate(columns)]).first()
        means = {c: row[i] for i, c in enumerate(columns)}
    gaps = df.agg(*[F.count_if(col(c).isNull()).alias(str(i)) for i, c in enumerate(columns)]).first()
    filled = []
    for i, c in enumerate(columns):
        if not gaps[i]:
            continue
        q = df.filter(col(c).isNull()).select(
            col(key).cast("string").alias("qid"), feature_array(df, columns).alias("x"))
        d = donors.filter(col(c).isNotNull()).select(
            col(key).cast("string").alias("did"), feature_array(df, columns).alias("x"),
            col(c).cast("double").alias("v"))
        near = knn_join(q, d, k, "nan_euclidean", **limits)
        filled.append(
            near.groupBy("qid").agg(F.avg("v").alias("v"))
            .select("qid", F.lit(c).alias("column"), "v")
        )
    if not filled:
        return df.select(*[
            col(x).cast("double").alias(x) if x in columns else col(x) for x in df.columns])
    long = filled[0]
    for part in filled[1:]:
        long = long.unionByName(part)
    wide = long.groupBy("qid").agg(F.map_from_entries(
        F.collect_list(F.struct("column", "v"))).alias("_fill"))  # one entry per gap of a row
    joined = df.join(wide, col(key).cast("string") == F.col("qid"), "left")
    return joined.select(*[
        F.coalesce(col(x).cast("double"), F.col("_fill")[x], F.lit(means[x])).alias(x)
        if x in columns else col(x)
        for x in df.columns
    ])
