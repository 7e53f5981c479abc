"""Exact top-k by inner product as a Voronoi join.

1. Pivots: a sample of vectors (``rows_per_cell`` sets how many, ``most_pivots``
   at most), chosen by the hashes of their ids. Every vector belongs to the cell
   of its nearest pivot.
2. Summaries: each cell's number of vectors and its radius r around the pivot p.
   For a query q they bound every score in the cell: q.p - |q| r <= q.x <= q.p + |q| r.
3. A first round solves each query in its home cell. The k-th score found, or the
   k-th that the lower bounds grant if that is higher, is the query's threshold.
4. A second round takes each query to those other cells only whose upper bound
   reaches the threshold.
5. Work is done on tiles of up to about ``TILE`` queries and about as many vectors
   of a cell. Tiles are queries of one home cell, or of several whose pivots follow
   each other from neighbour to neighbour; big cells are split by hash, queries and
   vectors alike, so no task holds a whole cell or all queries. Which parts of
   which cells a tile visits is worked out first, and only those vectors are
   copied to it. Tiles give their k best, which are merged.

Scores are exact integers (they must fit in a long); ties go to the smaller id.

Defined cases: vectors that are null or hold a null or non-finite component take
no part, neither do rows with a null id; vectors of another length than the
query's are no candidates, nor are rows with the query's id; repeated rows are
candidates each; a query without candidates has no result; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.frames import column, released, written

#: Most queries, and about the most vectors, that one task compares.
TILE = 8192
#: Visits (a tile to a part of a cell) that are broadcast; of more, the vectors are joined to them by a shuffle.
BROADCAST_VISITS = 100_000
#: Bounds are widened by this share against rounding.
_SLACK = 1e-9


def scaled(vector: str, by: int) -> Column:
    """Each component x as floor(by * x), x as a double; null if one is null or not finite."""
    whole = F.transform(column(vector), lambda x: F.floor(x.cast("double") * by).cast("long"))
    fine = F.forall(column(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, whole)


def _matrix(vectors: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    if rows is not None:
        vectors = vectors.take(pa.array(rows))
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def _lengths(vectors: pa.Array) -> np.ndarray:
    return pc.list_value_length(vectors).to_numpy(zero_copy_only=False)


class Cells:
    """Pivots by vector length with the summaries of their cells; cell numbers are unique over all lengths."""

    def __init__(self, pivots: list[list[int]], lengths: list[int]):
        self.pivots: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        total = 0
        for n in sorted(set(lengths)):
            rows = [p for p in pivots if len(p) == n] or [[0] * n]
            self.pivots[n] = np.array(rows, dtype=np.float64).reshape(len(rows), n)
            self.first[n] = total
            total += len(rows)
        self.count, self.radius = np.zeros(total, dtype=np.int64), np.zeros(total)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot's cell, and the distance to it."""
        x, pivots = vectors.astype(np.float64), self.pivots[vectors.shape[1]]
        squares = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
        near = squares.argmin(axis=1)
        return near + self.first[vectors.shape[1]], np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of the queries' length that hold vectors, and the lower and upper bounds of each query's scores there."""
        n = queries.shape[1]
        cells = self.first[n] + np.arange(len(self.pivots[n]))
        held = self.count[cells] > 0
        q = queries.astype(np.float64)
        centre = q @ self.pivots[n][held].T
        reach = np.sqrt((q * q).sum(axis=1))[:, None] * self.radius[cells[held]][None, :]
        slack = _SLACK * (np.abs(centre) + reach) + _SLACK
        return cells[held], centre - reach - slack, centre + reach + slack


def _tiles(asks: np.ndarray, cells: Cells, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first tile and number of tiles, from how many queries it is home to; neighbouring small cells share one."""
    first, number = np.zeros(len(asks), dtype=np.int64), np.ones(len(asks), dtype=np.int64)
    made, held = -1, size  # the tile being filled, and the queries in it
    for n, pivots in cells.pivots.items():
        left = np.arange(len(pivots))
        at = 0
        while len(left):
            place = left[at]
            left = np.delete(left, at)
            cell = cells.first[n] + place
            if asks[cell] > size:
                number[cell] = -(-asks[cell] // size)
                first[cell], made, held = made + 1, made + number[cell], size
            elif asks[cell]:
                if held + asks[cell] > size:
                    made, held = made + 1, 0
                first[cell], held = made, held + asks[cell]
            at = int(((pivots[left] - pivots[place]) ** 2).sum(axis=1).argmin()) if len(left) else 0
        held = size
    return first, number


def _best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query id, id, score) of each query's k best vectors; ``ids`` are ascending."""
    count = len(ids)
    largest = (np.abs(queries).max(initial=0) * 1.0) * (np.abs(vectors).max(initial=0) * 1.0) * max(1, queries.shape[1])
    exact = largest < 2**52
    right = vectors.T.astype(np.float64) if exact else vectors.T
    step = max(1, (1 << 22) // max(1, count))
    for at in range(0, len(queries), step):
        mine = query_ids[at: at + step]
        scores = ((queries[at: at + step].astype(np.float64) if exact else queries[at: at + step]) @ right).astype(np.int64)
        own = ids[None, :] == mine[:, None]
        if largest * count < 2**61:
            keys = scores * count + (count - 1 - np.arange(count))[None, :]  # of equal scores the smaller id is first
            keys[own] = -(2**62)
            top = np.argpartition(-keys, k - 1, axis=1)[:, :k] if count > k else np.broadcast_to(np.arange(count), scores.shape)
        else:
            top = np.stack([np.lexsort((np.arange(count), -s, o))[:k] for s, o in zip(scores, own)])
        row = np.repeat(np.arange(len(mine)), top.shape[1])
        pick = top.ravel()
        keep = ~own[row, pick]
        yield mine[row[keep]], ids[pick[keep]], scores[row[keep], pick[keep]]


def _solve(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """The k best of every tile. ``queries``: tile, cell, part, id, vector; ``data`` the same."""
    both = queries.withColumn("kind", F.lit(0)).unionByName(data.withColumn("kind", F.lit(1)))
    key = ["tile", "cell", "part"]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.concat_tables(held).combine_chunks()
            kind = rows.column("kind").to_numpy()
            ids = rows.column("id").to_numpy()
            vectors = rows.column("vector").combine_chunks()
            ask, have = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(ask) or not len(have):
                return
            have = have[np.argsort(ids[have], kind="stable")]
            for q, i, s in _best(_matrix(vectors, ask), ids[ask], _matrix(vectors, have), ids[have], k):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], ["query_id", "id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in key])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if now != (this := tuple(keys[:, a].tolist())):
                        yield from close()
                        held, now = [], this
                    held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        yield from close()

    return both.repartition(*key).sortWithinPartitions(*key).mapInArrow(released(solved), "query_id long, id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: Column | str = "embedding",
    rows_per_cell: int = 2000, most_pivots: int = 1024, stats: dict[str, int] | None = None,
) -> DataFrame:
    """``query_id``, ``rank``, ``id`` and ``score`` of the k vectors with the highest inner products with each query.

    ``vector`` has whole numbers (array<bigint>), ``is_query`` says which rows ask.
    ``stats`` is given the number of vectors, of tiles and of vectors copied to tiles in both rounds.
    """
    vector = column(vector) if isinstance(vector, str) else vector
    rows = written(vectors.select(column(id_column).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks")).filter(
        "id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"), "vectors")
    lengths = {r["n"]: r["count"] for r in rows.groupBy(F.size("vector").alias("n")).count().collect()}
    wanted = min(most_pivots, max(8, sum(lengths.values()) // rows_per_cell))
    sample = rows.select("vector").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # most_pivots vectors at most
    cells = Cells([r["vector"] for r in sample], list(lengths))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _lengths(batch.column("vector"))
            cell, far = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes))
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                cell[at], far[at] = cells.place(_matrix(batch.column("vector"), at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    data = written(rows.mapInArrow(released(placed), "id long, vector array<long>, asks boolean, cell long, far double"), "cells")
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():  # a row a cell
        cells.count[r["cell"]], cells.radius[r["cell"]] = r["n"], r["radius"]
    parts = np.maximum(1, -(-cells.count // TILE))
    asked = data.filter("asks").select("id", "vector", "cell")
    asks = np.zeros(len(cells.count), dtype=np.int64)
    for r in asked.groupBy("cell").count().collect():  # a row a cell
        asks[r["cell"]] = r["count"]
    first_tile, tiles_of = _tiles(asks, cells, TILE)

    def by_cell(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell").cast("int") + 1)

    asked = asked.withColumn("tile", (by_cell(first_tile) + F.pmod(F.xxhash64("id", F.lit(1)), by_cell(tiles_of))).cast("long"))
    shelved = data.withColumn("part", F.pmod(F.xxhash64("id"), by_cell(parts)).cast("long")).select("cell", "part", "id", "vector")

    def copied(queries: DataFrame, home: bool) -> DataFrame:
        """The vectors that some tile's queries visit, once for each such tile."""
        visits = written(queries.mapInArrow(released(visit(home, True)), "tile long, cell long, part long").distinct(), "visits")
        count = visits.count()
        if stats is not None:
            stats["tiles"] = int(first_tile.max(initial=0) + 1)
            stats["copies"] = stats.get("copies", 0) + shelved.groupBy("cell", "part").count().join(visits, ["cell", "part"]).agg(
                F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        return shelved.join(F.broadcast(visits) if count <= BROADCAST_VISITS else visits, ["cell", "part"]).select("tile", "cell", "part", "id", "vector")

    def visit(home: bool, places_only: bool = False):
        """Queries once for each part of the cells they go to, or only the tiles' visits."""
        def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = _lengths(batch.column("vector"))
                for n in np.unique(sizes):
                    at = np.flatnonzero(sizes == n)
                    own = batch.column("cell").to_numpy()[at]
                    if home:
                        row, cell = np.arange(len(at)), own
                    else:
                        floor_ = batch.column("floor").to_numpy(zero_copy_only=False)[at].astype(np.float64)
                        names, low, high = cells.bounds(_matrix(batch.column("vector"), at))
                        order = np.argsort(-low, axis=1)
                        held = np.cumsum(cells.count[names][order], axis=1)
                        # the lower bound that k vectors besides the query itself reach
                        enough = (held >= k + 1).argmax(axis=1)
                        granted = np.where(held[:, -1] >= k + 1, low[np.arange(len(at)), order[np.arange(len(at)), enough]], -np.inf)
                        least = np.fmax(np.where(np.isnan(floor_), -np.inf, floor_), granted)
                        row, to = np.nonzero((high >= least[:, None]) & (names[None, :] != own[:, None]))
                        cell = names[to]
                    copies = parts[cell]
                    row, cell = np.repeat(row, copies), np.repeat(cell, copies)
                    part = np.arange(len(cell)) - np.repeat(np.cumsum(copies) - copies, copies)
                    tile = batch.column("tile").to_numpy()[at[row]]
                    if places_only:
                        visits = np.unique(np.stack([tile, cell, part]), axis=1).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in visits], ["tile", "cell", "part"])
                        continue
                    for a in range(0, len(row), 20_000):
                        pick = pa.array(at[row[a: a + 20_000]])
                        yield pa.RecordBatch.from_arrays([
                            batch.column("id").take(pick), batch.column("vector").take(pick),
                            pa.array(cell[a: a + 20_000]), pa.array(part[a: a + 20_000]), pa.array(tile[a: a + 20_000])],
                            ["id", "vector", "cell", "part", "tile"])
        return visiting

    kind = "id long, vector array<long>, cell long, part long, tile long"
    if stats is not None:
        stats["vectors"] = int(cells.count.sum())
    first = written(_merged(_solve(asked.mapInArrow(released(visit(True)), kind), copied(asked, True), k), k).drop("rank"), "home")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
    more = asked.join(floors.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor")), "id", "left").select(
        "id", "vector", "cell", "tile", "floor")
    second = _solve(more.mapInArrow(released(visit(False)), kind), copied(more, False), k)
    return _merged(first.unionByName(second), k).select("query_id", "rank", "id", "score")
