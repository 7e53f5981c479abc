import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import queries, voronoi


def brute(rows, asks, k, by=256):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(by * x) for x in v]))
    out = set()
    for i, q in whole:
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    return sorted(out)


def run(spark, rows, k=5, **more):
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, cell int")
    found = voronoi.top_k(frame, F.col("vec_id") % 10 == 0, k, "vec_id", voronoi.scaled("embedding", 256), **more)
    return sorted(map(tuple, found.collect()))


def vectors(seed, count, spread=1.0, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 7] + spread * rng.normal(size=dims)]) for i in range(count)]


@pytest.mark.parametrize("spread, rows_per_cell", [(0.05, 20), (1.0, 20), (0.05, 2000)])
def test_equals_all_pairs(spark, spread, rows_per_cell):
    rows = vectors(1, 400, spread)
    assert run(spark, rows, rows_per_cell=rows_per_cell) == brute(rows, lambda i: i % 10 == 0, 5)


def test_tiles_ties_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "TILE", 16)
    rows = vectors(2, 150) + [(1000 + i, [0.5, 0.25, 1.0, -1.0, 0.0, 0.125]) for i in range(120)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows, rows_per_cell=30) == brute(rows, lambda i: i % 10 == 0, 5)


def test_far_cells_are_not_visited(spark):
    """With tight cells the second round must pass most of them by."""
    cells = voronoi.Cells([[100, 0], [-100, 0], [0, 100]], [2])
    cells.count[:], cells.radius[:] = 50, 5.0
    names, low, high = cells.bounds(np.array([[10, 0]]))
    assert names.tolist() == [0, 1, 2] and low[0, 0] > high[0, 1] and low[0, 0] > high[0, 2]


def test_only_visited_vectors_are_copied(spark, monkeypatch):
    """Clusters far apart: a tile gets the vectors around its queries, not the whole table."""
    monkeypatch.setattr(voronoi, "TILE", 16)
    rng = np.random.default_rng(3)
    centres = 10 * np.eye(12)
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.05 * rng.normal(size=12)]) for i in range(1200)]
    stats = {}
    assert run(spark, rows, rows_per_cell=20, stats=stats) == brute(rows, lambda i: i % 10 == 0, 5)
    assert stats["vectors"] == 1200 and stats["tiles"] >= 6
    assert stats["copies"] < 0.5 * stats["vectors"] * stats["tiles"]


def test_neighbouring_small_cells_share_a_tile():
    cells = voronoi.Cells([[0, 0], [100, 0], [1, 0], [101, 0]], [2])
    first, number = voronoi._tiles(np.array([3, 4, 5, 40]), cells, 10)
    assert first[0] == first[2] and number.tolist() == [1, 1, 1, 4]
    spans = [set(range(a, a + n)) for a, n in zip(first, number)]
    assert not spans[3] & (spans[0] | spans[1])


def test_large_scores(spark):
    rows = [(i, [float(2**17 * (i % 13)), float(i)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0, 5)


def test_odd_rows_and_no_rows(spark):
    rows = vectors(3, 60) + [
        (70, None), (80, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (90, [float("nan")] * 6), (100, [float("inf")] * 6), (None, [0.0] * 6),
        (110, [1.0, 2.0]), (111, [3.0, 1.0]), (120, [9.0]), (130, []), (140, [0.0] * 6), (141, [0.0] * 6)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0, 5)
    assert run(spark, rows[:1]) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert voronoi.top_k(frame, F.lit(True), 5, "vec_id", voronoi.scaled("embedding", 256)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, queries.QUERIES["op2_voronoi_top_k"](spark, sf).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0, 5)
