"""The neighbour join against brute force, with every limit forced low."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import neighbors
from gridwright.operators.neighbors import CellGrid, distances, impute_nearest, knn_join
from gridwright.operators.pivots import PivotTree

LOW = {"rows_per_cell": 20, "chunk_rows": 15, "query_rows": 10}


def frame(spark, x, ids, name, extra=None):
    rows = [(f"{i:04d}", [float(v) for v in row], float(i)) for i, row in zip(ids, x)]
    df = spark.createDataFrame(rows, f"{name} string, x array<double>, v double")
    return df if extra else df.select(name, "x") if name == "qid" else df


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "nan_euclidean"])
@pytest.mark.parametrize("limits", [{}, LOW])
def test_join_is_exact(spark, metric, limits):
    rng = np.random.default_rng(3)
    donors = np.round(rng.normal(size=(240, 3)), 1)
    donors[:80] = donors[0]  # a third of the donors is one point
    queries = np.round(rng.normal(size=(60, 3)), 1)
    queries[:20] = donors[0]
    if metric == "nan_euclidean":
        donors[rng.random(donors.shape) < 0.2] = np.nan
        queries[rng.random(queries.shape) < 0.2] = np.nan
    k = 4
    got = knn_join(frame(spark, queries, range(60), "qid"), frame(spark, donors, range(240), "did"), k,
                   metric, **limits).toPandas()
    d = distances(queries, donors, metric)
    for q in range(60):
        order = [j for j in np.lexsort((np.arange(240), d[q])) if not np.isnan(d[q, j])][:k]
        mine = got[got["qid"] == f"{q:04d}"].sort_values("rank")
        assert [int(x) for x in mine["did"]] == order
        np.testing.assert_allclose(mine["distance"], d[q, order])


def test_cell_bounds_never_exceed_distances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    grid = CellGrid([0, 2], [np.array([-0.5, 0.0, 0.7]), np.array([0.1])])
    cells = grid.cell(x)
    q = rng.normal(size=(20, 3))
    for metric in ("manhattan", "nan_euclidean"):
        bound = grid.lower_bounds(q, np.unique(cells), metric)
        d = distances(q, x, metric)
        for i, c in enumerate(np.unique(cells)):
            inside = d[:, cells == c]
            assert (bound[:, [i]] <= inside + 1e-12)[~np.isnan(inside)].all()


def test_imputation_without_any_shared_coordinate_uses_the_mean(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (2, 3.0, None), (3, None, 5.0), (4, None, None)], "id int, a double, b double")
    out = {r["id"]: r for r in impute_nearest(df, ["a", "b"], "id").collect()}
    assert out[4]["a"] == 2.0 and out[4]["b"] == 5.0
    assert out[3]["a"] == 2.0 and out[1]["b"] == 5.0


def test_imputation_keeps_rows_and_values(spark):
    df = spark.range(200).select(
        "id", F.when(F.col("id") % 9 != 0, F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("b"))
    out = impute_nearest(df, ["a", "b"], "id", 2, **LOW).toPandas().sort_values("id")
    assert len(out) == 200 and out["a"].notna().all()
    assert (abs(out["a"] - out["id"]) <= 9).all()
    assert (out[out["id"] % 9 != 0]["a"] == out[out["id"] % 9 != 0]["id"]).all()


def test_cells_smaller_than_k(spark):
    """Cells of a few donors each, and more neighbours wanted than a cell holds."""
    rng = np.random.default_rng(11)
    donors, queries = rng.normal(size=(300, 2)), rng.normal(size=(40, 2))
    got = knn_join(frame(spark, queries, range(40), "qid"), frame(spark, donors, range(300), "did"), 30,
                   "euclidean", rows_per_cell=5, chunk_rows=4, query_rows=10).toPandas()
    d = distances(queries, donors, "euclidean")
    for q in range(40):
        mine = got[got["qid"] == f"{q:04d}"].sort_values("rank")
        assert [int(x) for x in mine["did"]] == list(np.lexsort((np.arange(300), d[q]))[:30])


def exact(queries, donors, k, metric):
    d = distances(queries, donors, metric)
    return [[int(j) for j in np.lexsort((np.arange(len(donors)), row)) if not np.isnan(row[j])][:k] for row in d]


def found(got, queries):
    rows = {f"{q:04d}": [] for q in range(queries)}
    for r in got.sort_values("rank").itertuples():
        rows[r.qid].append(int(r.did))
    return list(rows.values())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "nan_euclidean"])
def test_balls_over_many_columns_are_exact(spark, metric):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 9)) * 3
    donors = np.round(middle[rng.integers(0, 6, 400)] + rng.normal(size=(400, 9)) * 0.4, 1)
    donors[:130] = donors[0]  # a third is one point
    queries = np.round(middle[rng.integers(0, 6, 50)] + rng.normal(size=(50, 9)) * 0.6, 1)
    queries[:15] = donors[0]
    if metric == "nan_euclidean":
        donors[rng.random(donors.shape) < 0.05] = np.nan
        donors[7] = np.nan
        queries[rng.random(queries.shape) < 0.2] = np.nan
        queries[3] = np.nan
    got = knn_join(frame(spark, queries, range(50), "qid"), frame(spark, donors, range(400), "did"), 4, metric, **LOW).toPandas()
    assert found(got, 50) == exact(queries, donors, 4, metric)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "nan_euclidean"])
def test_ball_bounds_never_exceed_distances(metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6)) + 4 * rng.integers(0, 3, (600, 1))
    if metric == "nan_euclidean":
        x[rng.random(x.shape) < 0.15] = np.nan
    tree = PivotTree.grown(x[:200], 12, metric)
    assert tree.splits
    leaf, far = tree.place(x)
    leaves = np.unique(leaf)
    tree.bounded_by({int(c): far[leaf == c].min() for c in leaves}, {int(c): far[leaf == c].max() for c in leaves})
    q = rng.normal(size=(40, 6)) * 3
    if metric == "nan_euclidean":
        q[rng.random(q.shape) < 0.2] = np.nan
    _, low = tree.reach(q, leaves)
    d = distances(q, x, metric)
    for i, c in enumerate(leaves):
        inside = d[:, leaf == c]
        assert (low[:, [i]] <= inside + 1e-12)[~np.isnan(inside)].all()
        assert np.isnan(inside[np.isinf(low[:, i])]).all()


def test_queries_visit_few_blocks_of_wide_clustered_rows(spark, sf):
    """The 64 columns of the embeddings, scaled up: twenty rows around each vector."""
    rng = np.random.default_rng(2)
    middle = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(100).collect()])
    donors = np.repeat(middle, 20, axis=0) + rng.normal(size=(2000, 64)) * 0.004
    queries = middle[:60] + rng.normal(size=(60, 64)) * 0.004
    visits = {}
    got = knn_join(frame(spark, queries, range(60), "qid"), frame(spark, donors, range(2000), "did"), 5, "euclidean",
                   rows_per_cell=20, chunk_rows=1000, query_rows=50, visits=visits).toPandas()
    assert found(got, 60) == exact(queries, donors, 5, "euclidean")
    assert visits["blocks"] >= 60 and visits["queries"] == 60
    assert visits["visited"] < 0.2 * visits["queries"] * visits["blocks"]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["plain", "far", "copies", "rounded", "missing", "huge"])
def test_rough_distances_lose_no_neighbour(metric, kind):
    """Many columns: rough distances choose what is compared; far fewer than all pairs are compared exactly."""
    rng = np.random.default_rng(4)
    donors, queries, k = rng.normal(size=(1500, 12)), rng.normal(size=(90, 12)), 5
    if kind == "far":
        donors, queries = donors + 1e7, queries + 1e7
    if kind == "copies":
        donors[400:] = donors[0]
        queries[:40] = donors[0]
    if kind == "rounded":
        donors, queries = np.round(donors), np.round(queries)
    if kind == "missing":
        queries[0, 3], donors[7, 5] = np.nan, np.nan
    if kind == "huge":
        queries[0], donors[3] = 1e200, 1e200
    searched = neighbors._Donors(donors, metric)
    assert searched.rough == (kind not in ("missing", "huge"))
    with np.errstate(over="ignore", invalid="ignore"):
        got = [np.concatenate(parts) for parts in zip(*searched.nearest(queries, k))]
        want, d = exact(queries, donors, k, metric), distances(queries, donors, metric)
    for q in range(90):
        mine = got[0] == q
        order = np.lexsort((got[1][mine], got[2][mine]))
        assert got[1][mine][order].tolist() == want[q]
        assert got[2][mine][order].tolist() == d[q, want[q]].tolist()


def test_a_search_is_spread_over_tasks(spark, monkeypatch):
    """One donor block, 2,000 queries: a block of few bytes is more work than one task should have."""
    monkeypatch.setattr(neighbors, "LEAST_QUERIES", 50)
    rng = np.random.default_rng(8)
    donors, queries = frame(spark, rng.normal(size=(300, 2)), range(300), "did"), frame(spark, rng.normal(size=(2000, 2)), range(2000), "qid")
    at = [q.withColumns({"cell": F.lit(0).cast("long"), "chunk": F.lit(0)}) for q in (queries, donors)]
    found = neighbors._search(*at, 3, "euclidean", 20_000)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert found.count() == 6000
