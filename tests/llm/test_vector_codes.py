import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright.llm import queries, vector_codes
from gridwright.llm.vector_codes import Codebooks


def plain_nearest(values, x):
    """Every entry looked at; the first of equal ones."""
    off = x[:, :, None, :] - values[None]
    distance = (off * off).sum(axis=3)
    return distance.argmin(axis=2), distance.min(axis=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 4), st.integers(1, 9), st.integers(0, 12), st.integers(0, 2**32 - 1), st.integers(1, 40))
def test_search_equals_looking_at_all(parts, size, entries, rows, seed, reach):
    rng = np.random.default_rng(seed)
    values = rng.integers(-reach, reach + 1, (parts, entries, size))
    x = rng.integers(-reach, reach + 1, (rows, parts, size))
    entry, distance, _ = Codebooks(values).nearest(x)
    want_entry, want_distance = plain_nearest(values, x)
    assert (entry == want_entry).all() and (distance == want_distance).all()


def test_search_leaves_entries_out():
    rng = np.random.default_rng(1)
    values, x = rng.integers(-300, 300, (16, 64, 4)), rng.integers(-300, 300, (500, 16, 4))
    entry, _, looked = Codebooks(values).nearest(x)
    assert (entry == plain_nearest(values, x)[0]).all()
    assert looked < 0.6 * x.shape[0] * 16 * 64


def test_equal_gap_and_distance_goes_on_to_the_lower_index():
    # from 0, entry 1 at +2 is met first or not; entry 0 at -2 ties and must win
    values = np.array([[[-2], [2], [2], [-2]]])
    assert Codebooks(values).nearest(np.array([[[0]], [[2]], [[-3]]]))[0].tolist() == [[0], [1], [0]]


def brute(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector, label) kept ones."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(rows[0][1]) // parts
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    cut = [[w[p * size: (p + 1) * size] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        new = []
        for p in range(parts):
            new.append([])
            for k, old in enumerate(books[p]):
                mine = [c[p] for c, f in zip(cut, found) if f[p] == k]
                new[p].append([sum(m[j] for m in mine) // len(mine) for j in range(size)] if mine else old)
        books = new
    out = []
    for (i, _, label), c in zip(rows, cut):
        hits = [near(p, c[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in hits], sum(d for d, _ in hits)))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    return books, [(*r, total[r[1]]) for r in out]


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[1] is None, r[1] or 0)


@pytest.mark.parametrize("limits", [{}, {"label_rows": 0, "salts": 3}])
def test_whole_against_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist(), [None, 1, 2, 7][i % 4]) for i in range(120)]
    rows += [(3, rows[3][1], 1), (3, rows[9][1], None), (None, rows[5][1], 2)]
    odd = [(200, None, 1), (201, [], 1), (202, [1.0, None] * 4, 1), (203, [float("nan")] * 8, 2), (204, [float("inf")] * 8, 2),
           (205, [0.5] * 4, 1), (206, [0.5] * 7, 1)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, error double, code string").repartition(5)
    books = vector_codes.train(df, parts=4, entries=9)
    found = vector_codes.with_label_errors(vector_codes.compress(df, books), **limits).collect()
    want_books, want = brute(rows, 4, 9, 2)
    assert books.values.tolist() == want_books
    got = [(r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_few_none_and_huge(spark):
    schema = "vec_id long, embedding array<float>, label int"
    two = spark.createDataFrame([(9, [0.1] * 16, 1), (4, [-0.1] * 16, None)], schema)
    books = vector_codes.train(two)
    assert books.values.shape == (16, 2, 1) and books.values[0].tolist() == [[-26], [25]]
    none = spark.createDataFrame([(1, None, 1)], schema)
    assert vector_codes.train(none) is None
    assert vector_codes.with_label_errors(vector_codes.compress(none, None)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.train(spark.createDataFrame([(1, [1e30] * 16, 1)], schema))


def test_query(spark, sf):
    rows = queries.QUERIES["op13_vector_codes"](spark, sf).collect()
    table = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    _, want = brute(table, 16, 64, 2)
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows)
    assert got == sorted((i, "".join(f"{k:02x}" for k in code), error, total) for i, _, code, error, total in want)
    assert len({r["codebooks_sha256"] for r in rows}) == 1
