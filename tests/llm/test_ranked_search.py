import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridwright.llm import queries, ranked_search
from tests.llm.cases import no_documents, odd_documents

LOWER = str.maketrans(ranked_search.CAPITALS, ranked_search.SMALL)


def terms(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    """docs: (id, text) rows, items: (id, text) rows."""
    bags = [(i, terms(t)) for i, t in docs]
    full = sum(1 for _, b in bags if b)
    length = sum(len(b) for _, b in bags)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in b for _, b in bags) for t in set().union(*wanted.values())}
    out = []
    for item, mine in wanted.items():
        found = []
        for i, bag in bags:
            score = 0
            for t in mine & set(bag):
                tf, m = bag.count(t), 100 - 90 + ((90 * len(bag) * full) // length)
                score += math.floor(1000 * math.log((2 * full + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_scan_counts_whole_terms():
    scan = ranked_search.TermScan(["a", "ab", "b", "é", "x1", "né", "9"])
    texts = ["a ab a-b,AB", "", "é né É É", "x1x1 x1", None or "", "a", "b", "a b a b 9"]
    n, text, term, tf = scan.count(pa.array(texts))
    names = ["a", "ab", "b", "é", "x1", "né", "9"]
    assert n.tolist() == [len(terms(t)) for t in texts]
    got = {(int(d), names[t]): int(c) for d, t, c in zip(text, term, tf)}
    want = {(d, t): terms(x).count(t) for d, x in enumerate(texts) for t in names if t in terms(x)}
    assert got == want


def test_large_numbers_stay_exact():
    n, weights, table = np.array([5]), np.array([2**40, 3]), np.ones((2, 1))
    args = (n, np.array([0, 0]), np.array([0, 1]), np.array([7, 1]), weights, table, 10, 50)
    m = 10 + 90 * 5 * 10 // 50
    want = 2**40 * (7 * 10**9 // (7000 + 8 * m)) + 3 * (10**9 // (1000 + 8 * m))
    assert ranked_search.scores_of(*args).tolist() == [[want]]


@pytest.mark.parametrize("limits", [{}, {"cells": 40}, {"term_bytes": 60}])
def test_against_brute_force(spark, limits, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)] + ["Éa", "ß", "7"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(150)]
    docs += [(200 + i, "w1, W2; w3") for i in range(40)] + [(7, "w1 w1"), (7, "w1 w1"), (None, "w1 w1"), (300, None), (301, " .")]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(6)]
    items += [(2, "w20 w1"), (90, None), (91, "..."), (92, "nowhere"), (None, "W3 w3 éa")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(ranked_search.rank_documents(df, asked, 10, **limits))
    assert got == brute(docs, items, 10)


def test_blocks_change_nothing(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = rows_of(ranked_search.rank_documents(docs, items, 3))
    monkeypatch.setattr(ranked_search, "TEXT_RUN", 1000)
    monkeypatch.setattr(ranked_search, "CELLS", 20_000)
    assert rows_of(ranked_search.rank_documents(docs, items, 3)) == whole


def test_odd_rows(spark):
    docs, items = odd_documents(spark), spark.createDataFrame([(1, "mill stone word", 9), (2, "né", 8)], "item_id long, text string, doc_id int")
    got = rows_of(ranked_search.rank_documents(docs, items))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "mill stone word"), (2, "né")], 10)
    for some, other in ((no_documents(spark), items), (docs, items.limit(0))):
        empty = ranked_search.rank_documents(some, other)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_query(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(queries.QUERIES["op11_ranked_search"](spark, sf)) == brute(docs, items, 10)
