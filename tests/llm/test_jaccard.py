import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import jaccard, queries
from tests.llm.cases import no_documents, odd_documents, prose


def brute(rows, words, percent):
    """Sets and smallest ids reachable, from all pairs of different ids."""
    sets = []
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(found) >= words:
            sets.append((i, {tuple(found[k: k + words]) for k in range(len(found) - words + 1)}))
        else:
            sets.append((i, {tuple(found)} if found else set()))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((i, len(a), root(i)) for i, a in sets)


def families(seed, groups, members):
    """Families of texts with growing numbers of edits, and a passage that all share."""
    rng = random.Random(seed)
    shared = prose(99, 60)
    rows = []
    for g in range(groups):
        base = prose(1000 + g, rng.randint(8, 220)).split()
        for m in range(members):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            rows.append(" ".join(text) + (" " + shared if g % 2 else ""))
    rng.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 50)])
def test_components_equal_all_pairs(spark, words, percent):
    rows = families(words, 14, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(docs, words, percent).collect())) == brute(rows, words, percent)


def test_split_lists_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_SETS", 3)
    monkeypatch.setattr(jaccard, "PAIR_RUN", 5)
    monkeypatch.setattr(jaccard, "MOST_BITS", 64)
    rows = families(5, 8, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.join(docs).collect())) == brute(rows, 3, 90)


def test_blocks_are_skipped_and_no_pair_is_missed():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 3, 1500))
    x = {c: rng.integers(*span, 1500) for c, span in {"n": (10, 2000), "rest": (0, 20), "l": (1, 6), "component": (0, 40)}.items()}
    x["visitor"] = rng.random(1500) < 0.3
    to_first = x["n"] + rng.integers(0, 30, 1500)
    order = np.lexsort((x["rest"], x["n"], group))
    x, to_first = {c: v[order] for c, v in x.items()}, to_first[order]

    def allowed(i, j):
        return ((100 * np.minimum(x["n"][i], x["n"][j]) >= 90 * np.maximum(x["n"][i], x["n"][j])) & (x["component"][i] != x["component"][j])
                & ~(x["visitor"][i] & x["visitor"][j]) & (np.minimum(x["rest"][i], x["rest"][j]) >= np.minimum(x["l"][i], x["l"][j]))
                & (np.abs(to_first[i] - to_first[j]) <= (x["n"][i] + x["n"][j]) * 10 // 190))

    every, made = ([np.concatenate(p) for p in zip(*pairs)] for pairs in (jaccard._list_pairs(group), jaccard._block_pairs(group, x, to_first, 90)))
    wanted, got = (set(zip(i[allowed(i, j)].tolist(), j[allowed(i, j)].tolist())) for i, j in (every, made))
    assert got == wanted and len(set(zip(made[0].tolist(), made[1].tolist()))) == len(made[0]) < len(every[0]) / 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 30)]
    links = spark.createDataFrame(chain + star + [(2001, 2000)], "a long, b long")
    got = {r["id"]: r["component"] for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(30)}, 2000: 2000, 2001: 2000}
    assert jaccard.components(links.limit(0)).count() == 0


def test_size_classes_hold_linked_sizes():
    for percent in (50, 80, 90, 95):
        bounds = jaccard.class_bounds(percent, 5000)
        place = {n: sum(bounds <= n) for n in range(1, 3000)}
        for n in range(1, 2000):
            for m in range(n, min(2999, n * 100 // percent) + 1):
                assert place[m] - place[n] <= 1


def test_odd_rows_and_no_rows(spark):
    rows = jaccard.join(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert (got[7], got[1], got[2], got[4], got[8], got[None]) == (1, 1, 2, 4, 8, None)
    assert {r["doc_id"]: r["n_shingles"] for r in rows if r["doc_id"] in (2, 3, 4, 5)} == {2: 0, 3: 0, 4: 0, 5: 1}
    assert got[11] == 10
    assert jaccard.join(no_documents(spark)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op6_ngram_jaccard"](spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows, 3, 90)
    assert got.filter(F.col("component_id") != F.col("doc_id")).count() > 0
