import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import queries, toxicity
from tests.llm.cases import no_documents, odd_documents, prose


@pytest.fixture(scope="module")
def labelled(spark):
    rows, marks = [], []
    for i in range(240):
        text = prose(i, 40 + i % 60)
        if i % 4 == 0:
            text = text.replace("mill", "scumbag", 1).replace("stone", "pathetic", 1) + " you loser"
        rows.append((i, text, "s"))
        marks.append((i, int(i % 4 == 0)))
    return (spark.createDataFrame(rows, "doc_id long, text string, source string"),
            spark.createDataFrame(marks, "doc_id long, toxic int"))


def test_held_out_rows_are_told_apart(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    rows = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held", toxicity.held_out()).collect()
    assert {r["held"] for r in rows} == {True, False}
    for r in rows:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    wrong = [r for r in rows if r["held"] and (r["score"] >= 0.5) != bool(r["toxic"])]
    assert len(wrong) <= 1


def test_score_reads_whole_long_texts(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    clean = prose(7, 150_000)
    assert len(clean) > toxicity.WINDOW
    rows = spark.createDataFrame([(1, clean), (2, clean + " scumbag pathetic loser")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert score[1] < 0.5 <= score[2]


def plain_grams(text):
    """All n-grams of the words between two boundaries, by slicing."""
    out = set()
    for word in re.findall("[a-z0-9]+", text.lower()):
        bounded = f" {word} "
        out |= {bounded[a: a + n] for n in toxicity.SIZES for a in range(len(bounded) - n + 1)}
    return out


def cell_of(gram):
    codes = np.array([0 if c == " " else ord(c) for c in gram], dtype=np.uint32)
    return next(int(cell[0]) for n, (cell, _) in zip(toxicity.SIZES, toxicity.cells(codes)) if n == len(gram))


def test_counts_ratios_choice_and_scores_by_hand(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, least_gain=2.0, ridge=1e-2)
    label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = {r["doc_id"]: {cell_of(g) for g in plain_grams(r["text"])} for r in docs.collect()}
    size = [sum(v == k for v in label.values()) for k in (0, 1)]
    count = {}
    for i, cells in held.items():
        for c in cells:
            count.setdefault(c, [0, 0])[label[i]] += 1
    chosen = {}
    for c, (clean, toxic) in count.items():
        p, q = (clean + 1) / (size[0] + 2), (toxic + 1) / (size[1] + 2)
        both = (clean + toxic + 1) / (sum(size) + 2)
        gain = sum(n * math.log(x / both) + (s - n) * math.log((1 - x) / (1 - both)) for n, s, x in ((clean, size[0], p), (toxic, size[1], q)))
        if gain >= 2.0:
            chosen[c] = math.log(q / p)
    assert set(np.flatnonzero(model.slots >= 0).tolist()) == set(chosen) and len(chosen) > 20
    for c, ratio in chosen.items():
        assert model.ratios[model.slots[c]] == pytest.approx(ratio)
    # the weights are at the optimum of the ridge regression over the scaled features
    x = np.zeros((len(held), len(chosen)))
    for row, cells in enumerate(held.values()):
        for c in cells & set(chosen):
            x[row, model.slots[c]] = model.ratios[model.slots[c]]
    y = np.array([label[i] for i in held])
    coefficient = np.divide(model.weights, model.ratios, out=np.zeros(len(model.ratios)), where=model.ratios != 0)
    score = 1 / (1 + np.exp(-(x @ coefficient + model.bias)))
    assert np.abs(x.T @ (score - y) / len(y) + 1e-2 * coefficient).max() < 2e-3 and abs((score - y).mean()) < 2e-3
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    np.testing.assert_allclose([got[i] for i in held], score, rtol=1e-9)


def test_no_largest_number_of_features(spark):
    """A toxic word that stands in two of 6,000 texts alone decides, behind thousands of more frequent n-grams."""
    rows = [(i, prose(i, 30) + (" vile" if i % 8 == 0 else "") + f" w{i % 977}q{i % 613}") for i in range(6000)]
    rows += [(6000 + i, f"{prose(-i - 1, 10)} zyxgorp zyxgorp{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0 or i >= 6000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    asked = spark.createDataFrame([(1, prose(99, 10)), (2, prose(99, 10) + " zyxgorp")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    assert score[1] < 0.5 < score[2]


def test_windows_change_nothing(spark, labelled, monkeypatch):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    texts = __import__("pyarrow").array([r["text"] for r in docs.orderBy("doc_id").limit(20).collect()])
    whole = toxicity._found(texts, model.slots)
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    parts = toxicity._found(texts, model.slots)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_odd_rows_and_no_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    odd = odd_documents(spark)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {round(r["score"], 12) for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert toxicity.score(no_documents(spark), model).count() == 0


@pytest.mark.parametrize("label, score", [(1, 1.0), (0, 0.0)])
def test_one_label_only(spark, labelled, label, score):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter(F.col("toxic") == label))
    assert toxicity.score(docs.limit(3), model).first()["score"] == pytest.approx(score)
    assert toxicity.fit(no_documents(spark), labels).bias < 0


def test_query(spark, sf):
    rows = queries.QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] != r["toxic"] for r in rows) <= 2
