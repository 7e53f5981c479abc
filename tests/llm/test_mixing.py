import re

import numpy as np
import pytest

from gridwright.llm import mixing, queries
from tests.llm.cases import no_documents, odd_documents, prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def share_by_rounds(sizes, weights, total, limit):
    """Pour the total by weight, cut what is above, pour the excess again."""
    targets, full = [0.0] * len(sizes), set()
    left = total
    while left > 1e-9:
        free = [i for i in range(len(sizes)) if i not in full and sizes[i]]
        if not free:
            break
        weight = sum(weights[i] for i in free)
        for i in free:
            targets[i] += left * weights[i] / weight
        left = 0.0
        for i in free:
            if targets[i] > limit * sizes[i]:
                left += targets[i] - limit * sizes[i]
                targets[i] = float(limit * sizes[i])
                full.add(i)
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 5, 0, 800], [1], [0, 0], [], [5, 4000, 3000, 2, 2, 2, 9000]])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert mixing.share_out(sizes, weights, 1.5 * sum(sizes), 2) == pytest.approx(share_by_rounds(sizes, weights, 1.5 * sum(sizes), 2))


def test_permutations():
    for size in (1, 2, 3, 5, 64, 65, 1000):
        for key in ((1, 2, 0), (1, 2, 1)):
            assert sorted(mixing.permuted(np.arange(size), size, key).tolist()) == list(range(size))
    assert (mixing.permuted(np.arange(1000), 1000, (1,)) != mixing.permuted(np.arange(1000), 1000, (2,))).mean() > 0.9


def sources(spark):
    rows, sizes = [], {"b": 30, "a": 60, "c": 10, None: 12}
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((len(rows), prose(len(rows), 20 + 37 * len(rows) % 400), source))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("shard_blocks, bucket_rows", [(4096, 4000), (16, 5)])
def test_quotas_limits_and_reruns(spark, shard_blocks, bucket_rows):
    rows, docs = sources(spark)
    size = {i: len(words(t)) for i, t, _ in rows}
    made = mixing.plan(docs, block_words=32, shard_blocks=shard_blocks, bucket_rows=bucket_rows)
    got = mixing.taken(made).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    order = ["a", "b", "c", None]
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in order}
    targets = dict(zip(order, share_by_rounds(list(total.values()), [5, 2, 1, 5], 1.5 * sum(total.values()), 2)))
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    for s in order:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - targets[s]) <= 3 * 32
    again = mixing.taken(mixing.plan(docs.repartition(5), block_words=32, shard_blocks=shard_blocks, bucket_rows=bucket_rows)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_slots_visit_each_block_once_a_pass(spark):
    _, docs = sources(spark)
    made = mixing.plan(docs, block_words=32, shard_blocks=16)
    visits = {}
    for r in made.slots.collect():
        assert (r["turn"], r["block"]) not in visits.setdefault(r["number"], set())
        visits[r["number"]].add((r["turn"], r["block"]))
    for s in made.sources:
        found = visits.get(s["number"], set())
        assert len(found) == s["quota"] and all(b < s["blocks"] for _, b in found)
        assert sum(t == 0 for t, _ in found) == min(s["quota"], s["blocks"])


def test_texts_hold_the_words_taken(spark):
    rows, docs = sources(spark)
    made = mixing.plan(docs, block_words=32)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(made).collect()}
    whole = {i: t for i, t, _ in rows}
    found = dict.fromkeys(taken, 0)
    for r in mixing.texts(docs, made, ["doc_id", "text", "source"]).collect():
        found[r["doc_id"]] += len(words(r["text"]))
        assert r["text"] == whole[r["doc_id"]] or all(run in whole[r["doc_id"]] for run in r["text"].split("\n"))
    assert found == taken


def test_odd_rows_and_no_rows(spark):
    odd = odd_documents(spark)
    made = mixing.plan(odd)
    got = mixing.taken(made).collect()
    assert len(got) == odd.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sum(len(words(r["text"])) for r in mixing.texts(odd, made, odd.columns).collect()) == sum(r["taken"] for r in got)
    none = no_documents(spark)
    assert mixing.taken(mixing.plan(none)).count() == 0
    assert mixing.texts(none, mixing.plan(none), ["text"]).count() == 0


def test_query(spark, sf):
    got = queries.QUERIES["op8_mixing"](spark, sf).collect()
    size = {r["doc_id"]: len(words(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in got} == size
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(size.values()), rel=0.01)
