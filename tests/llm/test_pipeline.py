import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridwright.llm import jaccard, secret_scan
from gridwright.llm.frames import written
from tests.llm.cases import odd_documents
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What goes into each stage and what comes out."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, sf), "test")
        out[name] = (docs, made)
        docs = made
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "ngram_jaccard", "secret_scan", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == corpus_pipeline.DOCUMENT


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, stages):
    before, after = (set(texts(f)) for f in stages["toxicity"])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum((i in after) == bool(labels[i]) for i in before if i in labels) <= 2
    kept = texts(stages["toxicity"][1])
    assert all(kept[i] == t for i, t in texts(stages["toxicity"][0]).items() if i in kept)


def test_one_of_each_group_stays(stages):
    before, after = (texts(f) for f in stages["ngram_jaccard"])
    groups = brute(sorted(before.items()), 5, 80)
    assert set(after) == {root for _, _, root in groups} and len(after) < len(before)


def test_secrets_are_marked_and_the_rest_stays(stages):
    before, after = (texts(f) for f in stages["secret_scan"])
    assert set(before) == set(after)
    for i, text in before.items():
        expected = re.sub(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{8,}|(?<=token = \")[0-9a-f]{40}", "[SECRET]", text)
        assert after[i] == expected


def test_mix_comes_near_its_targets(stages):
    before, after = stages["mixing"]
    count = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    size = {r["source"]: r["n"] for r in before.groupBy("source").agg(F.sum(count).alias("n")).collect()}
    got = {r["source"]: r["n"] for r in after.groupBy("source").agg(F.sum(count).alias("n")).collect()}
    assert sum(got.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    assert all(got[s] <= 2 * size[s] for s in got)
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_pieces_hold_every_token(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
    assert after.agg(F.sum("length")).first()[0] == wanted


def test_odd_rows_go_through(spark, sf):
    docs = odd_documents(spark).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.select(*corpus_pipeline.DOCUMENT, "size", "token")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    made = {name: stage(spark, docs, sf).collect() for name, stage in corpus_pipeline.STAGES}  # whole rows, so every column is worked out
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    ids = [r["doc_id"] or 0 for r in docs.collect()]
    for name, rows in made.items():
        if name == "mixing":  # documents without a word have nothing to give
            assert {r["doc_id"] or 0 for r in rows} == {r["doc_id"] or 0 for r in docs.collect() if (r["text"] or "").split()}
        elif name != "ngram_jaccard":
            assert {r["doc_id"] or 0 for r in rows} == set(ids), name
        if name != "packing":
            assert list(rows[0].asDict()) == list(corpus_pipeline.DOCUMENT), name
    assert sorted(r["doc_id"] or 0 for r in made["toxicity"]) == sorted(ids)
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in made["secret_scan"]) == sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in docs.collect())
    words = {}
    for r in made["mixing"]:
        words[r["source"]] = words.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    size = {}
    for r in docs.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert all(words.get(s, 0) <= 2 * n for s, n in size.items()) and sum(words.values()) > sum(size.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in made["packing"]) == sum(
        len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert jaccard.join(docs).count() == docs.count()
    assert secret_scan.sample_of(docs, 5).count() <= docs.count()
