import hashlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwright.llm import bpe, queries
from tests.llm.cases import no_documents, odd_documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " \n\t", "Hello  world's\n\tİstanbul ΣΑΣ ́x é <|endoftext|> q", "<|ENDOFTEXT|> A <|startoftext|>. a<|endoftext|>b",
    "don't. can't, 'S. ...x,. 1. 2, é. É, ß. ÷. x.. ?. e.g. a.b, (end.) ½. ª.", "\x1c\x85 a\xa0b　c d", "가각 각 ﬁ Å Å",
    prose(1, 3000), "ÀÉ" * 400, "x." * 500, "\x00 a\x00b", "\U0001f468‍\U0001f469‍\U0001f467 \U0001f1e9\U0001f1ea",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_numbers_come_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, 5])
    parts = bpe.packed(numbers, np.array([0, 3, 3, 10, 11]))
    assert [bpe.unpacked(p).tolist() for p in parts] == [[], [0, 1, 127], [], numbers[3:10].tolist(), [5]]
    assert bpe.packed(np.empty(0, dtype=np.int64), np.array([0])) == [b""]


def test_splitting_keeps_every_word():
    places, ends, distinct = bpe.split_words(pa.array(["the mill. The Mill, x", "", "a.b. <|X. <|x."]))
    assert [distinct[i] for i in places] == ["the", "mill", ".", "the", "mill", ",", "x", "", "a.b", ".", "<|X.", "<|x", "."]
    assert ends.tolist() == [7, 8, 13]


@pytest.mark.parametrize("block_bytes", [1500, bpe.BLOCK_BYTES])
def test_ids_and_texts_equal_the_library(spark, tokenizer, block_bytes):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").repartition(3)
    rows = bpe.decode(bpe.encode(docs, PATH, block_bytes=block_bytes), bpe.pieces(spark, PATH)).collect()
    assert len(rows) == len(HARD)
    for r in rows:
        ids = tokenizer.encode(HARD[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_every_distinct_word_is_encoded_once(spark):
    docs = spark.createDataFrame([(i, "mill stone. Mill") for i in range(50)], "doc_id long, text string").repartition(5)
    table = bpe.blocks(docs, block_bytes=100)
    words = table.filter(F.col("words").isNotNull()).select(F.explode("words").alias("word"))
    assert words.count() > 5  # each block has its own list
    found = bpe.word_table(table, PATH).collect()
    assert sorted(r["word"] for r in found) == [",", ".", "mill", "stone"]
    assert {r["word"]: r["ids"] for r in found} == {r["word"]: Tokenizer.from_file(PATH).encode(r["word"]).ids for r in found}


def test_decoding_any_ids(spark, tokenizer):
    rows = [(1, [49407, 5, 320, 49406]), (2, []), (3, None), (4, [99999, 320, -1])]
    out = bpe.decode(spark.createDataFrame(rows, "`a.b` int, ids array<int>"), bpe.pieces(spark, PATH)).collect()
    assert [r["a.b"] for r in out] == [1, 2, 3, 4]
    assert out[0]["decoded"] == tokenizer.decode(rows[0][1], skip_special_tokens=False)
    assert [r["decoded"] for r in out[1:]] == ["", "", tokenizer.decode([320])]


def test_odd_rows(spark, tokenizer):
    docs = odd_documents(spark)
    rows = bpe.encode(docs, PATH, block_bytes=40_000).collect()
    want = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    def key(pair):
        return (pair[0] is None, pair[0] or 0, pair[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=key) == sorted(want, key=key)
    empty = bpe.decode(bpe.encode(no_documents(spark), PATH), bpe.pieces(spark, PATH))
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0


def test_query(spark, sf, tokenizer):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op12_bpe"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for t in texts:
        ids = tokenizer.encode(t["text"] or "", add_special_tokens=False).ids
        r = rows[t["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
