import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from gridwright.llm import packing, queries
from tests.llm.cases import no_documents, odd_documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_tokenizer(tokenizer):
    texts = [
        "", " \n\t", "Hello  world's\n\tİstanbul ΣΑΣ ́x é <|endoftext|> q", "<|ENDOFTEXT|> A <|startoftext|>.",
        "don't. can't, 'S. ...x,. 1. 2, é. É, ß. ÷. x.. ?. e.g. a.b, (end.) ½. ª.", "\x1c\x85 a\xa0b　c",
        prose(1, 3000), "ÀÉ" * 400, "x." * 500,
    ]
    ids, ends = packing.token_ids(pa.array(texts), PATH, 2)
    start = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[start:end].tolist() == expected(tokenizer, text), text
        start = end
    assert start == len(ids)


def check(rows, texts, tokenizer):
    """Each id in one piece, pieces gapless in their windows, windows of powers of two, right checksums."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids, at = expected(tokenizer, texts[doc]), 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at: at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in windows.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == found[0]["tier"] <= 4096 and at & (at - 1) == 0
    steps = {}
    for found in windows.values():
        steps.setdefault(found[0]["step_id"], []).append(found[0]["tier"])
    for tiers in steps.values():
        assert len(set(tiers)) == 1 and sum(tiers) <= max(1 << 16, tiers[0])


def test_whole_documents_in_small_runs(spark, tokenizer):
    texts = {i: prose(i, [1, 3, 40, 300, 900, 6000][i % 6]) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    check(packing.pack(docs, PATH, run_tokens=3000).collect(), texts, tokenizer)
    with_ids = packing.pack(docs, PATH, with_ids=True).collect()
    assert all(r["ids"] == expected(tokenizer, texts[r["doc_id"]])[r["start"]: r["start"] + r["length"]] for r in with_ids)


def test_gaps_are_filled_from_shorter_tiers():
    packer = packing.Packer((16, 8, 4))
    lengths = [13, 11, 3, 2, 2, 7, 40, 1, 4, 4, 4, 5, 6, 9]
    made = []
    for i, n in enumerate(lengths):
        made += packer.add(packing.Piece(n, 0, i, np.arange(n), n))
    made += packer.pack()
    assert [t for t, _ in made[:2]] == [16, 16] and all(sum(p.length for p in w) == t for t, w in made)
    long_window = next(w for t, w in made if w[0].doc == 0)
    assert long_window[0].length == 13 and sum(p.length for p in long_window[1:]) == 3
    made += packer.rest()
    assert sum(p.length for _, w in made for p in w) == sum(lengths)


def test_odd_rows_and_no_rows(spark):
    odd = odd_documents(spark)
    rows = packing.pack(odd, PATH).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (2, 3, 4)] == [(1, 1)] * 3
    assert sum(r["start"] == 0 for r in rows) == odd.count()
    assert packing.pack(no_documents(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, PATH, tiers=(4096, 1000))


def test_query(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.QUERIES["op7_packing"](spark, sf).collect(), texts, tokenizer)
