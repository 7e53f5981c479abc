"""Encoding with a public tokenizer through a table of distinct words, and decoding.

1. Split: every task cuts its texts at ASCII white space. A point or comma that
   ends a word after a small letter is a word of its own, so ``mill`` and ``mill.``
   share one. Texts form blocks of about ``block_bytes``; a block numbers its
   distinct words, and each text becomes a run of numbers, its positions.
2. Table: the blocks' words, one row per block and word however often it stands
   there, are brought together in order, so every distinct word is a run of rows
   and is encoded once (``word_table``).
3. Join: the ids go back to the blocks by word number, and from there to the texts
   by position. The texts' numbers are kept as a table bucketed by block, so only
   words and their ids are shuffled, never texts or positions.
4. Decoding joins ids to the vocabulary's pieces (``pieces``). That table's size
   is the tokenizer's, whatever the texts are, so it is at hand in every task and
   each id of a batch takes the row of its number.

This gives the tokenizer's own ids for tokenizers that keep no white space and
let no piece span it (``word_bpe_49k.json`` does: it composes characters, puts
them in small letters, and looks at runs between white space). Where a word may
hold a special token (``<|``), its capitals stay as they are.

Memory: a task holds one block's words and numbers, or one text where that is
longer. A word that all blocks share is one row a block, not one an occurrence.

Defined cases: a null text is an empty one and has no ids; very long texts make a
block of their own; repeated rows, null ids and any id type pass through; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridwright.llm.frames import column, ragged, released, slices, text_of
from gridwright.session import scratch_path

#: Bytes of text to a block.
BLOCK_BYTES = 48 << 20
#: Bytes of text split at once.
TEXT_RUN = 4 << 20
#: Words in a row of a block's word list, and ids that become pieces at once.
LIST_ROWS, ID_RUN = 50_000, 1 << 20
#: Most buckets of a table that Spark allows.
MOST_BUCKETS = 100_000
#: A point or comma that ends a word after a small letter always is a token of its own.
_SIGNED = "[a-zß-öø-ÿ][.,]$"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each text's words in order as places in a list of distinct words, where each text ends, and that list.

    White space at a text's ends leaves an empty word there, which has no ids.
    """
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary
    words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
    signed = pc.match_substring_regex(words, _SIGNED)
    point = pc.ends_with(words, ".").to_numpy(zero_copy_only=False)
    stems = pc.if_else(signed, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
    distinct = [*stems.dictionary.to_pylist(), ".", ","]
    last = len(distinct)
    sign = np.where(signed.to_numpy(zero_copy_only=False), np.where(point, last - 2, last - 1), -1)
    use = coded.indices.to_numpy(zero_copy_only=False)
    both = np.column_stack([stems.indices.to_numpy(zero_copy_only=False)[use], sign[use]])
    lengths = 1 + (both[:, 1] >= 0)
    reached = np.concatenate([[0], np.cumsum(lengths)])
    return both[both >= 0].astype(np.int64), reached[np.cumsum(counts)], distinct


def packed(numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Runs of numbers as bytes, seven bits to a byte, the lowest first; the last byte of a number is below 128."""
    size = np.ones(len(numbers), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        size += numbers >= 1 << bits
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(begin[-1]), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[begin[some] + k] = (numbers[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    cuts = begin[np.concatenate([[0], ends])].tolist()
    data = out.tobytes()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of ``packed``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    begin = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, begin)


def _numbered(block_bytes: int):
    """Texts to numbers of their block's words; a block's word list follows it."""
    names = ["block", "doc_id", "numbers", "first", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 24, 0
        known: dict[str, int] = {}
        id_type = pa.int64()

        def word_list() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for at in range(0, len(words), LIST_ROWS):
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()),
                    pa.array([words[at: at + LIST_ROWS]], pa.list_(pa.string()))], names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text", TEXT_RUN):
                if filled >= block_bytes:
                    yield from word_list()
                    block, filled = block + 1, 0
                    known.clear()
                places, ends, distinct = split_words(part.column("text"))
                for word in distinct:
                    known.setdefault(word, len(known))
                numbers = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[places]
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, block)), part.column("doc_id"), pa.array(packed(numbers, ends), pa.binary()),
                    pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.string()))], names)
                filled += part.column("text").nbytes
        yield from word_list()

    return run


def blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts as numbers and the blocks' word lists, as a table in the shared folder, bucketed by block.

    Rows of texts: block, doc_id, numbers. Rows of word lists: block, first (the first word's number), words.
    """
    spark = docs.sparkSession
    rows = docs.select(column(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, math.ceil(size / block_bytes)))
    rows = rows.coalesce(buckets)  # small parts of a table are read together: the more text, the fewer words by block
    kind = rows.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "word-blocks")
    name = "word_blocks_" + path.rsplit("-", 1)[1]
    (rows.mapInArrow(released(_numbered(block_bytes)), f"block long, doc_id {kind}, numbers binary, first int, words array<string>")
     .write.option("path", path).option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(name))
    return spark.table(name)


def _encoded(tokenizer_path: str):
    """Words in sorted order get their ids (as ``packed``): each distinct word is encoded where its run begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_ids = None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = words[1:] if words[0] == last else words  # the run goes on from the batch before
            lists = [x.ids for x in _tokenizer(tokenizer_path).encode_batch_fast(new, add_special_tokens=False)]
            ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
            ids = ([last_ids] if len(new) < len(words) else []) + packed(np.fromiter(chain.from_iterable(lists), dtype=np.int64), ends)
            last, last_ids = words[-1], ids[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("block"), batch.column("number"), pa.array(ids, pa.binary()).take(coded.indices)],
                ["word", "block", "number", "ids"])

    return run


def word_places(table: DataFrame) -> DataFrame:
    """word, block and number of every block's words, each word's rows together and in order."""
    words = table.filter(F.col("words").isNotNull()).select("block", "first", F.posexplode("words").alias("at", "word"))
    return words.select("word", "block", (F.col("first") + F.col("at")).alias("number")).repartition("word").sortWithinPartitions("word")


def word_table(table: DataFrame, tokenizer_path: str) -> DataFrame:
    """The distinct words of ``blocks`` with their ids (array of int)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in _encoded(tokenizer_path)(batches):
            words = batch.column("word").to_pylist()
            begin = [i for i, w in enumerate(words) if w != (words[i - 1] if i else last)]
            last = words[-1]
            ids = [unpacked(x).astype(np.int32) for x in batch.column("ids").take(pa.array(begin, pa.int64())).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in begin], pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return word_places(table).mapInArrow(released(rows), "word string, ids array<int>")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, number, ids) of one block, as they come, as one row: numbers, the ids' bytes by word, and all ids."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).select(["block", "number", "ids"])
        rows = rows.take(pc.sort_indices(rows, [("block", "ascending"), ("number", "ascending")])).combine_chunks()
        block, number, ids = (rows.column(c).combine_chunks() for c in ("block", "number", "ids"))
        size = pc.binary_length(ids).to_numpy()
        block = block.to_numpy()
        ends = np.append(np.flatnonzero(np.diff(block)) + 1, len(block))
        cuts = [0, *ends.tolist()]
        flat = [b"".join(ids.slice(a, b - a).to_pylist()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[ends - 1]), *(pa.array(packed(x.astype(np.int64), ends), pa.binary()) for x in (number.to_numpy(), size)),
             pa.array(flat, pa.binary())], ["block", "number", "size", "ids"])

    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= 1 << 18:
            yield from close()
            held, count = [], 0
    if held:
        yield from close()


def _placed(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's texts (as ``packed``), from those of its words by number."""
    def numbers(name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, dtype=np.int64), *map(unpacked, words.column(name).to_pylist())])

    number, size = numbers("number"), numbers("size")
    flat = np.frombuffer(b"".join(words.column("ids").to_pylist()), dtype=np.uint8)
    begin, length = np.zeros((2, number.max(initial=-1) + 1), dtype=np.int64)
    begin[number], length[number] = np.cumsum(size) - size, size
    made = []
    for batch in texts.to_batches(max_chunksize=500):
        runs = [unpacked(x) for x in batch.column("numbers").to_pylist()]
        ids = [ragged(flat, begin[x], length[x]).tobytes() for x in runs]
        made.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"]))
    return pa.Table.from_batches(made, pa.schema([("doc_id", texts.schema.field("doc_id").type), ("ids", pa.binary())]))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids as lists."""
    for batch in batches:
        for part in slices(batch, "ids", ID_RUN):
            raw = part.column("ids").to_pylist()
            ids = unpacked(b"".join(raw)).astype(np.int32)
            last = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(raw), dtype=np.uint8) < 128)])
            ends = last[np.concatenate([[0], np.cumsum([len(x) for x in raw])])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])


def encode(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    table = blocks(docs, id_column, text_column, block_bytes)
    known = word_places(table).mapInArrow(
        released(lambda batches: _by_block(_encoded(tokenizer_path)(batches))), "block long, number binary, size binary, ids binary")
    texts = table.filter(F.col("words").isNull()).select("block", "doc_id", "numbers")
    kind = texts.schema["doc_id"].dataType.simpleString()
    placed = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_placed, f"doc_id {kind}, ids binary")
    return placed.mapInArrow(released(_listed), f"doc_id {kind}, ids array<int>")


def pieces(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """The vocabulary: id and piece, special tokens included."""
    with open(tokenizer_path, encoding="utf-8") as file:
        whole = json.load(file)
    found = {i: p for p, i in whole["model"]["vocab"].items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
    return spark.createDataFrame(sorted(found.items()), "id int, piece string")


def decode(encoded: DataFrame, vocabulary: DataFrame, ids: str = "ids", between: str = " ") -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of its ids with ``between`` between them, as a tokenizer without a decoder joins them.

    ``vocabulary`` has one row an id (``pieces``). An id that it doesn't hold has no piece, as in the library; null ids are none.
    """
    rows = vocabulary.select("id", "piece").collect()  # bounded by the vocabulary
    by_id: list[str | None] = [None] * (max((r["id"] for r in rows), default=-1) + 1)
    for r in rows:
        by_id[r["id"]] = r["piece"]
    piece = vocabulary.sparkSession.sparkContext.broadcast(by_id)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(piece.value, pa.string())

        def text(lists: pa.Array) -> pa.Array:
            flat = lists.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
            found = table.take(pc.if_else(inside, flat, pa.scalar(None, flat.type)))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            if found.null_count:  # ids without a piece leave no gap
                kept = found.is_valid().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(kept)])[ends]
                found = found.drop_null()
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), between)

        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:  # about ID_RUN ids at once, one row at least
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + ID_RUN, side="right")))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, text(part.column(part.num_columns - 1))], names)
                start = end

    others = [c for c in encoded.columns if c not in (ids, "decoded")]
    kept = encoded.select(*(column(c) for c in others), column(ids))
    names = [f"c{i}" for i in range(len(others) + 2)]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, kept.schema)] + [StructField(names[-1], StringType())])
    return kept.toDF(*names[:-1]).mapInArrow(released(joined), schema).toDF(*others, ids, "decoded")
