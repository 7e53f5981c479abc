"""Ranked search of whole documents by a scan with an automaton of all items' terms.

A term is a longest run of ASCII letters, digits and non-ASCII characters; only
A-Z count as their small letters. There is no index of the documents:

1. Items: their distinct terms. Items are dealt into groups whose terms stay
   below ``TERM_BYTES`` and whose table of terms by items stays below ``CELLS``
   (one item alone may be larger), so what goes to the tasks is bounded however
   many items there are. Each group is one scan.
2. Scan: the group's terms form an Aho-Corasick automaton, each with a blank on
   both sides as guard. Texts have every other character made a blank, so a
   guarded term is found exactly where it stands as a whole term, and two terms
   may share the blank between them. One pass over a text gives tf of all terms
   of all items, and the number n of its terms. UTF-8 is scanned byte by byte:
   all bytes of other than ASCII characters belong to terms.
3. Statistics over all documents: N with a term, L terms in all, df by term.
4. Scores: an output of the automaton is a row of the terms-by-items table, and a
   block of documents times that table gives all scores of the block, as whole
   numbers (in doubles while they are below 2^53, else in 64-bit integers). A
   task gives the ``k`` best of each item; those are ranked in two steps, first
   within a share of the documents.

Memory: one block of documents by terms, and k rows an item.

Defined cases: a null or empty text has no terms, counts in no statistic and is
never found; very long texts are scanned whole; repeated documents are ranked
each, a null document id after others of the same score; rows of items with the
same id (null is one) are one item with the terms of all; items without terms, or
none of whose terms occur, have no rows; extra columns are ignored; empty tables
give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gridwright.llm.frames import column, released, slices, text_of, written

#: A term in a text with A-Z made small.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes of terms in an automaton, cells of a table of terms by items or documents, bytes of text scanned at once.
TERM_BYTES, CELLS, TEXT_RUN = 1 << 20, 4 << 20, 4 << 20
#: Shares of the documents that are ranked by themselves first.
SHARES = 64

_BLANK = 32
#: Byte by byte: A-Z small, what belongs to no term a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _BLANK for b in range(256))


def terms_of(text: Column) -> Column:
    """All terms of a text in order."""
    return F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(TERM), F.lit(0))


class TermScan:
    """Counts given terms in texts; a term's output is its place in ``terms``."""

    def __init__(self, terms: Sequence[str]):
        import ahocorasick

        self.terms = len(terms)
        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            self.automaton.add_word(" " + term.encode().decode("latin-1") + " ", number)
        self.automaton.make_automaton()

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's number of terms of any kind; and (text, term, occurrences) sorted by text and term."""
        raw = texts.cast(pa.binary()).to_pylist()
        joined = (b" " + b" ".join(raw) + b" ").translate(_PLAIN)
        begins = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        inside = np.frombuffer(joined, dtype=np.uint8) != _BLANK
        first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        n = np.diff(np.searchsorted(first, begins))
        if not self.terms:
            return n, *np.empty((3, 0), dtype=np.int64)
        # an output comes at the blank behind the term
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        text = np.searchsorted(begins, found[:, 0] - 1, side="right") - 1
        key, tf = np.unique(text * self.terms + found[:, 1], return_counts=True)
        return n, key // self.terms, key % self.terms, tf


def scan(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """doc_id, n, and the numbers and occurrences of the ``terms`` that it holds. ``docs``: doc_id, text."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            automaton = automaton or TermScan(terms)
            for part in slices(batch, "text", TEXT_RUN):
                n, text, term, tf = automaton.count(part.column("text"))
                ends = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(released(scanned), f"doc_id {kind}, n long, terms array<int>, tf array<int>")


class BestRows:
    """The k best (score, id) of each item, of all blocks given so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items)  # a score below an item's floor is out
        self.held: pa.Table | None = None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        if len(scores) > self.k:
            at = len(scores) - self.k
            self.floor = np.maximum(self.floor, np.partition(scores, at, axis=0)[at])
        row, item = np.nonzero(scores >= self.floor)
        new = pa.table({"item": item.astype(np.int32), "score": scores[row, item].astype(np.int64), "doc_id": ids.take(pa.array(row))})
        whole = (pa.concat_tables([self.held, new]) if self.held else new).combine_chunks()
        whole = whole.take(pc.sort_indices(whole, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
        item = whole.column("item").to_numpy()
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.held = whole.filter(pa.array(rank < self.k)).combine_chunks()
        last = rank == self.k - 1
        self.floor[item[last]] = np.maximum(self.floor[item[last]], whole.column("score").to_numpy()[last])


def scores_of(
    n: np.ndarray, text: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, table: np.ndarray, documents: int, length: int,
) -> np.ndarray:
    """Scores [document, item]; (text, term, tf) are the occurrences and ``table`` [term, item] says which items hold a term."""
    m = np.array([10 + 90 * x * documents // length for x in n.tolist()], dtype=np.int64)
    part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[text]))
    # no sum of an item's terms is larger: below 2^53 doubles hold it exactly
    exact = int(weights.max(initial=0)) * 1_000_000 * int(table.sum(axis=0).max(initial=0)) < 2**53
    cells = np.zeros((len(n), len(weights)), dtype=np.float64 if exact else np.int64)
    cells[text, term] = part
    return cells @ table.astype(cells.dtype)


def _best(scans: DataFrame, weights: np.ndarray, table: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item (its place), score, doc_id: each task's k best of each item."""
    spark = scans.sparkSession
    shared = spark.sparkContext.broadcast((weights, table))
    block = max(1, CELLS // max(1, len(weights)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, table = shared.value
        best = BestRows(table.shape[1], k)
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                terms = batch.column("terms")
                text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
                n = batch.column("n").to_numpy()
                best.add(scores_of(n, text, term, tf, weights, table, documents, length), batch.column("doc_id"))
        if best.held:
            yield from best.held.to_batches()

    kind = scans.schema["doc_id"].dataType.simpleString()
    return scans.filter("size(terms) > 0").mapInArrow(released(scored), f"item int, score long, doc_id {kind}")


def _grouped(pairs: DataFrame, term_bytes: int, cells: int) -> tuple[DataFrame, int]:
    """``pairs`` (item_id, term) with ``part``, a group of items, and the number of groups."""
    parts = 1
    while True:
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
        sizes = dealt.groupBy("part").agg(
            F.countDistinct("item_id").alias("items"), F.count("*").alias("terms"), F.sum(F.octet_length("term") + 2).alias("bytes"))
        large = sizes.filter((F.col("items") > 1) & ((F.col("bytes") > term_bytes) | (F.col("items") * F.col("terms") > cells)))
        if large.isEmpty():
            return dealt, parts
        parts *= 2


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", term_bytes: int = TERM_BYTES, cells: int = CELLS,
) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents with the highest scores above 0 for each item; ties to the smaller id."""
    spark = docs.sparkSession
    texts = docs.select(column(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    pairs = written(items.select(column(item_column).alias("item_id"), F.explode(terms_of(text_of(item_text))).alias("term")).distinct(), "item-terms")
    dealt, parts = _grouped(pairs, term_bytes, cells)
    found = [x for part in range(parts) if (x := _one_group(spark, texts, dealt.filter(F.col("part") == part), k)) is not None]
    if not found:
        return spark.createDataFrame([], StructType([
            pairs.schema["item_id"], StructField("rank", IntegerType()), texts.schema["doc_id"]])).withColumn("score", F.lit(0).cast("long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _one_group(spark: SparkSession, texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    rows = pairs.select("item_id", "term").collect()  # bounded by the groups
    if not rows:
        return None
    terms = sorted({r["term"] for r in rows})
    item_ids = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i or 0))
    term_at, item_at = {t: i for i, t in enumerate(terms)}, {i: n for n, i in enumerate(item_ids)}
    table = np.zeros((len(terms), len(item_ids)), dtype=np.float64)
    for r in rows:
        table[term_at[r["term"]], item_at[r["item_id"]]] = 1
    scans = written(scan(texts, terms), "term-scan")
    total = scans.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    if not total["length"]:
        return None
    weights = np.zeros(len(terms), dtype=np.int64)
    for r in scans.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row a term
        weights[r["term"]] = math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * r["df"] + 1)))
    best = _best(scans, weights, table, total["documents"], total["length"], k)
    best = best.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    for keys in (["item", "share"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(item_ids)), StructType([
        StructField("item", IntegerType()), StructField("item_id", pairs.schema["item_id"].dataType)]))
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
