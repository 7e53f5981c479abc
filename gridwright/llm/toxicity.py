"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the character n-grams (``SIZES``) inside lower-cased words, a word
being bounded by anything that is not a letter or digit; a feature counts once a
text. Each n-gram is hashed into ``2 ** HASH_BITS`` cells. From the labelled
texts come, per cell, the number of toxic and of clean texts that hold it; the
log ratio of the two (smoothed) scales the feature. Every cell that tells the
classes apart by ``least_gain`` (log likelihood ratio; 2 is what an n-gram gains
that stands in one toxic text only where one text in eight is toxic) enters a
logistic regression over the scaled values; there is no largest number of them. A text's score is the regression's probability of label 1.

Scoring reads whole texts in one pass without a shuffle: the model (a table of
fixed size) goes to the tasks, and long texts are worked through in windows that
overlap by one n-gram.

Defined cases: a null text is an empty one and gets the score of a text without
features; repeated rows get the same score each; extra columns are ignored, so
their names can't clash; without labelled rows of both classes the score is the
share of label 1 among the labelled rows (0 without any); empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridwright.llm.frames import PIECE_ROWS, column, map_columns, released, text_of
from gridwright.session import checkpoint

SIZES = (3, 4, 5, 6)
HASH_BITS = 20
#: Characters worked on at once; longer texts go through several windows.
WINDOW = 1 << 19
_MULTIPLIER = np.uint32(0x9E3779B1)
_BASE = np.uint32(0x01000193)


@dataclass(frozen=True)
class ToxicityModel:
    """``slots`` maps a hash cell to a feature or -1; ``weights`` hold ratio times coefficient."""

    slots: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two blanks, other than letters and digits as 0."""
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points belong to words: ASCII letters and digits, and all from U+00C0 but × and ÷."""
    return (
        ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
        | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ((codes < 0x2000) | (codes > 0x206F)))
    )


def cells(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the hash cell from every position, and which positions hold an n-gram.

    An n-gram may begin or end with a boundary but has none inside, so it lies in one word.
    """
    inside = _letters(codes)
    codes = np.where(inside, codes, np.uint32(0))
    count = len(codes)
    value = codes * _BASE + np.uint32(1)
    whole = np.ones(count, dtype=bool)
    for size in range(2, max(SIZES) + 1):
        if count < size:
            return
        keep = count - size + 1
        value = (value[:keep] ^ (value[:keep] >> np.uint32(15))) * _BASE + codes[size - 1:]
        whole = whole[:keep] & inside[size - 2: size - 2 + keep] if size > 2 else whole[:keep]
        if size in SIZES:
            mixed = (value + np.uint32(size)) * _MULTIPLIER
            yield ((mixed ^ (mixed >> np.uint32(13))) * _MULTIPLIER) >> np.uint32(32 - HASH_BITS), whole


def _windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, end of each text in them, number of the first text) for runs of texts.

    Texts are separated by a boundary. A text longer than a window comes in overlapping parts.
    """
    parts: list[np.ndarray] = []
    first, held = 0, 0
    overlap = max(SIZES)
    for i, text in enumerate(t for at in range(0, len(texts), PIECE_ROWS) for t in texts.slice(at, PIECE_ROWS).to_pylist()):
        codes = _codes(text or "")
        if parts and held + len(codes) > WINDOW:
            yield np.concatenate(parts), np.cumsum([len(p) for p in parts]), first
            parts, held = [], 0
        if not parts:
            first = i
        while len(codes) > WINDOW:
            yield codes[:WINDOW], np.array([WINDOW]), i
            codes = codes[WINDOW - overlap:]
        parts.append(codes)
        held += len(codes)
    if parts:
        yield np.concatenate(parts), np.cumsum([len(p) for p in parts]), first


def _found(texts: pa.Array, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs of a batch, for features with a slot."""
    keys = [np.empty(0, dtype=np.int64)]
    width = np.int64(1 << HASH_BITS)
    for codes, ends, first in _windows(texts):
        here = []
        for cell, whole in cells(codes):
            slot = slots[cell]
            at = np.flatnonzero((slot >= 0) & whole)
            here.append((np.searchsorted(ends, at, side="right") + first) * width + slot[at])
        if here:
            keys.append(np.unique(np.concatenate(here)))
    pairs = np.unique(np.concatenate(keys))
    return pairs // width, pairs % width


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each label each cell occurs."""
    counts = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
    every = np.arange(1 << HASH_BITS, dtype=np.int32)
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        step = 200  # bounds the distinct pairs held at once
        for start in range(0, batch.num_rows, step):
            text, cell = _found(batch.column("text").slice(start, step), every)
            for label in (0, 1):
                counts[label] += np.bincount(cell[labels[start + text] == label], minlength=1 << HASH_BITS)
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], ["cell", "clean", "toxic"])


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", max_rows: int = 20_000, least_gain: float = 3.0,
    smoothing: float = 1.0, ridge: float = 1e-3,
) -> ToxicityModel:
    """Fit on the labelled rows, or where there are more than ``max_rows`` on about so many.

    ``max_rows`` bounds what a fit reads: beyond it, the rows with the lowest
    hashes of their ids are taken, with the hash bound set from the row count.
    A document that is labelled both ways counts as toxic.
    """
    marks = labels.select(column(id_column).alias("id"), column(label_column).cast("int").alias("label")).filter(
        "id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(column(id_column).alias("id"), text_of(text_column).alias("text")).join(marks, "id")
    totals = rows.groupBy("label").count().collect()
    size = {r["label"]: r["count"] for r in totals}
    none = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    if len(size) < 2:
        odds = 50.0 if size.get(1) else -50.0
        return ToxicityModel(none, np.zeros(0), np.zeros(0), odds)
    share = min(1.0, max_rows / sum(size.values()))
    if share < 1.0:
        rows = rows.filter(F.xxhash64("id") <= F.lit(int(-(2**63) + share * (2**64 - 1))))
    rows = checkpoint(rows.repartition(8))
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(size) < 2:
        return ToxicityModel(none, np.zeros(0), np.zeros(0), 50.0 if size.get(1) else -50.0)
    counted = rows.select("text", "label").mapInArrow(released(_count_cells), "cell long, clean long, toxic long").groupBy("cell").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    def share_of(name: str, label: int) -> F.Column:
        return (F.col(name) + smoothing) / (size[label] + 2 * smoothing)

    def surprise(name: str, label: int) -> F.Column:
        seen, rest = F.col(name), size[label] - F.col(name)
        both = (F.col("clean") + F.col("toxic") + smoothing) / (sum(size.values()) + 2 * smoothing)
        return seen * F.log(share_of(name, label) / both) + rest * F.log((1 - share_of(name, label)) / (1 - both))

    best = counted.select(
        "cell", F.log(share_of("toxic", 1) / share_of("clean", 0)).alias("ratio"),
        (surprise("clean", 0) + surprise("toxic", 1)).alias("gain"),
    ).filter(F.col("gain") >= least_gain).orderBy("cell").collect()  # at most a row a hash cell
    slots, ratios = none.copy(), np.array([r["ratio"] for r in best])
    slots[[r["cell"] for r in best]] = np.arange(len(best))

    vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, slot = _found(batch.column("text"), slots)
            offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            sparse = pa.StructArray.from_arrays([  # the library's own form of a sparse vector
                pa.array(np.zeros(batch.num_rows, dtype=np.int8)), pa.array(np.full(batch.num_rows, len(ratios), dtype=np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(ratios[slot])),
            ], fields=list(vector))
            yield pa.RecordBatch.from_arrays([batch.column("label"), sparse], ["label", "features"])

    training = checkpoint(rows.select(F.col("label").cast("double").alias("label"), "text").mapInArrow(
        released(featured), StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])))
    fitted = LogisticRegression(regParam=ridge, standardization=False, maxIter=50, tol=1e-5).fit(training)
    return ToxicityModel(slots, ratios, ratios * fitted.coefficients.toArray(), float(fitted.intercept))


def score(
    docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``doc_id`` (or the columns ``keep``, as they are) and ``score`` in [0, 1] for every row, from its whole text."""
    # fixed size: 2 ** HASH_BITS slots and at most as many weights
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(columns: list[pa.Array]) -> list[pa.Array]:
        model = shared.value
        text, slot = _found(columns[0], model.slots)
        sums = np.bincount(text, weights=model.weights[slot], minlength=len(columns[0])) + model.bias
        return [*columns[1:], pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -500, 500))))]

    kept = [column(id_column).alias("doc_id")] if keep is None else [column(c) for c in keep]
    wanted = docs.select(*kept).schema.add("score", "double")
    return map_columns(docs.select(text_of(text_column), *kept), scored, wanted)


def held_out(id_column: str = "doc_id") -> F.Column:
    """Rows kept from learning: those whose crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(column(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
