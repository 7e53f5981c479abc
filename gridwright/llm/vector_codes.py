"""Compression of vectors to codes of one entry a part, with an equal-average search for the entries.

Vectors become whole numbers (floor of ``scale`` times a component) and are cut
into ``parts`` equal consecutive parts. Each part position has a codebook. It
starts with that part of the ``entries`` vectors of the smallest ids, and each of
``rounds`` rounds assigns every vector's parts to their nearest entries and
replaces an entry by the componentwise floor of its parts' mean; an entry without
parts stays. Then all parts are assigned once more.

Nearest entries come from an equal-average search (``Codebooks.nearest``). A
codebook is sorted by the sums of its entries' components. From the place of a
part's own sum the search goes outward, always to the entry of the smaller gap
between the sums. By the inequality of Cauchy and Schwarz an entry whose sum is
``g`` away is at least ``g * g / d`` away in squared distance, d components to a
part; as soon as that strictly exceeds the best distance, no entry left can win
or tie. Distances are whole numbers, ties go to the entry of the lower index, so
the result is that of looking at all entries.

Spark reads the vectors once a round. A task adds up its parts by entry and gives
one row a used entry; sums of those come to the driver, ``parts * entries`` rows
however many vectors there are, and the new codebooks go out to the tasks. Sums of
errors by label are joined back; the sums are broadcast where their counted size
is small, otherwise the join is salted, so a label of a third of all rows is many
tasks' work.

Defined cases: vectors that are null, empty or hold a null or non-finite component
are dropped; so are those whose length is no multiple of ``parts`` or differs from
that of the kept vector of the smallest id. Rows with a null id or label are kept
(such ids come last when a codebook starts, null labels count as one); repeated
rows count each, in order of their vectors; fewer vectors than ``entries`` give
smaller codebooks; extra columns are ignored; an empty table gives an empty
result. Components so large that squares would leave 64 bits raise a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.frames import column, released, written

#: Sums by label that are broadcast: rows, and bytes of their labels. Beyond, the join has so many salts.
LABEL_ROWS, LABEL_BYTES, SALTS = 100_000, 4 << 20, 32


@dataclass(frozen=True)
class Codebooks:
    """``values`` [part, entry, component], whole numbers."""

    values: np.ndarray

    @property
    def digest(self) -> str:
        """SHA-256 of all components, decimal, joined by commas: by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For vectors [row, part, component]: the nearest entry and its squared distance, both [row, part];
        and how many distances were worked out."""
        parts, entries, size = self.values.shape
        reach = int(max(np.abs(vectors).max(initial=0), np.abs(self.values).max(initial=0)))
        if reach and size * size * (2 * reach) ** 2 >= 2**62:
            raise ValueError("components are too large for exact 64-bit distances")
        sums = self.values.sum(axis=2)
        order = np.argsort(sums, axis=1, kind="stable")
        sums = np.take_along_axis(sums, order, axis=1).ravel()
        sorted_values = np.take_along_axis(self.values, order[:, :, None], axis=1).reshape(-1, size)
        index = order.ravel()
        own = vectors.sum(axis=2)
        x, mine = vectors.reshape(-1, size), own.ravel()
        first = np.tile(np.arange(parts) * entries, len(vectors))  # where the codebook of each row of x begins
        start = np.stack([np.searchsorted(sums[p * entries: (p + 1) * entries], own[:, p]) for p in range(parts)], axis=1).ravel()
        low, high, last = first + start - 1, first + start, first + entries
        best = np.full(len(x), -1, dtype=np.int64)  # none yet
        entry = np.zeros(len(x), dtype=np.int64)
        active, looked = np.arange(len(x)), 0
        far = np.int64(2**62)
        while True:
            down, up = low[active], high[active]
            gap_down = np.where(down >= first[active], mine[active] - sums[np.maximum(down, 0)], far)
            gap_up = np.where(up < last[active], sums[np.minimum(up, len(sums) - 1)] - mine[active], far)
            gap = np.minimum(gap_down, gap_up)
            on = gap < far
            on[on] &= (best[active[on]] < 0) | (gap[on] * gap[on] <= best[active[on]] * size)
            active, down_first = active[on], (gap_down <= gap_up)[on]
            if not len(active):
                break
            at = np.where(down_first, low[active], high[active])
            low[active] -= down_first
            high[active] += ~down_first
            off = x[active] - sorted_values[at]
            distance = np.einsum("ij,ij->i", off, off)
            looked += len(active)
            better = (best[active] < 0) | (distance < best[active]) | ((distance == best[active]) & (index[at] < entry[active]))
            best[active[better]], entry[active[better]] = distance[better], index[at[better]]
        return entry.reshape(-1, parts), best.reshape(-1, parts), looked


def whole_vectors(vectors: pa.Array, scale: int, parts: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kept rows' numbers, and their components as whole numbers [row, component]; ``length`` is that of all kept vectors."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((sizes == length) if length else (sizes > 0) & (sizes % parts == 0))
    if not len(rows):
        return rows, np.empty((0, length or 0), dtype=np.int64)
    flat = pc.fill_null(vectors.take(pa.array(rows)).flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    x = np.floor(scale * flat.reshape(len(rows), -1))
    fine = np.isfinite(x).all(axis=1)
    if np.abs(x[fine]).max(initial=0) >= 2**31:
        raise ValueError("components are too large for exact 64-bit distances")
    return rows[fine], x[fine].astype(np.int64)


def _start(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The codebooks of the vectors with the smallest ids; None without vectors."""
    fine = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = rows.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0) & fine)
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    least = kept.orderBy(*order).limit(1).collect()
    if not least:
        return None
    length = len(least[0]["vector"])
    chosen = kept.filter(F.size("vector") == length).orderBy(*order).limit(entries).collect()
    x = np.floor(scale * np.array([r["vector"] for r in chosen], dtype=np.float64))
    if np.abs(x).max() >= 2**31:
        raise ValueError("components are too large for exact 64-bit distances")
    return Codebooks(x.astype(np.int64).reshape(len(chosen), parts, -1).transpose(1, 0, 2).copy())


def _improved(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """One round: entries become the floors of their parts' means."""
    parts, entries, size = books.values.shape
    names = [f"s{k}" for k in range(size)]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, size), dtype=np.int64)
        for batch in batches:
            _, x = whole_vectors(batch.column("vector"), scale, parts, parts * size)
            x = x.reshape(-1, parts, size)
            slot = (books.nearest(x)[0] + np.arange(parts) * entries).ravel()
            count += np.bincount(slot, minlength=parts * entries)
            np.add.at(total, slot, x.reshape(-1, size))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), *(pa.array(total[used, k]) for k in range(size))], ["slot", "n", *names])

    sums = rows.select("vector").mapInArrow(released(added), "slot long, n long, " + ", ".join(f"{n} long" for n in names))
    values = books.values.reshape(-1, size).copy()
    for r in sums.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect():  # a row an entry
        values[r["slot"]] = [r[n] // r["n"] for n in names]
    return Codebooks(values.reshape(books.values.shape))


def train(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds over all vectors; None if there are none."""
    rows = vectors.select(column(id_column).alias("id"), column(vector_column).alias("vector"))
    books = _start(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = _improved(rows, books, scale)
    return books


def compress(
    vectors: DataFrame, books: Codebooks | None, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label", scale: int = 256,
) -> DataFrame:
    """id and label, ``code`` (array of entries by part), ``error`` (squared distances added up) of every kept vector."""
    rows = vectors.select(column(id_column).alias("id"), column(label_column).alias("label"), column(vector_column).alias("vector"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("id", "label")) + ", code array<int>, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], kinds)
    parts, _, size = books.values.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = whole_vectors(batch.column("vector"), scale, parts, parts * size)
            entry, distance, _ = books.nearest(x.reshape(-1, parts, size))
            ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * parts)
            code = pa.ListArray.from_arrays(ends, pa.array(entry.ravel().astype(np.int32)))
            pick = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pick), batch.column("label").take(pick), code, pa.array(distance.sum(axis=1))],
                ["id", "label", "code", "error"])

    return rows.mapInArrow(released(coded), kinds)


def with_label_errors(coded: DataFrame, label_rows: int = LABEL_ROWS, label_bytes: int = LABEL_BYTES, salts: int = SALTS) -> DataFrame:
    """``coded`` with ``label_error``, the errors added up over equal labels, nulls together."""
    coded = written(coded, "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    size = totals.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col("label").cast("string"))).alias("bytes")).first()
    totals = totals.withColumnRenamed("label", "of")
    if size["rows"] <= label_rows and (size["bytes"] or 0) <= label_bytes:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = totals.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int")
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of"))
    return coded.withColumn("salt", salt).join(salted, same).drop("of", "salt", "salt_of")
