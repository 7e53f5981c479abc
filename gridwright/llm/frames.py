"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridwright.session import scratch_path

#: A word as the queries count it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that become Python objects at once.
PIECE_ROWS = 1000
#: Most integer keys that are broadcast (16 MB); beyond, a join shuffles.
BROADCAST_KEYS = 2_000_000


def column(name: str) -> Column:
    """A column by its exact name, also when the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its work is done once and survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose integer key is in ``keys``, without a shuffle where those are few enough."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch, unless the session says how many: rows here hold whole texts,
    and a batch takes memory outside the executor's heap and in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return memory that Arrow or the C library only keeps in reserve to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for ``mapInArrow``, giving memory that is only kept in reserve back to the system.

    Python workers live on over the stages of a job, next to the executor's heap.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(work(batches), 1):
            yield batch
            if number % 8 == 0:
                give_back()
        give_back()

    return run


def map_columns(df: DataFrame, rows: Callable[[list[pa.Array]], list[pa.Array]], schema: StructType) -> DataFrame:
    """``mapInArrow`` on columns by their places, so their names may be anything: ``rows`` turns those of a batch into new ones."""
    def placed(fields: int) -> list[str]:
        return [f"c{i}" for i in range(fields)]

    names = placed(len(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):  # what a batch turns into in Python stays small
                yield pa.RecordBatch.from_arrays(rows(batch.slice(start, PIECE_ROWS).columns), names)

    kinds = StructType([StructField(n, f.dataType) for n, f in zip(names, schema)])
    return df.toDF(*placed(len(df.columns))).mapInArrow(released(mapped), kinds).toDF(*schema.names)


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s : s + n]`` for every start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
