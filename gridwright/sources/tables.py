"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.columns import col, hash_key, nan_to_null

# Texts read as missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_table(spark: SparkSession, path: str, sep: str = ",",
               schema: T.StructType | str | None = None, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header row.

    Files are read in parts, unless quoted fields hold line breaks: then each is
    read whole by one task. ``multi_line`` says so; if it is left out, a pass over
    the lines, in parts too, finds out.

    With a schema the file is read once and typed by casts. Without one, every
    column is read as text and its narrowest type is found in one aggregate (whole
    number, number, boolean or text), after missing texts have become NULL.
    """
    if multi_line is None:
        multi_line = _fields_span_lines(spark, path)
    # double quotes inside quoted fields are doubled
    text = (spark.read.option("header", True).option("sep", sep).option("quote", '"')
            .option("escape", '"').option("multiLine", multi_line).csv(path))
    text = text.select(*[
        F.when(~F.coalesce(col(c), F.lit("")).isin(MISSING_TEXTS), col(c)).alias(c) for c in text.columns
    ])
    if schema is None:
        return nan_to_null(_typed(text, _infer(text)))
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    return nan_to_null(_typed(text, {c: kinds.get(c, "string") for c in text.columns}))


def _fields_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line ends inside quotes: the first that does has an odd number of them."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _infer(text: DataFrame) -> dict[str, str]:
    """Narrowest type that fits every value of each column."""
    tests = []
    for i, c in enumerate(text.columns):
        v = F.trim(col(c))
        known = v.isNotNull()
        tests += [
            F.count_if(known).alias(f"n{i}"),
            F.count_if(known & (v.rlike(r"^[+-]?\d+$")) & v.try_cast("bigint").isNotNull()).alias(f"l{i}"),
            F.count_if(known & v.try_cast("double").isNotNull()
                       & ~v.rlike("(?i)[df]$")).alias(f"d{i}"),
            F.count_if(known & v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    row = text.agg(*tests).first()
    kinds = {}
    for i, c in enumerate(text.columns):
        n = row[f"n{i}"]
        if n and row[f"l{i}"] == n:
            kinds[c] = "bigint"
        elif row[f"d{i}"] == n:
            kinds[c] = "double"
        elif row[f"b{i}"] == n:
            kinds[c] = "boolean"
        else:
            kinds[c] = "string"
    return kinds


def _typed(text: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return text.select(*[
        (col(c) if kinds[c] == "string" else F.trim(col(c)).cast(kinds[c])).alias(c) for c in text.columns
    ])


def read_scoring(spark: SparkSession, path: str, training: T.StructType, sep: str = ",",
                 multi_line: bool | None = None) -> DataFrame:
    """Rows to score, typed like the training table."""
    return read_table(spark, path, sep, training, multi_line)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; one file per task."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def columns(df: DataFrame) -> DataFrame:
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def preview(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """First rows by key: each task keeps n rows, no full sort."""
    return df.orderBy(*[col(c) for c in order]).limit(n)


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(col(target)), df.select(col(target))


def with_row_hash(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return df.withColumn("_h", hash_key(keys, seed))
