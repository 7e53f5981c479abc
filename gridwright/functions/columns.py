"""Column expressions and schema helpers used by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType, T.DayTimeIntervalType,
)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not numeric: strings, booleans, dates and timestamps."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC + NESTED)]


def col(name: str) -> Column:
    """Reference a column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.DayTimeIntervalType):
        units = (("DAY", 86400.0), ("HOUR", 3600.0), ("MINUTE", 60.0), ("SECOND", 1.0))
        return add_all(
            F.extract(F.lit(u), col(name)).cast("double") * F.lit(w) for u, w in units
        )
    return col(name).cast("double")


def order_text(df: DataFrame, name: str) -> Column:
    """A key as text whose order is the key's own: whole numbers of any sign and length, other values as they are."""
    c = col(name)
    if not isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    low = c.cast("long").bitwiseAND(F.lit(2**63 - 1)).cast("string")  # a negative number counts up from the smallest
    return F.concat(F.when(c < 0, "0").otherwise("1"), F.lpad(low, 19, "0"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NULL the only missing marker (one projection, no shuffle)."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def r(column: Column, digits: int = 4) -> Column:
    """Report rounding; adding 0.0 turns a negative zero into a plain one."""
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """Division that yields NULL, or ``default``, where the divisor is 0."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def hash_key(keys: Sequence[Column | str], seed: int | str = 42) -> Column:
    """Hex md5 of seed and row key.

    A total order that does not depend on partitioning, the same in any engine
    with md5, uniform over its prefixes.
    """
    parts = [k if isinstance(k, Column) else col(k) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def add_all(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text; timestamps without zone keep their wall-clock form."""
    return col(name).cast("string")
