"""Profiles of a table: shape, gaps, distinct counts, moments, quantiles, counts,
histograms and correlations. Every report is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.columns import (
    add_all, as_double, categorical_columns, col, hash_key, numeric_columns, r, ratio,
)
from gridwright.functions.ordered import join_sized, quantiles
from gridwright.operators.gram import pair_moments

# Targets with at most this many distinct values count as classes.
CLASS_LIMIT = 20
# The exploratory target plot switches from counts to a histogram here.
PLOT_CLASS_LIMIT = 15
# Wider tables compute correlations from per-partition cross products.
PAIR_EXPRESSION_LIMIT = 40


def _stack(one_row: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry of ``rows``."""
    cells = F.array(*[F.struct(*[c.alias(k) for k, c in row.items()]) for row in rows])
    return one_row.select(F.inline(cells))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols")
    )


def column_types(df: DataFrame) -> DataFrame:
    numeric = set(numeric_columns(df))
    rows = [
        (i, f.name, f.dataType.simpleString(), "numerical" if f.name in numeric else "categorical")
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position long, column string, dtype string, kind string"
    )


def missing(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column, in one pass."""
    names = df.columns
    one = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)],
    )
    return _stack(one, [
        {
            "column": F.lit(c),
            "n_missing": F.col(f"m{i}"),
            "pct_missing": r(ratio(F.col(f"m{i}") * 100.0, F.col("n")), 2),
        }
        for i, c in enumerate(names)
    ])


def missing_detail(df: DataFrame) -> DataFrame:
    return missing(df).filter("n_missing > 0").orderBy(F.desc("n_missing"), "column")


def _value_text(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # -0.0 and 0.0 are one value
    return c.cast("string")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long frame (column, value, n) of all non-missing values.

    One unpivot and one hash aggregation serve every column; repeated values are
    combined before the shuffle, so a dominant value costs nothing extra.
    """
    columns = list(columns or df.columns)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), _value_text(df, c).alias("value")) for c in columns
    ])
    return (
        df.select(F.inline(cells)).filter("value IS NOT NULL")
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    approximate: bool = False) -> DataFrame:
    columns = list(columns or df.columns)
    if approximate:
        one = df.agg(*[
            F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)
        ])
        return _stack(one, [
            {"column": F.lit(c), "n_unique": F.col(f"d{i}")} for i, c in enumerate(columns)
        ])
    counted = None
    for family in _families(df, columns):
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), value.alias("value")) for c, value in family
        ])
        values = df.select(F.inline(cells)).filter("value IS NOT NULL").distinct()
        part = values.groupBy("column").agg(F.count("*").alias("n_unique"))
        counted = part if counted is None else counted.unionByName(part)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique")
    )


def _families(df: DataFrame, columns: Sequence[str]) -> list[list[tuple[str, Column]]]:
    """Columns grouped by a common type, so that values keep their native form."""
    integers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    out: dict[str, list[tuple[str, Column]]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, integers):
            out.setdefault("bigint", []).append((c, col(c).cast("bigint")))
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            out.setdefault("double", []).append((c, col(c).cast("double") + F.lit(0.0)))
        else:
            out.setdefault(kind.simpleString(), []).append((c, col(c)))
    return list(out.values())


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int | None = 5) -> DataFrame:
    """Most frequent values per column, ties in ascending value order.

    The rank filter is pushed below the shuffle by Spark, so each map task sends
    at most ``k`` rows per column.
    """
    columns = categorical_columns(df) if columns is None else list(columns)
    counts = value_counts(df, columns)
    if k is None:
        return counts
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(
        F.col("rank") <= k
    ).select("column", "value", "n", "rank")


def column_info(df: DataFrame) -> DataFrame:
    return (
        column_types(df).select("column", "dtype", "kind")
        .join(missing(df).select("column", "n_missing"), "column")
        .join(distinct_counts(df), "column")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier one.

    Two hashes of each row are grouped first; only rows whose hashes occur more
    than once are then compared whole.
    """
    columns = [col(c) for c in df.columns]
    hashed = df.select(*columns, F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit(1), *columns).alias("_h2"))
    again = hashed.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h1", "_h2")
    rows = join_sized(hashed, again, ["_h1", "_h2"], "left_semi")
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates")
    )


def corrected_skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    spread = F.coalesce(F.skewness(x), F.lit(0.0))
    return F.when(n >= 3, spread * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(g2.isNull(), F.lit(0.0)).otherwise(value))


NUMERIC_STATS = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    "skewness": corrected_skewness, "kurtosis": corrected_kurtosis,
    "n_zeros": lambda x: F.count_if(x == 0), "n_negative": lambda x: F.count_if(x < 0),
}
COUNT_STATS = {"n_zeros", "n_negative", "count"}


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None,
                  stats: Sequence[str] = tuple(NUMERIC_STATS)) -> DataFrame:
    """One fused aggregate for all numeric columns, one row per column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    one = df.agg(*[
        {**NUMERIC_STATS, "count": F.count}[s](as_double(df, c)).alias(f"{s}_{i}")
        for i, c in enumerate(columns) for s in stats
    ])
    return _stack(one, [
        {"column": F.lit(c), **{
            s: F.col(f"{s}_{i}") if s in COUNT_STATS else r(F.col(f"{s}_{i}")) for s in stats
        }}
        for i, c in enumerate(columns)
    ])


def quartiles(df: DataFrame, columns: Sequence[str] | None = None,
              approximate: bool = False) -> DataFrame:
    columns = numeric_columns(df) if columns is None else list(columns)
    if approximate:
        one = df.agg(*[
            F.percentile_approx(as_double(df, c), [0.25, 0.5, 0.75]).alias(f"q{i}")
            for i, c in enumerate(columns)
        ])
        return _stack(one, [
            {"column": F.lit(c), **{
                f"{name}_approx": r(F.col(f"q{i}")[j])
                for j, name in enumerate(("q25", "median", "q75"))}}
            for i, c in enumerate(columns)
        ])
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [(c, *[None if v is None else float(v) for v in q[c]]) for c in columns]
    frame = df.sparkSession.createDataFrame(
        rows, "column string, q25 double, median double, q75 double")
    return frame.select("column", *[r(F.col(c)).alias(c) for c in ("q25", "median", "q75")])


def _outlier_count(x: Column, q1: float | None, q3: float | None) -> Column:
    if q1 is None:
        return F.count_if(F.lit(False))
    reach = 1.5 * (q3 - q1)
    return F.count_if((x < q1 - reach) | (x > q3 + reach))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else list(columns)
    q = quantiles(df, columns, [0.25, 0.75])
    one = df.agg(*[
        _outlier_count(as_double(df, c), *q[c]).alias(f"o{i}") for i, c in enumerate(columns)
    ])
    return _stack(one, [
        {"column": F.lit(c), "n_outliers_iqr": F.col(f"o{i}")} for i, c in enumerate(columns)
    ])


def samples(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
            k: int = 5, seed: int = 42) -> DataFrame:
    """Up to ``k`` non-missing values per column, drawn in hash order of the key."""
    columns = list(columns or df.columns)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), _value_text(df, c).alias("value")) for c in columns
    ])
    long = df.select(hash_key(keys, seed).alias("_h"), F.inline(cells)).filter("value IS NOT NULL")
    w = Window.partitionBy("column").orderBy("_h")
    return long.withColumn("rank", F.row_number().over(w).cast("long")).filter(
        F.col("rank") <= k
    ).select("column", "rank", "value")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All numeric column facts, one row per column.

    Quartiles first; then every other fact, outliers included, in one fused
    aggregate; distinct values come from the shared long frame.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    narrow = df.select(*[col(c) for c in columns])
    q = quantiles(narrow, columns, [0.25, 0.5, 0.75])
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        x = as_double(narrow, c)
        aggs.append(F.count_if(col(c).isNull()).alias(f"missing_{i}"))
        aggs += [f(x).alias(f"{s}_{i}") for s, f in NUMERIC_STATS.items()]
        aggs.append(_outlier_count(x, q[c][0], q[c][2]).alias(f"outliers_{i}"))
    facts = _stack(narrow.agg(*aggs), [
        {
            "column": F.lit(c),
            "n_missing": F.col(f"missing_{i}"),
            "pct_missing": r(ratio(F.col(f"missing_{i}") * 100.0, F.col("n")), 2),
            **{s: F.col(f"{s}_{i}") if s in COUNT_STATS else r(F.col(f"{s}_{i}")) for s in NUMERIC_STATS},
            **{name: r(F.lit(q[c][j])) for j, name in enumerate(("q25", "median", "q75"))},
            "n_outliers_iqr": F.col(f"outliers_{i}"),
        }
        for i, c in enumerate(columns)
    ])
    return facts.join(distinct_counts(narrow, columns), "column")


def profile(df: DataFrame, target: str | None = None, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The whole profile as a set of frames (lazy except for quantiles)."""
    out = {
        "shape": shape(df),
        "columns": column_info(df),
        "missing": missing_detail(df),
        "duplicates": duplicate_rows(df),
        "top_values": top_values(df),
        "overview": overview(df),
    }
    if numeric_columns(df):
        out["numeric"] = profile_numeric(df)
        out["correlation"] = correlation(df)
    if keys:
        out["samples"] = samples(df, keys)
    if target and target in df.columns:
        out["target"] = target_facts(df, target)
        out["target_counts"] = top_values(df, [target], CLASS_LIMIT)
    return out


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.DateType))


def target_facts(df: DataFrame, target: str) -> DataFrame:
    """Type, distinct count and suggested task of a target column."""
    text = F.lit(_is_text(df, target))
    boolean = F.lit(isinstance(df.schema[target].dataType, T.BooleanType))
    few = F.col("n_unique") <= CLASS_LIMIT

    def task(is_class: Column) -> Column:
        return F.when(is_class, "classification").otherwise("regression")

    return distinct_counts(df, [target]).select(
        "column",
        F.lit(df.schema[target].dataType.simpleString()).alias("dtype"),
        "n_unique",
        task(text | few).alias("suggested_task"),
        task(text | boolean | few).alias("training_task"),
    )


def detect_task(df: DataFrame, target: str) -> str:
    return target_facts(df, target).first()["training_task"]


def overview(df: DataFrame) -> DataFrame:
    n_cols = len(df.columns)
    gaps = add_all([F.when(col(c).isNull(), 1).otherwise(0) for c in df.columns])
    duplicates = duplicate_rows(df).first()["duplicates"]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(gaps.cast("long")), F.lit(0)).cast("long").alias("missing_cells"),
        F.lit(duplicates).cast("long").alias("duplicates"),
    ).select(
        "n_rows",
        F.lit(n_cols).cast("long").alias("n_cols"),
        F.lit(len(numeric_columns(df))).cast("long").alias("n_numeric"),
        F.lit(n_cols - len(numeric_columns(df))).cast("long").alias("n_categorical"),
        "missing_cells",
        r(ratio(F.col("missing_cells") * 100.0, F.col("n_rows") * n_cols), 1).alias("pct_cells"),
        "duplicates",
    )


def describe_all(df: DataFrame) -> DataFrame:
    """count, unique, top, freq for text; moments and quartiles for numbers."""
    num, cat = numeric_columns(df), categorical_columns(df)
    counts = _stack(
        df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]),
        [{"column": F.lit(c), "count": F.col(f"n{i}")} for i, c in enumerate(df.columns)],
    )
    out = counts
    if cat:
        vc = value_counts(df, cat)
        top = vc.groupBy("column").agg(
            F.count("*").alias("unique"),
            F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("a"), "value")).alias("t"),
        )
        out = out.join(top.select(
            "column", "unique", F.col("t.value").alias("top"), F.col("t.n").alias("freq")
        ), "column", "left")
    if num:
        stats = numeric_stats(df, num, ["mean", "std", "min", "max"])
        out = out.join(stats.join(quartiles(df, num), "column"), "column", "left")
    return out


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    q = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    return numeric_stats(df, [column], ["count", "mean", "std", "min", "max"]).select(
        "*", *[r(F.lit(v)).alias(name) for name, v in zip(("q25", "median", "q75"), q)])


def target_summary(df: DataFrame, label: str, task: str) -> DataFrame:
    """Value counts of classes, or the description of a numeric target."""
    if task == "classification":
        return value_counts(df, [label]).select("value", "n")
    return describe_numeric(df, label)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins kept."""
    x = as_double(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin long, lower double, upper double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1).cast("long"))
    counts = (
        df.filter(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    )
    return spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select(
        "bin",
        r(F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        r(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Counts for text or few distinct values, else a 30-bin histogram."""
    few = _is_text(df, target) or (
        distinct_counts(df, [target]).first()["n_unique"] < PLOT_CLASS_LIMIT
    )
    if few:
        return value_counts(df, [target]).select(F.col("value").alias("label"), "n")
    return histogram(df, target, 30)


def correlation(df: DataFrame, columns: Sequence[str] | None = None,
                digits: int | None = 4) -> DataFrame:
    """Pearson matrix over pairwise complete rows, long and symmetric.

    NULL where a column is constant. Narrow tables use one fused aggregate;
    wide ones sum per-partition cross products.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    p = len(columns)
    if p <= PAIR_EXPRESSION_LIMIT:
        pairs = _pair_expressions(df, columns)
    else:
        pairs = pair_moments(df, columns)
    value = F.col("corr") if digits is None else r(F.col("corr"), digits)
    half = pairs.select("i", "j", value.alias("corr"))
    both = half.union(half.filter("i <> j").select(
        F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(
        names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), "corr"
    )


def _pair_expressions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = [as_double(df, c) for c in columns]
    aggs, rows = [], []
    for i, a in enumerate(values):
        for j in range(i, len(values)):
            b = values[j]
            x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
            spread = F.stddev_pop(x) * F.stddev_pop(y)
            one = F.when(spread > 0, F.lit(1.0)) if i == j else F.try_divide(
                F.covar_pop(x, y), spread)
            aggs.append(one.alias(f"c{i}_{j}"))
            rows.append({"i": F.lit(i), "j": F.lit(j), "corr": F.col(f"c{i}_{j}")})
    return _stack(df.agg(*aggs), rows)


def high_correlations(df: DataFrame, threshold: float = 0.95,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs with |r| at or above the threshold: the later column, the earlier one, |r|."""
    columns = numeric_columns(df) if columns is None else list(columns)
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    c = correlation(df, columns, digits=None)
    return c.filter(
        (place[F.col("col_b")] < place[F.col("col_a")]) & (F.abs("corr") >= threshold)
    ).select(F.col("col_a").alias("col"), F.col("col_b").alias("row"), r(F.abs("corr")).alias("r"))
