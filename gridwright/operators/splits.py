"""Reproducible splits and folds as map-only predicates.

Rows are ranked by the md5 of seed and key. Only the hash values at the wanted
ranks are computed (see ``rank_cutoffs``); every row is then placed by comparing
its own hash with them, so no row is shuffled and no group is sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import col, hash_key
from gridwright.functions.ordered import join_sized, rank_cutoffs


def _place(df: DataFrame, keys: Sequence[str], groups: Sequence[str], ranks: Sequence[Column],
           seed: int | str, pick) -> DataFrame:
    hashed = df.withColumn("_h", hash_key(keys, seed))
    cuts = rank_cutoffs(hashed, groups, ranks)
    if groups:
        # rows without a label belong to no stratum: they stay, without a mark
        joined = join_sized(hashed, cuts, groups, "left")
    else:
        row = cuts.first()
        found = row["cutoffs"] if row else [""] * len(ranks)
        joined = hashed.withColumn("cutoffs", F.array(*[F.lit(c) for c in found]))
    return joined.select(*[col(c) for c in df.columns], pick(F.col("cutoffs")))


def holdout(df: DataFrame, keys: Sequence[str], test_size: float = 0.2,
            label: str | None = None, seed: int | str = 42, name: str = "is_test") -> DataFrame:
    """Mark ``round(n * test_size)`` rows as test, per class when ``label`` is given.

    A row without a label gets a NULL mark.
    """
    take = F.round(F.col("n") * F.lit(test_size)).cast("long")
    return _place(
        df, keys, [label] if label else [], [take], seed,
        lambda cuts: (F.col("_h") <= cuts[0]).alias(name),
    )


def folds(df: DataFrame, keys: Sequence[str], k: int = 5, label: str | None = None,
          seed: int | str = 42, name: str = "fold") -> DataFrame:
    """Fold ``floor((rank - 1) * k / n)``: sizes differ by one row at most.

    A row without a label gets a NULL fold.
    """
    # last rank of fold f is ceil((f + 1) * n / k)
    ends = [F.ceil(F.col("n") * F.lit(f + 1) / F.lit(k)).cast("long") for f in range(k - 1)]

    def fold(cuts: Column) -> Column:
        passed = [F.when(F.col("_h") > cuts[f], 1).otherwise(0) for f in range(k - 1)]
        total = passed[0]
        for p in passed[1:]:
            total = total + p
        return F.when(cuts.isNotNull(), total).alias(name)

    return _place(df, keys, [label] if label else [], ends, seed, fold)


def nested_samples(df: DataFrame, keys: Sequence[str], shares: Sequence[float],
                   groups: Sequence[str] = (), seed: int | str = 42,
                   name: str = "step") -> DataFrame:
    """Index of the smallest share whose hash-prefix sample holds the row."""
    ranks = [F.floor(F.col("n") * F.lit(s)).cast("long") for s in shares]

    def step(cuts: Column) -> Column:
        out = F.lit(len(shares))
        for i in reversed(range(len(shares))):
            out = F.when(F.col("_h") <= cuts[i], F.lit(i)).otherwise(out)
        return F.when(cuts.isNotNull(), out).alias(name)

    return _place(df, keys, list(groups), ranks, seed, step)
