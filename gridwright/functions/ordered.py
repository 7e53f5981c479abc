"""Order-based building blocks that never sort a whole table in one task.

* ``quantiles``      exact interpolated quantiles of many columns
* ``rank_cutoffs``   the hash values that sit at given ranks of a hash order
* ``running_totals`` prefix sums over a global order

Each first counts coarse buckets (a tiny shuffle thanks to map-side combine)
and only then looks inside buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import add_all, as_double, col, hash_key
from gridwright.session import checkpoint

# Above this many cells (rows x columns) one-buffer percentiles are not used.
EXACT_BUFFER_CELLS = 400_000
# Ordered rows one task should handle inside a bucket.
ROWS_PER_BUCKET = 1_000_000
# Largest side that may be broadcast: rows, and bytes of its values.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    buffer_cells: int = EXACT_BUFFER_CELLS,
    n_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation: ``{column: [q, ...]}``.

    ``percentile`` keeps every distinct value of a column in one buffer, so it
    serves only tables of checked, small size. Larger ones go through
    ``selected_quantiles``, which is exact too.
    """
    columns = list(columns)
    probabilities = [float(p) for p in probabilities]
    if not columns:
        return {}
    n = df.count() if n_rows is None else n_rows
    if n * len(columns) > buffer_cells:
        return selected_quantiles(df, columns, probabilities)
    probs = F.array(*[F.lit(p) for p in probabilities])
    row = df.agg(*[
        F.percentile(as_double(df, c), probs).alias(str(i)) for i, c in enumerate(columns)
    ]).first()
    return {
        c: list(row[i]) if row[i] is not None else [None] * len(probabilities)
        for i, c in enumerate(columns)
    }


def selected_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    bins: int = 4096,
    rows_per_pick: int = 20_000,
) -> dict[str, list[float | None]]:
    """Exact quantiles by counting: every shuffle holds counts, never the rows.

    The value range of each column is cut into equal bins and counted. Only bins
    in which a wanted rank falls are looked at again: as (value, count) pairs
    where few rows remain or one value fills the bin, else cut into bins anew. A
    bin narrows by ``bins`` each time, so a handful of passes serves any skew.
    """
    columns = list(columns)
    data = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    # infinities and NaN (which comes last) are counted apart; ranges are finite
    head = data.agg(*[
        f(F.col(f"v{i}")).alias(f"{s}{i}") for i in range(len(columns))
        for s, f in (
            ("n", F.count), ("a", lambda v: F.min(_finite(v))), ("b", lambda v: F.max(_finite(v))), ("f", lambda v: F.count(_finite(v))),
            ("l", lambda v: F.count_if(v == float("-inf"))), ("x", lambda v: F.count_if(F.isnan(v))))
    ]).first()
    sizes = [head[f"n{i}"] for i in range(len(columns))]
    found: dict[tuple[int, int], float] = {}
    wanted = []
    for i, n in enumerate(sizes):
        ranks = sorted({k for p in probabilities for k in _rank_pair(p, n)[:2]}) if n else []
        lowest, finite_until, last = head[f"l{i}"], head[f"l{i}"] + head[f"f{i}"], n - head[f"x{i}"]
        found.update({(i, k): float("-inf") for k in ranks if k < lowest})
        found.update({(i, k): float("inf") if k < last else float("nan") for k in ranks if k >= finite_until})
        wanted.append([k for k in ranks if lowest <= k < finite_until])
    # open ranges [low, high] of a column: rows below, rows inside, ranks to find
    spans = []
    for i, n in enumerate(sizes):
        if not n:
            continue
        low, high = head[f"a{i}"], head[f"b{i}"]
        if low == high:
            found.update({(i, k): low for k in wanted[i]})
        elif wanted[i]:
            spans.append((i, low, high, head[f"l{i}"], head[f"f{i}"], wanted[i]))
    while spans:
        fine = [s for s in spans if s[4] <= rows_per_pick]
        wide = [s for s in spans if s[4] > rows_per_pick]
        spans = []
        if fine:
            cells = _span_cells(fine, lambda v, low, high: v)
            counts: dict[int, list[tuple[float, int]]] = {}
            for row in data.select(F.explode(cells).alias("c")).filter("c IS NOT NULL").groupBy(
                    "c.span", "c.at").agg(F.count("*").alias("n")).collect():
                counts.setdefault(row["span"], []).append((row["at"], row["n"]))
            for k, (i, _, _, below, _, ranks) in enumerate(fine):
                at = below
                for value, n in sorted(counts.get(k, [])):
                    found.update({(i, r): value for r in ranks if at <= r < at + n})
                    at += n
        if wide:
            def slot(v, low, high):
                # halves, as the whole range may be more than a double holds
                share = (v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
                return F.least(F.floor(share * bins), F.lit(bins - 1).cast("long"))

            cells = _span_cells(wide, slot)
            rows = data.select(F.explode(cells).alias("c")).filter("c IS NOT NULL").select(
                "c.span", "c.at", "c.v").groupBy("span", "at").agg(
                F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            by_span: dict[int, list] = {}
            for row in rows:
                by_span.setdefault(row["span"], []).append(row)
            for k, (i, _, _, below, _, ranks) in enumerate(wide):
                at = below
                for row in sorted(by_span.get(k, []), key=lambda r: r["at"]):
                    hit = [r for r in ranks if at <= r < at + row["n"]]
                    if hit and row["a"] == row["b"]:
                        found.update({(i, r): row["a"] for r in hit})
                    elif hit:
                        spans.append((i, row["a"], row["b"], at, row["n"], hit))
                    at += row["n"]
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        values: list[float | None] = []
        for p in probabilities:
            if not sizes[i]:
                values.append(None)
                continue
            lo, hi, frac = _rank_pair(p, sizes[i])
            a, b = found[(i, lo)], found[(i, hi)]
            values.append(a if lo == hi else (1.0 - frac) * a + frac * b)
        out[c] = values
    return out


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _span_cells(spans: Sequence[tuple], place) -> Column:
    """Array with one entry per span that holds the row's value."""
    entries = []
    for k, (i, low, high, *_rest) in enumerate(spans):
        v = F.col(f"v{i}")
        at = place(v, low, high)
        entries.append(F.when((v >= F.lit(low)) & (v <= F.lit(high)), F.struct(
            F.lit(k).alias("span"), at.alias("at"), v.alias("v"))))
    return F.array(*entries)


def _rank_pair(p: float, n: int) -> tuple[int, int, float]:
    position = p * (n - 1)
    lo = math.floor(position)
    return lo, min(math.ceil(position), n - 1), position - lo


def bucketize(df: DataFrame, source: str, target: str, cuts: Sequence[float]) -> DataFrame:
    """Left-closed bucket number by binary search over sorted cut points."""
    inner = sorted({float(x) for x in cuts if math.isfinite(x)})
    splits = [float("-inf"), *inner, float("inf")]
    if len(splits) < 3:
        return df.withColumn(target, F.lit(0.0))
    return Bucketizer(
        splits=splits, inputCol=source, outputCol=target, handleInvalid="keep"
    ).transform(df)


def rank_cutoffs(
    df: DataFrame,
    groups: Sequence[str],
    ranks: Sequence[Column],
    hash_name: str = "_h",
    digits: int = 3,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Hash values at given ranks of each group's hash order.

    ``df`` holds the group columns and a uniform hex hash; every ``ranks``
    expression may use ``n`` (the group's row count) and gives a 1-based rank.
    Returns one row per group: groups, ``n`` and ``cutoffs`` (array; a rank of
    0 or less gives the empty string, which sorts before every hash).

    A group of any size is safe: rows are counted per hash prefix, prefixes that
    hold a wanted rank are refined until they are small, and only those few rows
    are put in order.
    """
    groups = list(groups) or ["_all"]
    by = [col(g) for g in groups]
    rows = df.withColumn("_all", F.lit(0)) if groups == ["_all"] else df
    rows = rows.select(*by, F.col(hash_name).alias("_h"))
    # rank 1 is always asked for, so that every group has a row to carry ``n``
    wanted = F.array(
        F.struct(F.lit(-1).alias("i"), F.lit(1).cast("long").alias("rank")),
        *[F.struct(F.lit(i).alias("i"), x.cast("long").alias("rank")) for i, x in enumerate(ranks)],
    )

    def place(counted: DataFrame, window, base: Column) -> DataFrame:
        running = window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counted.withColumn("_below", base + F.sum("_c").over(running) - F.col("_c"))

    def keep_hits(placed: DataFrame) -> DataFrame:
        hits = F.filter("_want", lambda s: (s["rank"] > F.col("_below"))
                        & (s["rank"] <= F.col("_below") + F.col("_c")))
        return placed.withColumn("_want", hits).filter(F.size("_want") > 0)

    size = digits
    whole = Window.partitionBy(*by)
    counted = rows.groupBy(*by, F.substring("_h", 1, size).alias("_p")).agg(F.count("*").alias("_c"))
    counted = counted.withColumn("n", F.sum("_c").over(whole))
    targets = place(counted, whole, F.lit(0)).withColumn("_want", wanted)
    targets = checkpoint(keep_hits(targets).select(*by, "_p", "_c", "n", "_below", "_want"))
    while size < 30 and (targets.agg(F.max("_c")).first()[0] or 0) > rows_per_bucket:
        inside = rows.withColumn("_p", F.substring("_h", 1, size))
        inside = join_sized(inside, targets.drop("_c"), [*groups, "_p"], materialised=True)
        size += digits
        counted = (
            inside.withColumn("_up", F.col("_p")).withColumn("_p", F.substring("_h", 1, size))
            .groupBy(*by, "_up", "_p", "n", "_below", "_want").agg(F.count("*").alias("_c"))
        )
        placed = place(counted, Window.partitionBy(*by, "_up"), F.col("_below"))
        targets = checkpoint(keep_hits(placed).select(*by, "_p", "_c", "n", "_below", "_want"))

    inside = rows.withColumn("_p", F.substring("_h", 1, size))
    inside = join_sized(inside, targets.drop("_c", "n"), [*groups, "_p"], materialised=True)
    order = Window.partitionBy(*by, "_p").orderBy("_h")
    picked = (
        inside.withColumn("_rank", F.row_number().over(order) + F.col("_below"))
        .select(*by, "_h", F.explode(
            F.filter("_want", lambda s: s["rank"] == F.col("_rank"))).alias("_hit"))
        .groupBy(*by)
        .agg(F.map_from_entries(F.collect_list(F.struct("_hit.i", "_h"))).alias("_m"))
    )
    cut = F.array(*[
        F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit("")) for i in range(len(ranks))
    ])
    sizes = targets.groupBy(*by).agg(F.max("n").alias("n"))
    out = sizes.join(picked, groups).select(*by, "n", cut.alias("cutoffs"))
    return out.drop("_all") if groups == ["_all"] else out


def join_sized(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS, materialised: bool = False,
) -> DataFrame:
    """Join with a side whose size is checked first.

    ``right`` is materialised in the shared folder and measured; it is broadcast
    only up to ``broadcast_rows`` rows and ``BROADCAST_BYTES``, otherwise the join
    shuffles both sides.
    """
    if not materialised:
        right = checkpoint(right)
    size = right.agg(F.count("*").alias("rows"), F.sum(value_bytes(right)).alias("bytes")).first()
    if size["rows"] <= broadcast_rows and (size["bytes"] or 0) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, list(on), how)


def value_bytes(df: DataFrame) -> Column:
    """About how many bytes the values of a row take."""
    parts = []
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(col(name)), F.lit(0)).cast("long"))
        elif kind.startswith(("array", "map", "struct")):
            parts.append(F.octet_length(F.to_json(F.struct(col(name)))).cast("long"))
        else:
            parts.append(F.lit(8).cast("long"))
    return add_all(parts)


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = 16384,
) -> DataFrame:
    """Inclusive prefix sums in descending order of a numeric column.

    Expects at most one row per (groups, order value) - aggregate first. Adds
    ``cum_<s>`` and ``total_<s>``. The order is cut into buckets; each bucket is
    ordered in its own task and shifted by the totals of the buckets above it.
    """
    groups = list(groups)
    n = df.count()
    buckets = max(1, min(max_buckets, math.ceil(n / rows_per_bucket)))
    cuts: list[float] = []
    if buckets > 1:
        grid = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        cuts = df.agg(F.percentile_approx(order, grid, 20 * buckets)).first()[0] or []
    g = [col(x) for x in groups]
    if not cuts:  # few rows: one window per group, no offsets
        whole = Window.partitionBy(*g)
        upto = whole.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            *[col(c) for c in df.columns],
            *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
        )
    tagged = bucketize(df, order, "_b", cuts)
    tagged = tagged.withColumn("_b", F.col("_b").cast("int"))
    per_bucket = tagged.groupBy(*g, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    all_rows = Window.partitionBy(*g)
    above = all_rows.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *g, "_b",
        *[F.coalesce(F.sum(f"_t_{s}").over(above), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(all_rows).alias(f"total_{s}") for s in sums],
    )
    joined = tagged.join(offsets, [*groups, "_b"])
    local = Window.partitionBy(*g, "_b").orderBy(F.desc(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = joined.select(
        *[col(c) for c in df.columns],
        *[(F.sum(s).over(local) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )
    return out


def with_hash(df: DataFrame, keys: Sequence[str], seed: int | str = 42, name: str = "_h") -> DataFrame:
    return df.withColumn(name, hash_key(keys, seed))
