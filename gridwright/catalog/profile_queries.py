"""Profiles, counts, histograms and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.catalog.base import (
    GAP_SQL, NUM, gapped, languages, line_numbers, query, r4, table,
)
from gridwright.operators import profile as P

CAT_COLUMNS = ["l_returnflag", "l_linestatus"]
PART_CATS = ["p_brand", "p_type", "p_name"]


def per_column(expressions: dict[str, str], columns=NUM, source: str = "lineitem") -> str:
    """One SELECT per column; ``{c}`` stands for the column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"{e.format(c=c)} AS {n}" for n, e in expressions.items())
        + f" FROM {source}" for c in columns)


@query("a01_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def _(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


GAPS = ["quantity", "discount", "tax", "price", "flag", "status"]


@query("a02_missing", per_column({
    "n_missing": "count(*) - count({c})",
    "pct_missing": r4("(count(*) - count({c})) * 100.0 / count(*)", 2)}, GAPS, f"({GAP_SQL})"))
def _(spark, sf):
    return P.missing(gapped(spark, sf).select(*GAPS))


ALL_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUM, *CAT_COLUMNS, "l_shipdate"]


@query("a03_distinct", per_column({"n_unique": "count(DISTINCT {c})"}, ALL_LINE))
def _(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"))


@query("a03_distinct_approximate")
def _(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"), approximate=True)


@query("a04_duplicates", """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM (SELECT p_brand, p_type, p_size FROM part) GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY p_brand, p_type, p_size"))
def _(spark, sf):
    return P.duplicate_rows(table(spark, sf, "part").select("p_brand", "p_type", "p_size"))


MOMENTS = {"mean": r4("avg({c})"), "std": r4("stddev_samp({c})"), "min": r4("min({c})"), "max": r4("max({c})")}
QUARTILES = {"q25": r4("quantile_cont({c}, 0.25)"), "median": r4("quantile_cont({c}, 0.5)"),
             "q75": r4("quantile_cont({c}, 0.75)")}


@query("a05_moments", per_column(MOMENTS))
def _(spark, sf):
    return P.numeric_stats(line_numbers(spark, sf), NUM, ["mean", "std", "min", "max"])


@query("a06_quartiles", per_column(QUARTILES))
def _(spark, sf):
    return P.quartiles(line_numbers(spark, sf))


@query("a07_skewness", per_column({"skewness": r4("skewness({c})")}) + " UNION ALL " + per_column(
    {"skewness": r4("skewness({c})")}, ["value"], "events"))
def _(spark, sf):
    one = P.numeric_stats(line_numbers(spark, sf), NUM, ["skewness"])
    return one.unionByName(P.numeric_stats(table(spark, sf, "events"), ["value"], ["skewness"]))


@query("a08_kurtosis", per_column({"kurtosis": r4("kurtosis({c})")}) + " UNION ALL " + per_column(
    {"kurtosis": r4("kurtosis({c})")}, ["value"], "events"))
def _(spark, sf):
    one = P.numeric_stats(line_numbers(spark, sf), NUM, ["kurtosis"])
    return one.unionByName(P.numeric_stats(table(spark, sf, "events"), ["value"], ["kurtosis"]))


@query("a09_zeros", per_column({"n_zeros": "count(*) FILTER (WHERE {c} = 0)"}))
def _(spark, sf):
    return P.numeric_stats(line_numbers(spark, sf), NUM, ["n_zeros"])


@query("a10_negatives", per_column({"n_negative": "count(*) FILTER (WHERE {c} < 0)"}, ["c_acctbal"], "customer"))
def _(spark, sf):
    return P.numeric_stats(table(spark, sf, "customer"), ["c_acctbal"], ["n_negative"])


def outlier_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) FILTER (WHERE {column} < q1 - 1.5 * (q3 - q1)
      OR {column} > q3 + 1.5 * (q3 - q1)) AS n_outliers_iqr FROM {source},
      (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"""


@query("a11_iqr_outliers", outlier_sql("value", "events"))
def _(spark, sf):
    return P.iqr_outliers(table(spark, sf, "events"), ["value"])


def top_sql(column: str, source: str, k: int) -> str:
    return f"""SELECT '{column}' AS "column", value, n, rank FROM (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n,
      row_number() OVER (ORDER BY count(*) DESC, CAST({column} AS VARCHAR)) AS rank FROM {source}
      WHERE {column} IS NOT NULL GROUP BY 1) WHERE rank <= {k}"""


@query("a12_top_values", " UNION ALL ".join(top_sql(c, "part", 5) for c in PART_CATS))
def _(spark, sf):
    return P.top_values(table(spark, sf, "part"))


@query("a13_target_counts", top_sql("p_size", "part", 20))
def _(spark, sf):
    return P.top_values(table(spark, sf, "part"), ["p_size"], 20)


def task_sql(column: str, source: str, dtype: str, rule: str) -> str:
    text = "true" if dtype == "string" else "false"
    return f"""SELECT '{column}' AS "column", '{dtype}' AS dtype, count(DISTINCT {column}) AS n_unique,
      CASE WHEN {text} OR count(DISTINCT {column}) <= 20 THEN 'classification' ELSE 'regression' END AS {rule}
      FROM {source}"""


TARGETS = [("l_returnflag", "lineitem", "string"), ("l_extendedprice", "lineitem", "double"),
           ("l_linenumber", "lineitem", "int"), ("p_size", "part", "int"), ("quality", "labels", "int")]


def _targets(spark, sf, rule: str):
    frames = [
        P.target_facts(table(spark, sf, source), c).select("column", "dtype", "n_unique", rule)
        for c, source, _ in TARGETS
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("a14_suggested_task", " UNION ALL ".join(task_sql(*t, "suggested_task") for t in TARGETS))
def _(spark, sf):
    return _targets(spark, sf, "suggested_task")


@query("a15_training_task", " UNION ALL ".join(task_sql(*t, "training_task") for t in TARGETS))
def _(spark, sf):
    return _targets(spark, sf, "training_task")


@query("a16_overview", f"""SELECT sum(n)::BIGINT AS n_rows, CAST(6 AS BIGINT) AS n_cols, CAST(4 AS BIGINT) AS n_numeric,
  CAST(2 AS BIGINT) AS n_categorical, sum(n * gaps)::BIGINT AS missing_cells,
  {r4('sum(n * gaps) * 100.0 / (sum(n) * 6)', 1)} AS pct_cells, sum(n - 1)::BIGINT AS duplicates FROM (
  SELECT count(*) AS n, (quantity IS NULL)::INT + (discount IS NULL)::INT + (tax IS NULL)::INT + (price IS NULL)::INT
    + (flag IS NULL)::INT + (status IS NULL)::INT AS gaps FROM ({GAP_SQL})
  GROUP BY quantity, discount, tax, price, flag, status)""")
def _(spark, sf):
    return P.overview(gapped(spark, sf).select(*GAPS))


def describe_sql() -> str:
    parts = []
    for c in ("quantity", "price"):
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, CAST(NULL AS BIGINT) AS "unique",
          CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, """ + ", ".join(
            f"{e.format(c=c)} AS {n}" for n, e in {**MOMENTS, **QUARTILES}.items()) + f" FROM ({GAP_SQL})")
    for c in ("flag", "status"):
        nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in {**MOMENTS, **QUARTILES})
        parts.append(f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
          first(v ORDER BY n DESC, v) AS top, max(n) AS freq, {nulls} FROM (
          SELECT {c} AS v, count(*) AS n FROM ({GAP_SQL}) WHERE {c} IS NOT NULL GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@query("a17_describe_all", describe_sql())
def _(spark, sf):
    return P.describe_all(gapped(spark, sf).select("quantity", "price", "flag", "status"))


@query("a18_target_summary_classes", "SELECT lang AS value, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1")
def _(spark, sf):
    return P.target_summary(languages(spark, sf), "lang", "classification")


@query("a18_target_summary_numeric", "SELECT 'value' AS \"column\", count(value) AS count, " + ", ".join(
    f"{e.format(c='value')} AS {n}" for n, e in {**MOMENTS, **QUARTILES}.items()) + " FROM events")
def _(spark, sf):
    return P.target_summary(table(spark, sf, "events"), "value", "regression")


def histogram_sql(column: str, source: str, bins: int, names: str = "bin, lower, upper, n") -> str:
    return f"""SELECT {names} FROM (
      SELECT b.bin, {r4(f'lo + b.bin * ((hi - lo) / {bins})')} AS lower, {r4(f'lo + (b.bin + 1) * ((hi - lo) / {bins})')} AS upper,
        coalesce(h.n, 0) AS n FROM (SELECT unnest(range({bins})) AS bin) b
      LEFT JOIN (SELECT least(CAST(floor(({column} - lo) / ((hi - lo) / {bins})) AS BIGINT), {bins} - 1) AS bin, count(*) AS n
        FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) WHERE {column} IS NOT NULL GROUP BY 1) h
        ON b.bin = h.bin,
      (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}))"""


@query("a19_histogram", histogram_sql("value", "events", 30))
def _(spark, sf):
    return P.histogram(table(spark, sf, "events"), "value", 30)


@query("a19_histogram_25", histogram_sql("l_extendedprice", "lineitem", 25))
def _(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 25)


@query("a20_category_counts", top_sql("p_name", "part", 20))
def _(spark, sf):
    return P.top_values(table(spark, sf, "part"), ["p_name"], 20)


@query("a21_target_distribution_classes", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return P.target_distribution(table(spark, sf, "events"), "event_type")


@query("a21_target_distribution_numeric", histogram_sql("l_quantity", "lineitem", 30))
def _(spark, sf):
    return P.target_distribution(table(spark, sf, "lineitem"), "l_quantity")


CORR_SQL = "SELECT l_quantity AS a, l_extendedprice AS b, l_extendedprice * 1.01 + l_quantity AS c, l_discount AS d, 5.0::DOUBLE AS k FROM lineitem"
CORR_COLUMNS = ["a", "b", "c", "d", "k"]


def _related(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        q.alias("a"), p.alias("b"), (p * 1.01 + q).alias("c"), F.col("l_discount").alias("d"),
        F.lit(5.0).alias("k"))


def corr_sql(a: str, b: str) -> str:
    if "k" in (a, b):
        return "max(CAST(NULL AS DOUBLE))"
    return "max(1.0::DOUBLE)" if a == b else r4(f"corr({a}, {b})")


@query("a22_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {corr_sql(a, b)} AS corr FROM ({CORR_SQL})"
    for a in CORR_COLUMNS for b in CORR_COLUMNS))
def _(spark, sf):
    return P.correlation(_related(spark, sf))


@query("a22_correlation_wide", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {corr_sql(a, b)} AS corr FROM ({CORR_SQL})"
    for a in CORR_COLUMNS[:4] for b in CORR_COLUMNS[:4]))
def _(spark, sf):
    from gridwright.functions.columns import r
    from gridwright.operators.gram import pair_moments
    df = _related(spark, sf).drop("k")
    half = pair_moments(df, df.columns).select("i", "j", r(F.col("corr")).alias("corr"))
    both = half.union(half.filter("i <> j").select("j", "i", "corr"))
    names = F.array(*[F.lit(c) for c in df.columns])
    return both.select(names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), "corr")


@query("a23_high_correlations", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS col, '{a}' AS \"row\", {r4(f'abs(corr({a}, {b}))')} AS r FROM ({CORR_SQL})"
    for i, a in enumerate(CORR_COLUMNS[:4]) for b in CORR_COLUMNS[i + 1:4]) + ") WHERE r >= 0.95")
def _(spark, sf):
    return P.high_correlations(_related(spark, sf), 0.95)


@query("profile_numeric", " UNION ALL ".join(
    f"""SELECT s.*, o.n_outliers_iqr FROM (SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing,
      {r4(f'(count(*) - count({c})) * 100.0 / count(*)', 2)} AS pct_missing, """
    + ", ".join(f"{e.format(c=c)} AS {n}" for n, e in {**MOMENTS, **QUARTILES}.items())
    + f""", {r4(f'skewness({c})')} AS skewness, {r4(f'kurtosis({c})')} AS kurtosis,
      count(*) FILTER (WHERE {c} = 0) AS n_zeros, count(*) FILTER (WHERE {c} < 0) AS n_negative,
      count(DISTINCT {c}) AS n_unique FROM lineitem) s JOIN ({outlier_sql(c, 'lineitem')}) o ON s."column" = o."column" """
    for c in NUM))
def _(spark, sf):
    return P.profile_numeric(line_numbers(spark, sf))
