"""Single trees and the first trees of the boosted ensembles against the same trees grown in SQL over the bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.catalog.base import query, table
from gridwright.functions.columns import r
from gridwright.models import boosting, grower
from gridwright.models.common import Problem

FEATURES = ["quantity", "price", "discount", "tax"]
#: Few values a column, so that every value is a bin; the price has gaps.
ROWS_SQL = """SELECT l_quantity AS quantity, CASE WHEN l_orderkey % 13 <> 0 THEN floor(l_extendedprice / 2500) END AS price,
  round(l_discount * 100) AS discount, round(l_tax * 100) AS tax, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem"""


WHOLE_SQL = ROWS_SQL.replace("CASE WHEN l_orderkey % 13 <> 0 THEN floor(l_extendedprice / 2500) END", "floor(l_extendedprice / 2500)")


def rows_of(spark, sf, label, gaps: bool = True) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").withColumns({"net": net, "flag": F.when(
        F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)}).select(
        F.col("l_quantity").cast("double").alias("quantity"),
        F.when((F.col("l_orderkey") % 13 != 0) | F.lit(not gaps), F.floor(F.col("l_extendedprice") / 2500).cast("double")).alias("price"),
        F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"), label.cast("double").alias("label"))


def _best(name: str, rows: str, below: str, least: int) -> str:
    """``name``: the best split of every (k, node) of ``rows`` (id, k, node, g, h); missing values to either side."""
    def part(side: str, sums: str, allowed: str) -> str:
        g, h, n = (f"({sums.format(x)})" for x in "ghn")
        score = "{0} * {0} / {1}"
        own, rest = (g, {"h": h, "n": n}[below]), (f"(tg - {g})", f"(t{below} - {({'h': h, 'n': n}[below])})")
        return f"""SELECT k, node, f, v, {side} AS side, {score.format(*own)} + {score.format(*rest)} - tg * tg / t{below} AS gain FROM {name}_c
      WHERE {n} >= {least} AND tn - {n} >= {least} AND {h} >= 1e-3 AND th - {h} >= 1e-3 AND {allowed}"""
    return f"""{name}_h AS MATERIALIZED (SELECT k, node, f, v, sum(g) AS g, sum(h) AS h, count(*)::DOUBLE AS n FROM u JOIN {rows} USING (id) GROUP BY ALL),
  {name}_t AS (SELECT k, node, sum(g) AS tg, sum(h) AS th, sum(n) AS tn FROM {name}_h WHERE f = 0 GROUP BY k, node),
  {name}_m AS (SELECT k, node, f, g AS mg, h AS mh, n AS mn FROM {name}_h WHERE v IS NULL),
  {name}_c AS MATERIALIZED (SELECT *, coalesce(mg, 0) AS xg, coalesce(mh, 0) AS xh, coalesce(mn, 0) AS xn FROM (
    SELECT k, node, f, v, sum(g) OVER w AS cg, sum(h) OVER w AS ch, sum(n) OVER w AS cn FROM {name}_h WHERE v IS NOT NULL
    WINDOW w AS (PARTITION BY k, node, f ORDER BY v)) JOIN {name}_t USING (k, node) LEFT JOIN {name}_m USING (k, node, f)),
  {name}_g AS MATERIALIZED ({part('0', 'c{0}', 'true')} UNION ALL {part('1', 'c{0} + x{0}', 'xn > 0')}),
  {name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY f, v, side) AS i
    FROM (SELECT *, max(gain) OVER (PARTITION BY k, node) AS most FROM {name}_g) WHERE gain >= most * (1 - 1e-9) AND most > 1e-9) WHERE i = 1)"""


def first_trees_sql(y: str, loss: str, trees: int, splits: int, rate: float, by_rows: bool, least: int, best_first: bool,
                    source: str = ROWS_SQL, digits: int | None = None) -> str:
    """``trees`` rounds; a tree is split ``splits`` times, at the best leaf or (levels) at all leaves at once."""
    classes = {"squared": 1, "logistic": 1, "softmax": 3}[loss]
    below = "n" if by_rows else "h"
    unpivot = " UNION ALL ".join(f"SELECT id, {i} AS f, {c}::DOUBLE AS v FROM d" for i, c in enumerate(FEATURES))
    base = {"squared": "SELECT 0 AS k, avg(y) AS m FROM d", "logistic": "SELECT 0 AS k, ln(avg(y) / (1 - avg(y))) AS m FROM d",
            "softmax": "SELECT k, ln(n) - avg(ln(n)) OVER () AS m FROM (SELECT y::INT AS k, count(*) AS n FROM d GROUP BY 1)"}[loss]
    steps = [f"d AS MATERIALIZED (SELECT row_number() OVER () AS id, {', '.join(FEATURES)}, ({y})::DOUBLE AS y FROM ({source}))",
             f"u AS MATERIALIZED ({unpivot})", f"m0 AS MATERIALIZED (SELECT id, k, m FROM d, ({base}))"]
    slopes = {"squared": "m - y AS g, 1.0 AS h", "logistic": "p - y AS g, p * (1 - p) AS h", "softmax": "p - (y = k)::INT AS g, p * (1 - p) AS h"}[loss]
    share = {"squared": "m", "logistic": "1 / (1 + exp(-m))", "softmax": "exp(m) / sum(exp(m)) OVER (PARTITION BY id)"}[loss]
    scale = rate * ((classes - 1) / classes if by_rows and classes > 1 else 1.0)
    for t in range(trees):
        steps.append(f"a{t}_0 AS MATERIALIZED (SELECT id, k, 0 AS node, {slopes} FROM (SELECT id, k, m, {share} AS p FROM m{t}) JOIN d USING (id))")
        for s in range(splits):
            name, rows = f"b{t}_{s}", f"a{t}_{s}"
            steps.append(_best(name, rows, below, least))
            pick = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, node) AS j FROM {name}) WHERE j = 1)" if best_first else name
            steps.append(f"""a{t}_{s + 1} AS MATERIALIZED (SELECT r.id, r.k, CASE WHEN b.f IS NULL THEN r.node
  WHEN CASE WHEN u.v IS NULL THEN b.side = 1 ELSE u.v <= b.v END THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node, g, h
  FROM {rows} r LEFT JOIN {pick} b ON b.k = r.k AND b.node = r.node LEFT JOIN u ON u.id = r.id AND u.f = b.f)""")
        steps.append(f"""m{t + 1} AS MATERIALIZED (SELECT id, k, m - {scale!r} * sum(g) OVER w / sum(h) OVER w AS m
  FROM m{t} JOIN a{t}_{splits} USING (id, k) WINDOW w AS (PARTITION BY k, node))""")
    digits = digits or (2 if loss == "squared" else 6)
    return (f"WITH {', '.join(steps)} SELECT k, round({share if loss == 'squared' else 'p'}, {digits}) + 0.0 AS value, count(*) AS rows "
            f"FROM (SELECT id, k, m, {share} AS p FROM m{trees}) GROUP BY ALL")


def _values(model, rows: DataFrame, loss: str) -> DataFrame:
    """How many rows have each value of the ensemble so far."""
    scored = model.transform(rows)
    if loss == "squared":
        scored = scored.select(F.lit(0).alias("k"), r(F.col("prediction"), 2).alias("value"))
    elif loss == "logistic":
        scored = scored.select(F.lit(0).alias("k"), r(F.col("probability")[1], 6).alias("value"))
    else:
        scored = scored.select(F.posexplode("probability").alias("k", "p")).select("k", r(F.col("p"), 6).alias("value"))
    return scored.groupBy("k", "value").agg(F.count("*").alias("rows"))


@query("m07_first_trees", first_trees_sql("net > 40000", "logistic", 2, 3, 0.1, False, 20, True))
def _(spark, sf):
    rows = rows_of(spark, sf, F.col("net") > 40000)
    model = boosting.histogram_boosting(rows, Problem(FEATURES, "classification", 2), {
        "max_iter": 2, "max_leaf_nodes": 4, "learning_rate": 0.1, "early_stopping": False})
    return _values(model, rows, "logistic")


@query("m26_first_trees", first_trees_sql("net", "squared", 2, 3, 0.1, False, 20, True))
def _(spark, sf):
    rows = rows_of(spark, sf, F.col("net"))
    model = boosting.histogram_boosting(rows, Problem(FEATURES, "regression", 0), {
        "max_iter": 2, "max_leaf_nodes": 4, "learning_rate": 0.1, "early_stopping": False})
    return _values(model, rows, "squared")


@query("m04_first_trees", first_trees_sql("flag", "softmax", 2, 2, 0.2, True, 1, False))
def _(spark, sf):
    rows = rows_of(spark, sf, F.col("flag"))
    model = boosting.gradient_boosting(rows, Problem(FEATURES, "classification", 3), {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.2})
    return _values(model, rows, "softmax")


@query("m23_first_trees", first_trees_sql("net", "squared", 2, 2, 0.1, True, 1, False))
def _(spark, sf):
    rows = rows_of(spark, sf, F.col("net"))
    model = boosting.gradient_boosting(rows, Problem(FEATURES, "regression", 0), {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1})
    return _values(model, rows, "squared")


# A tree on numbers is one round at rate 1; of two classes, Gini's impurity is twice the variance of the mark.
@query("m02_whole_tree", first_trees_sql("net > 40000", "squared", 1, 3, 1.0, True, 1, False, WHOLE_SQL, 6))
def _(spark, sf):
    rows = rows_of(spark, sf, F.col("net") > 40000, gaps=False)
    model = grower.decision_tree(rows, Problem(FEATURES, "classification", 2), {"max_depth": 3})
    return _values(model, rows, "logistic")


@query("m21_whole_tree", first_trees_sql("net", "squared", 1, 3, 1.0, True, 1, False, WHOLE_SQL))
def _(spark, sf):
    rows = rows_of(spark, sf, F.col("net"), gaps=False)
    return _values(grower.decision_tree(rows, Problem(FEATURES, "regression", 0), {"max_depth": 3}), rows, "squared")
