"""Searches, training runs and importances of models with a closed form, each against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.catalog.base import NET_KEYS, NET_SQL, net_prices, query, r4
from gridwright.catalog.model_queries import net_rows
from gridwright.functions.columns import r
from gridwright.models.common import Problem
from gridwright.operators import splits as S
from gridwright.plans import scoring as K
from gridwright.plans import trainer as T
from gridwright.plans.registry import find
from gridwright.session import checkpoint, scratch_path

ONE = ["price"]
#: Slope of one feature from the covariance c and the variance v.
SLOPES = {
    "Linear Regression": ("c / v", {"fit_intercept": True}),
    "Lasso Regression": ("sign(c) * greatest(abs(c) - 100.0, 0) / v", {"alpha": 100.0}),
    "Elastic Net": ("sign(c) * greatest(abs(c) - 50.0, 0) / (v + 50.0)", {"alpha": 100.0, "l1_ratio": 0.5}),
}
_HASH = f"md5('42:' || {' || '.join(f'{k}' if i == 0 else chr(39) + ':' + chr(39) + ' || ' + k for i, k in enumerate(NET_KEYS))})"
_ERROR = "net - my - (price - mx) * w"


def run_sql(folds: int, out: str) -> str:
    """A run as SQL: hold-out by hash rank, folds of the rest, a slope by model and fold; ``cv`` and ``test`` by model."""
    models = " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS name, f, mx, my, {s} AS w FROM g" for i, (n, (s, _)) in enumerate(SLOPES.items()))
    return f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {_HASH}) <= round(count(*) OVER () * 0.2) AS is_test FROM ({NET_SQL})),
  t AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY {_HASH}) - 1) * {folds} / count(*) OVER ()) AS INTEGER) AS fold FROM s WHERE NOT is_test),
  f AS (SELECT unnest(range({folds} + 1)) AS f),
  g AS (SELECT f, avg(price) AS mx, avg(net) AS my, covar_pop(price, net) AS c, var_pop(price) AS v FROM f JOIN t ON t.fold <> f GROUP BY f),
  m AS ({models}),
  folds_ AS (SELECT position, name, f, 1 - sum(({_ERROR}) * ({_ERROR})) / (count(*) * var_pop(net)) AS r2 FROM m JOIN t ON t.fold = f GROUP BY ALL),
  cv AS (SELECT position, name, avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std FROM folds_ GROUP BY ALL),
  test AS (SELECT position, name, 1 - sum(({_ERROR}) * ({_ERROR})) / (count(*) * var_pop(net)) AS r2, sqrt(avg(({_ERROR}) * ({_ERROR}))) AS rmse
    FROM m JOIN s ON s.is_test WHERE f = {folds} GROUP BY ALL)
  {out}"""


def _run(spark, sf) -> T.Training:
    options = T.TrainingOptions(task_type="regression", cv_folds=3, tune_hyperparams=False, selected_algorithms=list(SLOPES),
                                overrides={n: p for n, (_, p) in SLOPES.items()})
    return T.train(net_prices(spark, sf), "net", ONE, NET_KEYS, options)


@query("t08_train_closed_forms", run_sql(3, f"""SELECT name, {r4('cv_mean', 3)} AS cv_mean, {r4('cv_std', 3)} AS cv_std, {r4('r2', 3)} AS r2, {r4('rmse', 1)} AS rmse
  FROM cv JOIN test USING (position, name)"""))
def _(spark, sf):
    return _run(spark, sf).leaderboard.select("name", *[r(F.col(c), 3).alias(c) for c in ("cv_mean", "cv_std", "r2")], r(F.col("rmse"), 1).alias("rmse"))


@query("t09_rank_closed_forms", run_sql(3, "SELECT row_number() OVER (ORDER BY r2 DESC, position) AS place, name FROM test"))
def _(spark, sf):
    ranked = T.rank_models(_run(spark, sf).leaderboard, "regression").collect()  # a row a model
    return spark.createDataFrame([(i, x["name"]) for i, x in enumerate(ranked, 1)], "place long, name string")


@query("t11_compare_closed_forms", run_sql(3, f"SELECT name, {r4('r2', 3)} AS score FROM test ORDER BY r2 DESC, position LIMIT 12"))
def _(spark, sf):
    return T.comparison(_run(spark, sf).leaderboard, "regression").select("name", r(F.col("score"), 3).alias("score"))


@query("s05_write_closed_forms", run_sql(3, f"SELECT name, 'Linear' AS category, CAST({r4('cv_mean', 2)} AS VARCHAR) AS cv_mean FROM cv"))
def _(spark, sf):
    path = scratch_path(spark, "leaderboard")
    T.write_leaderboard(_run(spark, sf).leaderboard, path)
    return spark.read.option("header", True).csv(path).select(
        "name", "category", r(F.col("cv_mean").cast("double"), 2).cast("string").alias("cv_mean"))


@query("s06_save_closed_form", run_sql(3, f"SELECT 'Linear Regression' AS model, count(*) AS n, {r4('avg(my + (price - mx) * w)', 2)} AS mean FROM m JOIN s ON s.is_test WHERE f = 3 AND position = 0"))
def _(spark, sf):
    run = _run(spark, sf)
    back = K.Scorer.load(spark, run.save(scratch_path(spark, "model")))
    return back.predict(run.test).agg(F.count("*").alias("n"), r(F.avg("prediction"), 2).alias("mean")).withColumn("model", F.lit(back.name))


ALPHAS = (0.0, 10.0, 400.0)


def grid_sql() -> str:
    points = " UNION ALL ".join(
        f"SELECT {i} AS point, '{a}' AS alpha, f, mx, my, sign(c) * greatest(abs(c) - {a}, 0) / v AS w FROM g" for i, a in enumerate(ALPHAS))
    return f"""WITH t AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY {_HASH}) - 1) * 3 / count(*) OVER ()) AS INTEGER) AS fold FROM ({NET_SQL})),
  f AS (SELECT unnest(range(3)) AS f),
  g AS (SELECT f, avg(price) AS mx, avg(net) AS my, covar_pop(price, net) AS c, var_pop(price) AS v FROM f JOIN t ON t.fold <> f GROUP BY f),
  m AS ({points}),
  e AS (SELECT point, alpha, f, 1 - sum(({_ERROR}) * ({_ERROR})) / (count(*) * var_pop(net)) AS r2 FROM m JOIN t ON t.fold = f GROUP BY ALL),
  b AS (SELECT point FROM e GROUP BY point ORDER BY avg(r2) DESC, point LIMIT 1)
  SELECT alpha, CAST(f AS INTEGER) AS fold, {r4('r2', 3)} AS r2 FROM e JOIN b USING (point)"""


@query("t06_grid_closed_form", grid_sql())
def _(spark, sf):
    rows, _ = net_rows(spark, sf)
    marked = checkpoint(S.folds(rows.select(*NET_KEYS, *[c for c in ONE if c not in NET_KEYS], "label"), NET_KEYS, 3))
    best, scores = T.search(marked, Problem(ONE, "regression"), find("regression", "Lasso Regression"), [{"alpha": a} for a in ALPHAS], 3, "r2")
    return spark.createDataFrame([(str(best["alpha"]), i, float(s)) for i, s in enumerate(scores)], "alpha string, fold int, r2 double").withColumn("r2", r(F.col("r2"), 3))


def _linear(spark, sf) -> K.Scorer:
    rows, _ = net_rows(spark, sf)
    model = find("regression", "Linear Regression").fit(rows, Problem(ONE, "regression"), {})
    return K.Scorer(model, "Linear Regression", "regression", ONE, None)


@query("v10_coefficient_importance", f"""SELECT 'coefficients' AS kind, 'price' AS feature, {r4('regr_slope(net, price)')} AS importance, 1 AS rank FROM ({NET_SQL})""")
def _(spark, sf):
    return _linear(spark, sf).importance(spark).withColumn("importance", r(F.col("importance")))


@query("k05_linear_info", f"""SELECT 'Linear Regression' AS name, 'regression' AS task_type, 'price' AS features, {r4('regr_slope(net, price)')} AS importance FROM ({NET_SQL})""")
def _(spark, sf):
    scorer = _linear(spark, sf)
    top = scorer.importance(spark).first()["importance"]
    return scorer.info(spark).select("name", "task_type", F.array_join("features", ",").alias("features"), r(F.lit(top)).alias("importance"))
