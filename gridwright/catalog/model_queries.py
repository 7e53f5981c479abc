"""Algorithms, model selection, scoring and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.catalog.base import (
    LANG_FEATURES, LANG_SQL, NET_FEATURES, NET_KEYS, NET_SQL, REG_SQL, languages, net_prices, query, r4, table,
)
from gridwright.functions.columns import r
from gridwright.models.common import HINGE_ROUNDING, Problem
from gridwright.operators import metrics as M
from gridwright.operators import splits as S
from gridwright.operators.curves import permutation_importance
from gridwright.plans import scoring as K
from gridwright.plans import trainer as T
from gridwright.plans.registry import find
from gridwright.plans.runlog import RunLog, compare
from gridwright.session import checkpoint, scratch_path, spread

LANGS = ["de", "en", "es", "fr"]


# -- inputs with a numeric label -------------------------------------------------------------

def lang_rows(spark, sf) -> tuple[DataFrame, Problem]:
    """Four languages from three shares of accented letters."""
    df = languages(spark, sf)
    code = F.array_position(F.array(*[F.lit(v) for v in LANGS]), F.col("lang")) - 1
    rows = df.withColumn("label", code.cast("double"))
    return rows, Problem(LANG_FEATURES, "classification", n_classes=4)


def big_rows(spark, sf) -> tuple[DataFrame, Problem]:
    rows = net_prices(spark, sf).withColumnRenamed("big", "label")
    return rows, Problem(NET_FEATURES, "classification", n_classes=2)


def net_rows(spark, sf) -> tuple[DataFrame, Problem]:
    rows = net_prices(spark, sf).withColumnRenamed("net", "label")
    return rows, Problem(NET_FEATURES, "regression", n_classes=0)


def _evaluate(rows: DataFrame, problem: Problem, keys, name: str, params: dict) -> DataFrame:
    """Fit on the training part, report on the held-out part."""
    strata = "label" if problem.is_classification else None
    marked = spread(checkpoint(S.holdout(
        rows.select(*keys, *problem.features, "label"), keys, 0.2, strata)))
    model = find(problem.task, name).fit(marked.filter("NOT is_test").drop("is_test"), problem, params)
    scored = model.transform(marked.filter("is_test").drop("is_test"))
    if problem.is_classification:
        out = M.confusion_scores(M.confusion_counts(scored)).select("accuracy", "f1_weighted")
    else:
        out = M.regression_report(scored, len(problem.features), names=["r2", "rmse"])
    return M.rounded(out, 2).select(F.lit(name).alias("model"), "*")


CLASSIFIER_RUNS = {
    # query: (algorithm, parameters, input)
    "m01_logistic_regression": ("Logistic Regression", {"C": 1}, big_rows),
    "m01_logistic_regression_multiclass": ("Logistic Regression", {"C": 10}, lang_rows),
    "m02_decision_tree": ("Decision Tree", {"max_depth": 5, "min_samples_split": 10}, lang_rows),
    "m03_random_forest": ("Random Forest", {"n_estimators": 50, "max_depth": 10}, lang_rows),
    "m04_gradient_boosting": ("Gradient Boosting", {"n_estimators": 50, "learning_rate": 0.2}, big_rows),
    "m04_gradient_boosting_multiclass": ("Gradient Boosting", {"n_estimators": 50, "learning_rate": 0.2}, lang_rows),
    "m05_ada_boost": ("AdaBoost", {"n_estimators": 50, "learning_rate": 1.0}, big_rows),
    "m06_extra_trees": ("Extra Trees", {"n_estimators": 50, "max_depth": 10}, lang_rows),
    "m07_histogram_boosting": ("Hist Gradient Boosting", {"learning_rate": 0.1, "max_iter": 100}, big_rows),
    "m08_rbf_svm": ("SVM (RBF)", {"C": 10, "gamma": "scale"}, lang_rows),
    "m12_perceptron": ("MLP Neural Network", {"hidden_layer_sizes": (64,), "activation": "relu"}, lang_rows),
    "m14_sgd_hinge": ("SGD Classifier", {"alpha": 0.0001, "loss": "hinge"}, big_rows),
    "m14_sgd_log_loss": ("SGD Classifier", {"alpha": 0.0001, "loss": "log_loss"}, lang_rows),
}
REGRESSOR_RUNS = {
    "m19_huber": ("Huber Regressor", {"epsilon": 1.35, "alpha": 0.0001}),
    "m20_bayesian_ridge": ("Bayesian Ridge", {"alpha_1": 1e-6, "lambda_1": 1e-6}),
    "m21_decision_tree_regressor": ("Decision Tree", {"max_depth": 5, "min_samples_split": 5}),
    "m22_random_forest_regressor": ("Random Forest", {"n_estimators": 50, "max_depth": 10}),
    "m23_gradient_boosting_regressor": ("Gradient Boosting", {"n_estimators": 50, "learning_rate": 0.1}),
    "m24_ada_boost_regressor": ("AdaBoost", {"n_estimators": 50, "learning_rate": 0.5}),
    "m25_extra_trees_regressor": ("Extra Trees", {"n_estimators": 50, "max_depth": 8}),
    "m26_histogram_boosting_regressor": ("Hist Gradient Boosting", {"learning_rate": 0.1, "max_iter": 100}),
    "m27_support_vector_regressor": ("SVR", {"C": 10, "kernel": "linear"}),
    "m27_support_vector_regressor_rbf": ("SVR", {"C": 10, "kernel": "rbf", "gamma": "scale"}),
    "m29_perceptron_regressor": ("MLP Neural Network", {"hidden_layer_sizes": (64,), "activation": "tanh"}),
    "m30_sgd_huber": ("SGD Regressor", {"alpha": 0.0001, "loss": "huber"}),
}
for _key, (_name, _params, _source) in CLASSIFIER_RUNS.items():
    def _classify(spark, sf, name=_name, params=_params, source=_source):
        rows, problem = source(spark, sf)
        return _evaluate(rows, problem, ["doc_id"] if source is lang_rows else NET_KEYS, name, params)

    query(_key)(_classify)
for _key, (_name, _params) in REGRESSOR_RUNS.items():
    def _regress(spark, sf, name=_name, params=_params):
        rows, problem = net_rows(spark, sf)
        return _evaluate(rows, problem, NET_KEYS, name, params)

    query(_key)(_regress)


# -- nearest neighbours -----------------------------------------------------------------------

def neighbour_sql(distance: str, out: str) -> str:
    return f"""WITH s AS (SELECT vec_id, embedding, label, row_number() OVER (ORDER BY md5('42:' || vec_id))
      <= round(0.2 * count(*) OVER ()) AS is_test FROM embeddings),
      n AS (SELECT q.vec_id, d.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, d.vec_id) AS rn
        FROM s q JOIN s d ON NOT d.is_test WHERE q.is_test)
      {out}"""


EUCLID = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"
MANHATTAN = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: abs(z[1]::DOUBLE - z[2])))"
VOTE = """, v AS (SELECT vec_id, label, count(*) AS n FROM n WHERE rn <= 5 GROUP BY 1, 2)
  SELECT vec_id, first(label ORDER BY n DESC, label)::DOUBLE AS prediction FROM v GROUP BY 1"""


def _vectors(spark, sf) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(64)]
    df = table(spark, sf, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
        F.col("label").cast("double").alias("label"))
    return checkpoint(S.holdout(df, ["vec_id"], 0.2)), names


def _neighbours(spark, sf, task: str, params: dict) -> DataFrame:
    df, names = _vectors(spark, sf)
    problem = Problem(names, task, n_classes=10, settings={"key": "vec_id"})
    model = find(task, "K-Nearest Neighbors").fit(df.filter("NOT is_test"), problem, params)
    return model.transform(df.filter("is_test")).select("vec_id", "prediction")


@query("m09_nearest_neighbours", neighbour_sql(EUCLID, VOTE))
def _(spark, sf):
    return _neighbours(spark, sf, "classification", {"n_neighbors": 5, "metric": "euclidean"})


@query("m09_nearest_neighbours_manhattan", neighbour_sql(MANHATTAN, VOTE))
def _(spark, sf):
    return _neighbours(spark, sf, "classification", {"n_neighbors": 5, "metric": "manhattan"})


@query("m28_nearest_neighbours_regressor", neighbour_sql(
    EUCLID, f"SELECT vec_id, {r4('avg(label)')} AS prediction FROM n WHERE rn <= 7 GROUP BY 1"))
def _(spark, sf):
    out = _neighbours(spark, sf, "regression", {"n_neighbors": 7})
    return out.select("vec_id", r(F.col("prediction")).alias("prediction"))


# -- models with a closed form ------------------------------------------------------------------

def bayes_sql(tail: str, smoothing: str = "1e-9") -> str:
    """Gaussian naive Bayes on the language shares, by hand."""
    spread = ", ".join(f"var_pop({c})" for c in LANG_FEATURES)
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + (SELECT eps FROM e) AS v_{c}" for c in LANG_FEATURES)
    joint = " + ".join(
        f"(-0.5 * ln(2 * pi() * v_{c}) - (s.{c} - m_{c}) * (s.{c} - m_{c}) / (2 * v_{c}))" for c in LANG_FEATURES)
    return f"""WITH s AS ({LANG_SQL}), e AS (SELECT {smoothing} * greatest({spread}) AS eps FROM s),
      k AS (SELECT lang, count(*)::DOUBLE AS n, {stats} FROM s GROUP BY lang),
      j AS (SELECT s.doc_id, k.lang, ln(n / (SELECT count(*) FROM s)) + {joint} AS ll FROM s, k),
      p AS (SELECT doc_id, lang, ll, exp(ll - max(ll) OVER (PARTITION BY doc_id)) AS x FROM j),
      q AS (SELECT doc_id, lang, ll, x / sum(x) OVER (PARTITION BY doc_id) AS p FROM p) {tail}"""


BEST = "SELECT doc_id, first(lang ORDER BY ll DESC, lang) AS lang, max(p) AS p FROM q GROUP BY 1"


def _bayes(spark, sf) -> tuple[DataFrame, K.Scorer]:
    rows, problem = lang_rows(spark, sf)
    model = find("classification", "Gaussian Naive Bayes").fit(rows, problem, {"var_smoothing": 1e-9})
    return rows.select("doc_id", *LANG_FEATURES), K.Scorer(
        model, "Gaussian Naive Bayes", "classification", LANG_FEATURES, LANGS)


@query("m10_gaussian_naive_bayes", bayes_sql(f"SELECT doc_id, lang AS prediction, {r4('p')} AS p FROM ({BEST})"))
def _(spark, sf):
    rows, scorer = _bayes(spark, sf)
    return scorer.predict(rows).select("doc_id", "prediction", r(F.array_max("probability")).alias("p"))


TWO = ["price", "tax"]
LDA_SQL = f"""WITH s AS ({NET_SQL}), k AS (SELECT big, count(*)::DOUBLE AS n, avg(price) AS mx, avg(tax) AS my,
    count(*) * var_pop(price) AS sa, count(*) * covar_pop(price, tax) AS sb, count(*) * var_pop(tax) AS sd FROM s GROUP BY big),
  w AS (SELECT sum(sa) / (sum(n) - 2) AS a, sum(sb) / (sum(n) - 2) AS b, sum(sd) / (sum(n) - 2) AS d FROM k),
  z AS (SELECT o.n AS n0, i.n AS n1, i.mx - o.mx AS dx, i.my - o.my AS dy, (i.mx + o.mx) / 2 AS cx, (i.my + o.my) / 2 AS cy,
    a, b, d FROM w, k o, k i WHERE o.big = 0 AND i.big = 1),
  c AS (SELECT (d * dx - b * dy) / (a * d - b * b) AS wx, (a * dy - b * dx) / (a * d - b * b) AS wy, cx, cy, ln(n1 / n0) AS prior FROM z)"""


@query("m11_linear_discriminant", f"""{LDA_SQL} SELECT {', '.join(NET_KEYS)}, CASE WHEN t > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction,
  {r4('1 / (1 + exp(-t))')} AS p FROM (SELECT s.*, (price - cx) * wx + (tax - cy) * wy + prior AS t FROM s, c)""")
def _(spark, sf):
    rows, _ = big_rows(spark, sf)
    problem = Problem(TWO, "classification", n_classes=2)
    out = find("classification", "LDA").fit(rows, problem, {"solver": "svd"}).transform(rows)
    return out.select(*NET_KEYS, "prediction", r(F.col("probability")[1]).alias("p"))


def ridge_sql(target: str, alpha: float, out: str) -> str:
    """Ridge with two features: Cramer's rule on the penalised normal equations."""
    return f"""WITH s AS (SELECT *, {target} AS y FROM ({NET_SQL})), g AS (SELECT avg(price) AS mx, avg(tax) AS mt, avg(y) AS my,
        count(*) * var_pop(price) + {alpha} AS a, count(*) * covar_pop(price, tax) AS b, count(*) * var_pop(tax) + {alpha} AS d,
        count(*) * covar_pop(price, y) AS u, count(*) * covar_pop(tax, y) AS v FROM s),
      c AS (SELECT (d * u - b * v) / (a * d - b * b) AS wx, (a * v - b * u) / (a * d - b * b) AS wt, mx, mt, my FROM g)
      SELECT {', '.join(NET_KEYS)}, {out} AS prediction FROM (SELECT s.*, my + (price - mx) * wx + (tax - mt) * wt AS f FROM s, c)"""


@query("m13_ridge_classifier", ridge_sql("2 * big - 1", 1.0, "CASE WHEN f > 0 THEN 1.0::DOUBLE ELSE 0.0 END"))
def _(spark, sf):
    rows, _ = big_rows(spark, sf)
    problem = Problem(TWO, "classification", n_classes=2)
    return find("classification", "Ridge Classifier").fit(rows, problem, {"alpha": 1.0}).transform(rows).select(
        *NET_KEYS, "prediction")


@query("m16_ridge", ridge_sql("net", 10.0, r4("f")))
def _(spark, sf):
    return _predict_net(spark, sf, "Ridge Regression", {"alpha": 10.0}, TWO)


def _predict_net(spark, sf, name: str, params: dict, features: list[str], digits: int = 4) -> DataFrame:
    rows, _ = net_rows(spark, sf)
    model = find("regression", name).fit(rows, Problem(features, "regression"), params)
    return model.transform(rows).select(*NET_KEYS, r(F.col("prediction"), digits).alias("prediction"))


def one_feature_sql(slope: str, digits: int = 4, intercept: bool = True) -> str:
    """One feature: the slope from covariance c, variance v, and raw sums."""
    f = "my + (price - mx) * w" if intercept else "price * w"
    return f"""WITH s AS ({NET_SQL}), g AS (SELECT avg(price) AS mx, avg(net) AS my, covar_pop(price, net) AS c, var_pop(price) AS v,
        sum(price * net) / sum(price * price) AS raw FROM s), k AS (SELECT *, {slope} AS w FROM g)
      SELECT {', '.join(NET_KEYS)}, {r4(f, digits)} AS prediction FROM s, k"""


ONE = ["price"]


@query("m15_linear_regression", one_feature_sql("c / v"))
def _(spark, sf):
    return _predict_net(spark, sf, "Linear Regression", {"fit_intercept": True}, ONE)


@query("m15_linear_regression_no_intercept", one_feature_sql("raw", intercept=False))
def _(spark, sf):
    return _predict_net(spark, sf, "Linear Regression", {"fit_intercept": False}, ONE)


@query("m17_lasso", one_feature_sql("sign(c) * greatest(abs(c) - 10.0, 0) / v", 3))
def _(spark, sf):
    return _predict_net(spark, sf, "Lasso Regression", {"alpha": 10.0}, ONE, 3)


@query("m18_elastic_net", one_feature_sql("sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5)", 3))
def _(spark, sf):
    return _predict_net(spark, sf, "Elastic Net", {"alpha": 1.0, "l1_ratio": 0.5}, ONE, 3)


@query("m30_sgd_squared", one_feature_sql("c / (v + 0.001)"))
def _(spark, sf):
    return _predict_net(spark, sf, "SGD Regressor", {"alpha": 0.001, "loss": "squared_error"}, ONE)


# -- search and training ----------------------------------------------------------------------------

CV_SQL = f"""WITH s AS (SELECT *, CAST(floor((rn - 1) * 5 / n) AS INTEGER) AS fold FROM (SELECT *,
    row_number() OVER (ORDER BY md5('42:' || {" || ':' || ".join(NET_KEYS)})) AS rn, count(*) OVER () AS n FROM ({NET_SQL}))),
  f AS (SELECT unnest(range(5)) AS f), c AS (SELECT f, regr_slope(net, price) AS w, regr_intercept(net, price) AS b
    FROM f JOIN s ON s.fold <> f GROUP BY f)
  SELECT CAST(f AS INTEGER) AS fold, {r4('1 - sum((net - b - w * price) * (net - b - w * price)) / (count(*) * var_pop(net))')} AS r2
  FROM c JOIN s ON s.fold = f GROUP BY f"""


@query("t05_cross_validated_scores", CV_SQL)
def _(spark, sf):
    rows, _ = net_rows(spark, sf)
    problem = Problem(ONE, "regression")
    marked = checkpoint(S.folds(rows.select(*NET_KEYS, *ONE, "label"), NET_KEYS, 5))
    _, scores = T.search(marked, problem, find("regression", "Linear Regression"), [{}], 5, "r2")
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fold int, r2 double").select(
        "fold", r(F.col("r2")).alias("r2"))


def _search(spark, sf, points) -> DataFrame:
    rows, problem = lang_rows(spark, sf)
    marked = checkpoint(S.folds(rows.select("doc_id", *LANG_FEATURES, "label"), ["doc_id"], 3, "label"))
    best, scores = T.search(marked, problem, find("classification", "Gaussian Naive Bayes"), points, 3, "f1_weighted")
    return spark.createDataFrame(
        [(len(points), {k: str(v) for k, v in best.items()}["var_smoothing"], float(sum(scores) / len(scores)))],
        "n_points int, var_smoothing string, cv_mean double").withColumn("cv_mean", r(F.col("cv_mean"), 2))


@query("t06_grid_search")
def _(spark, sf):
    return _search(spark, sf, find("classification", "Gaussian Naive Bayes").points())


@query("t07_random_search")
def _(spark, sf):
    return _search(spark, sf, find("classification", "Gaussian Naive Bayes").sample(10))


def _trained(spark, sf, names=("Gaussian Naive Bayes", "LDA", "Ridge Classifier")) -> T.Training:
    options = T.TrainingOptions(cv_folds=3, tune_hyperparams=False, selected_algorithms=list(names))
    return T.train(languages(spark, sf), "lang", LANG_FEATURES, ["doc_id"], options)


@query("t08_train_all")
def _(spark, sf):
    board = _trained(spark, sf).leaderboard
    return board.select("name", "category", r(F.col("cv_mean"), 2).alias("cv_mean"), r(F.col("accuracy"), 2).alias("accuracy"))


@query("t09_leaderboard")
def _(spark, sf):
    run = _trained(spark, sf)
    ranked = T.rank_models(run.leaderboard, run.task).limit(1).select("name", r(F.col("cv_mean"), 2).alias("cv_mean"))
    return run.summary().join(ranked, F.col("best_model") == F.col("name")).drop("name")


@query("t11_comparison")
def _(spark, sf):
    run = _trained(spark, sf)
    return T.comparison(run.leaderboard, run.task).select("name", r(F.col("score"), 2).alias("score"))


@query("p08_selected_algorithms", "SELECT 'LDA' AS name, 'Linear' AS category")
def _(spark, sf):
    return _trained(spark, sf, ["LDA"]).leaderboard.select("name", "category")


@query("s05_write_leaderboard")
def _(spark, sf):
    path = scratch_path(spark, "leaderboard")
    T.write_leaderboard(_trained(spark, sf, ["LDA", "Gaussian Naive Bayes"]).leaderboard, path)
    return spark.read.option("header", True).csv(path).select("name", "category", "cv_scores")


@query("s06_save_model")
def _(spark, sf):
    run = _trained(spark, sf, ["Decision Tree"])
    path = run.save(scratch_path(spark, "model"))
    back = K.Scorer.load(spark, path)
    out = back.predict(run.test).groupBy("prediction").agg(F.count("*").alias("n"))
    return out.withColumn("model", F.lit(back.name))


@query("v04_learning_curve")
def _(spark, sf):
    rows, problem = lang_rows(spark, sf)
    curve = T.learning_curve(rows.select("doc_id", *LANG_FEATURES, "label"), problem,
                             find("classification", "Gaussian Naive Bayes").fit, {}, ["doc_id"], steps=8, k=5)
    return M.rounded(curve, 2)


@query("v09_permutation_importance")
def _(spark, sf):
    rows, problem = net_rows(spark, sf)
    model = find("regression", "Linear Regression").fit(rows, problem, {})
    out = permutation_importance(rows, NET_FEATURES, model.transform, NET_KEYS, repeats=10)
    return M.rounded(out, 2)


@query("v10_feature_importance")
def _(spark, sf):
    rows, problem = net_rows(spark, sf)
    model = find("regression", "Decision Tree").fit(rows, problem, {"max_depth": 5})
    out = K.Scorer(model, "Decision Tree", "regression", NET_FEATURES, None).importance(spark)
    return M.rounded(out, 2)


# -- scoring -----------------------------------------------------------------------------------------

@query("k01_predict", bayes_sql(f"SELECT doc_id, lang AS prediction FROM ({BEST})"))
def _(spark, sf):
    rows, scorer = _bayes(spark, sf)
    return scorer.predict(rows).select("doc_id", "prediction")


@query("k02_probabilities", bayes_sql(f"SELECT doc_id, lang AS class, {r4('p')} AS p FROM q"))
def _(spark, sf):
    rows, scorer = _bayes(spark, sf)
    return scorer.probabilities(rows, ["doc_id"]).select("doc_id", "class", r(F.col("p")).alias("p"))


@query("k03_batch_scores", bayes_sql(f"""SELECT doc_id, (SELECT lang FROM ({BEST}) b WHERE b.doc_id = q.doc_id) AS __prediction__,
  """ + ", ".join(f"{r4(f'max(p) FILTER (WHERE lang = {chr(39)}{v}{chr(39)})')} AS __prob_{v}__" for v in LANGS)
    + " FROM q GROUP BY doc_id"))
def _(spark, sf):
    rows, scorer = _bayes(spark, sf)
    return scorer.score_batch(rows).drop(*LANG_FEATURES)


@query("k04_predict_records", bayes_sql(f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _record, lang AS prediction
  FROM ({BEST}) QUALIFY _record < 5"""))
def _(spark, sf):
    # single records given as dictionaries; the model is fitted on the whole table
    rows, scorer = _bayes(spark, sf)
    records = [x.asDict() for x in rows.orderBy("doc_id").limit(5).drop("doc_id").collect()]
    return scorer.predict_records(spark, records).select("_record", "prediction")


@query("k05_model_info")
def _(spark, sf):
    rows, problem = net_rows(spark, sf)
    model = find("regression", "Linear Regression").fit(rows, problem, {})
    scorer = K.Scorer(model, "Linear Regression", "regression", NET_FEATURES, None)
    facts = scorer.info(spark).first()
    return M.rounded(scorer.importance(spark), 2).select(
        F.lit(facts["name"]).alias("model"), F.lit(facts["task_type"]).alias("task_type"),
        F.lit(len(facts["features"])).alias("n_features"), "*")


# -- run log -----------------------------------------------------------------------------------------

RUN_SQL = f"""SELECT substr(md5(l_returnflag), 1, 8) AS id, 'run_' || l_returnflag AS name, 'flat_discount' AS model, 'regression' AS task,
  {r4('avg(abs(label - prediction))')} AS mae, {r4('sqrt(avg((label - prediction) * (label - prediction)))')} AS rmse
  FROM ({REG_SQL.replace("SELECT l_orderkey", "SELECT l_returnflag, l_orderkey")}) GROUP BY l_returnflag"""


def _runs(spark, sf) -> DataFrame:
    """One run per return flag: how well a flat discount predicts net prices."""
    flags = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    p = F.col("l_extendedprice")
    e = p * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) - p * 0.99
    return flags.groupBy("l_returnflag").agg(
        r(F.avg(F.abs(e))).alias("mae"), r(F.sqrt(F.avg(e * e))).alias("rmse"),
        F.max("l_shipdate").cast("timestamp").alias("timestamp"), F.count("*").alias("n"),
    ).select(
        F.substring(F.md5("l_returnflag"), 1, 8).alias("id"), "timestamp",
        F.concat(F.lit("run_"), "l_returnflag").alias("name"), F.lit("regression").alias("task_type"),
        F.lit("flat_discount").alias("best_model"),
        F.create_map(F.lit("mae"), F.col("mae"), F.lit("rmse"), F.col("rmse")).alias("metrics"),
        F.create_map(F.lit("rate"), F.lit("0.99")).alias("config"),
        F.create_map(F.lit("rows"), F.col("n").cast("string")).alias("dataset_info"),
        F.array(F.lit("line"), F.col("l_returnflag")).alias("tags"))


def _log(spark, sf) -> RunLog:
    log = RunLog(spark, scratch_path(spark, "runs"))
    log.append(_runs(spark, sf))
    return log


@query("x01_log_run", f"SELECT id, name, model AS best_model, mae FROM ({RUN_SQL})")
def _(spark, sf):
    return _log(spark, sf).list().select("id", "name", "best_model", F.col("metrics")["mae"].alias("mae"))


@query("x02_list_runs", f"SELECT id, name, count(*) OVER () AS total FROM ({RUN_SQL})")
def _(spark, sf):
    log = _log(spark, sf)
    return log.list().select("id", "name", F.lit(log.count()).cast("long").alias("total"))


@query("x03_get_run", f"SELECT id, name, rmse FROM ({RUN_SQL}) WHERE name = 'run_R'")
def _(spark, sf):
    log = _log(spark, sf)
    wanted = log.list().filter("name = 'run_R'").first()["id"]
    return log.get(wanted).select("id", "name", F.col("metrics")["rmse"].alias("rmse"))


@query("x04_clear_runs", f"SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM ({RUN_SQL})")
def _(spark, sf):
    log = _log(spark, sf)
    before = log.count()
    log.clear()
    return log.list().agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"))


@query("x05_compare_runs", RUN_SQL)
def _(spark, sf):
    return compare(_runs(spark, sf))



# -- optima: slopes of the objective at the fitted model, which must vanish --------------------

def _slopes(rows: DataFrame, problem: Problem, model, slope, l2, digits: int = 3) -> DataFrame:
    """Derivative of the mean loss plus penalty by each coefficient, in units of its column's deviation.

    Worked out from the rows by column expressions, apart from the search that found the model.
    """
    coef, base = model.state["coef"][0], model.state["intercept"][0]
    margin = F.lit(float(base))
    for c, b in zip(problem.features, coef):
        margin = margin + F.col(c) * F.lit(float(b))
    s = slope(margin, F.col("label"))
    row = rows.agg(F.count("*").alias("n"), F.avg(s).alias("base"), *[
        f.alias(f"{k}{i}") for i, c in enumerate(problem.features)
        for k, f in (("g", F.avg(s * F.col(c))), ("m", F.avg(c)), ("d", F.stddev_pop(c)))]).first()
    out = [("intercept", float(row["base"]))]
    for i, (c, b) in enumerate(zip(problem.features, coef)):
        # the search is centred: the part along the intercept is taken out
        out.append((c, float((row[f"g{i}"] - row[f"m{i}"] * row["base"] + l2(row["n"]) * b) / row[f"d{i}"])))
    return rows.sparkSession.createDataFrame(out, "coefficient string, slope double").withColumn("slope", r(F.col("slope"), digits))


FLAT_SQL = f"SELECT unnest(['intercept', {', '.join(repr(c) for c in NET_FEATURES)}]) AS coefficient, CAST(0 AS DOUBLE) AS slope"


@query("m01_logistic_regression_optimum", FLAT_SQL)
def _(spark, sf):
    rows, problem = big_rows(spark, sf)
    model = find("classification", "Logistic Regression").fit(rows, problem, {"C": 1})
    return _slopes(rows, problem, model, lambda m, y: 1 / (1 + F.exp(-m)) - y, lambda n: 1.0 / n)


@query("m14_sgd_log_loss_optimum", FLAT_SQL)
def _(spark, sf):
    rows, problem = big_rows(spark, sf)
    model = find("classification", "SGD Classifier").fit(rows, problem, {"alpha": 0.001, "loss": "log_loss"})
    return _slopes(rows, problem, model, lambda m, y: 1 / (1 + F.exp(-m)) - y, lambda n: 0.001)


@query("m14_sgd_hinge_optimum", FLAT_SQL)
def _(spark, sf):
    rows, problem = big_rows(spark, sf)
    model = find("classification", "SGD Classifier").fit(rows, problem, {"alpha": 0.001, "loss": "hinge"})

    def slope(m, y):
        side = 2 * y - 1
        return -side * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - side * m) / HINGE_ROUNDING))

    return _slopes(rows, problem, model, slope, lambda n: 0.001)


@query("m30_sgd_huber_optimum", FLAT_SQL)
def _(spark, sf):
    rows, problem = net_rows(spark, sf)
    model = find("regression", "SGD Regressor").fit(rows, problem, {"alpha": 0.001, "loss": "huber"})
    return _slopes(rows, problem, model, lambda m, y: F.greatest(F.lit(-0.1), F.least(F.lit(0.1), m - y)), lambda n: 0.001, 2)


# -- trees: the first split, from all thresholds ------------------------------------------------

SPLIT_FEATURES = ["discount", "tax"]


def _first_split(rows: DataFrame, task: str) -> DataFrame:
    """Rows and mean label on both sides of the split of a tree of depth one."""
    problem = Problem(SPLIT_FEATURES, task, n_classes=2 if task == "classification" else 0)
    tree = find(task, "Decision Tree").fit(rows, problem, {"max_depth": 1, "min_samples_split": 5}).state["trees"][0]
    name = SPLIT_FEATURES[tree["feature"][0]]
    return rows.groupBy((F.col(name) <= F.lit(tree["threshold"][0])).alias("low")).agg(
        F.count("*").alias("n"), r(F.avg("label")).alias("mean")).select(F.lit(name).alias("feature"), "low", "n", "mean")


def first_split_sql(label: str) -> str:
    """For every value of a column: the drop of the squared error (for 0 and 1 half of gini's) if it ends the left side."""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS place, {c} AS edge, count(*)::DOUBLE AS n, sum(y) AS s FROM rows_ GROUP BY {c}" for i, c in enumerate(SPLIT_FEATURES))
    return f"""WITH rows_ AS (SELECT discount, tax, {label}::DOUBLE AS y FROM ({NET_SQL})), cells AS ({parts}),
      sums AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER f AS tn, sum(s) OVER f AS ts FROM cells
        WINDOW w AS (PARTITION BY feature ORDER BY edge), f AS (PARTITION BY feature)),
      best AS (SELECT feature, edge FROM sums WHERE ln < tn ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, place, edge LIMIT 1)
      SELECT feature, (CASE feature WHEN 'discount' THEN discount ELSE tax END) <= edge AS low, count(*) AS n, {r4('avg(y)')} AS mean
      FROM rows_, best GROUP BY 1, 2"""


@query("m02_first_split", first_split_sql("((discount >= 0.05) <> (tax > 0.06))::INT"))
def _(spark, sf):
    # the library joins leaves that predict the same class, so the label follows the columns
    mark = (F.col("discount") >= 0.05) != (F.col("tax") > 0.06)
    return _first_split(net_prices(spark, sf).withColumn("label", mark.cast("double")), "classification")


@query("m21_first_split", first_split_sql("net"))
def _(spark, sf):
    return _first_split(net_rows(spark, sf)[0], "regression")
